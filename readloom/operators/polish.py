"""Splitting contigs with their reads: blocks of contigs, shards of blocks, and their files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.blocks import greedy_blocks, split_table
from readloom.operators.running import keep, place, totals_before, written


def unique_lengths(*tables: DataFrame) -> DataFrame:
    """(name, len) of all; a name that comes twice is an error."""
    x = reduce(DataFrame.unionByName, [t.select("name", "len") for t in tables]).groupBy("name").agg(F.max("len").alias("len"), F.count("*").alias("times"))
    once = F.when(F.col("times") > 1, F.raise_error(F.concat(F.lit("a name comes twice: "), F.col("name"))).cast("boolean")).otherwise(F.lit(True))
    return x.where(once).select("name", "len")


def contig_reads(pairs: DataFrame, blacklist: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """pairs: read, ctg, as often as they come; without contigs of the blacklist (name) and, if lengths (name, len) are given, those that have none."""
    if blacklist is not None:
        pairs = pairs.join(blacklist.select(F.col("name").alias("ctg")), "ctg", "left_anti")
    if lengths is not None:
        pairs = pairs.join(lengths.select(F.col("name").alias("ctg")), "ctg", "left_semi")
    return pairs.select("read", "ctg")


def contig_blocks(pairs: DataFrame, lengths: DataFrame, target: int) -> DataFrame:
    """(ctg, len, block): contigs with reads, by name; a block is full once it has the target's bases."""
    contigs = pairs.select("ctg").distinct().join(lengths.select(F.col("name").alias("ctg"), "len"), "ctg")
    ranked = keep(totals_before(place(contigs.withColumn("one", F.lit(1)), ["ctg"]), ["ctg"], {"nth": "one"}))
    blocks = greedy_blocks(ranked, "nth", "len", target).select("nth", "block")
    return ranked.join(blocks, "nth").select("ctg", "len", "block")


def block_shards(pairs: DataFrame, blocks: DataFrame, n_shards: int) -> DataFrame:
    """(block, reads, shard): contiguous shards of blocks with even numbers of reads."""
    reads = pairs.join(blocks.select("ctg", "block"), "ctg").groupBy("block").agg(F.count("*").alias("reads"))
    return split_table(reads, "block", "reads", n_shards)


#: Order of the lines within the files that split_files() and split_paf_files() give.
FILE_ORDER = ["ctg", "file_of_line", "block_of_line", "at"]


def _files(reads: DataFrame, counts: DataFrame, blocks: DataFrame, n_shards: int, shard: str, block: str, ids: str, paf: bool) -> DataFrame:
    none = {"ctg": F.lit(""), "file_of_line": F.lit(""), "block_of_line": F.lit(0).cast("long"), "at": F.lit(0).cast("long")}
    row = lambda file, value, **at: [file.alias("file"), *[at.get(k, c).alias(k) for k, c in none.items()], value.alias("value")]
    name = lambda prefix, number, kind: F.concat(F.lit(f"{prefix}."), F.col(number).cast("string"), F.lit(f".{kind}"))
    dealt = reads.join(blocks.select("ctg", "block"), "ctg")
    place_ = {"ctg": F.col("ctg"), "file_of_line": F.col("file"), "block_of_line": F.col("block_start"), "at": F.col("at")}
    kinds = [("reads", "read"), *([("paf", "value")] if paf else [])]
    # a line gives its rows for all kinds at once
    lines = dealt.select(F.explode(F.array(*[F.struct(*row(name(block, "block", kind), F.col(c), **place_)) for kind, c in kinds])).alias("x")).select("x.*")
    contigs = blocks.select(*row(name(block, "block", "ctg_id"), F.col("ctg"), ctg=F.col("ctg")))
    shards = written(split_table(counts.join(blocks.select("ctg", "block"), "ctg").groupBy("block").agg(F.sum("reads").alias("reads")), "block", "reads", n_shards), "shards")
    in_shard = shards.select(*row(name(shard, "shard", "block_ids"), F.col("block").cast("string"), at=F.col("block").cast("long")))
    listed = shards.select("shard").distinct().select(*row(F.lit(ids), F.col("shard").cast("string"), at=F.col("shard").cast("long")))
    return lines.unionByName(contigs).unionByName(in_shard).unionByName(listed)


def split_files(pairs: DataFrame, lengths: DataFrame, target: int, n_shards: int, blacklist: DataFrame | None = None, shard: str = "shard", block: str = "block", ids: str = "all_shard_ids") -> DataFrame:
    """(file, FILE_ORDER, value): lines of all files of a split. pairs: read, ctg, and file, block_start, at for their order; contigs without a length are passed over.

    Of each block its contigs and their reads, of each shard its blocks, and the list of shards.
    """
    reads = pairs.join(contig_reads(pairs, blacklist, lengths).select("ctg").distinct(), "ctg", "left_semi")
    counts = written(reads.groupBy("ctg").agg(F.count("*").alias("reads")), "contigs")
    blocks = written(contig_blocks(counts, lengths, target), "contig-blocks")
    return _files(reads, counts, blocks, n_shards, shard, block, ids, paf=False)


def split_paf_files(lines: DataFrame, lengths: DataFrame, target: int, n_shards: int, blacklist: DataFrame | None = None, shard: str = "shard", block: str = "block", ids: str = "all_shard_ids") -> DataFrame:
    """The same from PAF lines (sources.text.placed_lines()), and of each block its contigs' lines. A contig without a length is an error."""
    part = F.split("value", "\t")
    x = lines.where(F.trim("value") != "").select("file", F.col("block").alias("block_start"), "at", "value", F.get(part, F.lit(0)).alias("read"), F.get(part, F.lit(5)).alias("ctg"))
    x = x.withColumn("ctg", F.coalesce("ctg", F.raise_error(F.concat(F.lit("not a PAF line: "), F.col("value"))).cast("string")))
    if blacklist is not None:
        x = x.join(blacklist.select(F.col("name").alias("ctg")).distinct(), "ctg", "left_anti")
    known = x.groupBy("ctg").agg(F.count("*").alias("reads")).join(lengths.select(F.col("name").alias("ctg"), "len"), "ctg", "left")
    known = written(known.withColumn("len", F.coalesce("len", F.raise_error(F.concat(F.lit("no length of the contig "), F.col("ctg"))).cast("long"))), "contigs")
    blocks = written(contig_blocks(known, known.withColumnRenamed("ctg", "name"), target), "contig-blocks")
    return _files(x, known, blocks, n_shards, shard, block, ids, paf=True)


def write_parts(rows: DataFrame, part: str, line: str, path: str) -> None:
    """A folder of text files for each part."""
    rows.select(part, F.col(line).alias("value")).repartition(part).sortWithinPartitions(part, "value").write.partitionBy(part).text(path)
