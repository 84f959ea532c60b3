"""Readers and writers of the text formats. Each reads with Spark's text source and parses with expressions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom import schemas
from readloom.functions.sequence import wrap
from readloom.operators.overlaps import overlap_text
from readloom.sources.fastq import read_any_fastq


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.strip().split(" ", 1)) for x in schema.split(",")]


def _typed(parts: str, schema: str, strict: int) -> list[Column]:
    """Columns by place; a line with fewer fields is an error."""
    cell = lambda i: F.col(parts)[i]
    checked = F.when(F.size(parts) >= strict, cell(0)).otherwise(F.raise_error(F.concat(F.lit("too few fields: "), F.array_join(parts, " "))).cast("string"))
    out = []
    for i, (name, kind) in enumerate(_fields(schema)):
        c = checked if i == 0 else F.get(F.col(parts), F.lit(i))
        c = (c == "1") if kind == "boolean" else c.cast(kind)
        out.append(c.alias(name))
    return out


def placed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, value): lines with their place, in order of file, split, and number in the split."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def read_overlaps(spark: SparkSession, path: str | list[str], extra: bool = False) -> DataFrame:
    """Overlap lines: 12 fields or more between spaces, the 13th a tag; lines that start with - are trailers. With extra, tagplus has the tag and all after it."""
    lines = spark.read.text(path).where(~F.col("value").startswith("-") & (F.trim("value") != ""))
    more = [F.expr("array_join(slice(p, 13, greatest(size(p) - 12, 0)), ' ')").alias("tagplus")] if extra else []
    x = lines.select(F.split(F.trim("value"), " +").alias("p")).select(*_typed("p", schemas.OVERLAP, 12), *more)
    return x.withColumn("tag", F.coalesce("tag", F.lit("")))


def write_overlaps(ovl: DataFrame, path: str, trailer: bool = False) -> None:
    """Lines of overlaps; with a trailer, --- in a last file of its own."""
    ovl.select(overlap_text("tagplus" if "tagplus" in ovl.columns else "tag").alias("value")).write.text(path)
    if trailer:
        ovl.sparkSession.range(1, numPartitions=1).select(F.lit("---").alias("value")).write.mode("append").text(path)


def write_pile_index(index: DataFrame, path: str) -> None:
    """Lines 0000, number of lines, where they start, bytes, in order."""
    line = F.concat_ws(" ", F.lit("0000"), *[F.col(c).cast("string") for c in ("n", "pos", "bytes")])
    index.orderBy("pos").select(line.alias("value")).write.text(path)


def read_pile_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(n, pos, bytes) of each pile; the first field is passed over."""
    p = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), " +").alias("p"))
    return p.select(*_typed("p", "skipped string, n bigint, pos bigint, bytes bigint", 4)).drop("skipped")


def listed_files(spark: SparkSession, path: str) -> list[str]:
    """Paths from a file of names, or from a JSON list; relative ones are taken from the list's folder."""
    if path.endswith(".json"):
        names = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    else:
        names = [r.value.strip() for r in spark.read.text(path).collect() if r.value.strip()]
    folder = path.rpartition("/")[0]
    return [n if n.startswith("/") or "://" in n or not folder else f"{folder}/{n}" for n in names]


def found_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(path) of files below a folder whose names match; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")


def read_lengths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, len) of a FASTA index: five fields between tabs."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.split("value", "\t").alias("p")).select(*_typed("p", "name string, len bigint", 5))


def read_read_contigs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Distinct (rid, ctg) of lines pid, rid, oid, ctg between spaces; other numbers of fields are an error."""
    p = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), " +").alias("p"))
    four = F.when(F.size("p") == 4, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("not four fields: "), F.array_join("p", " "))).cast("array<string>"))
    return p.select(four.alias("p")).select(F.col("p")[1].alias("rid"), F.col("p")[3].alias("ctg")).distinct()


def read_phases(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(oid, ctg, block, phase) of lines between spaces, fields 6, 1, 2 and 3 from 0; of one oid the last line counts, of several files the last by name."""
    p = placed_lines(spark, path).where(F.trim("value") != "").select(F.split(F.trim("value"), " +").alias("p"), F.struct("file", "block", "at").alias("at"))
    x = p.select(*_typed("p", "a string, ctg string, block int, phase int, b string, c string, oid string", 7), "at")
    return x.groupBy("oid").agg(F.max_by(F.struct("ctg", "block", "phase"), "at").alias("x")).select("oid", "x.*")


def write_phases(phased: DataFrame, path: str) -> None:
    """phased: v, label, phase, freq, name. Lines between tabs; reads without a phase have -1 for numbers."""
    none = F.col("phase") == -1
    number = lambda c: F.when(none, -1).otherwise(F.col(c)).cast("string")
    phased.select(F.concat_ws("\t", number("v"), number("label"), number("phase"), F.col("freq").cast("string"), "name").alias("value")).write.text(path)


def read_paf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return paf_lines(spark.read.text(path))


def paf_lines(lines: DataFrame) -> DataFrame:
    """lines: value. Their columns; empty lines are skipped."""
    return lines.where(F.trim("value") != "").select(F.split("value", "\t").alias("p")).select(*_typed("p", schemas.PAF, 12))


def write_paf(paf: DataFrame, path: str) -> None:
    paf.select(F.concat_ws("\t", *[F.col(n).cast("string") for n, _ in _fields(schemas.PAF)]).alias("value")).write.text(path)


def read_gff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Nine fields between tabs, or else spaces; comments are skipped."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.when(F.size(F.split("value", "\t")) >= 9, F.split("value", "\t")).otherwise(F.split("value", " +"))
    return lines.select(parts.alias("p")).select(*_typed("p", schemas.GFF, 9))


def gff_coverage(gff: DataFrame) -> DataFrame:
    """(seq, start (from 0), end, strand, cov_min, cov_median, cov_max, cov_mean, cov_sd, n_gaps, tot_gaps) from the attributes."""
    number = lambda key, i: F.split(F.regexp_extract("attrs", rf"(?:^|;){key}=([^;]*)", 1), ",")[i].cast("double")
    names = [("cov_min", "cov", 0), ("cov_median", "cov", 1), ("cov_max", "cov", 2), ("cov_mean", "cov2", 0), ("cov_sd", "cov2", 1), ("n_gaps", "gaps", 0), ("tot_gaps", "gaps", 1)]
    return gff.select("seq", (F.col("start") - 1).alias("start"), "end", "strand", *[number(k, i).alias(n) for n, k, i in names])


def read_sam(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(records with 0-based pos, targets (rname, ref_len))."""
    lines = spark.read.text(path)
    tag = lambda k: F.regexp_extract("value", rf"\t{k}:([^\t]+)", 1)
    targets = lines.where(F.col("value").startswith("@SQ")).select(tag("SN").alias("rname"), tag("LN").cast("int").alias("ref_len"))
    p = lines.where(~F.col("value").startswith("@") & (F.trim("value") != "")).select(F.split("value", "\t").alias("p"))
    head = _typed("p", schemas.SAM.rsplit(",", 1)[0], 11)
    x = p.select(*head, F.expr("slice(p, 12, greatest(size(p) - 11, 0))").alias("tags"))
    nm = F.regexp_extract(F.array_join("tags", "\t"), r"(?:^|\t)NM:i:(\d+)", 1)
    return x.withColumns({"pos": F.col("pos") - 1, "seq_len": F.length("seq"), "nm": F.nullif(nm, F.lit("")).cast("int")}), targets


def read_rdb(spark: SparkSession, path: str | list[str]) -> dict[str, DataFrame]:
    """Frames versions, files, seqs and blocks of a database file, by the letter of a line; other letters are skipped."""
    p = spark.read.text(path).select(F.split("value", "\t").alias("p"))
    kinds = {"versions": ("V", "version string"), "files": ("F", "file_id bigint, path string, format string"), "seqs": ("S", "seq_id bigint, header string, seq_len bigint, file_id bigint, offset bigint, data_len bigint"), "blocks": ("B", "block_id bigint, seq_id_start bigint, seq_id_end bigint, num_bases bigint")}
    return {k: p.where(F.col("p")[0] == letter).select(*_typed("p", "letter string, " + s, len(_fields(s)) + 1)).drop("letter") for k, (letter, s) in kinds.items()}


def write_rdb(tables: dict[str, DataFrame], path: str) -> None:
    """Lines of a database in order: versions, files, sequences, blocks; without any row nothing is written but an empty file."""
    kinds = {"versions": ("V", ["version"]), "files": ("F", ["file_id", "path", "format"]), "seqs": ("S", ["seq_id", "header", "seq_len", "file_id", "offset", "data_len"]), "blocks": ("B", ["block_id", "seq_id_start", "seq_id_end", "num_bases"])}
    lines = [tables[k].select(F.lit(i).alias("k"), F.lit(0).cast("long").alias("o") if k == "versions" else F.col(cols[0]).cast("long").alias("o"), F.concat_ws("\t", F.lit(letter), *[F.col(c).cast("string") for c in cols]).alias("value")) for i, (k, (letter, cols)) in enumerate(kinds.items()) if k in tables]
    reduce(DataFrame.union, lines).orderBy("k", "o").select("value").write.text(path)


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, seq) of each record; the reader splits files at record starts."""
    x = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "^>", "")
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\\n', 1)) + 1)"), r"\s", "")
    return x.select(F.regexp_extract(head, r"^(\S*)", 1).alias("name"), body.alias("seq"))


def write_fasta(seqs: DataFrame, path: str, width: int = 80) -> None:
    seqs.select(F.concat(F.lit(">"), _title(seqs), F.lit("\n"), wrap(F.col("seq"), width)).alias("value")).write.text(path)


def _title(seqs: DataFrame) -> Column:
    return F.col("header" if "header" in seqs.columns else "name")


def write_fastq(seqs: DataFrame, path: str, width: int = 80) -> None:
    seqs.select(F.concat(F.lit("@"), _title(seqs), F.lit("\n"), wrap(F.col("seq"), width), F.lit("\n+\n"), wrap(F.col("qual"), width)).alias("value")).write.text(path)


def _fastq_records(frames):  # noqa: ANN001, ANN202
    """Records of whole files: sequence lines up to +, then qualities until they are as long."""
    import pandas as pd

    for frame in frames:
        out = []
        for value in frame["value"]:
            lines = iter(value.splitlines())
            for head in lines:
                if not head.strip():
                    continue
                seq = qual = ""
                for line in lines:
                    if line.startswith("+"):
                        break
                    seq += line.strip()
                while len(qual) < len(seq):
                    qual += next(lines, None) or _cut_short(head)
                if len(qual) != len(seq) or not head.startswith("@"):
                    _cut_short(head)
                out.append((head[1:].split(" ")[0], seq, qual))
        yield pd.DataFrame(out, columns=["name", "seq", "qual"])


def _cut_short(head: str) -> str:
    raise ValueError(f"sequence and qualities differ in length: {head}")


def read_fastq(spark: SparkSession, path: str | list[str], four_lines: bool = False, whole_files: bool = False) -> DataFrame:
    """(name, seq, qual); lengths that differ are an error. Records of any number of lines are read from any part of a file
    (readloom.sources.fastq); records of four lines each, as instruments write them, with less work; compressed or small
    files also whole."""
    if four_lines:
        return _four_lines(spark, path)
    if whole_files:
        return spark.read.text(path, wholetext=True).mapInPandas(_fastq_records, schemas.SEQUENCE)
    return read_any_fastq(spark, path)


def _four_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines are numbered within the splits of a file, and splits by the lines before them."""
    at = W.partitionBy("file", "split").orderBy("id")
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    lines = lines.withColumn("n", F.row_number().over(at) - 1)
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)  # a row a split
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("lines")).withColumn("from", F.coalesce(F.sum("lines").over(before), F.lit(0))).select("file", "split", "from")
    numbered = lines.join(F.broadcast(splits), ["file", "split"]).withColumn("n", F.col("from") + F.col("n"))
    line = lambda k: F.max(F.when(F.col("n") % 4 == k, F.rtrim("value")))
    x = numbered.groupBy("file", F.expr("n div 4").alias("record")).agg(*[line(k).alias(c) for k, c in enumerate(("head", "seq", "plus", "qual"))]).where("NOT (head = '' AND seq IS NULL)")
    whole = F.expr("head LIKE '@%' AND plus LIKE '+%' AND length(seq) = length(qual)")
    name = F.when(whole, F.substring_index(F.expr("substring(head, 2)"), " ", 1)).otherwise(F.raise_error(F.concat(F.lit("not a record of four lines: "), F.coalesce("head", F.lit("")))).cast("string"))
    return x.select(name.alias("name"), "seq", "qual")


def read_names(spark: SparkSession, path: str | None, col: str = "name") -> DataFrame | None:
    """Distinct lines; no path means no list."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim("value").alias(col)).distinct() if path else None
