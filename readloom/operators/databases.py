"""Sequence databases in one go: filtered or subsampled, numbered anew, cut into blocks, as ordered lines.

A line has a place (section, number, 0 or 1): versions, files, then each sequence by its new number, and a block's line
after the sequence that fills it. New numbers are running counts over ranges, blocks the fold of operators.blocks; the
lines are sorted in ranges too, so no task holds a database.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.blocks import greedy_blocks
from readloom.operators.reports import alarm, movie_parts
from readloom.operators.running import keep, place, release, totals_before, written
from readloom.operators.sampling import subsample, without_blacklisted

#: Fixed value: bases of a block of a filtered database.
BLOCK_BASES = 1 << 20
ORDER = ["section", "number", "after"]
SEQUENCE = ["seq_id", "header", "seq_len", "file_id", "offset", "data_len"]


class CoverageError(ValueError):
    """Fewer bases than the coverage asks for."""


@contextmanager
def alarmed(spark: SparkSession, path: str | None) -> Iterator[None]:
    """If what runs within fails, the error is written to path as an alarm, one JSON line, and raised again. Reading or writing must happen within: plans fail when they run."""
    try:
        yield
    except Exception as e:
        if path:
            spark.createDataFrame([(alarm(type(e).__name__, str(e).split("\n")[0]),)], "value string").coalesce(1).write.mode("overwrite").text(path)
        raise


def numbered(seqs: DataFrame) -> DataFrame:
    """seqs with their number from 0 in the order of seq_id, as a written table."""
    x = totals_before(place(seqs.select(*SEQUENCE).withColumn("one", F.lit(1).cast("long")), SEQUENCE), SEQUENCE, {"nth": "one"})
    return written(x.select(*SEQUENCE, "nth"), "numbered")


def database_lines(tables: Mapping[str, DataFrame], block_bases: int = BLOCK_BASES, last_block: bool = True) -> DataFrame:
    """(section, number, after, value): lines of a database in order of the first three. tables: versions, files, seqs as read_rdb() gives them.

    A block is full once it has block_bases. last_block has another one follow the sequences in any case, empty if the one before is full.
    """
    spark = tables["seqs"].sparkSession
    seqs = numbered(tables["seqs"])
    line = lambda *parts: F.concat_ws("\t", *[F.lit(p) if isinstance(p, str) and len(p) == 1 else F.col(p).cast("string") for p in parts]).alias("value")
    at = lambda section, number, after: [F.lit(section).alias("section"), number.cast("long").alias("number"), F.lit(after).alias("after")]
    out = []
    if "versions" in tables:
        out.append(tables["versions"].select(*at(0, F.lit(0), 0), line("V", "version")))
    if "files" in tables:
        out.append(tables["files"].select(*at(1, F.col("file_id"), 0), line("F", "file_id", "path", "format")))
    out.append(seqs.select(*at(2, F.col("nth"), 0), line("S", "nth", *SEQUENCE[1:])))
    blocks = greedy_blocks(seqs, "nth", "seq_len", block_bases).groupBy("block").agg(F.min("nth").alias("first"), (F.max("nth") + 1).alias("stop"), F.sum("seq_len").alias("bases"))
    blocks = keep(blocks)
    end = blocks.agg(F.max(F.struct("block", "stop", "bases")).alias("x")).first().x  # one row
    out.append(blocks.select(*at(2, F.col("stop") - 1, 1), line("B", "block", "first", "stop", "bases")))
    if last_block and (end is None or end.bases >= block_bases):
        block, stop = (end.block + 1, end.stop) if end else (0, 0)
        empty = spark.createDataFrame([(block, stop, stop, 0)], "block long, first long, stop long, bases long")
        out.append(empty.select(*at(2, F.col("stop"), 2), line("B", "block", "first", "stop", "bases")))
    return reduce(DataFrame.unionByName, out)


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """A folder of text files that hold the lines in order."""
    lines.orderBy(*order).select("value").write.text(path)


def filtered_database(tables: Mapping[str, DataFrame], blacklist: DataFrame, block_bases: int = BLOCK_BASES) -> DataFrame:
    """database_lines() without sequences whose header is in blacklist (header); blocks are cut anew, and there is always a last one."""
    return database_lines({**tables, "seqs": without_blacklisted(tables["seqs"], blacklist, "header")}, block_bases)


def molecule(header: str = "header") -> Column:
    """Movie and zmw of a header, the header itself if it has other parts than three."""
    p = movie_parts(F.col(header))
    return F.when(p.isNotNull(), F.concat_ws("/", p["movie"], p["zmw"])).otherwise(F.col(header))


def seeded(seed: int, header: str = "header") -> Column:
    """A place in a random order that only the seed and the header decide."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(header)), 256)


def subsampled_database(tables: Mapping[str, DataFrame], genome: int, coverage: float, seed: int = 0, whole_molecules: bool = False, block_bases: int = BLOCK_BASES, fail_low: bool = False) -> DataFrame:
    """database_lines() of sequences that come first in a seeded order until their bases reach genome * coverage; with whole_molecules all sequences of a molecule whose first one is reached. With fail_low too few bases are a CoverageError. The last block is left out if it is empty."""
    if genome <= 0 or coverage <= 0:
        raise ValueError("genome and coverage must be positive")
    seqs = tables["seqs"].withColumn("_name", molecule() if whole_molecules else F.col("header"))
    picked = written(subsample(seqs, "_name", "seq_len", genome, coverage, [seeded(seed)]).drop("_name"), "subsample")
    if fail_low:
        first = seqs.groupBy("_name").agg(F.min(F.struct(seeded(seed).alias("o"), "seq_len")).alias("f")).agg(F.coalesce(F.sum("f.seq_len"), F.lit(0))).first()[0]
        if first < int(genome * coverage):
            release(picked)
            raise CoverageError(f"not enough reads for the coverage (bases needed={int(genome * coverage):,} > actual={first:,})")
    return database_lines({**tables, "seqs": picked}, block_bases, last_block=False)
