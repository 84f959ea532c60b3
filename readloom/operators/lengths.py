"""Length statistics: Nx/Lx, nearest-rank percentiles, E-size, coverage cutoffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def length_counts(df: DataFrame, col: str) -> DataFrame:
    """(len, n, upto, rank): lengths from the largest with their counts, and bases and reads so far. Different lengths are few, so the ordered sum runs over counts, not rows."""
    order = W.orderBy(F.desc("len")).rowsBetween(W.unboundedPreceding, 0)
    c = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("long").alias("len")).agg(F.count("*").alias("n"))
    return c.select("len", "n", F.sum(F.col("len") * F.col("n")).over(order).alias("upto"), F.sum("n").over(order).alias("rank"))


def _reads_to(percent: str, total: str) -> Column:
    """Of a row of length_counts(): how many reads, from the largest, it takes to reach a percentage of the total that lies within the row. In whole numbers, and lengths of 0 add nothing."""
    missing = f"{percent} * {total} - 100 * (upto - len * n)"
    return F.expr(f"rank - n + greatest(1, CASE WHEN len > 0 THEN ({missing} + 100 * len - 1) div (100 * len) END)")


def nx_lx(df: DataFrame, col: str, percents: Sequence[int] = (50, 75, 90, 95, 100)) -> DataFrame:
    """(percent, nx, lx): the length at which the running sum from the largest reaches that share, and how many reads it takes."""
    c = length_counts(df, col)
    total = c.agg(F.max("upto").alias("total"))
    p = df.sparkSession.createDataFrame([(x,) for x in percents], "percent int")
    met = c.crossJoin(F.broadcast(total)).join(F.broadcast(p), F.expr("100 * upto >= percent * total"))
    lx = _reads_to("percent", "total")
    return met.groupBy("percent").agg(F.max(F.struct("len", lx.cast("long").alias("lx"))).alias("x")).select("percent", F.col("x.len").alias("nx"), F.col("x.lx").alias("lx"))


def percentile_desc(df: DataFrame, col: str, p: float) -> DataFrame:
    """(value): the element at int(n * (1 - p)) from the largest."""
    c = length_counts(df, col)
    n = c.agg(F.max("rank").alias("total"))
    at = F.least(F.floor(F.col("total") * F.lit(1 - p)), F.col("total") - 1)
    return c.crossJoin(F.broadcast(n)).where(F.col("rank") > at).agg(F.max("len").alias("value"))


def length_stats(df: DataFrame, col: str) -> DataFrame:
    """One row: number, total, mean, min, max, median (nearest rank), E-size; zeros if empty."""
    z = lambda x, t: F.coalesce(x, F.lit(0)).cast(t)
    n = F.col(col).cast("long")
    one = df.agg(F.count(col).alias("number"), z(F.sum(n), "long").alias("total"), z(F.avg(n), "double").alias("mean"), z(F.min(n), "long").alias("min"), z(F.max(n), "long").alias("max"), z(F.expr(f"try_divide(CAST(sum(CAST({col} AS DECIMAL(19, 0)) * CAST({col} AS DECIMAL(19, 0))) AS DOUBLE), sum(CAST({col} AS BIGINT)))"), "double").alias("esize"))
    return one.crossJoin(percentile_desc(df, col, 0.5).select(z(F.col("value"), "long").alias("median")))


def length_cutoff(df: DataFrame, col: str, genome: int, coverage: float, fail_low: bool = False) -> DataFrame:
    """(cutoff): the length where the running sum from the largest reaches genome * coverage, or else the smallest, or an error."""
    if genome <= 0 or coverage <= 0:
        raise ValueError("genome and coverage must be positive")
    target = -(-int(genome * coverage * 1000) // 1000)
    c = length_counts(df, col)
    met = F.max(F.when(F.col("upto") >= target, F.col("len")))
    other = F.raise_error(F.lit(f"not enough reads for a coverage of {coverage}")).cast("long") if fail_low else F.min("len")
    return c.agg(F.coalesce(met, other).alias("cutoff"))


def length_report(df: DataFrame, col: str, percents: Sequence[int] = (50, 95)) -> DataFrame:
    """One row: number, total, mean, median, p95 (both nearest rank from the largest), min, max, esize, and n and l of each percentage; zeros if empty."""
    c = length_counts(df, col)
    all_ = c.agg(F.max("upto").alias("total"), F.max("rank").alias("number"))
    x = c.crossJoin(F.broadcast(all_))  # one row
    at = lambda p: F.max(F.when(F.col("rank") > F.least(F.floor(F.col("number") * F.lit(1 - p)), F.col("number") - 1), F.col("len")))
    reached = lambda p: F.when(F.expr(f"100 * upto >= {p} * total"), F.struct("len", _reads_to(str(p), "total").cast("long").alias("l")))
    one = x.agg(
        F.max("number").alias("number"), F.max("total").alias("total"), F.expr("try_divide(CAST(max(total) AS DOUBLE), max(number))").alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"),
        F.min("len").alias("min"), F.max("len").alias("max"), F.expr("try_divide(CAST(sum(CAST(len AS DECIMAL(19, 0)) * CAST(len AS DECIMAL(19, 0)) * n) AS DOUBLE), max(total))").alias("esize"), *[F.max(reached(p)).alias(f"r{p}") for p in percents],
    )
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double" if name in ("mean", "esize") else "long").alias(name.split(".")[0])
    points = [F.coalesce(F.col(f"r{p}.{k}"), F.lit(0)).cast("long").alias(f"{name}{p}") for p in percents for k, name in (("len", "n"), ("l", "l"))]
    return one.select(*map(zero, ("number", "total", "mean", "median", "p95", "min", "max", "esize")), *points)


#: Names of the figures of an assembly.
ASSEMBLY = {"sum": "total", "mean": "mean", "median": "median", "max": "max", "N100": "n100", "L100": "l100", "N90": "n90", "L90": "l90", "N50": "n50", "L50": "l50", "esize": "esize"}


def assembly_stats(df: DataFrame, col: str) -> DataFrame:
    """One row of ASSEMBLY; mean and esize to whole bases."""
    r = length_report(df, col, (50, 90, 100))
    return r.select(*[(F.round(F.col(c)) if c in ("mean", "esize") else F.col(c)).alias(name) for name, c in ASSEMBLY.items()])


def assembly_table(stats: DataFrame) -> DataFrame:
    """(report): the row as lines of figure and name."""
    names = {"N100": "min (aka N100)", "L100": "number (aka L100)", "esize": "E-Size (aka expected size of contig for a random base)"}
    line = lambda k: F.format_string("%12.1f %s" if k in ("mean", "esize") else "%10d   %s", F.col(k), F.lit(names.get(k, k)))
    return stats.select(F.concat_ws("\n", F.lit("Assembly statistics"), *map(line, ASSEMBLY)).alias("report"))


def preassembly_stats(raw: DataFrame, preads: DataFrame, cutoff: int, genome: int) -> DataFrame:
    """raw, preads: pos and len. One row of 26 figures: of raw reads, of seeds (cutoff or longer) and of preads, yield and mean truncation by position, to two decimals."""
    r2 = lambda c: F.floor(c.cast("double") * 100 + 0.5) / 100

    def side(d: DataFrame, k: str) -> DataFrame:
        x = length_report(d, "len", (50,))
        return x.select(F.col("number").alias(f"{k}_reads"), F.col("total").alias(f"{k}_bases"), r2(F.col("mean")).alias(f"{k}_mean"), F.col("n50").alias(f"{k}_n50"), F.col("p95").alias(f"{k}_p95"), r2(F.col("total") / genome).alias(f"{k}_coverage"), r2(F.col("esize")).alias(f"{k}_esize"))

    cut = preads.select("pos", F.col("len").alias("p_len")).join(raw, "pos").agg(r2(F.coalesce(F.avg(F.col("len") - F.col("p_len")), F.lit(-1.0))).alias("preassembled_seed_truncation"))
    out = side(raw, "raw").crossJoin(side(raw.where(F.col("len") >= cutoff), "seed")).crossJoin(side(preads, "preassembled")).crossJoin(cut)  # one row each
    given = {"genome_length": F.lit(genome), "length_cutoff": F.lit(cutoff), "preassembled_yield": r2(F.expr("coalesce(try_divide(preassembled_bases, seed_bases), 0)")), "preassembled_seed_fragmentation": F.lit(1.0)}
    return out.withColumns(given)


def report_json(row: DataFrame) -> DataFrame:
    """(report): the row as JSON."""
    return row.select(F.to_json(F.struct("*")).alias("report"))
