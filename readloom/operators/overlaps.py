"""Pairwise read overlaps: predicates, coverage, read flags, best-N. A frame of overlaps has the columns of schemas.OVERLAP."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.operators.running import place, totals_before, value_before

#: Bits of a read's flags.
CONTAINED, SHORT, LOW, HIGH, UNEVEN, GAP = 1, 2, 8, 16, 32, 64
FLAG_NAMES = {"contained": CONTAINED, "short": SHORT, "low": LOW, "high": HIGH, "uneven": UNEVEN, "gap": GAP}
#: Coverage looks at overlaps of this identity or more, and clipping this close to a dip counts.
PROFILE_IDENTITY, NEAR = 95.0, 500


def low_identity(least: float) -> Column:
    return F.col("idt") < least


def short_a(least: int) -> Column:
    return F.col("a_len") < least


def fraction_outside(low: float, high: float) -> Column:
    """Whether either read's aligned percentage is outside; a read without length has none."""
    outside = lambda k: F.expr(f"try_divide(100.0 * ({k}_end - {k}_start), {k}_len)")
    return F.coalesce((outside("a") < low) | (outside("a") > high), F.lit(False)) | F.coalesce((outside("b") < low) | (outside("b") > high), F.lit(False))


def missing_terminus() -> Column:
    return F.expr("(a_start != 0 AND a_end != a_len) OR (b_start != 0 AND b_end != b_len)")


def is_contained() -> Column:
    return F.col("tag").isin("contained", "c")


def is_contains() -> Column:
    return F.col("tag").isin("contains", "C")


def enough_overhang(least: int) -> Column:
    """False only for 5' and 3' dovetails that hang over by less than `least` on both sides."""
    left_b, right_b = "if(b_rev, b_len - b_end, b_start)", "if(b_rev, b_start, b_len - b_end)"
    hang_a, hang_b = f"(a_start - {left_b})", f"({right_b} - (a_len - a_end))"
    inside = f"((a_start <= 0 AND a_len - a_end <= 0) OR ({left_b} <= 0 AND {right_b} <= 0))"
    dovetail = f"((a_start <= 0 AND {right_b} <= 0) OR (a_len - a_end <= 0 AND {left_b} <= 0))"
    close = f"(({hang_a} >= 0 AND {hang_b} >= 0 AND {hang_a} < {least} AND {hang_b} < {least}) OR ({hang_a} <= 0 AND {hang_b} <= 0 AND {hang_a} > -{least} AND {hang_b} > -{least}))"
    return F.expr(f"NOT (NOT {inside} AND {dovetail} AND {close})")


def contained_filter(ovl: DataFrame, min_len: int = 400, min_idt: float = 96.0) -> DataFrame:
    """Overlaps between reads that no other read contains."""
    base = ovl.where((F.col("a_name") != F.col("b_name")) & ~F.col("tag").isin("none", "?") & (F.col("idt") >= min_idt) & (F.col("a_len") >= min_len) & (F.col("b_len") >= min_len))
    inner = base.where(is_contained()).select(F.col("a_name").alias("name")).union(base.where(is_contains()).select("b_name")).distinct()
    for side in ("a_name", "b_name"):
        base = base.join(inner.withColumnRenamed("name", side), side, "left_anti")
    return base


def coverage_profile(ovl: DataFrame) -> DataFrame:
    """(a_name, pos, cov, cco, cli): depth of all, of other than local, and of clipped overlaps at each end point."""
    events = ovl.where(F.col("idt") >= PROFILE_IDENTITY).select("a_name", F.expr(
        "inline(array(struct(a_start AS pos, 1 AS d, if(tag = 'u', 0, 1) AS k, if(b_start != 0 AND b_end != b_len, 1, 0) AS x), struct(a_end AS pos, -1 AS d, if(tag = 'u', 0, -1) AS k, -1 AS x)))"
    ))
    at = events.groupBy("a_name", "pos").agg(*[F.sum(c).alias(c) for c in "dkx"])
    upto = W.partitionBy("a_name").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return at.select("a_name", "pos", F.sum("d").over(upto).alias("cov"), F.sum("k").over(upto).alias("cco"), F.greatest(F.lit(0), F.sum("x").over(upto)).alias("cli"))


def gap_in_coverage(ovl: DataFrame, min_depth: int, min_avg: float = 0.0) -> DataFrame:
    """(a_name, gap): whether the read looks like two reads in one."""
    order = W.partitionBy("a_name").orderBy("pos")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    x = coverage_profile(ovl).withColumns({"i": F.row_number().over(order) - 1, "n": F.count("*").over(W.partitionBy("a_name"))})
    ok = F.col("cco") >= min_depth
    x = x.withColumns({
        "oi": F.max(F.when(ok, F.col("i"))).over(before), "op": F.max(F.when(ok, F.col("pos"))).over(before),
        "z": F.coalesce(F.max(F.when(F.col("cco") == 0, F.col("pos"))).over(upto), F.lit(-1)),
        "area": F.when((F.col("i") > 0) & (F.col("i") < F.col("n") - 1), (F.col("pos") - F.lag("pos").over(order)) * F.lag("cco").over(order)).otherwise(0),
    })
    x = x.withColumn("dip", ok & F.coalesce((F.col("oi") != 0) & (F.col("i") - F.col("oi") > 1), F.lit(False)))
    per = x.groupBy("a_name").agg(
        F.sum("area").alias("area"), F.max(F.col("dip") & (F.col("op") < F.col("z")) & (F.col("z") < F.col("pos"))).alias("zero_dip"),
        F.collect_list(F.when(F.col("dip"), F.array("pos", "op"))).alias("dips"), F.collect_list(F.when(F.expr("cco - cli < 5 AND cli > 2"), F.col("pos"))).alias("clips"),
    )
    near = F.exists(F.flatten("dips"), lambda d: F.exists("clips", lambda c: F.abs(c - d) < NEAR))
    lens = ovl.groupBy("a_name").agg(F.max("a_len").alias("a_len"))
    out = lens.join(per, "a_name", "left")
    return out.select("a_name", F.coalesce((F.try_divide(F.coalesce("area", F.lit(0)), F.col("a_len")) >= min_avg) & (F.col("zero_dip") | near), F.lit(False)).alias("gap"))


def average_coverage(ovl: DataFrame) -> DataFrame:
    """(a_name, avg_cov) over the whole read, all tags."""
    order = W.partitionBy("a_name").orderBy("pos")
    area = (F.col("pos") - F.lag("pos", 1, 0).over(order)) * F.lag("cov", 1, 0).over(order)
    per = coverage_profile(ovl).withColumn("area", area).groupBy("a_name").agg(F.sum("area").alias("area"))
    return ovl.groupBy("a_name").agg(F.max("a_len").alias("a_len")).join(per, "a_name", "left").select("a_name", F.try_divide(F.coalesce("area", F.lit(0)), F.col("a_len")).alias("avg_cov"))


def stage1_flags(ovl: DataFrame, max_diff: int = 100, max_cov: int = 200, min_cov: int = 2, min_len: int = 6000, min_idt: float = 95.0, gap_filter: bool = False, min_depth: int = 2, min_avg: float = 0.0, sample_rate: float | None = None, name_hash: Column | None = None) -> DataFrame:
    """(name, flags). With a sample rate, reads of uniformly high coverage are kept by the hash of their name at about rate * max_cov / coverage."""
    clean = (F.col("tag") != "u") & (F.col("idt") >= min_idt)
    short_a_, short_b = F.col("a_len") < min_len, F.col("b_len") < min_len
    use = clean & ~short_a_ & ~short_b
    per = ovl.groupBy("a_name").agg(F.count_if(use & (F.col("a_start") == 0)).alias("five"), F.count_if(use & (F.col("a_end") == F.col("a_len"))).alias("three"), F.max(clean & short_a_).alias("short"))
    low, high = F.least("five", "three"), F.greatest("five", "three")
    when = lambda c, bit: F.when(c, bit).otherwise(0)
    if sample_rate is None:
        flags = when(high - low > max_diff, UNEVEN).bitwiseOR(when(high > max_cov, HIGH))
    else:
        per = per.join(average_coverage(ovl), "a_name")
        spared = F.lit(False) if sample_rate <= 0 else (high < 1.5 * F.col("avg_cov")) & (F.expr("avg_cov") > 0) & (F.pmod(name_hash if name_hash is not None else F.xxhash64("a_name"), F.greatest(F.lit(1), F.ceil(F.col("avg_cov") / sample_rate))) < max_cov)
        flags = when(~spared & (high > max_cov), HIGH).bitwiseOR(when(~spared & (high - low > max_diff), UNEVEN))
    per = per.withColumn("flags", flags.bitwiseOR(when(low < min_cov, LOW)))
    good = per.where("flags = 0").select(F.col("a_name").alias("container"))
    of_b = ovl.where(clean & (short_b | (use & is_contains()))).select("a_name", "b_name", when(short_b, SHORT).alias("short"), is_contains().alias("contains"))
    inner = of_b.join(good, (F.col("a_name") == F.col("container")) & F.col("contains") & (F.col("short") == 0), "left")
    found = [
        per.select(F.col("a_name").alias("name"), F.col("flags").bitwiseOR(when(F.col("short"), SHORT)).alias("flags")).where("flags > 0"),
        inner.select("b_name", F.col("short").bitwiseOR(when(F.col("container").isNotNull(), CONTAINED)).alias("flags")).where("flags > 0"),
    ]
    if gap_filter:
        found.append(gap_in_coverage(ovl, min_depth, min_avg).where("gap").select("a_name", F.lit(GAP)))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return merge_flags(out)


def merge_flags(flags: DataFrame) -> DataFrame:
    return flags.groupBy("name").agg(F.bit_or("flags").alias("flags"))


def flag_report(flags: DataFrame) -> DataFrame:
    """(flag, n): flagged reads, and reads with each flag."""
    one = flags.agg(F.count("*").alias("flagged"), *[F.count_if(F.col("flags").bitwiseAND(b) > 0).alias(k) for k, b in FLAG_NAMES.items()])
    return one.select(F.expr(f"stack({1 + len(FLAG_NAMES)}, " + ", ".join(f"'{k}', {k}" for k in ("flagged", *FLAG_NAMES)) + ") AS (flag, n)"))


def stage2_best(ovl: DataFrame, flags: DataFrame | None = None, min_idt: float = 90.0, best_n: int = 10, min_overhang: int = 0) -> DataFrame:
    """Overlaps of unflagged reads, on each side of a read the best by score and what B leaves over; goes on to the first with more than 1,000 left after best_n."""
    x = ovl.where((F.col("idt") >= min_idt) & (F.col("tag") != "u"))
    x = x.where(enough_overhang(min_overhang)) if min_overhang > 0 else x
    if flags is not None:
        for side in ("a_name", "b_name"):
            x = x.join(flags.select(F.col("name").alias(side)), side, "left_anti")
    x = x.withColumn("side", F.when(F.col("a_start") == 0, 5).when(F.col("a_end") == F.col("a_len"), 3)).where("side IS NOT NULL").withColumn("m_range", F.expr("b_len - (b_end - b_start)"))
    side = W.partitionBy("a_name", "side")
    x = x.withColumn("rn", F.row_number().over(side.orderBy("score", "m_range", *[c for c in ovl.columns if c not in ("a_name", "score")])) - 1)
    x = x.withColumn("cut", F.min(F.when((F.col("rn") >= best_n) & (F.col("m_range") > 1000), F.col("rn"))).over(side))
    return x.where("cut IS NULL OR rn <= cut").select(*ovl.columns)


def filter_overlaps(ovl: DataFrame, idt1: float = 90.0, idt2: float = 90.0, min_len: int = 6000, min_cov: int = 2, max_cov: int = 200, max_diff: int = 100, sample_rate: float | None = 1.0, best_n: int = 10, min_overhang: int = 0, min_depth: int = 2, min_avg: float = 0.0, gap_filter: bool = False, name_hash: Column | None = None) -> DataFrame:
    """Both stages."""
    flags = stage1_flags(ovl, max_diff, max_cov, min_cov, min_len, idt1, gap_filter, min_depth if gap_filter else 0, min_avg, sample_rate, name_hash)
    return stage2_best(ovl, flags, idt2, best_n, min_overhang)


def pile_index(lines: DataFrame, order: list[str]) -> DataFrame:
    """lines: a_name, line and the columns of the order. (first_ord, a_name, n, pos, bytes) of each run of one A read, as in a text file of these lines in that order; lines count from 1."""
    placed = place(lines.select(*order, F.col("a_name").alias("pile"), (F.octet_length("line") + 1).alias("bytes"), F.lit(1).alias("one")), order)
    x = value_before(placed, order, "pile", "prior").withColumn("new", (~F.col("prior").eqNullSafe(F.col("pile"))).cast("int"))
    x = totals_before(x, order, {"earlier": "new", "pos": "bytes", "ord": "one"}).withColumn("run", F.col("earlier") + F.col("new"))
    runs = x.groupBy("run", F.col("pile").alias("a_name")).agg((F.min("ord") + 1).alias("first_ord"), F.count("*").alias("n"), F.min("pos").alias("pos"), F.sum("bytes").alias("bytes"))
    return runs.select("first_ord", "a_name", "n", "pos", "bytes")


def index_text() -> Column:
    """A line of a pile index: read, number of lines, where they start, bytes."""
    return F.concat_ws(" ", "a_name", *[F.col(c).cast("string") for c in ("n", "pos", "bytes")])


def overlap_text(tag: str = "tag") -> Column:
    """A line of an overlap file."""
    return F.format_string("%s %s %d %.3f %d %d %d %d %d %d %d %d %s", "a_name", "b_name", "score", "idt", F.col("a_rev").cast("int"), "a_start", "a_end", "a_len", F.col("b_rev").cast("int"), "b_start", "b_end", "b_len", tag)


def coverage_stats(ovl: DataFrame) -> DataFrame:
    """One row over the 5' and 3' counts of all piles; zeros if there are none."""
    per = ovl.groupBy("a_name").agg(F.count_if(F.col("a_start") == 0).alias("five"), F.count_if(F.col("a_end") == F.col("a_len")).alias("three"))
    c = per.select(F.expr("stack(2, five, three) AS (c)"))
    z = lambda x: F.coalesce(x, F.lit(0))
    return c.agg(z(F.avg("c")).alias("mean"), z(F.stddev_pop("c")).alias("std"), z(F.median("c")).alias("median"), z(F.min("c")).alias("min"), z(F.max("c")).alias("max"), F.count("*").alias("n"))
