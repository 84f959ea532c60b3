"""Genomic intervals: binned overlap joins, subtraction, coverage summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.operators.joins import BLOCK, block_join
from readloom.operators.running import written


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, block: int = BLOCK) -> DataFrame:
    """Pairs with equal keys and overlapping closed intervals; left has start and end, right r_start and r_end.

    Both sides are dealt into bins; a pair counts in the first bin that both reach, so it comes up once. Deep bins are joined in blocks.
    """
    binned = lambda d, a, b: d.withColumn("bin", F.explode(F.expr(f"sequence({a} div {width}, {b} div {width})")))
    own = [[c for c in side.columns if c not in keys] for side in (left, right)]
    x = block_join(binned(left.where("start <= end"), "start", "end"), binned(right.where("r_start <= r_end"), "r_start", "r_end"), [*keys, "bin"], *own, block)
    return x.where(f"start <= r_end AND r_start <= end AND bin = greatest(start, r_start) div {width}").drop("bin")


def _neighbours(masks: DataFrame, points: DataFrame, width: int, merged: bool) -> DataFrame:
    """masks: seq, r_start (once each), r_end; points: seq, x, different. (seq, x, prev_start, prev_end, next): of the last mask that begins at x or before, and where the first one after x begins. If merged, prev_end is the furthest end of all that begin at x or before."""
    mask = F.struct("r_start", "r_end")
    none = F.lit(None).cast("struct<r_start:bigint,r_end:bigint>")
    both = masks.select("seq", F.col("r_start").alias("x"), mask.alias("m"), F.lit(0).alias("asked")).union(points.select("seq", F.col("x").cast("long").alias("x"), none.alias("m"), F.lit(1).alias("asked")))
    both = both.withColumn("bin", F.expr(f"x div {width}"))
    # within a bin, and from the bins before and after it: a row a bin
    here, over = W.partitionBy("seq", "bin"), W.partitionBy("seq").orderBy("bin")
    up = here.orderBy("x", "asked").rowsBetween(W.unboundedPreceding, 0)
    down = here.orderBy(F.desc("x"), F.desc("asked")).rowsBetween(W.unboundedPreceding, 0)
    near = both.select("seq", "bin", "x", "asked", F.last("m", True).over(up).alias("prev"), F.max("m.r_end").over(up).alias("far"), F.last("m.r_start", True).over(down).alias("next")).where("asked = 1")
    bins = both.groupBy("seq", "bin").agg(F.max("m").alias("m"), F.max("m.r_end").alias("far"), F.min("m.r_start").alias("low"))
    earlier, later = over.rowsBetween(W.unboundedPreceding, -1), over.rowsBetween(1, W.unboundedFollowing)
    bins = bins.select("seq", "bin", F.last("m", True).over(earlier).alias("bin_prev"), F.max("far").over(earlier).alias("bin_far"), F.first("low", True).over(later).alias("bin_next"))
    x = near.join(bins, ["seq", "bin"]).withColumn("prev", F.coalesce("prev", "bin_prev"))
    end = F.greatest("far", "bin_far") if merged else F.col("prev.r_end")
    return x.select("seq", "x", F.col("prev.r_start").alias("prev_start"), end.alias("prev_end"), F.coalesce("next", "bin_next").alias("next"))


def subtract(rows: DataFrame, masks: DataFrame, width: int = 10_000, merged: bool = False) -> DataFrame:
    """(id, seq, start, end): what masks leave of rows, 1-based and inclusive; rows of a sequence without masks are dropped. Rows that repeat are rows of their own.

    Each gap is taken from the previous mask's end, so a mask within another exposes bases again; merged uses the furthest end so far.

    A gap between two masks that both begin within a row is the same for all such rows, so gaps are made once for a sequence, and a row meets
    the gaps in it, not its masks. Its parts before the first and after the last of these masks hang on where it starts and ends alone.
    """
    m = masks.where("start <= end").groupBy("seq", F.col("start").cast("long").alias("r_start")).agg(F.max(F.col("end").cast("long")).alias("r_end"))
    m = written(m, "masks")  # of masks that begin together the longest is last in order, and no gap lies between them
    x = rows.join(masks.select("seq").distinct(), "seq", "left_semi").where("start <= end")
    x = written(x.select("id", "seq", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")), "rows")
    before = x.select("seq", (F.col("start") - 1).alias("x")).distinct()
    points = before.union(x.select("seq", F.col("end").alias("x"))).union(m.select("seq", (F.col("r_start") - 1).alias("x"))).distinct()
    near = written(_neighbours(m, points, width, merged), "neighbours")
    enter = near.select("seq", (F.col("x") + 1).alias("start"), "next", F.col("prev_end").alias("until"))
    if not merged:  # the last mask that begins before a row and reaches into it: at a place, as many as lie over each other there
        reach = interval_join(before.select("seq", F.col("x").alias("start"), F.col("x").alias("end")), m.select("seq", "r_start", (F.col("r_end") - 1).alias("r_end"), F.col("r_end").alias("until")), ["seq"], width)
        reach = reach.groupBy("seq", (F.col("start") + 1).alias("start")).agg(F.max_by("until", "r_start").alias("until"))
        enter = enter.drop("until").join(reach, ["seq", "start"], "left")
    leave = near.select("seq", F.col("x").alias("end"), F.col("prev_end").alias("reach"))
    gap = lambda start, end: F.struct(start.alias("start"), F.col(end).alias("end") if isinstance(end, str) else end.alias("end"))
    begun, rest = (F.greatest(F.col("start"), F.col(c) + 1) for c in ("until", "reach"))
    sides = F.when(F.col("next") <= F.col("end"), F.array(gap(begun, F.col("next") - 1), gap(rest, "end"))).otherwise(F.array(gap(begun, "end")))
    outer = x.join(enter, ["seq", "start"]).join(leave, ["seq", "end"]).select("id", "seq", F.inline(F.filter(sides, lambda g: g["start"] <= g["end"])))
    gaps = near.where("prev_end < x").join(m.select("seq", (F.col("r_start") - 1).alias("x")), ["seq", "x"])
    gaps = gaps.select("seq", (F.col("x") + 1).alias("r_start"), (F.col("x") + 1).alias("r_end"), "prev_start", (F.col("prev_end") + 1).alias("from"))
    inner = interval_join(x, gaps, ["seq"], width).where("prev_start >= start").select("id", "seq", F.col("from").alias("start"), (F.col("r_start") - 1).alias("end"))
    return outer.union(inner)


def span_summary(rows: DataFrame, span: Column) -> DataFrame:
    """rows: seq, cov_min, cov_max, cov_mean. (seq, cov_mean, cov_min, cov_max): the mean is weighted by span."""
    return rows.withColumn("span", span).groupBy("seq").agg(F.expr("try_divide(sum(cov_mean * span), sum(span))").alias("cov_mean"), F.min("cov_min").alias("cov_min"), F.max("cov_max").alias("cov_max"))


#: Order of the lines that subtract_lines() gives.
LINE_ORDER = ["section", "seq", "file", "block", "at", "start"]


def subtract_lines(lines: DataFrame, masks: DataFrame, mask_name: str, width: int = 10_000) -> DataFrame:
    """(LINE_ORDER, value): lines (of sources.text.placed_lines()) after subtraction: their ## lines, the mask's name, an empty line, then what masks (seq, start, end) leave, by sequence and in the order of the lines."""
    none = [F.lit("").alias("seq"), F.lit(0).cast("long").alias("start")]
    heads = lines.where(F.col("value").startswith("##")).select(F.lit(0).alias("section"), none[0], "file", "block", "at", none[1], "value")
    said = lines.sparkSession.createDataFrame([(0, f"##mask {mask_name}"), (1, "")], "at long, value string")
    said = said.select(F.lit(1).alias("section"), none[0], F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), "at", none[1], "value")
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    parts = F.when(F.size(F.split("value", "\t")) >= 9, F.split("value", "\t")).otherwise(F.split("value", " +"))
    cut = body.select(F.struct("file", "block", "at", parts.alias("p")).alias("id"))
    number = lambda k: F.col("id.p")[k].cast("long")
    cut = subtract(cut.select("id", F.col("id.p")[0].alias("seq"), number(3).alias("start"), number(4).alias("end")), masks, width)
    text = F.concat_ws("\t", F.slice("id.p", 1, 3), F.col("start").cast("string"), F.col("end").cast("string"), F.expr("slice(id.p, 6, size(id.p) - 5)"))
    rest = cut.select(F.lit(2).alias("section"), "seq", "id.file", "id.block", "id.at", "start", text.alias("value"))
    return heads.unionByName(said).unionByName(rest)
