"""Contigs that no row holds: skew and rotation over pieces.

A contig is rows (key, start, piece), pieces that follow each other without gaps. A piece gets a halo, the first letters
of those after it; it then knows its own windows. Running sums are those of a piece and what earlier pieces add up to, a
number each. So nothing ever holds more than a piece and its halo.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.functions.sequence import _letters, _skews
from readloom.operators.running import written
from readloom.shipping import ship


def cut_pieces(df: DataFrame, key: str, seq: str, size: int) -> DataFrame:
    """(key, start, piece) of sequences that are a row each; an empty or null one has no piece."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.length(seq).cast("long") - 1, F.lit(size).cast("long")))
    return df.where(F.length(seq) > 0).select(key, F.col(seq).alias("_s"), starts.alias("start")).select(key, "start", F.expr(f"substring(_s, CAST(start AS INT) + 1, {size})").alias("piece"))


def _with_halo(pieces: DataFrame, key: str, window: int) -> DataFrame:
    """pieces with the window letters that follow each, or as many as there are. A piece hands its first letters to those pieces before it that they are a halo of."""
    reach = pieces.select(key, "start", F.length("piece").alias("n"))
    # the pieces that a halo needs: as far back as window letters reach; only heads of pieces go along
    heads = pieces.select(F.col(key).alias("_key"), F.col("start").alias("at"), F.expr(f"left(piece, {window})").alias("head"))
    needs = reach.select(F.col(key).alias("_key"), "start", (F.col("start") + F.col("n")).alias("stop"))
    # equi-join on cells of the window's length: a head starts in the cell of stop, or in the next
    cell = lambda c: F.expr(f"{c} div {max(window, 1)}")
    wanted = needs.withColumn("cell", F.explode(F.array(cell("stop"), cell("stop") + 1)))
    met = wanted.join(heads.withColumn("cell", cell("at")), ["_key", "cell"]).where(f"at >= stop AND at < stop + {window}")
    halo = met.groupBy("_key", "start").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "head"))), lambda x: x["head"]), "").alias("halo"))
    x = pieces.join(halo.withColumnRenamed("_key", key), [key, "start"], "left")
    return x.select(key, "start", "piece", F.expr(f"left(coalesce(halo, ''), {window})").alias("halo"))


def piece_windows(pieces: DataFrame, key: str, window: int, step: int) -> DataFrame:
    """(key, pos, skew, accum) as functions.sequence.windows() gives them for whole sequences."""

    def skews(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (start, piece, halo) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                first = -start % step  # places are multiples of the step from the sequence's start
                letters, total = _letters(piece + halo)[first:], 0.0
                for pos, skew, none in _skews(letters[: max(len(piece) - first, 0) + window], window, step):
                    accum = np.cumsum(np.concatenate(([total], np.where(none, 0.0, skew))))[1:]
                    total = accum[-1]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(pos), k))), pa.array(np.full(len(pos), start), pa.int64()), pa.array(start + first + pos, pa.int64()), pa.array(skew, mask=none), pa.array(accum)], [key, "start", "pos", "skew", "upto"])

    ship(pieces.sparkSession)
    rows = _with_halo(pieces, key, window)
    own = written(rows.mapInArrow(skews, f"`{key}` {rows.schema[key].dataType.simpleString()}, start long, pos long, skew double, upto double"), "skews")
    sums = own.groupBy(key, "start").agg(F.max_by("upto", "pos").alias("sum"))
    before = W.partitionBy(key).orderBy("start").rowsBetween(W.unboundedPreceding, -1)  # a row a piece
    return own.join(sums.withColumn("before", F.coalesce(F.sum("sum").over(before), F.lit(0.0))), [key, "start"]).select(key, "pos", "skew", (F.col("before") + F.col("upto")).alias("accum"))


def least_skew_place(pieces: DataFrame, key: str, window: int, step: int) -> DataFrame:
    """(key, shift) of every key: the first place of the least running skew, 0 if the sequence isn't longer than the window."""
    low = piece_windows(pieces, key, window, step).groupBy(key).agg(F.min(F.struct(F.round("accum", 9).alias("low"), "pos")).alias("m"))
    return pieces.select(key).distinct().join(low, key, "left").select(key, F.coalesce("m.pos", F.lit(0)).alias("shift"))


def rotated_pieces(pieces: DataFrame, shifts: DataFrame, key: str) -> DataFrame:
    """pieces of each sequence from its shift on, what came before at its end; the piece with the shift is cut in two. A piece moves alone."""
    size = pieces.groupBy(key).agg(F.max(F.col("start") + F.length("piece")).alias("size"))
    at = size.join(shifts.select(key, "shift"), key).select(key, "size", F.expr("shift % size").alias("shift"))
    x = pieces.join(at, key)
    cut = F.expr("CAST(least(greatest(shift - start, 0), length(piece)) AS INT)")
    part = lambda a, text: F.struct(F.expr(f"({a} - shift + size) % size").alias("start"), text.alias("piece"))
    both = F.array(part("start", F.expr("left(piece, _cut)")), part("start + _cut", F.expr("substring(piece, _cut + 1)")))
    return x.withColumn("_cut", cut).select(key, F.explode(F.filter(both, lambda p: F.length(p["piece"]) > 0)).alias("p")).select(key, "p.*")
