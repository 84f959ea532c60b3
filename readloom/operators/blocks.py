"""Blocks and shards: contiguous greedy blocks, weighted splits, largest-first bins, comparison ranges.

Greedy blocks are a fold over ordered weights whose state is the sum of the open block. The rows are dealt out
in ranges of the order, and each range is folded in a task of its own from the sum it is entered with. The
driver holds one number a range: it guesses that a range is entered with a new block, and asks again for the
ranges where the exit of the one before says otherwise. Folds from different sums soon meet at a block's
start, so few rounds are needed; there are never more than ranges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators.running import PART, place, totals_before, written
from readloom.shipping import ship

#: Blocks that are dealt largest first at most (some 100 bytes each on the driver).
MAX_BLOCKS = 1_000_000


def _fold(weights: np.ndarray, open_sum: int, target: int) -> tuple[np.ndarray, int]:
    """(places where a block starts, sum of the open block at the end)."""
    upto = np.concatenate(([0], np.cumsum(weights)))
    starts, at = [], 0
    while at < len(weights):
        if open_sum >= target:
            starts.append(at)
            open_sum, at = int(weights[at]), at + 1
        else:
            to = min(int(np.searchsorted(upto, upto[at] + target - open_sum)), len(weights))
            open_sum, at = open_sum + int(upto[to] - upto[at]), to
    return np.array(starts, np.int64), open_sum


def _exits(placed: DataFrame, entries: Mapping[int, int], target: int) -> list:
    """(part, open sum at the end, blocks started) of the ranges in entries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, n, at = None, 0, 0
        for rows in batches:
            if not len(rows):
                continue
            if part is None:
                part = int(rows[PART].iloc[0])
                at = entries[part]
            starts, at = _fold(rows["w"].to_numpy(np.int64), at, target)
            n += len(starts)
        if part is not None:
            yield pd.DataFrame({"part": [part], "at": [at], "n": [n]})

    return placed.where(F.col(PART).isin(list(entries))).mapInPandas(run, "part int, at long, n long").collect()


def greedy_blocks(df: DataFrame, order: str, weight: str, target: int) -> DataFrame:
    """(order, weight, block): a new block starts when the current one has reached the target. Weights aren't negative; null weighs nothing."""
    ship(df.sparkSession)
    placed = place(df.select(F.col(order).cast("long").alias("o"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("w")), ["o"])
    parts = sorted(map(tuple, placed.groupBy(PART).agg(F.sum("w")).collect()))  # a row a range
    known: dict[tuple[int, int], tuple[int, int]] = {}
    latest: dict[int, tuple[int, int]] = {}
    while True:
        entries, asked, at, block = {}, {}, target, -1
        for part, total in parts:
            entries[part] = (at, block)
            if at + total < target:
                at += total
                continue
            if (part, at) not in known:
                asked[part] = at
            at, n = known.get((part, at)) or latest.get(part, (target, 0))
            block += n
        if not asked:
            break
        for r in _exits(placed, asked, target):
            known[r.part, asked[r.part]] = latest[r.part] = (r.at, r.n)

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for rows in batches:
            if not len(rows):
                continue
            at, block = state or entries[int(rows[PART].iloc[0])]
            starts, at = _fold(rows["w"].to_numpy(np.int64), at, target)
            numbers = block + np.searchsorted(starts, np.arange(len(rows)), side="right")
            state = at, block + len(starts)
            yield pd.DataFrame({order: rows["o"], weight: rows["w"], "block": numbers.astype(np.int32)})

    return placed.mapInPandas(label, f"`{order}` long, `{weight}` long, block int")


def block_table(df: DataFrame, order: str, weight: str, target: int) -> DataFrame:
    """(block, first, stop, total): half-open ranges of renumbered rows; a negative target makes one block."""
    b = greedy_blocks(df, order, weight, target if target >= 0 else 1 << 62).groupBy("block").agg(F.count("*").alias("n"), F.sum(weight).alias("total"))
    return totals_before(place(b, ["block"]), ["block"], {"first": "n"}).select("block", "first", (F.col("first") + F.col("n")).alias("stop"), "total")


def _cuts(rows: DataFrame, part: int, at: int, groups: int, total: int) -> list[int]:
    """Running sums at which shards end within a range, if the open one began at the sum `at` and `groups` are left with it."""

    def run(key: tuple, x: pd.DataFrame) -> pd.DataFrame:
        ends = np.sort((x["before"] + x["w"]).to_numpy(np.int64))
        found, begun, left = [], at, groups
        while left > 1 and begun < total:
            k = int(np.searchsorted(ends, begun - (begun - total) // left))  # the share is rounded up
            if k == len(ends):
                break
            begun, left = int(ends[k]), left - 1
            found.append(begun)
        return pd.DataFrame({"cut": np.array(found, np.int64)})

    return sorted(r.cut for r in rows.where(F.col(PART) == part).groupBy(PART).applyInPandas(run, "cut long").collect())


def split_table(df: DataFrame, order: str, weight: str, n: int) -> DataFrame:
    """(order, weight, shard): contiguous shards, n at most; each takes rows up to an even share of what is left. Rows without a weight that none is left for go to the last one.

    The driver holds the running sum at the end of each range, so it knows the range that a shard ends in; a job over that range alone
    finds the ends of all shards there. So there is a job for each range with an end in it, and each reads its range.
    """
    ship(df.sparkSession)
    placed = place(df.select(F.col(order).alias("o"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("w")), ["o"])
    rows = written(totals_before(placed, ["o"], {"before": "w"}), "sums")
    ends = sorted((r.end, r[PART]) for r in rows.groupBy(PART).agg(F.max(F.expr("before + w")).alias("end"), F.count("*").alias("n")).collect())  # a row a range
    total, count = (ends[-1][0] if ends else 0), rows.count()
    starts, groups, at, k = [0], min(n, count), 0, 0
    while groups > 1 and at < total and k < len(ends):
        if ends[k][0] >= at - (at - total) // groups:
            for cut in _cuts(rows, ends[k][1], at, groups, total):
                at, groups = cut, groups - 1
                if at < total:
                    starts.append(at)
        k += 1
    firsts = np.array(sorted(starts), np.int64)

    @F.pandas_udf("int")
    def shard(before):  # noqa: ANN001, ANN202
        return pd.Series(np.searchsorted(firsts, before.to_numpy(np.int64), side="right") - 1)

    return rows.select(F.col("o").alias(order), F.col("w").alias(weight), shard("before").alias("shard"))


def largest_first_table(df: DataFrame, name: str, weight: str, n: int) -> DataFrame:
    """(name, weight, bin) by largest_first; bins by sum. The items are blocks of reads, each of which fills a file: more than MAX_BLOCKS are an error."""
    items = [tuple(r) for r in df.select(name, F.col(weight).cast("long")).orderBy(name).limit(MAX_BLOCKS + 1).collect()]
    if len(items) > MAX_BLOCKS:
        raise ValueError(f"more than {MAX_BLOCKS} blocks")
    bins = largest_first(n, [w for _, w in items])
    kind = df.schema[name].dataType.simpleString()
    return df.sparkSession.createDataFrame([(*items[i], b) for b, held in enumerate(bins) for i in held], f"`{name}` {kind}, `{weight}` long, bin int")


def largest_first(n: int, sizes: Sequence[int]) -> list[list[int]]:
    """Indices by bin: the largest left goes to the bin with the least, then fewest, then first; bins by sum, without empty ones."""
    bins: list[tuple[int, int, int, list[int]]] = [(0, 0, k, []) for k in range(n)]
    for size, i in sorted(((s, i) for i, s in enumerate(sizes)), reverse=True):
        total, count, k, held = heapq.heappop(bins)
        heapq.heappush(bins, (total + size, count + 1, k, [*held, i]))
    return [b[3] for b in sorted(bins, key=lambda b: b[:3]) if b[3]]


def _cells(spark: SparkSession, rows: DataFrame, n_shards: int) -> DataFrame:
    """rows: t, lo, hi (half-open), before (cells of earlier rows), total. Cuts them where the line of all cells is cut into shards of even sizes, larger ones first."""
    bounds = spark.range(n_shards).selectExpr("CAST(id AS INT) AS shard")
    cut = rows.crossJoin(F.broadcast(bounds)).withColumns({"a": F.expr(f"shard * (total div {n_shards}) + least(shard, total % {n_shards})"), "b": F.expr(f"(shard + 1) * (total div {n_shards}) + least(shard + 1, total % {n_shards})")})
    return cut.withColumns({"qs": F.expr("lo + greatest(a - before, 0)"), "qe": F.expr("lo + least(b - before, hi - lo)")}).where("qs < qe").selectExpr("shard", "t", "CAST(qs AS BIGINT) AS qs", "CAST(qe AS BIGINT) AS qe")


def shard_triangular(spark: SparkSession, n: int, n_shards: int) -> DataFrame:
    """(shard, t, qs, qe): all pairs t <= q of n blocks."""
    rows = spark.range(n).selectExpr("id AS t", "id AS lo", f"{n}L AS hi", f"id * {n}L - id * (id - 1) div 2 AS before", f"{n * (n + 1) // 2}L AS total")
    return _cells(spark, rows, n_shards)


def shard_columns(spark: SparkSession, n_rows: int, n_cols: int, n_shards: int) -> DataFrame:
    """(shard, t, qs, qe): each shard has a range of columns for every row."""
    line = spark.range(1).selectExpr("0L AS t", "0L AS lo", f"{n_cols}L AS hi", "0L AS before", f"{n_cols}L AS total")
    cut = _cells(spark, line, n_shards).drop("t")
    return cut.crossJoin(spark.range(n_rows).withColumnRenamed("id", "t")).select("shard", "t", "qs", "qe")
