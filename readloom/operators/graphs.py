"""Connected components by alternating stars.

Every vertex hangs its larger neighbours on the smallest vertex that it sees (large star), then itself and its smaller
neighbours (small star); edges that have become equal fall away. When nothing changes, each component is one star around
its smallest vertex; that takes a number of rounds that grows with the logarithm of the vertices. A vertex's minimum is
summed up in each task before it moves. Edges meet it by a join, but a hub's edges would be one task's: minima of vertices
with many edges are broadcast, HUBS of them at most, so that no key of the join has more than a hub's least edges.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators.running import release, written

#: Edges from which a vertex is a hub, at least, and hubs at most.
HUB, HUBS = 100_000, 50_000


def _least(ways: DataFrame) -> DataFrame:
    """(u, least, n) of each u of ways (u, v)."""
    return ways.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n"))


def with_least(ways: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """ways (u, v) and the least of each u, from (u, least, n)."""
    least = least.crossJoin(F.broadcast(least.agg(F.expr(f"greatest({hub}L, coalesce(ceil(sum(n) / {HUBS}), 0))").alias("many"))))  # one row
    is_hub = F.expr("n >= many")
    return keyed_join(ways, least.where(is_hub).select(F.col("u").alias("hub"), F.col("least").alias("hub_least")), least.where(~is_hub).select(F.col("u").alias("key"), "least")).select("u", "v", F.coalesce("hub_least", "least").alias("least"))


def keyed(ways: DataFrame, hubs: DataFrame) -> DataFrame:
    """ways with hub_least where u is a hub, and the key by which the others are joined; hubs' edges have keys of their own, spread by v, that no vertex has."""
    x = ways.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    return x.withColumns({"key": F.when(F.col("hub").isNull(), F.col("u")), "spread": F.when(F.col("hub").isNotNull(), F.col("v"))})


def keyed_join(ways: DataFrame, hubs: DataFrame, others: DataFrame) -> DataFrame:
    x = keyed(ways, hubs)
    others = others.withColumn("spread", F.lit(None).cast(x.schema["spread"].dataType))
    return x.join(others, x["key"].eqNullSafe(others["key"]) & x["spread"].eqNullSafe(others["spread"]), "left")


def _stars(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """edges (a, b) after one kind of star, as a written table."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    ways = down.union(down.select("v", "u")) if large else down
    least = _least(ways).withColumn("least", F.least("u", "least"))
    met = with_least(ways, least, hub)
    if large:
        new = met.where("v > u").select(F.col("v").alias("a"), F.col("least").alias("b"))
    else:
        new = met.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("least").alias("b")), F.struct(F.col("u").alias("a"), F.col("least").alias("b")))).alias("x")).select("x.*")
    return written(new.where("a != b").distinct(), "stars")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def graph_components(edges: DataFrame, rounds: int | None = None, hub: int = HUB) -> DataFrame:
    """(v, label) of the vertices of edges (a, b): the smallest vertex within reach. An error if that takes more than the given rounds. Vertices that have edges to themselves alone are components of their own; edges with a null end are left out."""
    known = edges.where("a IS NOT NULL AND b IS NOT NULL")
    stars = written(known.where("a != b").select("a", "b").distinct(), "stars")
    mark = None
    for done in count():
        if done == rounds:
            raise RuntimeError(f"components still changed after {rounds} rounds")
        wide = _stars(stars, True, hub)
        near = _stars(wide, False, hub)
        release(stars, wide)
        stars, before, mark = near, mark, _mark(near)
        if mark == before:
            break
    alone = known.where("a = b").select(F.col("a").alias("v")).distinct().join(stars.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v", "left_anti")
    out = stars.select(F.col("a").alias("v"), F.col("b").alias("label")).union(stars.select("b", "b").distinct()).union(alone.select("v", "v"))
    found = written(out, "components")
    release(stars)
    return found
