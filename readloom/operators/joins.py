"""Equi-joins whose frequent keys are dealt into blocks.

All rows of a key meet in one task, and all their pairs arise there. A key that has more rows on a side than a block is
heavy: its rows are dealt into blocks on both sides, and each block of one side meets each of the other in a task of its
own. Blocks hold `block` rows, or so many that HEAVY keys a side at most are heavy; those are broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key in a block at least, and heavy keys of a side at most.
BLOCK, HEAVY = 4096, 50_000


def heavy_keys(a: DataFrame, b: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(keys, in_a, in_b): into how many blocks each side's rows of a key are dealt, of the keys that both have and either has more of than a block."""
    sides = []
    for side, x in (("a", a), ("b", b)):
        n = x.groupBy(*keys).agg(F.count("*").alias(f"n_{side}"))
        total = n.agg(F.expr(f"greatest({block}L, coalesce(ceil(sum(n_{side}) / {HEAVY}), 0))").alias(f"most_{side}"))
        sides.append(n.crossJoin(F.broadcast(total)))  # one row
    both = sides[0].join(sides[1], list(keys)).where("n_a > most_a OR n_b > most_b")
    return both.select(*keys, *[F.expr(f"CAST(ceil(n_{s} / most_{s}) AS INT)").alias(f"in_{s}") for s in "ab"])


def block_join(a: DataFrame, b: DataFrame, keys: Sequence[str], spread_a: Sequence[str], spread_b: Sequence[str], block: int = BLOCK) -> DataFrame:
    """a and b joined on keys; their other columns have different names. Rows of a heavy key are dealt by the hash of the columns to spread."""
    keys = list(keys)
    heavy = F.broadcast(heavy_keys(a, b, keys, block))  # 2 * HEAVY rows at most

    def dealt(x: DataFrame, spread: Sequence[str], own: str, other: str) -> DataFrame:
        x = x.join(heavy, keys, "left")
        mine = F.pmod(F.xxhash64(*spread), F.coalesce(f"in_{own}", F.lit(1))).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(f"in_{other}", F.lit(1)) - 1))
        return x.withColumn(f"at_{own}", mine).withColumn(f"at_{other}", theirs).drop("in_a", "in_b")

    return dealt(a, spread_a, "a", "b").join(dealt(b, spread_b, "b", "a"), [*keys, "at_a", "at_b"]).drop("at_a", "at_b")
