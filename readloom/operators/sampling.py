"""Sequence databases: blacklist filter, subsampling to a coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.operators.running import place, totals_before


def without_blacklisted(seqs: DataFrame, blacklist: DataFrame, key: str) -> DataFrame:
    """A name that the blacklist has twice is an error."""
    once = blacklist.groupBy(key).agg(F.count("*").alias("times")).where(F.when(F.col("times") > 1, F.raise_error(F.lit("a name is listed twice")).cast("boolean")).otherwise(F.lit(True)))
    return seqs.join(once.select(key), key, "left_anti")


def subsample(seqs: DataFrame, name: str, length: str, genome: int, coverage: float, order: list[Column]) -> DataFrame:
    """seqs of the names that come first in the order until their lengths reach the target; of a name met again only the first length counts."""
    first = seqs.groupBy(name).agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(length).alias("len"))).alias("f")).select(name, "f.*")
    keys = [f"o{i}" for i in range(len(order))]
    before = totals_before(place(first, [*keys, name]), [*keys, name], {"before": "len"})
    return seqs.join(before.where(F.col("before") < int(genome * coverage)).select(name), name, "left_semi")
