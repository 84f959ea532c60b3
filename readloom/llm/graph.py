"""Connected components of an edge table, for links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex in edges (a, b): the smallest vertex that it reaches.

    Every vertex joins its smallest neighbour, and that one's, if smaller than itself; then the edges between
    what has become one vertex fall away, and the rest go on. At least half the vertices of a component go in
    a round, so few rounds are left for large ones. Every round is a written table: a lost executor costs a
    round at most.
    """
    left = materialize(edges.where("a != b").select("a", "b").distinct(), "edges")
    labels = table = None
    while labels is None or not left.isEmpty():
        both = left.union(left.select("b", "a"))
        least = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("near")), "near")
        further = least.select(F.col("v").alias("near"), F.col("near").alias("to"))
        to = materialize(least.join(further, "near").select("v", "to"), "to")
        done = [left, least]
        if labels is None:
            labels, table = to.withColumnRenamed("to", "label"), to
        else:
            done += [table, to]
            labels = table = materialize(labels.join(to.withColumnRenamed("v", "label"), "label", "left").select("v", F.coalesce("to", "label").alias("label")), "labels")
        left = left.join(to.select(F.col("v").alias("a"), F.col("to").alias("to_a")), "a").join(to.select(F.col("v").alias("b"), F.col("to").alias("to_b")), "b")
        left = materialize(left.where("to_a != to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), "edges")
        discard(*done)
    return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (v, label) after further edges (a, b)."""
    at = lambda k: labels.select(F.col("v").alias(k), F.col("label").alias(f"label_{k}"))
    named = edges.join(at("a"), "a", "left").join(at("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    named = materialize(named, "edges")
    over = components(named).withColumnRenamed("v", "was").withColumnRenamed("label", "to")
    # a vertex without an edge before is a label of its own
    all_ = labels.union(named.select(F.explode(F.array("a", "b")).alias("v")).distinct().join(labels, "v", "left_anti").select("v", "v"))
    return all_.join(over, all_.label == over.was, "left").select("v", F.coalesce("to", "label").alias("label"))
