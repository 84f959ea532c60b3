"""Mixing sources to target weights by hierarchical budgeting (DataFrame functions only).

A token budget goes down a tree (domain, language, source). At each node it is dealt to the children in
proportion to their weights; a child can take what its subtree holds in the allowed epochs, and what it
can't take goes to its siblings, so that a shortage leaves a node only when the whole node is short. Each
leaf then gives whole epochs, and of one more epoch the token-prefix in an order that the seed and the
epoch's number decide.

Leaf totals, capacities and budgets are small aggregates. The order of a leaf is never sorted as a whole:
keys are counted in 4,096 ranges, and only the range with the cut is looked at row by row, so one source
may hold most of the rows.

Defined results: null texts have no tokens; null levels are the node ''; repeated rows have equal keys and
are taken or left together; with no rows the result is empty; no node gets a token above its capacity;
parts of a token that a division leaves over go to the first children in order. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import WORD, documents, materialize

#: A leaf table up to this many rows (some 100 bytes each) is broadcast; beyond, the join is salted.
BROADCAST_LEAVES, SALTS = 50_000, 64
LEVELS = ("domain", "lang", "source")
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}}
SEED, EPOCHS, SHARE = 17, 4, (4, 5)


def source_domain(source: str = "source") -> Column:
    """Sources srcN fall into four domains by N; others are of domain d0."""
    return F.concat(F.lit("d"), F.coalesce(F.expr(f"try_cast(regexp_extract({source}, '^src([0-9]{{1,9}})$', 1) AS int) % 4"), F.lit(0)).cast("string"))


def _dealt(nodes: DataFrame, parents: Sequence[str], child: str) -> DataFrame:
    """nodes: parents, child, cap, weight, given (to the parent). Adds budget."""
    # in order of capacity over weight, those that fill up come first
    order = W.partitionBy(*parents).orderBy((F.col("cap") / F.col("weight")), child)
    up, all_ = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy(*parents)
    x = nodes.withColumn("before", F.coalesce(F.sum("cap").over(up), F.lit(0))).withColumn("ahead", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(up), F.lit(0)))
    x = x.withColumn("full", F.col("before") * F.col("weight") + F.col("cap") * F.col("ahead") <= F.col("given") * F.col("weight"))
    x = x.withColumn("left", F.col("given") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(all_)).withColumn("shares", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_))
    x = x.withColumn("floor", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(left * weight) div greatest(shares, 1)")))
    x = x.withColumn("over", F.col("left") - F.sum(F.when(F.col("full"), 0).otherwise(F.col("floor"))).over(all_))
    nth = F.row_number().over(W.partitionBy(*parents, "full").orderBy(child))
    return x.withColumn("budget", F.col("floor") + F.when(~F.col("full") & (nth <= F.col("over")), 1).otherwise(0)).select(*parents, child, "budget")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: Column, epochs: int) -> DataFrame:
    """leaves: levels and tokens. (levels, tokens, budget); budget: of all tokens that there are (column total)."""
    caps = leaves.withColumn("cap", F.col("tokens") * epochs)
    given = caps.agg(F.sum("cap").alias("all_cap"), F.sum("tokens").alias("total")).select(F.least(budget, F.col("all_cap")).cast("long").alias("given"))
    at: list[str] = []
    for level in levels:
        w = F.lit(1).cast("long")
        for value, n in weights.get(level, {}).items():
            w = F.when(F.col(level) == value, F.lit(n).cast("long")).otherwise(w)
        nodes = caps.groupBy(*at, level).agg(F.sum("cap").alias("cap")).withColumn("weight", w)
        nodes = nodes.join(given, at) if at else nodes.crossJoin(F.broadcast(given))  # one row
        given = _dealt(nodes, at, level).withColumnRenamed("budget", "given")
        at.append(level)
    return leaves.join(given, list(levels)).withColumnRenamed("given", "budget")


def _with_leaf(rows: DataFrame, leaves: DataFrame, levels: Sequence[str], small: bool) -> DataFrame:
    if small:
        return rows.join(F.broadcast(leaves), list(levels))
    salted = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*levels, "salt"]).drop("salt")


def _key(seed: int) -> Column:
    """Hexadecimal place of a row in a leaf's epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))


def plan_mix(rows: DataFrame, levels: Sequence[str] = LEVELS, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, share: tuple[int, int] = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> tuple[DataFrame, bool]:
    """rows: id, levels, tokens (a written table). (levels, budget, epoch, cut), and whether that is small: rows whose key is cut or less are in the last, partial epoch."""
    leaves = rows.groupBy(*levels).agg(F.sum("tokens").alias("tokens"))
    dealt = leaf_budgets(leaves, levels, weights, F.expr(f"total * {share[0]} div {share[1]}"), epochs)
    dealt = materialize(dealt.withColumn("epoch", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epoch") * F.col("tokens")).withColumnRenamed("tokens", "leaf_tokens"), "mix-leaves")
    small = dealt.count() <= BROADCAST_LEAVES
    keyed = _with_leaf(rows, dealt, levels, small).withColumn("key", _key(seed)).withColumn("part", F.substring("key", 1, 3))
    parts = keyed.groupBy(*levels, "rest", "part").agg(F.sum("tokens").alias("part_tokens"))
    running = F.sum("part_tokens").over(W.partitionBy(*levels).orderBy("part").rowsBetween(W.unboundedPreceding, 0))
    parts = parts.withColumn("until", running).where("until > rest")
    cut_at = parts.groupBy(*levels).agg(F.min(F.struct("part", (F.col("until") - F.col("part_tokens")).alias("before"))).alias("at")).select(*levels, F.col("at.part").alias("cut_part"), F.col("at.before").alias("before"))
    dealt = materialize(dealt.join(cut_at, list(levels), "left"), "mix-cuts")
    inside = _with_leaf(rows, dealt, levels, small).withColumn("key", _key(seed)).where(F.substring("key", 1, 3) == F.col("cut_part"))
    until = F.col("before") + F.sum("tokens").over(W.partitionBy(*levels).orderBy("key").rangeBetween(W.unboundedPreceding, 0))
    last = inside.withColumn("until", until).where("until <= rest").groupBy(*levels).agg(F.max("key").alias("last"))
    # without a part over the rest the leaf gives a whole epoch (only when it has no tokens); without a row inside, the cut is before the part
    cut = F.when(F.col("cut_part").isNull(), F.lit("g")).otherwise(F.coalesce("last", "cut_part"))
    return materialize(dealt.join(last, list(levels), "left").select(*levels, "budget", "epoch", cut.alias("cut")), "mix-plan"), small


def _levels(given: Mapping[str, Column] | None) -> dict[str, Column]:
    named = given or {"domain": source_domain(), "lang": F.col("lang"), "source": F.col("source")}
    return {k: F.coalesce(c.cast("string"), F.lit("")) for k, c in named.items()}


def _rows(docs: DataFrame, levels: Mapping[str, Column], id_col: str, text_col: str) -> DataFrame:
    """(id, levels, tokens) of every row, as a written table."""
    tokens = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return materialize(docs.select(F.col(id_col).alias("id"), *[c.alias(k) for k, c in levels.items()], tokens.alias("tokens")), "mix-rows")


def mix_sources(docs: DataFrame, levels: Mapping[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """(id, levels, tokens, copies, kept): how often each row is in the mix. levels: columns of docs by the level's name."""
    named = _levels(levels)
    rows = _rows(docs, named, id_col, text_col)
    plan, small = plan_mix(rows, tuple(named), **params)
    return _copies(_with_leaf(rows, plan, tuple(named), small), params.get("seed", SEED)).select("id", *named, "tokens", "copies", (F.col("copies") > 0).alias("kept"))


def _copies(rows: DataFrame, seed: int) -> DataFrame:
    return rows.withColumn("copies", F.col("epoch") + F.when(_key(seed) <= F.col("cut"), 1).otherwise(0))


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """docs, each row as often as the mix takes it, by its own leaf and key; columns may have any names."""
    levels, id_col = _levels(params.pop("levels", None)), params.pop("id_col", "doc_id")
    plan, small = plan_mix(_rows(docs, levels, id_col, params.pop("text_col", "text")), tuple(levels), **params)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("id"), *[c.alias(k) for k, c in levels.items()])
    out = _copies(_with_leaf(whole, plan, tuple(levels), small), params.get("seed", SEED)).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long")))).select("doc.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def oracle(share: tuple[int, int] = SHARE, epochs: int = EPOCHS) -> str:
    """Plain windows over whole leaves, in place of ranges of keys."""
    case = lambda c: "CASE " + " ".join(f"WHEN {c} = '{k}' THEN {v}" for k, v in WEIGHTS[c].items()) + " ELSE 1 END" if c in WEIGHTS else "1"
    sql = f"""WITH d AS (SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(source, '^src([0-9]{{1,9}})$', 1) AS INT) % 4, 0) AS VARCHAR) AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM d GROUP BY ALL),
g0 AS (SELECT least(CAST(sum(tokens) AS BIGINT) * {share[0]} // {share[1]}, CAST(sum(tokens) AS BIGINT) * {epochs}) AS given FROM leaf)"""
    at: list[str] = []
    for i, level in enumerate(LEVELS):
        cols, part = ", ".join([*at, level]), "PARTITION BY " + ", ".join(at) if at else ""
        part_full = "PARTITION BY " + ", ".join([*at, "is_full"])
        sql += f""",
n{i} AS (SELECT {cols}, CAST(sum(tokens) * {epochs} AS BIGINT) AS cap, {case(level)} AS weight FROM leaf GROUP BY {cols}),
a{i} AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior,
  sum(weight) OVER ({part}) - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM n{i} {"JOIN g" + str(i) + " USING (" + ", ".join(at) + ")" if at else ", g0"} WINDOW w AS ({part} ORDER BY CAST(cap AS DOUBLE) / weight, {level})),
b{i} AS (SELECT *, prior * weight + cap * ahead <= given * weight AS is_full FROM a{i}),
c{i} AS (SELECT *, given - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part}) AS remains, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part}) AS shares FROM b{i}),
e{i} AS (SELECT *, CASE WHEN is_full THEN cap ELSE remains * weight // greatest(shares, 1) END AS base FROM c{i}),
f{i} AS (SELECT *, remains - sum(CASE WHEN is_full THEN 0 ELSE base END) OVER ({part}) AS extra, row_number() OVER ({part_full} ORDER BY {level}) AS nth FROM e{i}),
g{i + 1} AS (SELECT {cols}, CAST(base + CASE WHEN NOT is_full AND nth <= extra THEN 1 ELSE 0 END AS BIGINT) AS given FROM f{i})"""
        at.append(level)
    return sql + f""",
p AS (SELECT d.*, CASE WHEN leaf.tokens > 0 THEN given // leaf.tokens ELSE 0 END AS epoch, leaf.tokens AS leaf_tokens, given FROM d JOIN leaf USING (domain, lang, source) JOIN g3 USING (domain, lang, source)),
q AS (SELECT *, md5('{SEED}:' || CAST(epoch AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM p),
s AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM q)
SELECT doc_id, domain, lang, source, tokens, CAST(epoch + CASE WHEN until <= given - epoch * leaf_tokens THEN 1 ELSE 0 END AS BIGINT) AS copies,
  epoch + CASE WHEN until <= given - epoch * leaf_tokens THEN 1 ELSE 0 END > 0 AS kept FROM s"""


ORACLE = oracle()
