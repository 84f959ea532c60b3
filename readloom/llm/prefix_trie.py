"""The prefix trie of conversations: which openings are shared, by how many, and what sharing them would save.

A node is a distinct sequence of first turns; its members are the conversations that begin with it, and the smallest
one owns it. What a conversation owns is one chain, from its first owned depth to its end, as owners only grow with
depth. That depth is found by binary search, all conversations at once: in each round every conversation looks up one
prefix digest in the table of each digest's smallest conversation. The chains hang on each other's nodes and are the
tree. Sums over subtrees go from the leaves up in doubling steps over chains (after k steps a chain has what lies
within 2^k chains below it), and along a chain as running sums.

A prefix's digest is made of five sums, each of 32 bits of SHA-256 of every turn with its place: 160 bits, exact up to
2^31 turns. So digests are running sums: a conversation of any length is dealt out in ranges of its turns and no task
holds it as a whole. Prefixes of very many conversations are looked up in a broadcast table of HOT_SHARE rows at most,
the others in a join. Members that end at a node are hashed in sorted runs of at most one Arrow batch each.

Defined results: turns are in order of their number, null first, then of role and text; a null role or text is empty;
rows that repeat are turns of their own; rows without a conversation's id are left out; an empty table gives an empty
result (no conversation, no root); a conversation without turns of its own is a member of the root or of what it
borrows; other columns are ignored. Texts are read whole, once, before the first shuffle drops them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import WORD, discard, materialize, ship

#: A prefix is looked up by broadcast if it has this share of all (conversation, prefix) rows; so there are HOT_SHARE such prefixes at most.
HOT_SHARE = 5_000
PIECES = tuple(f"s{k}" for k in range(5))
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Place of the root's range among a conversation's, and of borrowed turns.
ROOT_PART, BORROWED_PART = -2, -1


def _turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, part, at, digest, words) of every turn: part is a range of the order, at the place in the order."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(empty(role), F.lit("\0"), empty(text))
    x = rows.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), said.alias("said"), F.length(empty(role)).alias("role_n"), F.regexp_count(empty(text), F.lit(WORD)).cast("long").alias("words"))
    digest = F.sha2(F.concat(F.col("role_n").cast("string"), F.lit(":"), F.col("said")), 256)
    placed = x.repartitionByRange("conv", "turn", F.substring("said", 1, 64)).sortWithinPartitions("conv", "turn", "said")
    return materialize(placed.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), digest.alias("digest"), "words"), "trie-turns")


def _conversations(parts: DataFrame, shared: tuple[int, int] | None) -> DataFrame:
    """(conv, base, skipped, lent, depth): depth turns are left when the first `skipped` are replaced by the `lent` first ones of base."""
    own = parts.groupBy("conv").agg(F.sum("n").alias("n"))
    if shared is None:
        return own.select("conv", F.col("conv").alias("base"), F.lit(0).cast("long").alias("skipped"), F.lit(0).cast("long").alias("lent"), F.col("n").alias("depth"))
    every, most = shared
    own = own.withColumns({"base": F.expr(f"conv - conv % {every}"), "skipped": F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most))})
    bases = own.where("conv = base").select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    x = own.join(bases, "base", "left").withColumn("lent", F.least("skipped", F.coalesce("base_n", F.lit(0))).cast("long"))
    return x.select("conv", "base", "skipped", "lent", F.expr("lent + greatest(n - skipped, 0)").alias("depth"))


def _carried(totals: DataFrame, cols: Sequence[str], down: bool = False) -> DataFrame:
    """totals: conv, part, cols. For each, what the conversation's earlier parts have (later ones, if down); a row a part that it lies in."""
    order = W.partitionBy("conv").orderBy(F.col("part").desc() if down else F.col("part")).rowsBetween(W.unboundedPreceding, -1)
    return totals.select("conv", "part", *[F.coalesce(F.sum(c).over(order), F.lit(0)).alias(f"_{c}") for c in cols])


def _subtree_sums(nodes: DataFrame, cols: Sequence[str], name: str) -> DataFrame:
    """nodes with each of the columns replaced by its sum over the node and the deeper ones of its chain."""
    deeper = W.partitionBy("conv", "part").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    beyond = _carried(nodes.groupBy("conv", "part").agg(*[F.sum(c).alias(c) for c in cols]), cols, down=True)
    x = nodes.withColumns({c: F.sum(c).over(deeper) for c in cols}).join(beyond, ["conv", "part"])
    return materialize(x.withColumns({c: F.col(c) + F.col(f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols]), name)


def prefixes(rows: DataFrame, shared: tuple[int, int] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """((conv, part, depth, digest pieces, words) of every prefix, (conv, depth) of every conversation), as written tables.

    shared=(e, m): conversation c opens with the first h turns of c - c % e in place of its own first h, h = crc32(decimal c) % m.
    """
    turns = _turns(rows, conv, turn, role, text)
    parts = materialize(turns.groupBy("conv", "part").agg(F.count("*").alias("n")), "trie-parts")
    convs = materialize(_conversations(parts, shared), "trie-conversations")
    known = _carried(parts, ["n"]).join(convs, "conv")
    within = W.partitionBy("conv", "part").orderBy("at")
    x = turns.join(known, ["conv", "part"]).withColumn("nth", F.row_number().over(within) + F.col("_n"))
    x = x.withColumn("depth", F.expr("CASE WHEN conv = base THEN nth WHEN nth > skipped THEN nth - skipped + lent END")).where("depth IS NOT NULL")
    sha = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    x = x.withColumn("sha", sha).withColumns({p: F.conv(F.substring("sha", 8 * k + 1, 8), 16, 10).cast("long") for k, p in enumerate(PIECES)})
    upto = within.rowsBetween(W.unboundedPreceding, 0)
    own = materialize(x.select("conv", "part", "depth", "words", *[F.sum(p).over(upto).alias(p) for p in PIECES]), "trie-own")
    carried = materialize(_carried(own.groupBy("conv", "part").agg(*[F.max(p).alias(p) for p in PIECES]), PIECES), "trie-carried")
    if shared is not None:
        # what a base lends: its first turns, `most - 1` of them at most
        first = own.where(F.expr(f"conv % {shared[0]} = 0 AND depth < {shared[1]}")).join(carried, ["conv", "part"])
        lends = first.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("depth", "words", *[(F.col(p) + F.col(f"_{p}")).alias(p) for p in PIECES]))).alias("lends"))
        borrows = materialize(convs.where("conv != base AND lent > 0").join(lends, "base").select("conv", F.slice("lends", 1, F.col("lent").cast("int")).alias("lends")), "trie-borrows")
        last = lambda p: F.coalesce(F.element_at("lends", -1)[p], F.lit(0))
        added = carried.join(borrows, "conv", "left").select("conv", "part", *[(F.col(f"_{p}") + last(p)).alias(f"_{p}") for p in PIECES])
        borrowed = borrows.select("conv", F.lit(BORROWED_PART).alias("part"), F.explode("lends").alias("x")).select("conv", "part", "x.depth", *[f"x.{p}" for p in PIECES], "x.words")
    else:
        added, borrowed, borrows = carried, None, None
    out = own.join(added, ["conv", "part"]).select("conv", "part", "depth", *[(F.col(p) + F.col(f"_{p}")).alias(p) for p in PIECES], "words")
    out = materialize(out.unionByName(borrowed) if borrowed is not None else out, "trie-prefixes")
    discard(turns, parts, own, carried, *([borrows] if borrows is not None else []))
    return out, convs


class _Owners:
    """The smallest conversation of each prefix, looked up for many conversations at once."""

    def __init__(self, all_: DataFrame):
        self.all, keys = all_, ["depth", *PIECES]
        self.least = materialize(all_.groupBy(*keys).agg(F.min("conv").alias("owner"), F.count("*").alias("n")), "trie-minima")
        total = self.least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        often = f"n >= {max(2, -(-total // HOT_SHARE))}"
        self.hot = self.least.where(often).select(*keys, F.col("owner").alias("hot_owner"))
        self.cold = self.least.where(f"NOT {often}").select(*keys, "owner")

    def of(self, probes: DataFrame) -> DataFrame:
        """probes: conv, at. (conv, owner) of each one's prefix of that depth."""
        keys = ["depth", *PIECES]
        x = self.all.select("conv", *keys).join(probes.select("conv", F.col("at").alias("depth")), ["conv", "depth"])
        x = x.join(F.broadcast(self.hot), keys, "left")
        # what is found goes on under keys that no prefix has, so that it doesn't meet in one task
        found = F.col("hot_owner").isNotNull()
        x = x.withColumns({"depth": F.when(found, -1).otherwise(F.col("depth")), PIECES[0]: F.when(found, F.col("conv")).otherwise(F.col(PIECES[0]))})
        return x.join(self.cold, keys, "left").select("conv", F.coalesce("hot_owner", "owner").alias("owner"))


def first_owned(convs: DataFrame, owners: _Owners, root: int, longest: int) -> DataFrame:
    """(conv, depth, first, up): the first depth that each conversation owns (depth + 1: none), and who owns the node above it."""
    state = materialize(convs.select("conv", "depth", F.when(F.col("conv") == root, 0).otherwise(1).cast("long").alias("lo"), F.when(F.col("conv") == root, 0).otherwise(F.col("depth") + 1).cast("long").alias("hi")), "trie-search")
    for _ in range(longest.bit_length()):
        at = owners.of(state.where("lo < hi").select("conv", F.expr("(lo + hi) div 2").alias("at")))
        mid, own = F.expr("(lo + hi) div 2"), F.col("owner") == F.col("conv")
        after = state.join(at, "conv", "left").select("conv", "depth", F.when(F.col("owner").isNull() | own, F.col("lo")).otherwise(mid + 1).alias("lo"), F.when(own, mid).otherwise(F.col("hi")).alias("hi"))
        before, state = state, materialize(after, "trie-search")
        discard(before)
    above = owners.of(state.where("lo > 1").select("conv", (F.col("lo") - 1).alias("at")))
    x = state.join(above, "conv", "left").withColumn("up", F.when(F.col("lo") == 1, F.lit(root).cast("long")).otherwise(F.col("owner")))
    out = materialize(x.select("conv", "depth", F.col("lo").alias("first"), "up"), "trie-chains")
    discard(state)
    return out


def _ancestors(chains: DataFrame, root: int) -> list[DataFrame]:
    """Tables (conv, up) of the chains 1, 2, 4, ... above, as far as there are any."""
    steps = [materialize(chains.where("up IS NOT NULL").select("conv", "up"), "trie-up")]
    while True:
        last = steps[-1]
        further = last.where(F.col("up") != root).join(last.select(F.col("conv").alias("up"), F.col("up").alias("further")), "up").select("conv", F.col("further").alias("up"))
        further = materialize(further, "trie-up")
        if further.isEmpty():
            discard(further)
            return steps
        steps.append(further)


def _with_descendants(values: DataFrame, steps: Sequence[DataFrame], cols: Sequence[str], name: str) -> DataFrame:
    """values: conv, cols. Each column's sum over a chain and all chains below it."""
    for step in steps:
        gained = values.join(step, "conv").groupBy(F.col("up").alias("conv")).agg(*[F.sum(c).alias(f"_{c}") for c in cols])
        x = values.join(gained, "conv", "left").select("conv", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in cols])
        before, values = values, materialize(x, name)
        discard(before)
    return values


def joined_hashes(ends: DataFrame) -> DataFrame:
    """ends: conv, depth, member. (conv, depth, ends_sha256): SHA-256 of the members' decimal ids in order, with commas between."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            conv, depth, member = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(conv):
                continue
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(conv) != 0) | (np.diff(depth) != 0))))
            ids = member.astype(str)
            text = [",".join(ids[a:b]) for a, b in zip(starts, [*starts[1:], len(ids)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(conv[starts]), pa.array(depth[starts]), pa.array(member[starts]), pa.array(text)], ["conv", "depth", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        for batch in batches:
            for conv, depth, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if node != (conv, depth):
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield _hash_rows(out)
                out = []
        if node:
            yield _hash_rows([(*node, sha.hexdigest())])

    ship(ends.sparkSession)
    keys = ["conv", "depth", "member"]
    ordered = ends.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys)
    chunks = ordered.mapInArrow(runs, "conv long, depth long, first long, ids string")
    return chunks.repartition("conv", "depth").sortWithinPartitions("conv", "depth", "first").mapInArrow(digests, "conv long, depth long, ends_sha256 string")


def _hash_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv", "depth", "ends_sha256"])


def prefix_trie(rows: DataFrame, shared: tuple[int, int] | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every node; shared as in prefixes()."""
    all_, convs = prefixes(rows, shared, conv, turn, role, text)
    root, longest = convs.agg(F.min("conv"), F.max("depth")).first()
    schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if root is None:
        return rows.sparkSession.createDataFrame([], schema)
    owners = _Owners(all_)
    found = first_owned(convs, owners, root, longest)
    discard(owners.least, convs)
    own = F.col("first") <= F.col("depth")
    chains = found.where(own)
    ends = materialize(found.select(F.when(own, F.col("conv")).otherwise(F.col("up")).alias("owner"), "depth", F.col("conv").alias("member")).withColumnRenamed("owner", "conv"), "trie-ends")
    ended = ends.groupBy("conv", "depth").agg(F.count("*").alias("ended"))
    hung = chains.where("up IS NOT NULL").groupBy(F.col("up").alias("conv"), (F.col("first") - 1).alias("depth")).agg(F.count("*").alias("hung"))
    events = materialize(ended.join(hung, ["conv", "depth"], "full").na.fill(0, ["ended", "hung"]), "trie-events")

    # chains: members that end on them, and whether their last node is a leaf
    last = events.where("hung > 0").select("conv", "depth", F.lit(0).cast("long").alias("leaf"))
    values = chains.select("conv", "depth").join(last, ["conv", "depth"], "left").select("conv", F.coalesce("leaf", F.lit(1)).cast("long").alias("leaf"))
    values = values.join(events.groupBy("conv").agg(F.sum("ended").alias("ended")), "conv", "left").na.fill(0, ["ended"])
    steps = _ancestors(chains, root)
    sums = _with_descendants(materialize(values, "trie-values"), steps, ["ended", "leaf"], "trie-values")
    below = chains.where("up IS NOT NULL").join(sums, "conv").groupBy(F.col("up").alias("conv"), (F.col("first") - 1).alias("depth")).agg(F.sum("ended").alias("sub_convs"), F.sum("leaf").alias("sub_leaves"))

    # nodes: what each chain owns, part by part, so that a long chain is dealt out
    info = all_.select("conv", "part").distinct().join(chains.withColumnRenamed("depth", "last"), "conv")
    nodes = all_.select("conv", "part", "depth", "words").join(info, ["conv", "part"]).where("depth >= first")
    top = chains.where(F.col("conv") == root).select("conv", F.lit(ROOT_PART).alias("part"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("words"), "first", F.col("depth").alias("last"), "up")
    nodes = nodes.select(*top.columns).unionByName(top).join(events, ["conv", "depth"], "left").join(below, ["conv", "depth"], "left").na.fill(0, ["ended", "hung", "sub_convs", "sub_leaves"])
    nodes = nodes.withColumns({"n_convs": F.col("ended") + F.col("sub_convs"), "n_leaves": F.col("sub_leaves") + F.expr("CAST(depth = last AND hung = 0 AS LONG)"), "n_children": F.col("hung") + F.expr("CAST(depth < last AS LONG)")})
    parent = F.when(F.col("depth") > F.col("first"), F.col("conv")).otherwise(F.col("up"))
    nodes = materialize(nodes.select("conv", "part", "depth", "words", parent.alias("parent_conv_id"), "n_convs", "n_leaves", "n_children"), "trie-nodes")
    counted = _subtree_sums(nodes, ["n_convs", "n_leaves"], "trie-counted").withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("words"))
    saved = counted.groupBy("conv").agg(F.sum("saved_tokens").alias("saved"))
    saved = _with_descendants(materialize(saved, "trie-saved"), steps, ["saved"], "trie-saved")
    under = chains.where("up IS NOT NULL").join(saved, "conv").groupBy(F.col("up").alias("conv"), (F.col("first") - 1).alias("depth")).agg(F.sum("saved").alias("sub_saved"))
    counted = materialize(counted.join(under, ["conv", "depth"], "left").withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("sub_saved", F.lit(0))).drop("sub_saved"), "trie-priced")
    out = _subtree_sums(counted, ["saved_tokens"], "trie-summed").join(joined_hashes(ends), ["conv", "depth"], "left")
    out = out.select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))
    discard(all_, nodes, counted, sums, saved, *steps)
    return out


#: Of every 20 conversations the later ones open with up to 3 turns of the first.
SHARED = (20, 4)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), SHARED)


ORACLE = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, crc AS h FROM (SELECT DISTINCT conv_id, (WITH RECURSIVE r(i, c) AS (SELECT 0, CAST(4294967295 AS BIGINT)
  UNION ALL SELECT i + 1, list_reduce([xor(c, CAST(ascii(substr(CAST(conv_id AS VARCHAR), i + 1, 1)) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN CAST(3988292384 AS BIGINT) ELSE CAST(0 AS BIGINT) END)) FROM r WHERE i < length(CAST(conv_id AS VARCHAR)))
  SELECT xor(c, CAST(4294967295 AS BIGINT)) % 4 FROM r ORDER BY i DESC LIMIT 1) AS crc FROM t)),
k AS (SELECT conv_id, base, h, least(h, coalesce(n, 0)) AS k FROM h LEFT JOIN (SELECT conv_id AS base, count(*) AS n FROM t GROUP BY 1) b USING (base)),
r AS (SELECT k.conv_id, nth AS depth, role, text FROM k JOIN t ON t.conv_id = k.base AND nth <= h
      UNION ALL SELECT k.conv_id, nth - h + k, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND nth > h),
d AS (SELECT conv_id, depth, role || chr(1) || length(role) || chr(1) || text AS said, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
      UNION ALL SELECT conv_id, 0, '', 0 FROM h),
p AS (SELECT *, sha256(string_agg(sha256(said), '/') OVER (PARTITION BY conv_id ORDER BY depth)) AS pfx, max(depth) OVER (PARTITION BY conv_id) AS ends_at FROM d),
n AS (SELECT pfx, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
             coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends_at = depth), '') AS ends FROM p GROUP BY pfx, depth),
u AS (SELECT n.pfx, p.pfx AS up, m.conv_id AS parent FROM n JOIN p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN n m ON m.pfx = p.pfx AND m.depth = p.depth),
c AS (SELECT up AS pfx, count(*) AS n_children FROM u GROUP BY up),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, parent FROM n LEFT JOIN c USING (pfx) LEFT JOIN u USING (pfx)),
s AS (SELECT p.pfx, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved FROM f JOIN p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.pfx)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256 FROM f JOIN s USING (pfx)
"""
