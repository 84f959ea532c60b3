"""Sharding by minimax contiguous partition (DataFrame functions only).

Groups of equal texts are atomic and stand in the order of their digests. The smallest feasible shard
capacity over the ordered group sizes is found by binary search, each candidate checked greedily, and
the shards are cut there. The greedy check needs, for a target, the last group end below it. The
driver holds no list of groups: it asks Spark for at most `resolution` cells (first and last group end
of each), searches with lower and upper bounds, and has only the cells around the cuts split further,
until the cuts are exact. A group over the mean of what is left gets a shard of its own first.

Defined results: a null text counts as empty; its size is the overhead alone; a null id is one more
id; repeated rows are rows of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import documents, materialize, text_or_empty

#: Pieces that a group is dealt in by the ids' hashes (256 at most), so that no task holds all copies of a text.
SALTS = 256


class Ends:
    """Ends of the groups in order, as far as known: points, and which gaps between them may hide more."""

    def __init__(self, total: int):
        self.points, self.open = [0, total], [True]

    def around(self, x: int) -> tuple[int, int]:
        """Bounds of the last end that is x or less."""
        i = bisect.bisect_right(self.points, x) - 1
        if i >= len(self.open) or not self.open[i]:
            return self.points[i], self.points[i]
        return self.points[i], x

    def windows(self, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Gaps that still hide ends within these spans, neighbours put together."""
        found: list[tuple[int, int]] = []
        for lo, hi in sorted(spans):
            i = max(0, bisect.bisect_right(self.points, lo) - 1)
            while i < len(self.open) and self.points[i] <= hi:
                if self.open[i]:
                    if found and found[-1][1] >= self.points[i]:
                        found[-1] = (found[-1][0], max(found[-1][1], self.points[i + 1]))
                    else:
                        found.append((self.points[i], self.points[i + 1]))
                i += 1
        return found

    def refine(self, windows: list[tuple[int, int]], cells: list[tuple[int, int, int]]) -> None:
        """cells: (first end, last end, number of ends) within the windows, in order."""
        gaps = {a: o for a, o in zip(self.points, self.open, strict=False) if o}
        known = set(self.points)
        for lo, hi in windows:
            for a in [a for a in gaps if lo <= a < hi]:
                del gaps[a]
        for first, last, n in cells:
            known |= {first, last}
            if n > 2:
                gaps[first] = True
        self.points = sorted(known)
        self.open = [p in gaps for p in self.points[:-1]]


def _greedy(ends: Ends, capacity: int, shards: int, side: int) -> list[int]:
    """Cuts that the greedy check makes, by the lower (0) or upper (1) bound of each."""
    cuts, at = [], 0
    for _ in range(shards):
        at = ends.around(min(at + capacity, ends.points[-1]))[side]
        cuts.append(at)
    return cuts


def _first(lo: int, hi: int, holds) -> int:
    """The smallest value from lo to hi for which holds() is true; it is for hi."""
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if holds(mid) else (mid + 1, hi)
    return lo


def minimax_cuts(ask, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """(capacity, cuts): ask(windows) gives the cells of the windows, or of everything."""
    ends = Ends(total)
    least = max(largest, -(-total // shards))
    spans = [(0, total)]
    while spans:
        ends.refine(spans, ask(spans))
        surely = _first(least, least + largest, lambda c: _greedy(ends, c, shards, 0)[-1] == total)
        maybe = _first(least, surely, lambda c: _greedy(ends, c, shards, 1)[-1] == total)
        spans = ends.windows(list(zip(_greedy(ends, maybe, shards, 0), _greedy(ends, surely, shards, 1), strict=True)))
        if surely == maybe and _greedy(ends, surely, shards, 0) == _greedy(ends, surely, shards, 1):
            break
    return surely, _greedy(ends, surely, shards, 0)


def shard_documents(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8, salts: int = SALTS, buckets: int = 4096, resolution: int = 32768) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    body = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    rows = body.select(
        "id", (F.octet_length("body") + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode("body", "UTF-8")).alias("text_crc32"),
        F.unhex(F.sha2("body", 256)).alias("gid"), F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, 2), 16, 10).cast("int"), F.lit(salts)).alias("salt"),
    )
    bucket = F.pmod(F.conv(F.hex(F.substring("gid", 1, 4)), 16, 10).cast("long"), F.lit(1 << 32)) * buckets / (1 << 32)
    pieces = rows.groupBy("gid", "salt").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).withColumn("bucket", F.floor(bucket).cast("int"))
    in_order, group = W.partitionBy("bucket").orderBy("gid", "salt"), W.partitionBy("bucket", "gid")
    pieces = (
        pieces.withColumn("end", F.sum("bytes").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("before", F.sum("n").over(in_order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
        .withColumn("g_end", F.max("end").over(group)).withColumn("g_bytes", F.sum("bytes").over(group)).withColumn("g_n", F.sum("n").over(group))
        .withColumn("head", F.row_number().over(group.orderBy("salt")) == 1)
    )
    pieces = materialize(pieces.drop("bytes", "n", "end"), "shard-pieces")
    sums = pieces.where("head").groupBy("bucket").agg(F.sum("g_bytes").alias("b_bytes"), F.sum("g_n").alias("b_n"))
    prior = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # a row for each of the fixed buckets
    offsets = sums.select("bucket", F.coalesce(F.sum("b_bytes").over(prior), F.lit(0)).alias("o_bytes"), F.coalesce(F.sum("b_n").over(prior), F.lit(0)).alias("o_n"))
    pieces = pieces.join(F.broadcast(offsets), "bucket").select("gid", "salt", "head", "g_bytes", "g_n", (F.col("g_end") + F.col("o_bytes")).alias("g_end"), (F.col("before") + F.col("o_n")).alias("before"))
    pieces = materialize(pieces, "shard-placed")

    heads = pieces.where("head")
    total = heads.agg(F.sum("g_bytes")).first()[0]
    if total is None:
        return _placed(rows, pieces.withColumn("shard", F.lit(0)).withColumn("first", F.lit(0).cast("long")))
    top = heads.orderBy(F.desc("g_bytes"), "gid").limit(n_shards).select("g_bytes", "g_end").collect()
    alone, left = [], total
    for g in top:  # groups larger than an even share of what is left
        if len(alone) < n_shards - 1 and g.g_bytes * (n_shards - len(alone)) > left:
            alone.append(g)
            left -= g.g_bytes
    rest = top[len(alone) :]
    end = F.col("g_end") - reduce(add, (F.when(F.col("g_end") >= g.g_end, g.g_bytes).otherwise(0) for g in alone), F.lit(0))
    own = reduce(lambda e, i: e.when(F.col("g_end") == alone[i].g_end, n_shards - 1 - i), range(1, len(alone)), F.when(F.col("g_end") == alone[0].g_end, n_shards - 1)) if alone else F.lit(None).cast("int")
    cuts: list[int] = []
    if rest:
        others = materialize(heads.select(end.alias("end"), own.alias("own")).where("own IS NULL").select("end"), "shard-ends")

        def ask(spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
            per = max(1, resolution // len(spans))
            from_, to, width = (F.array(*[F.lit(x).cast("long") for x in xs]) for xs in ([lo for lo, _ in spans], [hi for _, hi in spans], [max(1, -(-(hi - lo) // per)) for lo, hi in spans]))
            placed = others.withColumn("k", F.size(F.filter(from_, lambda lo: lo < F.col("end")))).where("k > 0").withColumns({"lo": F.element_at(from_, F.col("k")), "hi": F.element_at(to, F.col("k")), "width": F.element_at(width, F.col("k"))})
            found = placed.where("end <= hi").groupBy("k", F.expr("(end - lo - 1) div width")).agg(F.min("end").alias("a"), F.max("end").alias("z"), F.count("*").alias("n")).select("a", "z", "n").toPandas()
            return sorted(found.itertuples(index=False, name=None))

        cuts = minimax_cuts(ask, left, rest[0].g_bytes, n_shards - len(alone))[1]
    inner = sorted(set(cuts))[:-1]
    placed = pieces.withColumn("shard", F.coalesce(own, reduce(add, (F.when(end > c, 1).otherwise(0) for c in inner), F.lit(0))).cast("int"))
    # within a shard, rows stand in the groups' order; groups with a shard of their own don't count for the others
    before = F.col("before") - reduce(add, (F.when(own.isNull() & (F.col("g_end") > g.g_end), g_n).otherwise(0) for g, g_n in zip(alone, _sizes(heads, alone), strict=True)), F.lit(0))
    placed = placed.withColumn("before", before)
    firsts = placed.groupBy("shard").agg(F.min("before").alias("first"))
    return _placed(rows, placed.join(F.broadcast(firsts), "shard"))


def _sizes(heads: DataFrame, alone: list) -> list[int]:
    """Rows of the few groups that have a shard of their own."""
    if not alone:
        return []
    n = {r.g_end: r.g_n for r in heads.where(F.col("g_end").isin([g.g_end for g in alone])).select("g_end", "g_n").collect()}
    return [n[g.g_end] for g in alone]


def _placed(rows: DataFrame, pieces: DataFrame) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("gid", "salt").orderBy("id", "size")) - 1
    out = rows.withColumn("rank", rank).join(pieces.select("gid", "salt", "shard", (F.col("before") - F.col("first")).alias("from")), ["gid", "salt"])
    return out.select("id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("from") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


#: The same for 24 shards, with a fold over whole lists for each candidate capacity and for checksums.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, sha256(coalesce(text, '')) AS gid, octet_length(encode(coalesce(text, ''))) + 8 AS size FROM documents),
h AS (SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
v AS (SELECT gid, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INT) + 1])), 4294967295) AS crc FROM (SELECT gid, any_value(b) AS b FROM d GROUP BY gid), h),
g AS (SELECT gid, CAST(sum(size) AS BIGINT) AS bytes, row_number() OVER (ORDER BY sum(size) DESC, gid) AS r FROM d GROUP BY gid),
l AS (SELECT *, (SELECT CAST(sum(bytes) AS BIGINT) FROM g) - coalesce(sum(bytes) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_ FROM g),
alone AS (SELECT gid, r FROM l WHERE r < coalesce((SELECT min(r) FROM l WHERE NOT (r < 24 AND bytes * (25 - r) > left_)), 1 << 40)),
s AS (SELECT gid, bytes, row_number() OVER (ORDER BY gid) AS k FROM g WHERE gid NOT IN (SELECT gid FROM alone)),
c AS (SELECT list([0, bytes] ORDER BY k) AS sizes, max(bytes) AS largest, CAST(sum(bytes) AS BIGINT) AS total, 24 - (SELECT count(*) FROM alone) AS n FROM s),
q AS (SELECT greatest(largest, (total + n - 1) // n) AS lo, greatest(largest, (total + n - 1) // n) + largest AS hi FROM c
  UNION ALL SELECT CASE WHEN fits THEN lo ELSE mid + 1 END, CASE WHEN fits THEN mid ELSE hi END FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, list_reduce(list_prepend([1, (lo + hi) // 2], sizes), lambda a, x: CASE WHEN x[2] > a[2] THEN [a[1] + 1, (lo + hi) // 2 - x[2]] ELSE [a[1], a[2] - x[2]] END)[1] <= n AS fits FROM q, c WHERE lo < hi)),
z AS (SELECT min(hi) AS capacity FROM q),
f AS (SELECT k, gid, 0 AS shard, (SELECT capacity FROM z) - bytes AS room FROM s WHERE k = 1
  UNION ALL SELECT s.k, s.gid, CASE WHEN s.bytes > room THEN shard + 1 ELSE shard END, CASE WHEN s.bytes > room THEN (SELECT capacity FROM z) ELSE room END - s.bytes FROM f JOIN s ON s.k = f.k + 1),
w AS (SELECT gid, shard FROM f UNION ALL SELECT gid, 24 - r FROM alone)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INT) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY gid, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 2), doc_id NULLS FIRST) - 1 AS slot, CAST(NULL AS INT) AS grown_shard FROM d JOIN w USING (gid) JOIN v USING (gid)
"""
