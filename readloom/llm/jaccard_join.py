"""N-gram Jaccard self-join of documents: a size-aware heavy-light join, exact at its threshold.

A document is its set of distinct five-word shingles, as 64-bit hashes. Documents with one and the same set
are one class; classes are told apart by a 128-bit digest of the set: 64 bits are the class's name, and the few
classes whose names meet under different second halves take the second half as their name. Two classes link at a Jaccard
similarity of 0.8 or more. Classes of at most B shingles are joined by enumerating fixed-size subsets: if
two of them overlap in c, they meet in a common c-subset, and there 9c >= 4 (n + m) is the link condition
itself. Larger ones scan inverted lists, of their own prefixes and those of the small ones that can still
reach them in size. B is where enumerating costs more rows than scanning, from the histogram of set sizes.

Elements are ordered light before heavy: those found often come last, so lists of common passages are short but
for documents made of nothing else. What is often within some tasks is known from a first pass; what is not, but
makes a long list over all tasks, is known from the exact lengths of the lists, and the lists are then made again.
Within lists that stay long, of whatever kind, first a few leaders are compared with all members and linked
classes become one. Then only lists with several components are looked at, long ones in salted pieces, and of their
pairs those of different components whose places in the list still allow the link; what their prefixes
have in common bounds their overlap from above once more. Pairs that can still link are verified on whole
sets. So no group is expanded into all its pairs, and no link between components is lost. jaccard_links leaves the
leaders out and returns every link between classes.

Defined results: a null or empty text has no shingles and is linked with nothing; fewer than five words
count as one shingle; repeated rows are in one class; null ids are never the smallest; an empty table
gives an empty result; texts are never cut; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import discard, documents, materialize, ship
from readloom.llm.graph import components, joined

SHINGLE = 5
#: Elements in the broadcast list of heavy ones, at most (8 bytes each), and their least count.
MAX_HEAVY, LEAST_HEAVY = 1_000_000, 6
#: A longer list is long; lists are made again for new heavy elements so many times at most (long ones that are left are handled as such).
LONG, AGAIN = 128, 2
#: Salts of a heavy list; rows of a list that are paired in one piece; rounds of leaders, and leaders of a list in each.
SALTS, TOGETHER, ROUNDS, LEADERS = 64, 4096, 2, 2
#: Rows that scanning a list costs for each row that enumerating a subset costs.
SCAN_COST = 3
#: Bytes hashed at a time.
BLOCK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            factors = np.full(n, base, np.uint64)
            factors[0] = 1
            _powers[k] = np.cumprod(factors)
    return _powers[0], _powers[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its first byte): differences of a running sum over bytes times powers of a base."""
    hashes, firsts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        stop = at + BLOCK
        if stop < len(raw):  # a block ends where a word does
            found = [i for i in (raw.find(c, stop) for c in b" \n\t\r\x0b\x0c") if i >= 0] if not _SPACE[raw[stop]] else [stop]
            stop = min(found, default=len(raw))
        a = np.frombuffer(raw[at:stop], np.uint8)
        word = ~_SPACE[a]
        edge = np.diff(word.view(np.int8), prepend=0, append=0)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _power(max(BLOCK, len(a) + 1))
        total = np.concatenate(([np.uint64(0)], np.cumsum(_BYTE[a] * up[: len(a)])))
        hashes.append(_mixed((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64)))
        firsts.append(first + at)
        at = stop
    return np.concatenate(hashes), np.concatenate(firsts)


def shingles(texts: list[str | None], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    raws = [(x or "").encode().lower() for x in texts]
    h, first = word_hashes(b"\n".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    at = np.concatenate(([0], np.searchsorted(first, ends)))
    rolled = h[: max(0, len(h) - width + 1)] * _MIX
    for k in range(1, width):
        rolled = (rolled ^ (rolled >> np.uint64(29))) * _MIX + h[k : len(h) - width + 1 + k]
    rolled = _mixed(rolled)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            x = np.sort(rolled[a : b - width + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        else:
            out.append(np.array([xxhash.xxh3_64_intdigest(h[a:b].tobytes(), seed=width)] if b > a else [], np.uint64))
    return out


def digest(shingle_set: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """(name, second half) of a set; fewer bits of the name are for tests."""
    both = xxhash.xxh3_128_intdigest(shingle_set.tobytes())
    return (both & ((1 << bits) - 1)) - (1 << 63), (both >> 64) - (1 << 63)


class Names:
    """Names of sets: the first half of their digest, or the second where the first has several owners."""

    def __init__(self, shared: list[int] | None = None, bits: int = 64):
        self.shared, self.bits = frozenset(shared or ()), bits

    def __call__(self, shingle_set: np.ndarray) -> int:
        name, second = digest(shingle_set, self.bits)
        return second if name in self.shared else name


def needed(n):  # noqa: ANN001, ANN201
    """Least overlap with any partner, of a set of n."""
    return (4 * n + 4) // 5


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            yield part, shingles(part.column(part.num_columns - 1).to_pylist())


def _survey(bits: int):  # noqa: ANN202
    """kind 0: (id, set size, both halves of the digest, hash of the text) of each row; kind 1: (element, its count here) of those found twice or more among a task's texts."""
    names = ["kind", "a", "n", "sig", "second", "text_hash"]

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        keys, counts = keys[counts > 1].view(np.int64), counts[counts > 1]
        zero = pa.array(np.zeros(len(keys), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(keys), np.int32)), pa.array(keys), pa.array(counts), zero, zero, zero], names)

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part, sets in _slices(batches):
            halves = [digest(s, bits) for s in sets]
            sig, second = (pa.array([h[k] for h in halves], pa.int64()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), part.column(0), pa.array([len(s) for s in sets], pa.int64()), sig, second, part.column(1)], names)
            held += sets
            if sum(map(len, held)) > 4_000_000:
                yield frequent(held)
                held = []
        if held:
            yield frequent(held)

    return survey


def boundary(sizes: dict[int, int], largest: int = 16) -> int:
    """The largest set that is enumerated, by cost; sizes: number of sets by size."""
    subsets = lambda n: sum(comb(n, i) for i in range(n - needed(n) + 1))
    scan = lambda n: SCAN_COST * (n - needed(n) + 1)
    cost = lambda b: sum(k * ((subsets(n) if n <= b else 0) + (scan(n) if n > b or 5 * n >= 4 * (b + 1) else 0)) for n, k in sizes.items())
    return min(range(largest + 1), key=cost)


def _postings(heavy: np.ndarray, small: int, name: Names):  # noqa: ANN202
    """Rows (kind, key, sig, n, pos) of each different set in the task."""
    names = ["kind", "key", "sig", "n", "pos"]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys_sorted = np.sort(heavy)
        seen: set[int] = set()
        for _, sets in _slices(batches):
            out: list[tuple] = []
            for s in sets:
                n = len(s)
                sig = name(s)
                if not n or sig in seen:
                    continue
                seen.add(sig)
                if n <= small:
                    subs = [(xxhash.xxh3_64_intdigest(np.array(c, np.uint64).tobytes(), seed=1), len(c)) for k in range(needed(n), n + 1) for c in combinations(s.tolist(), k)]
                    out.append((np.full(len(subs), 2, np.int32), np.array([x for x, _ in subs], np.uint64), sig, n, np.array([c for _, c in subs], np.int32)))
                if n > small or 5 * n >= 4 * (small + 1):
                    is_heavy = np.zeros(n, bool)
                    if len(keys_sorted):
                        is_heavy = keys_sorted[np.minimum(np.searchsorted(keys_sorted, s), len(keys_sorted) - 1)] == s
                    order = np.argsort(is_heavy, kind="stable")[: n - needed(n) + 1]
                    out.append((is_heavy[order].astype(np.int32), s[order], sig, n, np.arange(len(order), dtype=np.int32)))
            if out:
                size = [len(x[1]) for x in out]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([x[0] for x in out])), pa.array(np.concatenate([x[1] for x in out]).view(np.int64)),
                    pa.array(np.repeat(np.array([x[2] for x in out], np.int64), size)), pa.array(np.repeat(np.array([x[3] for x in out], np.int32), size)), pa.array(np.concatenate([x[4] for x in out])),
                ], names)

    return post


def _sets(docs: DataFrame, wanted: DataFrame, classes: DataFrame, name: Names) -> DataFrame:
    """(sig, elements) of the wanted classes, read again from one document of each."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _slices(batches):
            at = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            values = pa.array(np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([name(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(at), values)], ["sig", "elements"])

    of = classes.join(wanted, "sig", "left_semi").select(F.col("first").alias("of"))
    texts = docs.join(of, docs.id.eqNullSafe(of.of), "left_semi").select("body")
    found = texts.mapInArrow(gather, "sig long, elements array<long>")
    return materialize(found.join(wanted, "sig", "left_semi").dropDuplicates(["sig"]), "jaccard-sets")


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, name: Names) -> DataFrame:
    """Those of the pairs (a, b) that link, by their whole sets."""
    pairs = materialize(pairs, "jaccard-pairs")
    if pairs.isEmpty():
        return pairs
    sets = _sets(docs, pairs.select(F.col("a").alias("sig")).union(pairs.select("b")).distinct(), classes, name)
    left, right = (sets.select(F.col("sig").alias(k), F.col("elements").alias(f"in_{k}")) for k in "ab")
    both = F.size(F.array_intersect("in_a", "in_b"))
    linked = pairs.join(left, "a").join(right, "b").where(100 * both >= 80 * (F.size("in_a") + F.size("in_b") - both))
    links = materialize(linked.select("a", "b"), "jaccard-links")
    discard(pairs, sets)
    return links


class _Join(NamedTuple):
    """Rows (id, text_hash, body), what is known of each (id, text_hash, n_shingles, sig), classes (sig, first, n), lists (kind, key, sig, n, pos, times)."""

    rows: DataFrame
    own: DataFrame
    classes: DataFrame
    lists: DataFrame
    small: int
    name: Names


def _lists(docs: DataFrame, id_col: str, text_col: str, bits: int, long_: int) -> _Join:
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).alias("body"))
    survey = materialize(rows.mapInArrow(_survey(bits), "kind int, a long, n long, sig long, second long, text_hash long"), "jaccard-survey")
    own = survey.where("kind = 0").select(F.col("a").alias("id"), "text_hash", F.col("n").alias("n_shingles"), "sig", "second")
    # names with several owners: at 10**11 classes some 300 are expected
    shared = [r.sig for r in own.groupBy("sig").agg(F.min("second").alias("lo"), F.max("second").alias("hi")).where("lo != hi").select("sig").collect()]
    name = Names(shared, bits)
    own = own.withColumn("sig", F.when(F.col("sig").isin(shared), F.col("second")).otherwise(F.col("sig")) if shared else F.col("sig")).drop("second")
    classes = materialize(own.where("n_shingles > 0").groupBy("sig").agg(F.min("id").alias("first"), F.first("n_shingles").alias("n")), "jaccard-classes")
    sizes = dict(map(tuple, classes.where("n <= 20").groupBy("n").count().collect()))
    small = boundary(sizes)
    counted = materialize(survey.where("kind = 1").groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_HEAVY), "jaccard-counts")
    least = LEAST_HEAVY
    while counted.where(F.col("n") >= least).count() > MAX_HEAVY:
        least *= 2
    elements = lambda d: d.toPandas().iloc[:, 0].to_numpy(np.int64).view(np.uint64)
    heavy = elements(counted.where(F.col("n") >= least).select("a"))
    for again in range(AGAIN + 1):
        posted = rows.select("body").mapInArrow(_postings(heavy, small, name), "kind int, key long, sig long, n int, pos int")
        salted = posted.withColumn("salt", F.when(F.col("kind") == 1, F.pmod("sig", F.lit(SALTS))).otherwise(0))
        counts = salted.withColumn("times", F.count("*").over(W.partitionBy("key", "salt"))).where("kind = 1 OR times > 1")
        lists = materialize(counts.drop("salt"), "jaccard-lists")
        # light elements of long lists, over all tasks
        more = lists.where((F.col("kind") == 0) & (F.col("times") > long_)).select("key").distinct()
        n = more.count() if again < AGAIN else 0
        if not n or len(heavy) + n > MAX_HEAVY:
            return _Join(rows, own, classes, lists, small, name)
        heavy = np.concatenate((heavy, elements(more)))
        discard(lists)


def _candidates(join: _Join, labels: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of classes, of different components if labels (v, label) are given, that their lists allow to link."""
    scan = join.lists.where("kind < 2")
    placed = scan.select("key", "sig", "n", (F.col("n") - F.col("pos")).alias("rest"))
    if labels is None:
        placed = placed.withColumn("label", F.col("sig"))
    else:
        placed = placed.join(labels.withColumnRenamed("v", "sig"), "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    placed = materialize(placed, "jaccard-placed")
    # lists of one component alone have no such pair; long lists are paired piece by piece
    several = placed.groupBy("key").agg(F.count("*").alias("rows"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi")
    pieces = several.select("key", F.ceil(F.col("rows") / TOGETHER).cast("int").alias("pieces"))
    met = placed.join(pieces, "key")
    piece: dict[str, Column] = {"x": F.pmod("sig", "pieces").cast("int"), "y": F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))}
    x, y = (met.withColumn("piece", piece[k]).select("key", "piece", *[F.col(c).alias(f"{c}_{k}") for c in ("sig", "n", "rest", "label")]) for k in "xy")
    can = F.expr("label_x != label_y AND (n_x < n_y OR n_x = n_y AND sig_x < sig_y) AND 5 * n_x >= 4 * n_y AND 9 * least(rest_x, rest_y) >= 4 * (n_x + n_y)")
    pairs = materialize(x.join(y, (x.key == y.key) & (x.piece == y.piece) & can & (F.col("n_y") > join.small)).select("sig_x", "n_x", "sig_y", "n_y").distinct(), "jaccard-met")
    held = scan.join(pairs.select(F.col("sig_x").alias("sig")).union(pairs.select("sig_y")).distinct(), "sig", "left_semi").groupBy("sig").agg(F.collect_list("key").alias("keys"))
    held = materialize(held, "jaccard-prefixes")
    left, right = (held.select(F.col("sig").alias(f"sig_{k}"), F.col("keys").alias(f"keys_{k}")) for k in "xy")
    # what isn't common in both prefixes lies beyond the prefix of one of the two
    most = F.size(F.array_intersect("keys_x", "keys_y")) + F.expr("greatest((4 * n_x + 4) div 5, (4 * n_y + 4) div 5) - 1")
    cross = pairs.join(left, "sig_x").join(right, "sig_y").where(9 * most >= 4 * (F.col("n_x") + F.col("n_y")))
    return cross.select(F.col("sig_x").alias("a"), F.col("sig_y").alias("b"))


def _labelled(join: _Join, long_: int) -> DataFrame:
    """own with component_id."""
    # small sets: all that link in a subset's list link with the smallest set in it
    subsets = join.lists.where("kind = 2")
    smallest = subsets.groupBy("key").agg(F.min(F.struct("n", "sig")).alias("m"))
    met = subsets.join(smallest, "key").where((F.col("sig") != F.col("m.sig")) & (9 * F.col("pos") >= 4 * (F.col("n") + F.col("m.n"))))
    labels = components(met.select(F.col("m.sig").alias("a"), F.col("sig").alias("b")).distinct())

    # long lists: leaders first
    long_lists = join.lists.where((F.col("kind") == 1) | (F.col("kind") == 0) & (F.col("times") > long_)).withColumn("again", F.xxhash64("key"))
    for r in range(ROUNDS):
        members = long_lists.join(labels.withColumnRenamed("v", "sig"), "sig", "left").select("key", "again", "sig", "n", F.coalesce("label", "sig").alias("label"))
        lead = F.array(*[F.min_by(F.struct("sig", "n", "label"), F.xxhash64("sig", "key", F.lit(r * LEADERS + k))) for k in range(LEADERS)])
        leaders = members.groupBy("key", "again").agg(lead.alias("m")).select("key", "again", F.explode(F.array_distinct("m")).alias("m"))
        low, high = F.least(F.col("n"), F.col("m.n")), F.greatest(F.col("n"), F.col("m.n"))
        near = members.join(leaders, ["key", "again"]).where((F.col("label") != F.col("m.label")) & (5 * low >= 4 * high) & (high > join.small))
        star = near.select(F.least("sig", "m.sig").alias("a"), F.greatest("sig", "m.sig").alias("b")).distinct()
        labels = materialize(joined(labels, _verified(star, join.rows, join.classes, join.name)), "labels")

    # then pairs of different components
    labels = joined(labels, _verified(_candidates(join, labels), join.rows, join.classes, join.name)).withColumnRenamed("v", "sig")
    named = join.classes.join(labels, "sig", "left").select("sig", "first", F.coalesce("label", "sig").alias("label"))
    least_id = named.groupBy("label").agg(F.min("first").alias("component"))
    named = named.join(least_id, "label").select("sig", F.xxhash64("sig").alias("again"), "component")
    out = join.own.withColumn("again", F.xxhash64("sig")).join(named, ["sig", "again"], "left")
    return out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, long_: int = LONG) -> DataFrame:
    """(id, n_shingles, component_id) of every row: the smallest id that links reach from it, its own included."""
    return _labelled(_lists(docs, id_col, text_col, bits, long_), long_).select("id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, long_: int = LONG) -> tuple[DataFrame, DataFrame]:
    """(links (a, b) between classes, every one once with a < b; members (id, class) of every row with shingles)."""
    join = _lists(docs, id_col, text_col, bits, long_)
    subsets = join.lists.where("kind = 2").select("key", "sig", "n", "pos")
    x, y = (subsets.select("key", *[F.col(c).alias(f"{c}_{k}") for c in ("sig", "n", "pos")]) for k in "xy")
    few = x.join(y, "key").where("sig_x < sig_y AND 9 * pos_x >= 4 * (n_x + n_y)").select(F.col("sig_x").alias("a"), F.col("sig_y").alias("b"))
    more = _verified(_candidates(join, None), join.rows, join.classes, join.name)
    links = few.union(more.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    return links, join.own.where("n_shingles > 0").select("id", F.col("sig").alias("class"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, of each component only the document with the smallest id.

    Rows are told apart by id and text: of rows that share an id only those that are in a component under a smaller
    one go. A row without an id goes if its component has an id; components without any id stay whole.
    """
    found = _labelled(_lists(docs, id_col, text_col, 64, LONG), LONG)
    gone = found.where(~F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone.gone_id) & (F.xxhash64(docs[text_col].cast("string")) == gone.gone_hash), "left_anti")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


#: All pairs with a common shingle, counted; fit for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
      ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT q.b, r.c FROM r JOIN q ON r.v = q.a)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, min(r.c) AS component_id FROM s JOIN r ON s.doc_id = r.v GROUP BY s.doc_id, g
"""
