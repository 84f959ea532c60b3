"""Substring deduplication with merged Burrows-Wheeler transforms.

A byte goes if it lies in a string of 200 bytes that also starts anywhere else. The work is dealt out by
content: the smallest k-mer hash in a 200-byte window is the window's anchor, so equal windows share their
anchor and meet in one task; a run of windows with one anchor travels as one segment of text, and only
runs whose anchor comes up again travel at all. Equal segments are one string with several places.

In a task, segments are split into shards. A shard's multi-string transform is over symbols of 40 bytes
(each segment is forty interleaved strings of symbols, so every byte starts a suffix), its suffixes sorted
by the five symbols that make 200 bytes. The transforms of all shards are then merged by refining their
interleave: each round takes the preceding symbols in the present order and deals the places out by symbol,
stably, which sorts the merged suffixes by one symbol more. A boundary that first shows in round r tells
that the common prefix there has r - 1 symbols; after five rounds what has no boundary between is a repeated
interval. No suffix of one shard is compared with one of another. Symbol names are verified byte by byte.

Runs are counted by anchor with partial sums before any of them moves, so anchors that come up once never move
and hot ones are known: an anchor with very many runs is dealt out window by window, keyed by the whole window.
Copies of one text take part once, and go as a whole. Texts go by a 64-bit hash; those whose hash has several
owners by their SHA-256 go by another one.

Defined results: a null text counts as empty; texts under 200 bytes lose
nothing; repeated rows are copies of each other; null ids are kept; an empty table gives an empty
result; texts are processed whole, in overlapping blocks; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import discard, documents, materialize, ship, text_or_empty

WINDOW, SYMBOL, KMER = 200, 40, 64
#: Suffixes in a shard, and in the shards that a task merges at a time; bytes of text looked at at a time.
SHARD, MERGED, BLOCK = 600_000, 2_400_000, 1 << 22
#: An anchor with more runs is hot; the list of hot ones is total / HOT long at most.
HOT = 20_000
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = x * _B + y
    h ^= h >> np.uint64(29)
    h *= _A
    h ^= h >> np.uint64(32)
    return h


def _kmers(raw: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes (a power of two) from each place."""
    h = (raw.astype(np.uint64) + np.uint64(1)) * _A
    s = 1
    while s < k:
        h = _mixed(h[:-s], h[s:])
        s *= 2
    return h


def _sliding(h: np.ndarray, w: int, pick) -> np.ndarray:  # noqa: ANN001
    s = 1
    while 2 * s <= w:
        h = pick(h[:-s], h[s:])
        s *= 2
    return pick(h[: len(h) - w + s], h[w - s :]) if s < w else h


def anchors(raw: np.ndarray, window: int = WINDOW, k: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: (anchor, first window, number of windows, whether the anchor recurs within)."""
    found = []
    for at in range(0, max(0, len(raw) - window + 1), BLOCK):
        part = raw[at : at + BLOCK + window - 1]
        if len(part) < window:
            break
        h, w = _kmers(part, k), window - k + 1
        m = _sliding(h, w, np.minimum)
        first = np.flatnonzero(np.concatenate(([True], m[1:] != m[:-1])))
        # a place holds an anchor if some window over it has its hash as the least
        padded = np.concatenate((np.zeros(w - 1, np.uint64), m, np.zeros(w - 1, np.uint64)))
        held = h[_sliding(padded, w, np.maximum) == h]
        twice = held[1:][held[1:] == held[:-1]]
        found.append((m[first], first + at, np.diff(first, append=len(m)), np.isin(m[first], twice)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))


def _stable(keys: np.ndarray) -> np.ndarray:
    """Stable order of 32-bit keys: two radix passes."""
    low = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((keys[low] >> 16).astype(np.uint16), kind="stable")] if len(keys) and keys.max() > 0xFFFF else low


def _symbols(raw: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """A number from 1 on for the 40 bytes from each valid place, equal if and only if the bytes are; 0 elsewhere."""
    b = np.concatenate((raw, np.zeros(SYMBOL, np.uint8))).astype(np.uint64)
    for s in (1, 2, 4):
        b = b[:-s] | (b[s:] << np.uint64(8 * s))
    words = [b[8 * t : 8 * t + len(raw)] for t in range(SYMBOL // 8)]
    place = np.flatnonzero(valid)
    h = words[0][place]
    for x in words[1:]:
        h = _mixed(h, x[place])
    order = np.argsort(h)
    p = place[order]
    new = np.diff(h[order]) != 0
    if any((~new & (x[p[1:]] != x[p[:-1]])).any() for x in words):  # one hash for several strings
        p = place[np.lexsort([x[place] for x in words])]
        new = np.logical_or.reduce([x[p[1:]] != x[p[:-1]] for x in words])
    out = np.zeros(len(raw), np.uint32)
    out[p] = np.concatenate(([1], 1 + np.cumsum(new)))[: len(p)]
    return out


class Shard:
    """The transform of some strings: their suffixes in order of `depth` symbols, and the symbol before each."""

    def __init__(self, symbol: np.ndarray, first: np.ndarray, last: np.ndarray, start: int, stop: int, depth: int):
        at = np.arange(start, stop)
        order = np.arange(len(at))
        for t in reversed(range(depth)):
            there = at + t * SYMBOL
            key = np.where(there <= last[at], symbol[np.minimum(there, len(symbol) - 1)], 0)
            order = order[_stable(key[order])]
        self.suffixes = at[order]
        before = self.suffixes - SYMBOL
        self.transform = np.where(before >= first[self.suffixes], symbol[np.maximum(before, 0)], 0)


def merge_transforms(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes of all shards by their first `depth` symbols, symbols that each has in common with the one before, up to depth)."""
    source = np.repeat(np.arange(len(shards), dtype=np.uint16), [len(s.suffixes) for s in shards])
    transform = np.concatenate([s.transform for s in shards])
    block = np.zeros(len(source), np.int64)
    common = np.full(len(source), depth, np.int64)
    common[:1] = 0
    for done in range(depth):
        symbol = np.empty_like(transform)
        symbol[np.argsort(source, kind="stable")] = transform  # each shard's symbols in its own order, at its places
        order = _stable(symbol)
        source, symbol, block = source[order], symbol[order], block[order]
        border = np.concatenate(([True], (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1])))[: len(source)]
        block = np.cumsum(border)
        common[border & (common > done)] = done  # the first round that parts the two
        common[~border] = depth
    out = np.empty(len(source), np.int64)
    out[np.argsort(source, kind="stable")] = np.concatenate([s.suffixes for s in shards])
    return out, common


def repeated_windows(segments: list[bytes], window: int = WINDOW, shard: int = SHARD) -> list[np.ndarray]:
    """For each segment, which of its windows start anywhere else in the segments as well."""
    depth = window // SYMBOL
    size = np.array([len(s) for s in segments], np.int64)
    stop = np.cumsum(size + 1)  # a place more for the ends of the strings
    start = stop - size - 1
    raw = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    of = np.repeat(np.arange(len(segments)), size + 1)
    first, last = start[of], stop[of] - 1
    place = np.arange(len(raw))
    symbol = _symbols(raw, place + SYMBOL <= last)
    cuts = [0]
    for k, s in enumerate(stop):
        if s - cuts[-1] >= shard or k == len(stop) - 1:
            cuts.append(int(s))
    shards = [Shard(symbol, first, last, a, b, depth) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    suffixes, common = merge_transforms(shards, depth)
    same = common >= depth
    again = same.copy()
    again[:-1] |= same[1:]
    twice = np.zeros(len(raw), bool)
    twice[suffixes] = again
    twice &= place + window <= last
    return [twice[a : a + max(0, n - window + 1)] for a, n in zip(start, size, strict=True)]


def _ranges(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, seen = ["anchor", "sig", "at", "n", "self"], set()
    for batch in batches:
        for sig, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if sig in seen:
                continue
            seen.add(sig)
            a, at, n, again = anchors(np.frombuffer(text.as_py().encode(), np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(np.full(len(a), sig, np.int64)), pa.array(at, pa.int64()), pa.array(n, pa.int64()), pa.array(again)], names)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches put together, as each costs."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 20_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, text, runs) to (anchor, segment_id, segment, sig, at); of hot anchors each window on its own."""
    import xxhash

    names = ["anchor", "segment_id", "segment", "sig", "at"]
    out: list[tuple] = []
    for batch in batches:
        for sig, text, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = text.as_py().encode()
            for r in runs.as_py():
                spans = [(r["anchor"], r["at"], r["n"])] if not r["hot"] else [(None, i, 1) for i in range(r["at"], r["at"] + r["n"])]
                for anchor, at, n in spans:
                    segment = raw[at : at + n + WINDOW - 1]
                    key = xxhash.xxh3_64_intdigest(segment) - (1 << 63)
                    out.append((key if anchor is None else anchor, key, segment, sig, at))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names)
                out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, segment_id, segment, times), sorted by anchor, to (anchor, segment_id, ranges of windows that repeat)."""
    pair = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))

    def solved(held: list[tuple]) -> pa.RecordBatch:
        alone = {}
        for a, *_ in held:
            alone[a] = alone.get(a, 0) + 1
        # an anchor with one segment that comes up more than once: it repeats as a whole
        whole = [h[3] > 1 and alone[h[0]] == 1 for h in held]
        merged = iter(repeated_windows([h[2] for h, w in zip(held, whole, strict=True) if not w]) if not all(whole) else [])
        ranges = []
        for h, w in zip(held, whole, strict=True):
            flags = None if w else next(merged)
            n = len(h[2]) - WINDOW + 1
            ranges.append([(0, n)] if w or h[3] > 1 else _ranges(flags))
        rows = [(h[0], h[1], [{"lo": lo, "hi": hi} for lo, hi in r]) for h, r in zip(held, ranges, strict=True) if r]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pair), strict=True)], ["anchor", "segment_id", "ranges"])

    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size >= MERGED and row[0] != held[-1][0]:
                yield solved(held)
                held, size = [], 0
            held.append(row)
            size += len(row[2]) + 1
    if held:
        yield solved(held)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, whole, ranges of windows) to (id, n_bytes, kept bytes, spans removed)."""
    pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    names = ["id", "n_bytes", "kept", "spans"]
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            part = batch.slice(k, 256)
            rows = []
            for i, text, whole, ranges in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                raw, spans = text.encode(), []
                if whole and len(raw) >= WINDOW:
                    spans = [(0, len(raw))]
                else:
                    for lo, hi in sorted((r["lo"], r["hi"] + WINDOW - 1) for r in ranges or []):
                        if spans and lo <= spans[-1][1]:
                            spans[-1] = (spans[-1][0], max(hi, spans[-1][1]))
                        else:
                            spans.append((lo, hi))
                kept = b"".join(raw[a:b] for a, b in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(raw)], strict=True))
                rows.append((i, len(raw), kept, [{"start": a, "stop": b} for a, b in spans]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pair), strict=True)], names)


def _named(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows (id, body) with sig, texts (sig, first_id, copies, size))."""
    sha, shared = F.sha2("body", 256), []
    sig: Column = F.xxhash64("body") if bits == 64 else F.xxhash64("body").bitwiseAND(F.lit((1 << bits) - 1))
    for _ in range(2):
        named = rows.withColumn("sig", F.when(sig.isin(shared), F.xxhash64(F.lit(1), sha)).otherwise(sig) if shared else sig)
        per = named.select("id", "sig", F.octet_length("body").alias("size"), F.substring(sha, 1, 32).alias("sha")).groupBy("sig")
        texts = materialize(per.agg(F.min("id").alias("first_id"), F.count("*").alias("copies"), F.max("size").alias("size"), F.min("sha").alias("lo"), F.max("sha").alias("hi")), "suffix-texts")
        shared = [r.sig for r in texts.where("lo != hi").select("sig").collect()]  # some 300 of 10**11 texts
        if not shared:
            break
    else:
        raise RuntimeError("texts share both hashes")
    return named, texts.drop("lo", "hi")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, bits: int = 64) -> DataFrame:
    """(id, n_bytes, kept, spans) of every row: the bytes that stay, and the maximal runs that go. Fewer bits of a text's hash are for tests."""
    ship(docs.sparkSession)
    rows, texts = _named(docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("body")), bits)
    runs = rows.where(F.octet_length("body") >= WINDOW).select("sig", "body").mapInArrow(lambda b: _gathered(_runs(b)), "anchor long, sig long, at long, n long, self boolean")
    runs = materialize(runs, "suffix-anchors")
    place = F.xxhash64("sig", "at")
    twice = runs.groupBy("anchor").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.max("self").alias("self"), F.count("*").alias("runs")).where("self OR lo != hi")
    again = runs.drop("self").join(twice.select("anchor", (F.col("runs") > hot).alias("hot")), "anchor")
    by_text = materialize(again.groupBy("sig").agg(F.collect_set(F.struct("anchor", "at", "n", "hot")).alias("runs")), "suffix-runs")

    one = texts.join(by_text, "sig").select(F.col("sig").alias("of"), "first_id", "runs")
    found = rows.join(one, rows.id.eqNullSafe(one.first_id) & (rows.sig == one.of)).select("sig", "body", "runs")
    placed = materialize(found.mapInArrow(_segments, "anchor long, segment_id long, segment binary, sig long, at long"), "suffix-segments", compression="zstd")
    distinct = placed.groupBy("anchor", "segment_id", "segment").agg(F.count("*").alias("times"))
    discard(runs)
    size = placed.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    parts = max(8, -(-size // (2 * MERGED)))
    met = distinct.repartition(parts, "anchor").sortWithinPartitions("anchor")
    repeats = materialize(met.mapInArrow(_repeats, "anchor long, segment_id long, ranges array<struct<lo:int,hi:int>>"), "suffix-repeats")

    hits = placed.select("anchor", "segment_id", "sig", "at").join(repeats, ["anchor", "segment_id"])
    moved = F.transform("ranges", lambda r: F.struct((r.lo + F.col("at")).cast("long").alias("lo"), (r.hi + F.col("at")).cast("long").alias("hi")))
    marks = hits.select("sig", F.lit(False).alias("whole"), moved.alias("ranges"))
    none = F.lit(None).cast("array<struct<lo:long,hi:long>>")
    marks = marks.union(texts.where(f"copies > 1 AND size >= {WINDOW}").select("sig", F.lit(True), none))
    marks = marks.groupBy("sig").agg(F.max("whole").alias("whole"), F.flatten(F.collect_list("ranges")).alias("ranges")).withColumn("marked", F.xxhash64("sig"))
    out = rows.withColumn("marked", F.xxhash64("sig")).join(marks, ["sig", "marked"], "left").select("id", "body", F.coalesce("whole", F.lit(False)).alias("whole"), "ranges")
    return out.mapInArrow(_cut, "id long, n_bytes long, kept binary, spans array<struct<start:long,stop:long>>")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.stop - s.start)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All windows of 200 bytes, counted by digest; fit for small tables.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, encode(coalesce(text, '')) AS b FROM documents),
n AS (SELECT *, octet_length(b) AS n FROM d),
w AS (SELECT k, i, md5(b[i:i + 199]) AS h FROM (SELECT k, b, unnest(generate_series(1, n - 199)) AS i FROM n WHERE n >= 200)),
t AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY h) AS times FROM w) WHERE times > 1),
s AS (SELECT k, i, sum(CASE WHEN i - p <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS p FROM t)),
r AS (SELECT k, min(i) AS a, max(i) + 199 AS z FROM s GROUP BY k, run),
g AS (SELECT k, a, z, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM r),
m AS (SELECT g.k, count(*) AS n_spans, sum(z - a + 1) AS n_removed, list_reduce(list(b[before + 1:a - 1] ORDER BY a), lambda x, y: x || y) || b[max(z) + 1:any_value(n)] AS kept FROM g JOIN n USING (k) GROUP BY g.k, b)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(kept, b)) AS kept_sha256 FROM n LEFT JOIN m USING (k)
"""
