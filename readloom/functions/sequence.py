"""Sequence expressions: complement, counts, skew, rotation, k-mers."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.shipping import ship

#: Largest k: two bits a base in a signed 64-bit integer.
MAX_K = 31
#: Places of a text that are looked at together, and rows handed on together.
PIECE = 250_000


def revcomp(seq: Column, fix_t: bool = False) -> Column:
    """Reverse complement. A lower-case t stays as it is unless fix_t, other letters always."""
    return F.translate(F.reverse(seq), "ATGCacg" + "t" * fix_t, "TACGtgc" + "a" * fix_t)


def base_count(seq: Column, bases: str) -> Column:
    """Number of these letters in either case: a sum over single letters, which Spark counts once however often they are asked for."""
    one = lambda b: F.length(seq) - F.length(F.replace(F.replace(seq, F.lit(b.upper()), F.lit("")), F.lit(b.lower()), F.lit("")))
    return reduce(add, map(one, bases))


def base_counts(seq: Column) -> Column:
    """Struct of a, c, g, t, gc, at and okay (any of ACGT)."""
    return F.struct(*[base_count(seq, b).alias(k) for k, b in (("a", "A"), ("c", "C"), ("g", "G"), ("t", "T"), ("gc", "GC"), ("at", "AT"), ("okay", "ACGT"))])


def gc_fraction(seq: Column) -> Column:
    """Null without a base."""
    return F.try_divide(base_count(seq, "GC").cast("double"), base_count(seq, "ACGT"))


def gc_skew(seq: Column) -> Column:
    """(G - C) / (G + C), null without either."""
    return F.try_divide((base_count(seq, "G") - base_count(seq, "C")).cast("double"), base_count(seq, "GC"))


def rotate_left(seq: Column, shift: Column) -> Column:
    return F.concat(F.substring(seq, shift + 1, F.length(seq)), F.substring(seq, F.lit(1), shift))


def wrap(seq: Column, width: int = 80) -> Column:
    return F.regexp_replace(seq, f"(.{{{width}}})(?!$)", "$1\n")


def _letters(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _skews(letters: np.ndarray, window: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, skew of window + 1 letters from each, whether it has neither G nor C), for some PIECE places' letters at a time."""
    span = max(PIECE // step, 1) * step
    for at in range(0, max(len(letters) - window, 0), span):
        part = letters[at : at + span + window]
        pos = np.arange(0, min(span, len(part) - window), step)
        upto = [np.concatenate(([0], np.cumsum((part == ord(b)) | (part == ord(b.lower()))))) for b in "GC"]
        g, c = (x[pos + window + 1] - x[pos] for x in upto)
        none = g + c == 0
        yield at + pos, (g - c) / np.where(none, 1, g + c), none


def windows(df: DataFrame, key: str, seq: str, window: int, step: int) -> DataFrame:
    """(key, pos, skew, accum): skew of window + 1 letters from each step, and its running sum; letters without G or C add nothing. A text is one row, looked at piece by piece; operators.contigs has texts of several rows."""

    def skews(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                total = 0.0
                for pos, skew, none in _skews(_letters(text.as_py() or ""), window, step):
                    accum = np.cumsum(np.concatenate(([total], np.where(none, 0.0, skew))))[1:]
                    total = accum[-1]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(pos), k))), pa.array(pos, pa.int32()), pa.array(skew, mask=none), pa.array(accum)], [key, "pos", "skew", "accum"])

    ship(df.sparkSession)
    rows = df.select(key, F.col(seq).alias("letters"))
    return rows.mapInArrow(skews, f"`{key}` {rows.schema[key].dataType.simpleString()}, pos int, skew double, accum double")


def least_skew(df: DataFrame, key: str, seq: str, window: int, step: int, allowed: DataFrame | None = None) -> DataFrame:
    """(key, shift): the first place of the least running skew; 0 for keys that aren't allowed."""
    low = windows(df, key, seq, window, step).groupBy(key).agg(F.min(F.struct(F.round("accum", 9), "pos")).alias("m")).select(key, F.col("m.pos").alias("shift"))
    if allowed is None:
        return low
    return low.join(allowed.select(key).withColumn("ok", F.lit(True)), key, "left").select(key, F.when(F.col("ok"), F.col("shift")).otherwise(0).alias("shift"))


def _starts(codes: np.ndarray, k: int) -> np.ndarray:
    """Places where a k-mer is read: another letter than ACGT ends a stretch of them, and the k letters after it are passed over, whatever they are."""
    others, runs, at = np.flatnonzero(codes > 3).tolist(), [], 0
    n = 0
    while n < len(others):
        runs.append((at, others[n]))
        at = others[n] + k + 1
        n = bisect.bisect_left(others, at, n)
    runs.append((at, len(codes)))
    first, stop = np.array(runs, np.int64).T
    size = np.maximum(stop - first - k + 1, 0)
    return np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())


def _packed(codes: np.ndarray, k: int, reverse: bool) -> np.ndarray:
    """Two bits a letter of the k letters from each place: in order, or the complement backwards."""
    part, width = ((3 - codes) if reverse else codes).astype(np.int64), 1
    out, done = np.zeros(len(codes) + 1, np.int64), 0
    while k >> (width.bit_length() - 1):  # widths double; those that k has bits of are put together
        if k & width:
            ahead = part[done:]
            out = out[: len(ahead)] | ahead << 2 * done if reverse else out[: len(ahead)] << 2 * width | ahead
            done += width
        part, width = (part[:-width] | part[width:] << 2 * width if reverse else part[:-width] << 2 * width | part[width:]), 2 * width
    return out


def _alphabet() -> np.ndarray:
    """Codes of the letters by code point, 4 for others than ACGT."""
    code = np.full(128, 4, np.uint8)
    for i, b in enumerate("ACGT"):
        code[[ord(b), ord(b.lower())]] = i
    return code


def text_kmers(text: str, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes of their k letters and of the reverse complement, one after the other) of some PIECE places at a time."""
    codes = _alphabet()[np.minimum(_letters(text), 127)]
    starts = _starts(codes, k)
    for at in range(0, len(codes) - k + 1, PIECE):
        part = codes[at : at + PIECE + k - 1] & 3
        here = starts[slice(*np.searchsorted(starts, (at, at + PIECE)))]
        if len(here):
            yield here, np.stack((_packed(part, k, False)[here - at], _packed(part, k, True)[here - at]), 1).ravel()


def kmer_set(text: str | None, k: int, forward: bool = False) -> np.ndarray:
    """Different k-mers of a text in order, of both strands or of the forward one."""
    found = [both[::2] if forward else both for _, both in text_kmers(text or "", k)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _absent(words: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which words aren't among those, which are in order."""
    at = np.minimum(np.searchsorted(among, words), max(len(among) - 1, 0))
    return among[at] != words if len(among) else np.ones(len(words), bool)


def kmers(df: DataFrame, key: str, seq: str, k: int, other: str | None = None) -> DataFrame:
    """(key, pos, strand, kmer): two-bit codes of every k letters and of their reverse complement, pos where they start. After another letter than ACGT, k more are passed over unread. With other, a column of texts, those k-mers that the row's other text doesn't have."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k is from 1 to {MAX_K}")
    names = [key, "pos", "strand", "kmer"]

    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strands = pa.array(["fwd", "rev"])
        for batch in batches:
            held: list[tuple[int, np.ndarray, np.ndarray]] = []
            n = 0

            def table(batch: pa.RecordBatch = batch) -> pa.RecordBatch:
                pos = np.concatenate([p for _, p, _ in held])
                who = np.repeat([i for i, _, _ in held], [len(p) for _, p, _ in held])
                kmer = np.concatenate([x for _, _, x in held])
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), pa.array(pos // 2, pa.int32()), strands.take(pa.array(pos % 2)), pa.array(kmer)], names)

            for i, text in enumerate(batch.column(1)):
                gone = kmer_set(batch.column(2)[i].as_py(), k) if other else None
                for here, both in text_kmers(text.as_py() or "", k):
                    pos = np.stack((2 * here, 2 * here + 1), 1).ravel()  # with the strand
                    if gone is not None:
                        new = _absent(both, gone)
                        pos, both = pos[new], both[new]
                    held.append((i, pos, both))
                    n += len(pos)
                    if n > PIECE:
                        yield table()
                        held, n = [], 0
            if n:
                yield table()

    ship(df.sparkSession)
    rows = df.select(key, F.col(seq).alias("letters"), *([F.col(other).alias("other")] if other else []))
    return rows.mapInArrow(seeds, f"`{key}` {rows.schema[key].dataType.simpleString()}, pos int, strand string, kmer long")


def randomized(df: DataFrame, name: str, seq: str, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """(name, header, seq): each sequence rotated by a place that its name and the seed draw, or the given number."""
    shift = F.pmod(draw if draw is not None else F.xxhash64(F.col(name), F.lit(seed)), (F.length(seq) + 1).cast("long")).cast("int")
    x = df.select(name, F.col(seq).alias("s"), shift.alias("shift"))
    return x.select(name, _moved(name, "randomly_shifted_by_bp"), rotate_left(F.col("s"), F.col("shift")).alias(seq))


def _moved(name: str, how: str) -> Column:
    return F.concat(F.col(name).cast("string"), F.lit(f" {how}:-"), F.col("shift"), F.lit("/"), F.length("s")).alias("header")


def least_skew_shift(seq: Column, window: int, step: int, short: bool = False) -> Column:
    """The first place of the least running skew of a sequence longer than the window; others, and null, are an error, or if short is set their shift is 0. A sequence doesn't move for it."""

    @F.pandas_udf("int")
    def shift(texts):  # noqa: ANN001, ANN202
        def least(text: str) -> int:
            total, best = 0.0, (np.inf, 0)
            for pos, skew, _ in _skews(_letters(text), window, step):
                accum = np.cumsum(np.concatenate(([total], skew)))[1:]
                total, low = accum[-1], np.round(accum, 9)
                best = min(best, (low.min(), int(pos[low.argmin()])))
            return best[1]

        return texts.map(least)

    if short:
        return F.when(F.length(seq) > window, shift(F.when(F.length(seq) > window, seq).otherwise(F.lit("A" * (window + 1))))).otherwise(0)
    long_enough = F.when(F.length(seq) > window, seq).otherwise(F.raise_error(F.lit("a sequence isn't longer than the window")).cast("string"))
    return shift(long_enough)


def reoriented(df: DataFrame, name: str, seq: str, window: int = 500, step: int = 200, allowed: DataFrame | None = None, qual: str | None = None, short: bool = False) -> DataFrame:
    """(name, header, seq[, qual]): each sequence, and its qualities, from the place of its least running skew on; with allowed (name), only those. Sequences that aren't longer than the window are an error; if short is set they stay as they are."""
    ship(df.sparkSession)
    x = df.select(name, F.col(seq).alias("s"), *([F.col(qual).alias("q")] if qual else []))
    shift = least_skew_shift(F.col("s"), window, step, short)
    if allowed is not None:
        x = x.join(allowed.select(name).distinct().withColumn("ok", F.lit(True)), name, "left")
        shift = F.when(F.col("ok"), shift).otherwise(0)
    x = x.withColumn("shift", shift)
    turn = lambda c: rotate_left(F.col(c), F.col("shift"))
    return x.select(name, _moved(name, "shifted_by_bp"), turn("s").alias(seq), *([turn("q").alias(qual)] if qual else []))


def kmer_text(kmer: Column, k: int) -> Column:
    return F.translate(F.lpad(F.conv(kmer.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def kmer_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Seeds of a whose k-mer isn't in b, as often as they come."""
    return a.join(b.select("kmer").distinct(), "kmer", "left_anti")


def has_kmer(seeds: DataFrame, words: DataFrame) -> DataFrame:
    """words (kmer, ...) that some seed has."""
    return words.join(seeds.select("kmer").distinct(), "kmer", "left_semi")


def distinct_kmers(seeds: DataFrame) -> DataFrame:
    """(key, n): different k-mers of each text."""
    return seeds.groupBy("key").agg(F.count_distinct("kmer").alias("n"))
