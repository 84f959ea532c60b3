"""Token-ID files: Parquet list columns with controlled row groups, pages and encodings.

Documents are range-partitioned and sorted by id; each partition is encoded and written as one file:
ids as a list of integers (dictionary-encoded, as a vocabulary is small), the sorted and counting columns
next to them, so that Parquet's page indexes and row-group statistics let a reader fetch the metadata
without the tokens, or the tokens of an id range without the rest. Files hold the place of a document
among their own ids; a table of the files' totals, a row a file, turns it into the place in the corpus.

Encoding is the tokenizers library's. A word's ids don't depend on its neighbours under the given
vocabulary (white space is dropped before the merges), so a task encodes each different word once.
encode_texts says when that holds and encodes whole texts otherwise. Arrow splits the texts and numbers the
different words of a stretch of documents, without the marks at their ends, so that only those become Python's objects.

Defined results: a null text is empty and has the end id alone; null ids come first; rows with equal ids
are all written, in the order of their texts; an empty table gives one empty set of files; texts are never cut.
"""

from __future__ import annotations

import json
import os
import re
import string
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import byte_characters, documents, materialize, shared_dir, ship

END_ID = 2
#: Bytes of a row group and of a page, and how often the number of rows in a page is looked at.
LAYOUT = {"parquet.block.size": 32 << 20, "parquet.page.size": 256 << 10, "parquet.page.row.count.limit": 1000, "parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}
#: A word of one token that stands between words while they are encoded together.
BETWEEN = "~"
#: Documents in a file, about; files whose totals are summed in one task; totals that are broadcast at most (some 20 bytes each).
ROWS_PER_FILE, FILES_TOGETHER, BROADCAST_FILES = 10_000, 1024, 200_000
#: Different words that a worker remembers at a time, over its tasks; bytes of text encoded at a time, or one document.
CACHE_WORDS, STRETCH = 900_000, 4 << 20

#: Fixed value: how the given vocabulary cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Marks that end a word, in ASCII: no letters, numbers or white space.
MARKS = string.punctuation
#: What keeps a word's capitals from being lower-cased here: a special token's <, and marks that compose with A-Z (lower-casing comes after composing, which is the library's to do).
CAPITALS = "[<\u0300-\u037f]"
#: Letters before this one, if lower-case, are what the normalizers leave as they are.
STABLE = "\u0250"
#: The letter that stands for each byte in a byte-level vocabulary.
_BYTES = {b: c for c, b in byte_characters().items()}

_loaded: dict[str, tuple] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, with room for n values."""
    return a if len(a) >= n else np.concatenate((a, np.zeros(max(n, len(a)), a.dtype)))


def _cuts_at_marks(spec: dict) -> bool:
    """Whether letters and the marks after them are pieces of their own, and a lower-case word reaches the merges as its bytes."""
    before = spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers", [before])
    cut = {"type": "Split", "pattern": {"Regex": PIECES}, "behavior": "Removed", "invert": True}
    normal = (spec.get("normalizer") or {}).get("normalizers", [])
    byte_level = len(steps) == 2 and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
    return steps[0] == cut and byte_level and [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"] and spec["model"]["type"] == "BPE"


class _Words:
    """Ids of the words seen: word number n has sizes[n] of ids, from starts[n]."""

    def __init__(self, between: str, between_id: int, lower: bool, at_marks: bool, merges=None, last: np.ndarray | None = None):  # noqa: ANN001
        self.between, self.between_id, self.lower, self.at_marks, self.merges, self.last = between, between_id, lower, at_marks, merges, last
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes, self.n, self.n_ids = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 0
        self._add([b""], np.zeros(1, np.int64), self.ids)  # number 0

    def learn(self, words: list[bytes], tok) -> None:  # noqa: ANN001
        """Encodes words that are not known yet; a lower-case one goes straight to the library's merges."""
        texts, straight, other = [], [], []
        for w in words:
            if self.at_marks and w.isalpha() and w.islower():
                texts.append(w.decode())
            elif self.at_marks and (text := w.decode()).isalpha() and text == text.lower() and max(text) < STABLE:
                texts.append(w.decode("latin-1").translate(_BYTES))
            else:
                other.append(w)
                continue
            straight.append(w)
        self._add(straight, *self._merged(texts, tok))
        self._encode(other, tok)

    def _merged(self, texts: list[str], tok) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
        """(number of ids of each text, ids): the library's merges of each text as one piece, many at a time where the last id of a piece shows."""
        if self.merges is not None:
            many = self.merges.encode_batch_fast([" ".join(texts[k : k + 500]) for k in range(0, len(texts), 500)], add_special_tokens=False)
            ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in many)])
            ends = np.flatnonzero(self.last[ids])
            if len(ends) == len(texts):
                return np.diff(ends, prepend=-1), ids
        found = [[t.id for t in tok.model.tokenize(x)] for x in texts]
        return np.array([len(x) for x in found], np.int64), np.array([i for x in found for i in x], np.int32)

    def _encode(self, words: list[bytes], tok) -> None:  # noqa: ANN001
        """Many words in one text, with a token between that no word without its character has."""
        sign = self.between.encode()
        apart, plain = [w for w in words if sign in w], [w for w in words if sign not in w]
        found, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        texts = [f" {self.between} ".join(w.decode() for w in plain[k : k + 500]) for k in range(0, len(plain), 500)]
        for e in tok.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.array(e.ids, np.int32)
            cut = np.flatnonzero(ids == self.between_id)
            sizes.append(np.diff(cut, prepend=-1, append=len(ids)) - 1)
            found.append(np.delete(ids, cut))
        for e in tok.encode_batch_fast([w.decode() for w in apart], add_special_tokens=False):
            found.append(np.array(e.ids, np.int32))
            sizes.append(np.array([len(e.ids)]))
        self._add([*plain, *apart], np.concatenate(sizes).astype(np.int64), np.concatenate(found))

    def _add(self, words: list[bytes], new: np.ndarray, ids: np.ndarray) -> None:
        self.number.update(zip(words, range(self.n, self.n + len(new)), strict=True))
        self.ids, self.starts, self.sizes = _room(self.ids, self.n_ids + len(ids)), _room(self.starts, self.n + len(new)), _room(self.sizes, self.n + len(new))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[self.n : self.n + len(new)] = self.n_ids + np.cumsum(new) - new
        self.sizes[self.n : self.n + len(new)] = new
        self.n, self.n_ids = self.n + len(new), self.n_ids + len(ids)


def _tokenizer(path: str):  # noqa: ANN202
    """The tokenizer, and whether it drops white space and keeps words apart."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(Path(path).read_text())
        parts = json.dumps(spec.get("normalizer")) + json.dumps(spec.get("pre_tokenizer"))
        by_word = '"behavior": "Removed", "invert": true' in parts and r"[^\\s\\p{L}\\p{N}]+" in parts and not any("<" not in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or set(t["content"]) & set(" \t\n\x0b\f\r") for t in spec["added_tokens"])
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        between = tok.encode(BETWEEN, add_special_tokens=False).ids
        at_marks, merges, last = _cuts_at_marks(spec), None, None
        if at_marks and (end := spec["model"].get("end_of_word_suffix")):
            merges, vocab = Tokenizer(tok.model), tok.get_vocab()
            merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            last = np.zeros(max(vocab.values()) + 1, bool)
            last[[i for t, i in vocab.items() if t.endswith(end)]] = True
        _loaded[path] = (tok, by_word and len(between) == 1, _Words(BETWEEN, between[0], '"Lowercase"' in json.dumps(spec.get("normalizer")), at_marks, merges, last))
    return _loaded[path]


def encode_texts(texts: list[str] | pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, number of ids of each)."""
    tok, by_word, cache = _tokenizer(path)
    if not by_word:
        found = [x.ids for x in tok.encode_batch(texts if isinstance(texts, list) else texts.to_pylist(), add_special_tokens=False)]
        return np.fromiter((i for x in found for i in x), np.int32), np.array([len(x) for x in found], np.int64)
    split = pc.ascii_split_whitespace(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    coded = split.flatten().dictionary_encode()
    different = coded.dictionary
    if cache.lower:  # what the vocabulary lower-cases need not be told apart
        different = pc.if_else(pc.match_substring_regex(different, CAPITALS), different, pc.ascii_lower(different))
    words, two = _parts(different, cache.at_marks)
    places = np.fromiter(map(cache.number.get, words, repeat(-1)), np.int64, len(words))
    unknown = np.flatnonzero(places < 0)
    if len(unknown):
        if len(cache.number) > CACHE_WORDS:
            cache.clear()
            unknown = np.flatnonzero(words != b"")
            places[:] = 0
        cache.learn(new := words[unknown].tolist(), tok)
        places[unknown] = np.fromiter(map(cache.number.__getitem__, new), np.int64, len(new))
    at = places[two][coded.indices.to_numpy(zero_copy_only=False)].ravel()
    sizes = cache.sizes[at]
    until = np.cumsum(sizes)
    ids = cache.ids[np.repeat(cache.starts[at] - until + sizes, sizes) + np.arange(until[-1] if len(until) else 0)]
    ends = np.concatenate(([0], until))[2 * np.cumsum(counts)]
    return ids, np.diff(ends, prepend=0)


def _parts(words: pa.Array, at_marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """(different parts, two of them for each word): of a word that ends in marks the rest and the marks, else the word and the empty one."""
    if at_marks:
        core = pc.utf8_rtrim(words, MARKS)
        apart = pc.and_(pc.not_equal(pc.binary_length(core), pc.binary_length(words)), pc.match_substring_regex(core, r"[A-Za-z0-9]\z"))
        apart = pc.and_not(apart, pc.match_substring(words, "<"))  # special tokens have a <
        marks = pc.struct_field(pc.extract_regex(words.filter(apart), f"(?P<marks>[{re.escape(MARKS)}]+)\\z"), "marks")
        words = pc.if_else(apart, core, words)
    else:
        apart, marks = pa.array(np.zeros(len(words), bool)), words[:0]
    coded = pa.concat_arrays([pa.array([""], words.type), words, marks]).dictionary_encode()
    number = coded.indices.to_numpy()
    two = np.zeros((len(words), 2), np.int64)
    two[:, 0] = number[1 : 1 + len(words)]
    two[apart.to_numpy(zero_copy_only=False), 1] = number[1 + len(words) :]
    return coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False), two


def _stretches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of stretches of some STRETCH bytes, one row at least."""
    until, first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while first < len(until):
        stop = max(first + 1, int(np.searchsorted(until, (until[first - 1] if first else 0) + STRETCH, "right")))
        yield first, stop - first
        first = stop


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = ROWS_PER_FILE) -> None:
    """Files under folder: (id, file, place, n_tokens, tokens), ids ascending within and across files."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, at = TaskContext.get().partitionId(), 0  # the range's number
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            for k, n in _stretches(texts):
                part = batch.slice(k, n)
                ids, counts = encode_texts(texts.slice(k, n), path)
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                offsets = np.concatenate(([0], ends + np.arange(1, len(ends) + 1)))
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(len(counts), file, np.int32)), pa.array(at + offsets[:-1], pa.int64()), pa.array(counts + 1, pa.int64()), tokens], ["id", "file", "place", "n_tokens", "tokens"])
                at += int(offsets[-1])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    files = max(1, -(-docs.count() // rows_per_file))
    placed = rows.repartitionByRange(files, "id").sortWithinPartitions("id", "body")
    made = placed.mapInArrow(encoded, "id long, file int, place long, n_tokens long, tokens array<int>")
    made.write.options(**{k: str(v) for k, v in LAYOUT.items()}).option("parquet.enable.dictionary", "true").parquet(folder)


_SCHEMA = "id long, file int, place long, n_tokens long, tokens array<int>"


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """(id, start, n_tokens), without a look at the tokens."""
    meta = spark.read.schema(_SCHEMA).parquet(folder).select("id", "file", "place", "n_tokens")
    return _with_start(meta, meta).select("id", "start", "n_tokens")


def _with_start(rows: DataFrame, all_: DataFrame) -> DataFrame:
    """rows with start, the ids of all documents before; files are in the order of their numbers."""
    files = all_.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("some", F.expr(f"file div {FILES_TOGETHER}"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    many = files.groupBy("some").agg(F.sum("n").alias("n")).select("some", before(W.orderBy("some")).alias("more"))  # a row for many files
    starts = files.withColumn("own", before(W.partitionBy("some").orderBy("file"))).join(many, "some").select("file", (F.col("own") + F.col("more")).alias("from"))
    starts = materialize(starts, "token-starts")
    starts = F.broadcast(starts) if starts.count() <= BROADCAST_FILES else starts
    return rows.join(starts, "file").withColumn("start", F.col("from") + F.col("place"))


def read_tokens(spark: SparkSession, folder: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """(id, start, n_tokens, tokens), of ids from first to last if given: the filter reaches row groups and pages."""
    all_ = spark.read.schema(_SCHEMA).parquet(folder)
    rows = all_
    rows = rows.where(F.col("id") >= first) if first is not None else rows
    rows = rows.where(F.col("id") <= last) if last is not None else rows
    return _with_start(rows, all_).select("id", "start", "n_tokens", "tokens")


def token_digests(rows: DataFrame) -> DataFrame:
    """rows with the crc32 of each list as little-endian unsigned 32-bit integers, in place of the list."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")).cast("B")
            at = lists.offsets.to_numpy() * 4
            crc = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], crc], ["id", "start", "n_tokens", "ids_crc32"])

    ship(rows.sparkSession)
    return rows.select("id", "start", "n_tokens", "tokens").mapInArrow(digest, "id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), folder, vocabulary("word_bpe_49k.json"))
    return token_digests(read_tokens(spark, folder)).withColumnRenamed("id", "doc_id")
