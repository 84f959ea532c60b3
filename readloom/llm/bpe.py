"""Byte-level BPE by speculation: greedy longest match proposes, pair checks verify, exact merging repairs.

A text is split at special tokens, then at single spaces where no match of the split pattern can reach
across, and each different piece is encoded once in a task. Each word of a piece gets the tokens of the
greedy longest match. The proposal is the true encoding if and only if no adjacent pair of its tokens
would have merged across their boundary: when every merge's parts have lower ranks than the merge, the
tokens that stand left of the boundary over time are the right spine of the left token's merge tree, those
right of it the left spine of the other's, and a merge (x, y) happens if it comes before x and y are
merged upwards. All pairs of a batch are checked at once with numpy; only words with a failing pair are
merged exactly, all together in rounds. Tokens that don't encode to themselves are never proposed.

Defined results: a null text is empty and has no tokens; a special token's string in a text becomes its id;
repeated rows are encoded alike; an empty table gives an empty result; texts are never cut; other columns
are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import string
from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import byte_characters, documents, ship
from readloom.llm.token_files import _room, vocabulary

#: Fixed value: the split pattern of byte-level vocabularies, white space by its Unicode property.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
_RUN = re.compile(r"\s ")
#: Different pieces that a task remembers at a time, and bytes of new words looked at at a time.
CACHE_PIECES, BATCH = 500_000, 1 << 22
#: Words up to this many bytes are followed and merged together, longer ones one by one.
SHORT = 256
_NEVER = 1 << 40
_loaded: dict[str, "Vocabulary"] = {}


class Table:
    """A fixed map from numbers to numbers, looked up for whole arrays: hashed places, the next free one where two meet."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, missing: int):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values, self.missing = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, missing, np.int64), missing
        left, at = np.arange(len(keys)), self._places(keys)
        while len(left):
            free = np.flatnonzero(self.keys[at] < 0)
            there, one = np.unique(at[free], return_index=True)
            self.keys[there], self.values[there] = keys[left[free[one]]], values[left[free[one]]]
            rest = np.ones(len(left), bool)
            rest[free[one]] = False
            left, at = left[rest], (at[rest] + 1) & (len(self.keys) - 1)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], self.missing)
        go = np.flatnonzero((found != keys) & (found >= 0))
        while len(go):
            at_go = (at[go] + 1) & (len(self.keys) - 1)
            at[go] = at_go
            found = self.keys[at_go]
            hit = found == keys[go]
            out[go[hit]] = self.values[at_go[hit]]
            go = go[~hit & (found >= 0)]
        return out


def _checked(spec: dict) -> None:
    """Refuses what this encoder doesn't do."""
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        raise ValueError("not a plain BPE model")
    if spec["normalizer"] is not None or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        raise ValueError("not plain byte-level words")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
        raise ValueError("added tokens that take in their neighbours")


class Vocabulary:
    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text())
        _checked(spec)
        byte = byte_characters()
        vocab = spec["model"]["vocab"]
        raw = {t: bytes(byte[c] for c in t) for t in vocab}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.n = n = max([*vocab.values(), *self.special.values()]) + 1
        of = [b""] * n
        for t, i in vocab.items():
            of[i] = raw[t]
        for t, i in self.special.items():
            of[i] = t.encode()
        # what each token decodes to, in one row of bytes
        self.text = np.frombuffer(b"".join(of), np.uint8)
        self.text_size = np.array([len(b) for b in of], np.int64)
        self.text_start = np.cumsum(self.text_size) - self.text_size
        self.base = np.full(256, -1)
        for t, i in vocab.items():
            if len(raw[t]) == 1:
                self.base[raw[t][0]] = i
        if (self.base < 0).any():
            raise ValueError("a byte without a token")
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right, self.made, self.whole = np.full(n, -1), np.full(n, -1), np.full(n, -1), np.zeros(len(spec["model"]["merges"]), np.int64)
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, whole = (vocab[a], vocab[b]), vocab[a + b]
            if self.made[whole] >= 0:
                raise ValueError("two merges make one token")
            self.rank[pair] = r, whole
            self.left[whole], self.right[whole], self.made[whole], self.whole[r] = *pair, r, whole
        if any(max(self.made[a], self.made[b]) >= r for (a, b), (r, _) in self.rank.items()):
            raise ValueError("a merge comes before a merge of its parts")
        self.ranks = Table(np.array([a * n + b for a, b in self.rank], np.int64), np.array([r for r, _ in self.rank.values()], np.int64), _NEVER)
        # a token encodes to itself if its two parts do and no merge crosses between them before its own
        good = self.made < 0
        pairs = np.flatnonzero(self.made >= 0)
        clean = np.ones(n, bool)
        clean[pairs] = ~self.merges_across(self.left[pairs], self.right[pairs], self.made[pairs])
        for i in np.argsort(self.made, kind="stable"):
            if self.made[i] >= 0:
                good[i] = clean[i] and good[self.left[i]] and good[self.right[i]]
        # the tokens as a tree of bytes: node * 256 + byte leads to a node, and a node to the token that ends there
        ways: dict[int, int] = {}
        ends: dict[int, int] = {}
        for t, i in vocab.items():
            if good[i] and len(raw[t]) > 1:
                node = raw[t][0]
                for b in raw[t][1:]:
                    node = ways.setdefault(node * 256 + b, 256 + len(ways))
                ends[node] = i
        self.ways = Table(np.fromiter(ways.keys(), np.int64, len(ways)), np.fromiter(ways.values(), np.int64, len(ways)), -1)
        self.ends = np.full(256 + len(ways), -1)
        self.ends[list(ends)] = list(ends.values())
        self.clear()

    def merges_across(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether some merge joins what stands left and right of the boundary of a and b (before a rank)."""
        across = np.zeros(len(a), bool)
        top = np.full(len(a), _NEVER) if before is None else before
        rows, x, up_x = np.arange(len(a)), a, top
        while len(rows):  # down the right spine of a
            inner, y, up_y, xs, up_xs = rows, b[rows], top[rows], x, up_x
            while len(inner):  # down the left spine of b
                r = self.ranks.get(xs * self.n + y)
                across[inner[(r < up_xs) & (r <= up_y) & (r < top[inner])]] = True
                go = (self.left[y] >= 0) & ~across[inner]
                inner, up_y, y, xs, up_xs = inner[go], self.made[y[go]], self.left[y[go]], xs[go], up_xs[go]
            go = (self.right[x] >= 0) & ~across[rows]
            rows, up_x, x = rows[go], self.made[x[go]], self.right[x[go]]
        return across

    def clear(self) -> None:
        """Forgets all pieces. Their keys: bytes, or for a piece that starts with a space the string after it."""
        self.number: dict[bytes | str, int] = {}
        self.ids, self.starts, self.sizes, self.n_ids = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        self._add([s.encode() for s in self.special], np.ones(len(self.special), np.int64), np.array(list(self.special.values()), np.int32))

    def _add(self, keys: list[bytes | str], sizes: np.ndarray, ids: np.ndarray) -> None:
        n, more = len(self.number), len(keys)
        self.number.update(zip(keys, range(n, n + more), strict=True))
        self.ids, self.starts, self.sizes = _room(self.ids, self.n_ids + len(ids)), _room(self.starts, n + more), _room(self.sizes, n + more)
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[n : n + more] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[n : n + more] = sizes
        self.n_ids += len(ids)

    def _of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces in a row, number of ids of each)."""
        sizes = self.sizes[places]
        return self.ids[np.repeat(self.starts[places] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())], sizes

    def greedy(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(tokens of the longest match from each word's start on, word of each). raw: bytes of all words."""
        end = np.repeat(np.cumsum(size), size)
        token, reach = self.base[raw], np.ones(len(raw), np.int64)
        at, node, depth = np.arange(len(raw)), raw.astype(np.int64), 1
        while len(at):  # the longest match at every byte
            go = at + depth < end[at]
            at, node = at[go], node[go]
            node = self.ways.get(node * 256 + raw[at + depth])
            at, node, depth = at[node >= 0], node[node >= 0], depth + 1
            own = self.ends[node]
            token[at[own >= 0]], reach[at[own >= 0]] = own[own >= 0], depth
        taken = np.zeros(len(raw), bool)
        first = np.cumsum(size) - size
        at = first[(size > 0) & (size <= SHORT)]
        while len(at):  # from match to match
            taken[at] = True
            last = end[at]
            at = at + reach[at]
            at = at[at < last]
        for a, n in zip(first[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            steps, i = reach[a : a + n].tolist(), 0
            while i < n:
                taken[a + i] = True
                i += steps[i]
        return token[taken], np.repeat(np.arange(len(size)), size)[taken]

    def exact(self, word: bytes) -> list[int]:
        """Merges by rank, leftmost first, through a heap of places."""
        t = [int(self.base[b]) for b in word]
        n = len(t)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.rank[p][0], i, p) for i, p in enumerate(zip(t, t[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            r, i, p = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or (t[i], t[j]) != p:
                continue
            t[i], alive[j], nxt[i] = self.rank[p][1], False, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < n and (q := (t[k], t[nxt[k]])) in self.rank:
                    heapq.heappush(heap, (self.rank[q][0], k, q))
        return [x for x, on in zip(t, alive, strict=True) if on]

    def exact_words(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for many short words at once: in each round every word does its merge of the least rank, wherever it fits. (tokens, word of each)."""
        t, word = self.base[raw], np.repeat(np.arange(len(size)), size)
        rank = np.full(len(t), _NEVER)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.ranks.get(t[inside] * self.n + t[inside + 1])
        done_t, done_w = [], []
        while len(t):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(t)))
            over = least == _NEVER
            if over.any():
                done_t.append(t[over])
                done_w.append(word[over])
                t, word, rank, least = t[~over], word[~over], rank[~over], least[~over]
                if not len(t):
                    break
            at = np.flatnonzero(rank == least)
            # of pairs that overlap (three equal tokens and more) every second one
            run = np.concatenate(([True], at[1:] != at[:-1] + 1))
            nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            at = at[nth % 2 == 0]
            t[at] = self.whole[rank[at]]
            keep = np.ones(len(t), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # where the merged tokens are now
            t, word, rank = t[keep], word[keep], rank[keep]
            new = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
            rank[new] = _NEVER
            new = new[new + 1 < len(t)]
            new = new[word[new] == word[new + 1]]
            rank[new] = self.ranks.get(t[new] * self.n + t[new + 1])
        t, word = np.concatenate([np.zeros(0, np.int64), *done_t]), np.concatenate([np.zeros(0, np.int64), *done_w])
        order = np.argsort(word, kind="stable")
        return t[order], word[order]

    def _learn_words(self, keys: list[bytes | str]) -> None:
        """Speculates on new words, checks all pairs at once, and merges the failing words exactly."""
        raws = [k if isinstance(k, bytes) else b" " + k.encode() for k in keys]
        size = np.array(list(map(len, raws)), np.int64)
        raw = np.frombuffer(b"".join(raws), np.uint8)
        flat, word_of = self.greedy(raw, size)
        inside = np.flatnonzero(word_of[1:] == word_of[:-1])
        pairs, back = np.unique(flat[inside] * self.n + flat[inside + 1], return_inverse=True)
        fails = np.zeros(len(raws), bool)
        fails[word_of[inside[self.merges_across(pairs // self.n, pairs % self.n)[back]]]] = True
        parts = [(flat[~fails[word_of]], word_of[~fails[word_of]])]
        many = np.flatnonzero(fails & (size <= SHORT))
        t, w = self.exact_words(raw[np.repeat(fails & (size <= SHORT), size)], size[many])
        parts.append((t, many[w]))
        for k in np.flatnonzero(fails & (size > SHORT)):
            t = np.array(self.exact(raws[k]), np.int64)
            parts.append((t, np.full(len(t), k)))
        flat, word_of = (np.concatenate(x) for x in zip(*parts, strict=True))
        self._add(keys, np.bincount(word_of, minlength=len(raws)), flat[np.argsort(word_of, kind="stable")].astype(np.int32))

    def learn(self, pieces: list[bytes | str]) -> None:
        """New pieces: their words, and the pieces of several words from those."""
        words: dict[bytes | str, None] = {}
        several: list[tuple[bytes | str, Sequence[bytes | str]]] = []
        for p in pieces:
            if isinstance(p, str):  # most are letters, or letters and marks
                if p.isalpha():
                    words[p] = None
                    continue
                core = p.rstrip(string.punctuation)
                if core.isalpha():
                    marks = p[len(core) :].encode()
                    words[core] = words[marks] = None
                    several.append((p, (core, marks)))
                    continue
            own = [w[1:] if w[0] == " " else w.encode() for w in SPLIT.findall(" " + p if isinstance(p, str) else p.decode())]
            if own != [p]:
                several.append((p, own))
            words.update(dict.fromkeys(own))
        new, held = [], 0
        for w in words:
            if w not in self.number:
                new.append(w)
                held += len(w)
                if held > BATCH:
                    self._learn_words(new)
                    new, held = [], 0
        if new:
            self._learn_words(new)
        if several:
            ids, sizes = self._of(np.array([self.number[w] for _, own in several for w in own], np.int64))
            ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([len(own) for _, own in several])]
            self._add([p for p, _ in several], np.diff(ends, prepend=0), ids)

    def pieces(self, text: str) -> list[bytes | str]:
        """The text in pieces that encode on their own: no match of the pattern starts in one and ends in the next."""
        first, *rest = text.split(" ")
        if not _RUN.search(text) and first and not first[-1].isspace():
            return [first.encode(), *rest]
        out = [first]
        for p in rest:
            if not out[-1] or out[-1][-1].isspace():  # white space may go on
                out[-1] += " " + p
            else:
                out.append(" " + p)
        return [out[0].encode(), *[p[1:] for p in out[1:]]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each)."""
        pieces: list[bytes | str] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            before = len(pieces)
            if any(s in text for s in self.special):
                for part in self.at_special.split(text):
                    pieces += [part.encode()] if part in self.special else self.pieces(part) if part else []
            elif text:
                pieces += self.pieces(text)
            counts[k] = len(pieces) - before
        places = list(map(self.number.get, pieces))
        if None in places:
            if len(self.number) > CACHE_PIECES:
                self.clear()
                places = list(map(self.number.get, pieces))
            unknown = [i for i, p in enumerate(places) if p is None]
            self.learn(list({pieces[i]: None for i in unknown}))
            for i in unknown:
                places[i] = self.number[pieces[i]]
        ids, sizes = self._of(np.array(places, np.int64))
        ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        return ids, np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts that the ids give, counts[k] of them for text k; bytes that are no UTF-8 are replaced."""
        sizes = self.text_size[ids]
        until = np.concatenate(([0], np.cumsum(sizes)))
        raw = self.text[np.repeat(self.text_start[ids] - until[:-1], sizes) + np.arange(until[-1])]
        ends = until[np.concatenate(([0], np.cumsum(counts)))]
        inner = ends[(ends > 0) & (ends < len(raw))]
        if not ((raw[inner] & 0xC0) == 0x80).any():  # no text ends within a character
            try:
                raw.tobytes().decode()
                return pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))
            except UnicodeDecodeError:
                pass
        return pa.array([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())


def load(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens, decoded) of every row: the ids of its whole text, and the text that those ids give."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = load(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids, counts = vocab.encode([x or "" for x in part.column(1).to_pylist()])
                at = np.concatenate(([0], np.cumsum(counts)))
                tokens = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), tokens, vocab.decode(ids, counts)], ["id", "tokens", "decoded"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(coded, "id long, tokens array<int>, decoded string")


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    out = bpe_round_trip(docs, path)
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return out.select(F.col("id").alias("doc_id"), F.size("tokens").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
