"""Quality rules as a short-circuit cascade.

Each rule's cost (seconds a document) and selectivity are estimated on a bounded random sample. The rule with
the most rejections per cost comes first; then the one with the most among the texts that are left, and so on.
Counts that are asked of every text anyway cost a rule nothing. The cascade then reads every whole text and
stops at the first rule that rejects it. The sample decides the order alone: a document is kept if no
rule rejects it, so the verdict is the same for every order.

Defined results: a null or empty text has no words and fails the rule on word counts; repeated rows are
judged alike; an empty table gives an empty result and leaves the rules in their given order; texts are
never cut; other columns are ignored by quality_verdicts and kept by keep_good.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import documents, ship

SYMBOLS = "#*$%&|<>"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
#: Rows in the sample that orders the rules.
SAMPLE_ROWS = 2000


class Text:
    """A text and what rules ask of it, each computed once and only if asked."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\x0b\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS.encode()))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three that occur twice or more, the first time included."""
        n = len(self.words)
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        w = np.fromiter((number.setdefault(x, len(number)) for x in self.words), np.int64, n)
        pairs = w[:-1] * len(number) + w[1:]
        if len(number) > 2_000_000:  # three numbers would not fit in 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        keys = pairs[:-1] * len(number) + w[2:]
        order = np.argsort(keys, kind="stable")
        same = np.diff(keys[order]) == 0
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        return int(covered.sum())

    @cached_property
    def letters(self) -> int:
        """ASCII letters and all characters beyond ASCII."""
        rest = self.raw.translate(None, _UPPER + _LOWER)
        return len(self.text) - len(rest.decode("utf-8", "surrogatepass").encode("ascii", "ignore"))


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]


def few_words(t: Text) -> bool:
    return t.n_words < 50


def repeated_words(t: Text) -> bool:
    return 100 * t.n_repeat_words > 50 * t.n_words


def many_symbols(t: Text) -> bool:
    return 10 * t.n_symbols > t.n_words


def odd_word_length(t: Text) -> bool:
    return 2 * t.word_chars < 5 * t.n_words or t.word_chars > 10 * t.n_words


def repeated_lines(t: Text) -> bool:
    return 10 * t.n_dup_lines > 4 * len(t.lines)


def few_letters(t: Text) -> bool:
    return 10 * t.letters < 6 * t.word_chars


def shouting(t: Text) -> bool:
    up, low = (len(t.raw) - len(t.raw.translate(None, x)) for x in (_UPPER, _LOWER))
    return 10 * up > 4 * (up + low)


def many_exclamations(t: Text) -> bool:
    return 5 * t.text.count("!") > t.n_words


BASE = (Rule("few_words", few_words), Rule("repeated_words", repeated_words))
RULES = (*BASE, *(Rule(f.__name__, f) for f in (many_symbols, odd_word_length, repeated_lines, few_letters, shouting, many_exclamations)))


def profile_rules(docs: DataFrame, rules: Sequence[Rule], text_col: str = "text", rows: int = SAMPLE_ROWS, seed: int = 7, paid: Sequence[str] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(whether each text of a sample of about `rows` rows is rejected by each rule on its own, seconds that took); paid: what is known of a text before the rules ask."""
    total = docs.count()

    def timed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected, seconds = [], []
            for x in batch.column(0):
                verdicts, costs = [], []
                for rule in rules:
                    text = Text(x.as_py())
                    for c in paid:
                        getattr(text, c)
                    began = time.perf_counter()
                    verdicts.append(rule.rejects(text))
                    costs.append(time.perf_counter() - began)
                rejected.append(verdicts)
                seconds.append(costs)
            yield pa.RecordBatch.from_arrays([pa.array(rejected, pa.list_(pa.bool_())), pa.array(seconds, pa.list_(pa.float64()))], ["rejected", "seconds"])

    ship(docs.sparkSession)
    sample = docs.select(F.col(text_col).alias("body")).sample(min(1.0, rows / max(1, total)), seed)
    found = sample.mapInArrow(timed, "rejected array<boolean>, seconds array<double>").collect()  # some `rows` rows
    shape = len(found), len(rules)
    return np.array([r.rejected for r in found], bool).reshape(shape), np.array([r.seconds for r in found], float).reshape(shape)


def ordered(rules: Sequence[Rule], rejected: np.ndarray, seconds: np.ndarray) -> list[Rule]:
    """By rejections per cost among the texts that the rules before leave, most first; ties in the given order."""
    left, alive, out = list(range(len(rules))), np.ones(len(rejected), bool), []
    while left:
        gain = [rejected[alive, k].sum() / max(seconds[alive, k].sum(), 1e-9) for k in left]
        best = left.pop(int(np.argmax(gain)))
        out.append(rules[best])
        alive &= ~rejected[:, best]
    return out


def first_rejection(t: Text, rules: Sequence[Rule]) -> str | None:
    return next((r.name for r in rules if r.rejects(t)), None)


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality_verdicts(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, the five counts, base_failed, kept) of every row; the counts are asked of all, the other rules in cascade."""
    rules = ordered(rules, *profile_rules(docs, rules, text_col, paid=_COUNTS))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[tuple] = []
            for x in batch.column(1):  # one text as Python objects at a time
                t = Text(x.as_py())
                base = any(r.rejects(t) for r in BASE)
                counts.append((*(getattr(t, c) for c in _COUNTS), base, not base and first_rejection(t, rules) is None))
            columns = [pa.array(c, pa.int64() if i < 5 else pa.bool_()) for i, c in enumerate(zip(*counts, strict=True))] if counts else [pa.array([], pa.int64())] * 5 + [pa.array([], pa.bool_())] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *_COUNTS, "base_failed", "kept"])

    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(judged, "id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """docs without the rows that a rule rejects."""
    rules = ordered(rules, *profile_rules(docs, rules, text_col))

    @F.pandas_udf("boolean")
    def good(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda x: first_rejection(Text(x), rules) is None).astype(bool)

    ship(docs.sparkSession)
    verdict: Column = good(F.coalesce(F.col(text_col), F.lit("")))
    return docs.where(verdict)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d)),
n AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY k),
t AS (SELECT *, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, w, b, c) AS times FROM t WHERE c IS NOT NULL),
p AS (SELECT k, count(DISTINCT i + j) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS v(j) WHERE times > 1 GROUP BY k),
l AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT k, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY k),
f AS (SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS letters,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^a-z]', '', 'g')) AS low, length(regexp_replace(text, '[^!]', '', 'g')) AS bangs
  FROM d LEFT JOIN n USING (k) LEFT JOIN p USING (k) LEFT JOIN l USING (k)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * word_chars < 5 * n_words OR word_chars > 10 * n_words OR 10 * n_dup_lines > 4 * n_lines
       OR 10 * letters < 6 * word_chars OR 10 * up > 4 * (up + low) OR 5 * bangs > n_words) AS kept FROM g
"""
