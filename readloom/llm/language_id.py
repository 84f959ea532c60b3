"""Language identification in two levels: the family first, then the language within it.

A text is a vector of hashed two- and three-byte strings of its lower-cased letters, roots of their counts at unit
length. Linear support vector machines, one for each family against the rest, choose the family; within it every two
languages have a machine of their own, and the language with most of the votes wins. Machines see few, close classes
each, so the words that all languages of a family share don't decide between it and others again.

Machines are fitted on a bounded sample: PER_LANG texts of each of the MAX_LANGS most frequent languages, FAMILY_ROWS
texts for a family's machine. Each is fitted in a task of its own by dual coordinate descent; its weights, DIMENSIONS
numbers, come to the driver and go to the executors. Prediction reads every whole text, in pieces, and nothing but it.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text if nothing could be
learned; with one language learned, that one has score 1; equal texts are judged alike; ties of votes go to the larger
sum of chances, then to the first name; a null id is neither learned from nor held out; an empty table gives an empty
result; other columns are ignored. A language that FAMILIES doesn't list is a family of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import discard, documents, materialize, ship

#: Codes of languages by family.
FAMILIES = {
    "germanic": "en de nl af fy lb yi da sv no nb nn is fo",
    "romance": "fr es it pt ro ca gl oc ast la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tt tk ug",
    "indo-aryan": "hi ur bn pa mr gu ne si sa",
    "iranian": "fa ps ku tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt ti",
    "austronesian": "id ms tl jv su mg mi",
    "bantu": "sw zu xh sn rw",
    "sinitic": "zh yue",
}
#: Bounds of the sample and of the model: texts of a language, languages, texts of a family's machine.
PER_LANG, MAX_LANGS, FAMILY_ROWS, SPARE = 600, 100, 3000, 4
DIMENSIONS = 1 << 13
#: Rounds of a machine over its texts, and how much an error may cost.
ROUNDS, COST = 15, 1.0
#: Bytes of a text that are hashed at once, and texts that are multiplied at once.
PIECE, BLOCK = 1_000_000, 512
UNKNOWN = "und"
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def family_of(lang: str, families: Mapping[str, str] = FAMILIES) -> str:
    """A family of the table, or the language itself; regions after - or _ don't count."""
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in families.items() if code in codes.split()), lang)


def text_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed strings of a whole text, None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split()) + b" "
    found = np.zeros(DIMENSIONS, np.int64)
    for at in range(0, len(raw), PIECE):
        b = np.frombuffer(raw[at : at + PIECE + 2], np.uint8).astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        for code, factor in ((two[:PIECE], 2246822519), (three[:PIECE], 2654435761)):
            found += np.bincount((code * np.uint32(factor)) >> np.uint32(19), minlength=DIMENSIONS)
    return found


def _unit(counts: np.ndarray) -> np.ndarray:
    x = np.sqrt(counts.astype(np.float64))
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def fit_machine(rows: Sequence[tuple[np.ndarray, np.ndarray]], sides: np.ndarray, rounds: int = ROUNDS, cost: float = COST) -> np.ndarray:
    """Weights (the last is the threshold) of a support vector machine with squared hinge loss, by dual coordinate descent; rows: (places, values), sides: 1 or -1."""
    w, alpha = np.zeros(DIMENSIONS + 1), np.zeros(len(rows))
    rng = np.random.default_rng(0)
    weight = np.where(sides > 0, len(rows) / max(1, (sides > 0).sum()), len(rows) / max(1, (sides < 0).sum())) / 2  # both sides count the same
    soft = 0.5 / (cost * weight)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            slope = sides[i] * (w[at] @ x + w[-1]) - 1 + soft[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / (2 + soft[i]))  # unit vectors and a constant 1
            if new != alpha[i]:
                step = (new - alpha[i]) * sides[i]
                w[at] += step * x
                w[-1] += step
                alpha[i] = new
    return w


class Model(NamedTuple):
    """langs by family, both in order; weights of each family's machine (none if there is one family) and of each pair (family, first, second)."""

    families: dict[str, list[str]]
    heads: np.ndarray
    pairs: dict[str, tuple[list[tuple[int, int]], np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores of rows of unit vectors."""
        names = list(self.families)
        x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
        if len(names) > 1:
            chance = np.exp(2 * np.clip(x @ self.heads.T, -20, 20))
            chance /= chance.sum(1, keepdims=True)
        else:
            chance = np.ones((len(x), 1))
        head = chance.argmax(1)
        score, found = chance[np.arange(len(x)), head], [""] * len(x)
        for k in np.unique(head):
            langs, rows = self.families[names[k]], np.flatnonzero(head == k)
            best = np.zeros(len(rows), int)
            if len(langs) > 1:
                ends, weights = self.pairs[names[k]]
                first = 1 / (1 + np.exp(-2 * np.clip(x[rows] @ weights.T, -20, 20)))
                votes, sums = np.zeros((len(rows), len(langs))), np.zeros((len(rows), len(langs)))
                for n, (a, b) in enumerate(ends):
                    votes[:, a] += first[:, n] >= 0.5
                    votes[:, b] += first[:, n] < 0.5
                    sums[:, a] += first[:, n]
                    sums[:, b] += 1 - first[:, n]
                best = (votes + sums / (len(langs) + 1)).argmax(1)  # sums are below the number of languages
                score[rows] *= sums[np.arange(len(rows)), best] / (len(langs) - 1)
            for row, b in zip(rows, best, strict=True):
                found[row] = langs[b]
        return found, np.clip(score, 0.0, 1.0)


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int, max_langs: int) -> tuple[list[str], DataFrame]:
    """(languages, (lang, nth, places, values) of per_lang texts of each at most, as a written table)."""
    learn = docs.where((F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) != 2) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("body"))
    counts = learn.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(max_langs).collect()
    langs = [r["lang"] for r in counts]
    # the least hashes are among those below a cutoff that some SPARE times as many rows pass; so few rows are ranked
    cutoffs = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 31, (SPARE * per_lang << 31) // r["count"])) for r in counts], "lang string, cutoff long")
    place = F.shiftrightunsigned(F.xxhash64("id"), 33)
    order = W.partitionBy("lang").orderBy(place, "id")
    chosen = learn.select("id", "lang").join(F.broadcast(cutoffs), "lang").where(place < F.col("cutoff")).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_lang).select("id", "lang").distinct()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one_id, lang, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts = text_counts(body.as_py())
                if counts is not None:
                    at = np.flatnonzero(counts)
                    out.append((one_id, lang, at.astype(np.int32), _unit(counts[at])))
            if out:
                kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["id", "lang", "places", "vals"])

    ship(docs.sparkSession)
    # max_langs * per_lang rows at most
    rows = learn.join(F.broadcast(chosen), ["id", "lang"]).select(F.xxhash64("id").alias("id"), "lang", "body").mapInArrow(vectors, "id long, lang string, places array<int>, vals array<double>")
    capped = rows.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("id", "places"))).where(F.col("nth") <= per_lang)
    return langs, materialize(capped.select("lang", "nth", "places", "vals"), "language-sample")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", families: Mapping[str, str] = FAMILIES, per_lang: int = PER_LANG, max_langs: int = MAX_LANGS, family_rows: int = FAMILY_ROWS) -> Model | None:
    """A model from rows with a language whose id's crc32 isn't 2 modulo 4; None if there is no such row with a letter."""
    langs, sample = _sample(docs, id_col, text_col, lang_col, per_lang, max_langs)
    learned = {r.lang for r in sample.select("lang").distinct().collect()}
    by_family: dict[str, list[str]] = defaultdict(list)
    for lang in sorted(learned):
        by_family[family_of(lang, families)].append(lang)
    by_family = dict(sorted(by_family.items()))
    # a machine: name, how many texts of each language, languages on its side, languages against
    machines = [(f"family {f}", max(1, family_rows // len(learned)), own, [x for x in sorted(learned) if x not in own]) for f, own in by_family.items() if len(by_family) > 1]
    machines += [(f"pair {a} {b}", per_lang, [a], [b]) for own in by_family.values() for i, a in enumerate(own) for b in own[i + 1 :]]
    spark = docs.sparkSession
    uses = [(name, lang, most, side) for name, most, own, other in machines for side, group in ((1, own), (-1, other)) for lang in group]
    weights: dict[str, np.ndarray] = {}
    if uses:

        def fitted(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["lang", "nth"])
            w = fit_machine([(np.asarray(a), np.asarray(v)) for a, v in zip(rows["places"], rows["vals"], strict=True)], rows["side"].to_numpy(float))
            return pd.DataFrame({"name": [key[0]], "w": [w]})

        table = spark.createDataFrame(uses, "name string, lang string, most int, side int")
        rows = sample.join(F.broadcast(table), "lang").where("nth <= most")
        weights = {r["name"]: np.array(r["w"], np.float32) for r in rows.groupBy("name").applyInPandas(fitted, "name string, w array<double>").collect()}
    discard(sample)
    if not learned:
        return None
    pairs = {}
    for f, own in by_family.items():
        ends = [(i, j) for i in range(len(own)) for j in range(i + 1, len(own))]
        if ends:
            pairs[f] = ends, np.array([weights[f"pair {own[i]} {own[j]}"] for i, j in ends])
    heads = np.array([weights[f"family {f}"] for f in by_family]) if len(by_family) > 1 else np.zeros((1, DIMENSIONS + 1), np.float32)
    return Model(by_family, heads, pairs)


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_langs and DIMENSIONS

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                langs, scores = [UNKNOWN] * part.num_rows, np.zeros(part.num_rows)
                vectors, rows = [], []
                for k, body in enumerate(part.column(1)):  # one text as a Python string at a time
                    counts = text_counts(body.as_py()) if shared.value else None
                    if counts is not None:
                        vectors.append(_unit(counts).astype(np.float32))
                        rows.append(k)
                if rows:
                    found, score = shared.value.predict(np.array(vectors))
                    scores[rows] = score
                    for k, lang in zip(rows, found, strict=True):
                        langs[k] = lang
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(scores)], ["id", "lang_pred", "score"])

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body")).mapInArrow(judged, "id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row, by a model of those that aren't held out."""
    out = predict(docs, fit(docs, id_col, text_col, lang_col, **bounds), id_col, text_col)
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return out.select("id", held.alias("held_out"), "lang_pred", "score")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")
