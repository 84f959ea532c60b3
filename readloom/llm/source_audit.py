"""How far the sources of a language diverge, and by which terms, by inclusion-exclusion over supports.

Every group (language, source) gives each kept term of its language a smoothed whole-number share p; a term that the
group never uses gets one constant, z. For two groups g and h the divergence sums f(p, q) over all kept terms, though
most terms are used by few groups. The sum is taken apart by support: all terms of g against h's constant, priced from
g's histogram of counts, and the same for h; the terms that neither uses as one product of constants (as if supports
were disjoint); and, for terms that both use, the difference to what was charged, from a join of postings. No term is
visited for a group that doesn't use it.

Terms are counted in tasks before anything is shuffled: what moves is a row for each term, group and task. Postings of a
term meet in blocks of GROUP_BLOCK groups a side, so that a term of very many groups isn't one task's; pairs are summed
where they arise. Groups' totals go along by broadcast up to BROADCAST_GROUPS, else by a salted join.

Defined results: a null text, language or source counts as empty; rows that repeat count as often as they come; a
language without a kept term has pairs of value 0 and no terms; an empty table gives an empty result; texts are read
whole; other columns are ignored. All arithmetic is exact: shares in decimal(38) division, sums of 64 bits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.llm.common import discard, documents, materialize, ship

#: A term of a language is kept if so many of its documents have it; ranks of terms that are returned.
MIN_DOCS, TOP = 10, 10
UNIT = 1_000_000_000
GROUP_BLOCK, BROADCAST_GROUPS, SALTS = 256, 50_000, 64
#: Different terms that a task holds before it hands them on, and bytes of a text that are split at once.
HELD_TERMS, PIECE = 500_000, 4_000_000
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, lower-cased, in lists of what PIECE bytes hold."""
    raw = text.encode("utf-8", "surrogatepass").translate(_TERMS)
    at = 0
    while at < len(raw):
        to = raw.find(b" ", at + PIECE)
        to = len(raw) if to < 0 else to
        yield raw[at:to].split()
        at = to + 1


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): how often a group has a term, and in how many of its documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

        def rows() -> Iterator[pa.RecordBatch]:
            for (one_lang, one_source), (n, of_docs) in held.items():
                terms = [t.decode("utf-8", "replace") for t in n]
                columns = [*[pa.array(x, pa.string()) for x in ([one_lang] * len(terms), [one_source] * len(terms), terms)], pa.array(list(n.values()), pa.int64()), pa.array([of_docs[t] for t in n], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            held.clear()

        for batch in batches:
            for one_lang, one_source, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                n, of_docs = held[one_lang, one_source]
                seen: set[bytes] = set()
                for words in _words(body.as_py()):
                    n.update(words)
                    seen.update(words)
                of_docs.update(seen)
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from rows()
        yield from rows()

    ship(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("body")).mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, terms: str) -> Column:
    """A term's share in units of UNIT, from 1 on."""
    wide = "DECIMAL(20, 0)"
    return F.expr(f"1 + (CAST({n} + 2 AS {wide}) * {UNIT}) div CAST({total} + 2 * {terms} AS {wide})")


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def _with_group(rows: DataFrame, groups: DataFrame, small: bool) -> DataFrame:
    if small:
        return rows.join(F.broadcast(groups), ["lang", "source"])
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"]).drop("salt")


def _sides(rows: DataFrame, blocks: int, keep: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows as (a_ columns, left block, right block) and (b_ columns, ...): every two rows meet at one pair of blocks."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int"))
    named = lambda x: [F.col(c).alias(f"{x}_{c}") for c in keep]
    key = [c for c in ("lang", "term") if c in rows.columns]
    left = rows.select(*key, F.col("block").alias("i"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("j"), *named("a")) if blocks > 1 else rows.select(*key, F.lit(0).alias("i"), F.lit(0).alias("j"), *named("a"))
    right = rows.select(*key, F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j"), *named("b")) if blocks > 1 else rows.select(*key, F.lit(0).alias("i"), F.lit(0).alias("j"), *named("b"))
    return left, right


def _met(sides: tuple[DataFrame, DataFrame], key: list[str]) -> DataFrame:
    return sides[0].join(sides[1], [*key, "i", "j"]).where("i < j OR a_source < b_source")


def audit_sources(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, top: int = TOP, group_block: int = GROUP_BLOCK, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, part `term` the terms that stand out most against the language."""
    counts = materialize(term_counts(docs, lang, source, text), "audit-counts")
    kept = materialize(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs"), "audit-kept")
    used = materialize(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "audit-used")
    discard(counts)
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    groups = docs.select(empty(lang).alias("lang"), empty(source).alias("source")).distinct()
    own = used.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    groups = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "support", "terms", "lang_total"])
    # without a kept term nothing is priced; the constant is then any
    groups = materialize(groups.withColumn("z", F.when(F.col("terms") > 0, _share("0", "total", "greatest(terms, 1)")).otherwise(1)), "audit-groups")
    n_groups, widest = groups.groupBy("lang").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.max("count"), F.lit(0))).first()
    blocks, small = max(1, -(-widest // group_block)), n_groups <= broadcast_groups

    priced = _with_group(used, groups.select("lang", "source", "total", "terms", "lang_total", "z"), small)
    priced = materialize(priced.select("lang", "source", "term", _share("n", "total", "terms").alias("p"), "z", _share("lang_n", "lang_total", "terms").alias("q")), "audit-priced")

    pairs = materialize(_met(_sides(groups, blocks, ["source", "z", "support", "terms"]), ["lang"]), "audit-pairs")
    neither = pairs.select("lang", "a_source", "b_source", F.expr(f"(a_terms - a_support - b_support) * ({_f('a_z', 'b_z')})").alias("value"))
    # a histogram of counts is one of shares, as one group has one total
    prices = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    charge = F.expr(f"times * ({_f('p', 'against')})").alias("value")
    one_sided = [prices.join(pairs.select("lang", F.col(f"{x}_source").alias("source"), "a_source", "b_source", F.col(f"{y}_z").alias("against")), ["lang", "source"]).select("lang", "a_source", "b_source", charge) for x, y in (("a", "b"), ("b", "a"))]
    both = _met(_sides(priced, blocks, ["source", "p", "z"]), ["lang", "term"])
    both = both.select("lang", "a_source", "b_source", F.expr(f"{_f('a_p', 'b_p')} - {_f('a_p', 'b_z')} - {_f('a_z', 'b_p')} + {_f('a_z', 'b_z')}").alias("value"))
    # each kind is summed where it arises; then a few rows a pair are left
    summed = [x.groupBy("lang", "a_source", "b_source").agg(F.sum("value").alias("value")) for x in (*one_sided, both)]
    total = neither.unionByName(summed[0]).unionByName(summed[1]).unionByName(summed[2]).groupBy("lang", "a_source", "b_source").agg(F.sum("value").alias("value"))
    total = materialize(total, "audit-values")
    ways = total.select("lang", F.col("a_source").alias("source"), F.col("b_source").alias("item"), "value").union(total.select("lang", "b_source", "a_source", "value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pair = ways.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    marked = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    term = marked.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
    out = materialize(pair.unionByName(term), "audit")
    discard(kept, used, groups, priced, pairs, total)
    return out


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(documents(spark, sf_dir))


def oracle(min_docs: int = MIN_DOCS, top: int = TOP) -> str:
    """Every group against every kept term, as the divergence is written."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    f = "((p - q) * (p - q)) // (p + q)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{lower}') AS text FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= {min_docs}),
g AS (SELECT DISTINCT lang, source FROM d),
x AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
c AS (SELECT g.lang, g.source, v.term, lang_n, coalesce(n, 0) AS n FROM g JOIN v ON g.lang = v.lang LEFT JOIN x ON x.lang = g.lang AND x.source = g.source AND x.term = v.term),
p AS (SELECT lang, source, term, n, 1 + CAST({UNIT} AS HUGEINT) * (n + 2) // (sum(n) OVER s + 2 * count(*) OVER s) AS p, 1 + CAST({UNIT} AS HUGEINT) * (lang_n + 2) // (sum(lang_n) OVER s + 2 * count(*) OVER s) AS q
      FROM c WINDOW s AS (PARTITION BY lang, source)),
e AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY ALL),
o AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value, row_number() OVER (PARTITION BY g.lang, g.source ORDER BY coalesce(value, 0) DESC, h.source) AS rank
      FROM g JOIN g h ON g.lang = h.lang AND g.source != h.source LEFT JOIN e ON e.lang = g.lang AND e.source = g.source AND e.item = h.source),
t AS (SELECT lang, source, 'term' AS part, term AS item, {f} AS value, row_number() OVER (PARTITION BY lang, source ORDER BY {f} DESC, term) AS rank FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT * FROM o UNION ALL SELECT * FROM t WHERE rank <= {top})
"""


ORACLE = oracle()
