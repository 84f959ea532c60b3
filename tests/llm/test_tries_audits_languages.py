"""Conversation tries, source audits and language identification against brute force, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from readloom.llm import language_id, prefix_trie, source_audit
from readloom.llm.common import documents, materialize

SF = "/root/testdata/sf0.001"
TALK = "conv_id long, turn long, role string, text string, conv long, depth long, words long, n long"


def talk():
    r = random.Random(5)
    said = ["hello there", "hi", "", None, "what is it", "the same words here", "x y z " * 40]
    rows = []
    for c in [*range(0, 70), 200, 219, 977]:
        if c in (20, 45):
            continue
        for t in range(r.choice([1, 2, 2, 3, 4, 6])):
            rows.append((c, t if t else r.choice([0, None]), r.choice(["user", "assistant", None]), r.choice(said), 1, 2, 3, 4))
    rows += [(61, 100 + t, "user", "again and again", 1, 2, 3, 4) for t in range(300)]
    rows += [(66, 100 + t, "user", "again and again", 1, 2, 3, 4) for t in range(250)]
    rows += [rows[3], rows[3], rows[40], (None, 0, "user", "nobody's", None, None, None, None), (5, None, None, None, None, None, None, None)]
    return rows


def trie(rows, shared):
    convs = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    if shared:
        every, most = shared
        h = {c: zlib.crc32(str(c).encode()) % most for c in turns}
        turns = {c: turns.get(c - c % every, [])[: h[c]] + own[h[c] :] for c, own in turns.items()}
    nodes = defaultdict(list)
    for c, t in turns.items():
        for d in range(len(t) + 1):
            nodes[tuple(t[:d])].append(c)
    inside = lambda p: [q for q in nodes if q[: len(p)] == p]
    out = []
    for p, members in nodes.items():
        below = inside(p)
        ends = [c for c in sorted(members) if len(turns[c]) == len(p)]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        leaves = sum(1 for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below))
        children = sum(1 for q in below if len(q) == len(p) + 1)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children, leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out)


@pytest.fixture
def no_coalescing(spark):
    """Ranges stay as many as they are, so that a long conversation lies in several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize(("shared", "hot"), [(None, 5_000), ((20, 4), 5_000), ((20, 4), 3)])
def test_prefix_trie(spark, no_coalescing, monkeypatch, shared, hot):
    monkeypatch.setattr(prefix_trie, "HOT_SHARE", hot)
    rows = talk()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, TALK).repartition(3), shared)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == [r for r in sorted(trie(rows, shared), key=lambda r: r[:2])]


def test_long_conversations_lie_in_several_ranges(spark, no_coalescing):
    all_, _ = prefix_trie.prefixes(spark.createDataFrame(talk(), TALK))
    assert all_.where("conv = 61").select("part").distinct().count() > 1


def test_prefix_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], TALK), (20, 4)).count() == 0
    only = spark.createDataFrame([(21, None, None, None)], "conv_id long, turn long, role string, text string")
    # the one turn is replaced by turns that aren't there: 21 is a member of the root alone, if its h is not 0
    assert sorted(map(tuple, prefix_trie.prefix_trie(only, (20, 4)).collect())) == trie([(21, None, None, None)], (20, 4))
    alone = prefix_trie.prefix_trie(only).orderBy("depth").collect()
    assert [(r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in alone] == [(0, 1, 1, 1, 0), (1, 1, 0, 1, 0)]


def test_hashes_over_several_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        ends = spark.range(500).selectExpr("id % 3 AS conv", "id % 2 AS depth", "id * 11 AS member").union(spark.sql("SELECT 9L, 9L, -4L"))
        got = {(r.conv, r.depth): r.ends_sha256 for r in prefix_trie.joined_hashes(ends).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = defaultdict(list)
    for i in range(500):
        want[i % 3, i % 2].append(i * 11)
    want[9, 9] = [-4]
    assert got == {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}


DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, value long, p long"


def texts():
    r = random.Random(11)
    words = ["Alpha", "beta", "gamma", "Déjà", "vu", "zeta", "eta", "theta", "ÀB", "àb"]
    out = []
    for i in range(120):
        lang = r.choice(["en", "en", "fr", None])
        own = words[: 3 + zlib.crc32(str(i % 7).encode()) % 7]
        text = r.choice([None, "", "123 \x7f\x00"]) if i % 13 == 0 else " ".join(r.choice(own) for _ in range(r.randint(1, 40))) + r.choice([".", "|x1y2", "\t"])
        out.append((i, text, lang, r.choice(["a", "b", None, "ç", f"s{i % 7}"]), 0, "clash", 1, 1))
    out += [(200 + k, None, "xx", s, 0, None, None, None) for k, s in enumerate(("a", "b"))] + [out[5], out[5]]
    return out


def audit(rows, min_docs, top):
    groups, of_docs, n = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        g = lang or "", source or ""
        groups.add(g)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        n[g].update(terms)
        of_docs[g[0]].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in of_docs[lang].items() if d >= min_docs]
        own = sorted(g for g in groups if g[0] == lang)
        total = Counter()
        for g in own:
            total.update(n[g])

        def shares(counts):
            all_ = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (all_ + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {g: shares(n[g]) for g in own}, shares(total)
        for g in own:
            pairs = [(-sum(f(p[g][t], p[h][t]) for t in kept), h[1].encode(), h[1]) for h in own if h != g]
            out += [(*g, "pair", x[2], -x[0], k) for k, x in enumerate(sorted(pairs), 1)]
            terms = [(-f(p[g][t], q[t]), t.encode(), t) for t in kept if n[g][t] and p[g][t] > q[t]]
            out += [(*g, "term", x[2], -x[0], k) for k, x in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "small", "held"), [(256, 50_000, 500_000), (2, 0, 5)])
def test_source_audit(spark, monkeypatch, block, small, held):
    """Also with several blocks of groups, a salted join and terms handed on early."""
    monkeypatch.setattr(source_audit, "HELD_TERMS", held)
    monkeypatch.setattr(source_audit, "PIECE", 16)
    rows = texts()
    got = source_audit.audit_sources(spark.createDataFrame(rows, DOCS).repartition(3), min_docs=4, top=3, group_block=block, broadcast_groups=small)
    assert sorted(map(tuple, got.collect())) == audit(rows, 4, 3)
    assert source_audit.audit_sources(spark.createDataFrame([], DOCS)).count() == 0


def test_terms_of_a_long_text(spark):
    rows = [(i, "aa bb " * 1_500_000 + "cc", "en", f"s{i}", 0, "", 0, 0) for i in range(2)]
    got = {(r.source, r.term): (r.n, r.docs) for r in source_audit.term_counts(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(f"s{i}", t): (1_500_000 if t != "cc" else 1, 1) for i in range(2) for t in ("aa", "bb", "cc")}


def test_language_accuracy(spark):
    """On rows that nothing is learned from."""
    docs = documents(spark, SF)
    got = language_id.op13_language_id(spark, SF)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == docs.count()
    both = got.join(docs, "doc_id")
    for r in both.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = both.where("held_out AND lang IS NOT NULL")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count() > 20


def test_language_of_odd_rows(spark):
    docs = documents(spark, SF).select("doc_id", "text", "lang", F.lit("clash").alias("id"), F.lit(1).alias("score"))
    odd = spark.createDataFrame([(None, "the of and ing", "en"), (-5, None, "en"), (-6, "", None), (-7, "12 34 !!", "fr"), (-8, "Étionpa ouchoi onellevi éoiquere étionou " * 60_000, None), (-9, "e", None), (-9, "e", None)], "doc_id long, text string, lang string")
    both = materialize(docs.unionByName(odd.withColumns({"id": F.lit("x"), "score": F.lit(2)})), "languages")
    got = {(r.id, r.held_out): (r.lang_pred, r.score) for r in language_id.identify(both).where("id < 0 OR id IS NULL").collect()}
    crc = lambda k: zlib.crc32(str(k).encode()) % 4 == 2
    assert got[None, False][0] == "en"
    assert [got[k, crc(k)] for k in (-5, -6, -7)] == [("und", 0.0)] * 3
    assert got[-8, crc(-8)][0] == "fr" and got[-9, crc(-9)][0] in ("en", "de", "fr", "es")


def test_languages_that_cannot_be_told(spark):
    schema = "doc_id long, text string, lang string"
    assert language_id.identify(spark.createDataFrame([], schema)).count() == 0
    nothing = language_id.identify(spark.createDataFrame([(1, "some words", None)], schema)).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    one = language_id.identify(spark.createDataFrame([(i, "some words", "qq") for i in range(9)], schema)).collect()
    assert {(r.lang_pred, r.score) for r in one} == {("qq", 1.0)}


def test_families():
    assert [language_id.family_of(x) for x in ("en", "de-AT", "fr", "PT_br", "qq")] == ["germanic", "germanic", "romance", "romance", "qq"]


def test_pieces_of_a_text(monkeypatch):
    text = "Größe und Maß, 12 Dinge; l'été à Nîmes " * 30
    whole = language_id.text_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 7)
    assert (language_id.text_counts(text) == whole).all()
