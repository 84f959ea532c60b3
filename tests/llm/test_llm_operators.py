"""The training-data operators against brute force, on rows with nulls, empty and repeated texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from readloom.llm import bpe, exact_dedup, jaccard_join, mixing, pii, quality, sharding, suffix_dedup, token_files, url_filter
from readloom.llm.common import documents, materialize

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, sig long"


def rows():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    base = [" ".join(word() for _ in range(r.randint(60, 200))) for _ in range(12)]
    near = [b + " one more word here" for b in base[:4]]
    texts = [*base, *near, *base[:3], "", None, None, "a", "a b c", "ab" * 700, base[5][:300] + base[6][:300], "x" * 9000, "é ñ — “quoted” <|endoftext|> don't 123"]
    out = [(i, t, "en", f"src{i % 5}", len(t or ""), "clash", "clash", 1) for i, t in enumerate(texts)]
    return out + [out[0], (None, "nobody's text", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return materialize(spark.createDataFrame(rows(), SCHEMA).repartition(3), "fixture")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("bits", [256, 8])
def test_exact_dedup(docs, none, bits):
    """With digests of eight bits, which many chunks share, too."""
    got = exact_dedup.exact_dedup(docs, least=16, most=64, digest_bits=bits).drop("n_chunks")
    groups = {}
    for r in rows():
        groups.setdefault(r[1] or "", []).append(r[0])
    want = []
    for t, ids in groups.items():
        keep = max([i for i in ids if i is not None], default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert table(got) == sorted(want, key=repr)
    assert exact_dedup.exact_dedup(none).count() == 0
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    best = {t: max([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    assert table(kept) == sorted([r for r in rows() if r[0] == best[r[1] or ""]], key=repr)


def test_chunks_are_whole(spark):
    pattern = re.compile(exact_dedup.chunk_pattern(16, 64).replace(r"\z", r"\Z"))
    for t in [r[1] or "" for r in rows()]:
        assert "".join(m.group(0) for m in pattern.finditer(t)) == t


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, 4, salts=4, buckets=8, resolution=8).collect()
    assert len(got) == len(rows()) and sharding.shard_documents(none, 4).count() == 0
    where, slots = {}, {}
    texts = {r[0]: r[1] or "" for r in rows()}
    for r in got:
        t = texts[r.id]
        assert (r.size, r.text_crc32, r.law) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "bytes")
        where.setdefault(t, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 4


def test_sharding_by_brute_force(docs):
    """Every row's shard: groups by digest, those over an even share of what is left alone, the others cut at the least capacity that is enough."""
    n, groups = 4, {}
    for r in rows():
        groups.setdefault(hashlib.sha256((r[1] or "").encode()).digest(), []).append(r[0])
    size = {g: 0 for g in groups}
    for r in rows():
        size[hashlib.sha256((r[1] or "").encode()).digest()] += len((r[1] or "").encode()) + 8
    alone, left = [], sum(size.values())
    for g in sorted(groups, key=lambda g: (-size[g], g)):
        if len(alone) < n - 1 and size[g] * (n - len(alone)) > left:
            alone.append(g)
            left -= size[g]
        else:
            break

    def cuts(capacity):
        shard, room, out = 0, capacity, {}
        for g in sorted(groups):
            if g not in alone:
                if size[g] > room:
                    shard, room = shard + 1, capacity
                room -= size[g]
                out[g] = shard
        return out

    rest = [size[g] for g in groups if g not in alone]
    best = next(c for c in range(max(rest), sum(rest) + 1) if max(cuts(c).values()) < n - len(alone))
    want = cuts(best) | {g: n - 1 - i for i, g in enumerate(alone)}
    got = {(r.id, r.text_crc32): r.shard for r in sharding.shard_documents(docs, n, salts=4, buckets=8, resolution=8).collect()}
    assert got == {(r[0], zlib.crc32((r[1] or "").encode())): want[hashlib.sha256((r[1] or "").encode()).digest()] for r in rows()}


def test_minimax():
    r = random.Random(5)
    for _ in range(50):
        sizes = [r.randint(8, r.choice([20, 3000])) for _ in range(r.randint(1, 200))]
        n, ends = r.randint(1, 9), np.cumsum(sizes).tolist()

        def ask(spans, ends=ends):
            out = []
            for lo, hi in spans:
                width, cells = max(1, -(-(hi - lo) // 5)), {}
                for e in ends:
                    if lo < e <= hi:
                        cells.setdefault((e - lo - 1) // width, []).append(e)
                out += [(min(v), max(v), len(v)) for v in cells.values()]
            return sorted(out)

        def greedy(c, sizes=sizes, n=n):
            used, left = 1, c
            for s in sizes:
                if s > left:
                    used, left = used + 1, c
                left -= s
            return used <= n

        got = sharding.minimax_cuts(ask, ends[-1], max(sizes), n)[0]
        assert greedy(got) and (got == max(sizes) or not greedy(got - 1))


def test_quality(spark, docs, none):
    # two rules reject the same texts: after the cheaper one, the other rejects nothing more
    rejected = np.array([[1, 1, 0], [1, 1, 0], [0, 0, 1], [0, 0, 0]], bool)
    seconds = np.tile([2.0, 1.0, 3.0], (4, 1))
    assert quality.ordered(list("abc"), rejected, seconds) == ["b", "c", "a"]
    assert quality.ordered(list("abc"), rejected[:0], seconds[:0]) == ["a", "b", "c"]
    assert {x.shape for x in quality.profile_rules(docs, quality.RULES)} == {(len(rows()), len(quality.RULES))}
    got = {r.id: r for r in quality.quality_verdicts(docs).collect()}
    assert got[17 + 2].n_words == 0 and got[19].base_failed and not got[19].kept
    for r in rows():
        t = quality.Text(r[1])
        w = (r[1] or "").split(" ") if r[1] else []
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if c[x] > 1 for k in range(3)}
        assert t.n_repeat_words == len(again)
        assert got[r[0]].kept == (quality.first_rejection(t, quality.RULES) is None)
    assert quality.quality_verdicts(none).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    want = [r for r in rows() if quality.first_rejection(quality.Text(r[1]), quality.RULES) is None]
    assert table(kept) == sorted(want, key=repr) and 0 < len(want) < len(rows())


def test_pii(docs, none):
    k = b"key"
    for fn, s in [(pii.card, "4111 1111 1111 1111"), (pii.ip, "10.0.0.255"), (pii.date, "2024-02-29"), (pii.date, "31.12.1999"), (pii.ssn, "123-45-6789"), (pii.iban, "DE89 3704 0044 0532 0130 00"), (pii.phone, "+1 (017) 555-7713"), (pii.mail, "a.b1@x.org"), (pii.secret, "0a" * 20)]:
        new = fn(s, k)
        assert new != s and fn(s, k) == new and fn(new, k, True) == s
    assert pii.card("4111 1111 1111 1112", k) is None and pii.ip("1.2.3.256", k) is None and pii.date("2023-02-29", k) is None
    for n in (1, 2, 3, 100, 128, 1000):
        new = [pii.permute(i, n, k, "t") for i in range(n)]
        assert sorted(new) == list(range(n)) and [pii.permute(i, n, k, "t", True) for i in new] == list(range(n))
        assert n == 1 or all(i != j for i, j in enumerate(new))
    text = "call +1 (017) 555-7713, mail und.34@mail7.example.com### from 97.51.17.173. version 4.0."
    new, spans = pii.pseudonymise_text(text, k)
    assert [s[0] for s in spans] == ["phone", "mail", "ip"] and pii.pseudonymise_text("version 4.0 of 2", k) == ("version 4.0 of 2", [])
    got = {r.id: r.text for r in pii.pseudonymise(docs, k).collect()}
    assert got[20] is None and got[5] == rows()[5][1] and pii.pseudonymise(none, k).count() == 0
    assert pii.date("2024-02-29", k).split("-") == pii.date("29.02.2024", k).split(".")[::-1]


def test_pii_dates():
    """All spellings of all days: one pseudonym a day, no two days with the same, nothing in its place, and back again."""
    import datetime

    k, became = b"key", {}
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(n) for n in range(2000)] + [datetime.date(y, m, d) for y in (1, 4, 1899, 1900, 2099, 2100, 9999) for m, d in ((1, 1), (2, 28), (12, 12), (12, 13), (12, 31))]
    for d in days:
        y, m, n = f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}"
        for s, order in ((f"{y}-{m}-{n}", "ymd"), (f"{y}/{m}/{n}", "ymd"), (f"{n}.{m}.{y}", "dmy"), (f"{m}/{n}/{y}", "mdy"), *([(f"{n}/{m}/{y}", "dmy")] if d.day > 12 else [])):
            new = pii.date(s, k)
            assert pii.date(new, k, True) == s and len(new) == len(s)
            parts = dict(zip(order, map(int, new.replace("/", "-").replace(".", "-").split("-")), strict=True))
            became.setdefault(d, set()).add(datetime.date(parts["y"], parts["m"], parts["d"]))
    assert all(len(v) == 1 and d not in v for d, v in became.items())
    assert len(set.union(*became.values())) == len(became)


def test_pii_of_all_scripts(docs):
    """Digits and letters beyond ASCII are replaced within their script, and a span never is what it was."""
    k, r = b"key", random.Random(9)
    arabic = str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩")
    for s in ("4111 1111 1111 1111", "+1 (017) 555-7713", "2024-02-29", "10.0.0.255"):
        new, spans = pii.pseudonymise_text("no " + s.translate(arabic) + " ok", k)
        plain = pii.pseudonymise_text("no " + s + " ok", k)
        assert spans == plain[1] and len(spans) == 1 and new == plain[0].translate(arabic)
    for local in ("иван", "王小明", "ΑΒγ", "a", "я", "é", "ab.ш1"):
        new, spans = pii.pseudonymise_text(f"to {local}@x.org now", k)
        assert [s[0] for s in spans] == ["mail"] and new != f"to {local}@x.org now" and new.endswith("@x.org now") and len(new) == len(local) + len("to @x.org now")
    assert pii.pseudonymise_text("-@x.org", k) == ("-@x.org", [])
    # every span that is counted has changed, whatever the text
    pieces = ["4111111111111111", "a@b.de", "я@b.de", "1.1.2000", "2000-01-31", "12/31/1999", "31/12/1999", "127.0.0.1", "123-45-6789", "DE89370400440532013000", "0a" * 16, "٣", "x", " ", "\n", "+49 171 2345 6789", ".", "é"]
    for _ in range(300):
        text = "".join(r.choice([*pieces, " ", " "]) for _ in range(r.randint(1, 12)))
        new, spans = pii.pseudonymise_text(text, k)
        at_old = at_new = 0
        for kind, a, b in spans:  # what is between the spans stays, and each is what its own function gives
            assert new[at_new : at_new + a - at_old] == text[at_old:a]
            own = pii.KINDS[kind][1](text[a:b].translate(pii._FOLD), k)
            at_new += a - at_old
            assert own != text[a:b] and new[at_new : at_new + len(own)].translate(pii._FOLD) == own
            at_old, at_new = b, at_new + len(own)
        assert new[at_new:] == text[at_old:]
    got = {(x.id, x.text, tuple(map(tuple, x.spans))) for x in pii.pseudonymise(docs, k).collect()}
    assert got == {(row[0], *(lambda o: (o[0], tuple(o[1])))(pii.pseudonymise_text(row[1], k) if row[1] is not None else (None, []))) for row in rows()}


@pytest.mark.parametrize("kind,number", [("card", "4111 1111 1111 1111"), ("card", "3782-822463-10005"), ("iban", "BE68 5390 0754 7034"), ("iban", "DE89370400440532013000"), ("phone", "+49 171 2345 6789"), ("date", "31.12.1899"), ("date", "2100-01-01")])
def test_pii_with_neighbours(kind, number):
    """A valid number is replaced whatever digits or capitals stand beside it."""
    k = b"key"
    want = pii.KINDS[kind][1](number, k)
    assert want and pii.KINDS[kind][1](want, k, True) == number
    before = {"card": ["", "card ", "order 7 ", "12 34 ", "2024-01-02 "], "iban": ["", "AB12 ", "IBAN ", "7 "], "phone": ["", "call 7 "], "date": ["", "born 7 "]}[kind]
    after = {"card": ["", " 123", " 12/27", " 7 8", ", 9"], "iban": ["", " IS mine", " THIS is", " 1234 AND", " X"], "phone": ["", " 2024", " 2024 1234", ", 9"], "date": ["", " 7", ", 9"]}[kind]
    for a in before:
        for b in after:
            new, spans = pii.pseudonymise_text(a + number + b, k)
            # or, if it passes its check as well, with neighbours
            assert any(s[0] == kind and s[1] <= len(a) and len(a + number) <= s[2] for s in spans) and number not in new, a + number + b
            assert want in new or (kind, len(a), len(a + number)) not in spans
    assert pii.pseudonymise_text("card 4111 1111 1111 1112 12", k)[1] == [] and pii.pseudonymise_text("BE68 5390 0754 7035 IS", k)[1] == []


def test_pii_cards_in_runs():
    """Every stretch of whole groups that passes its check is in a span or shares digits with one."""
    r = random.Random(4)
    for _ in range(200):
        groups = ["".join(r.choice("0123456789") for _ in range(r.randint(1, 6))) for _ in range(r.randint(1, 12))]
        text, at, ends = " ".join(groups), [], []
        for g in groups:
            at.append(ends[-1] + 1 if ends else 0)
            ends.append(at[-1] + len(g))
        want = {(a, e) for a in at for e in ends if e > a and pii.card(text[a:e], b"key")}
        assert {c[:2] for c in pii._cards(text)} == want
        spans = [s[1:] for s in pii.pseudonymise_text(text, b"key")[1]]
        assert all(any(a < e2 and a2 < e for a2, e2 in spans) for a, e in want)


def test_token_files(spark, docs, none, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    path = token_files.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    token_files.write_token_files(docs, str(tmp_path / "t"), path, rows_per_file=10)
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == sorted([r[0] for r in rows()], key=lambda i: -1 if i is None else i)
    texts, at = {r[0]: r[1] or "" for r in rows()}, 0
    for r in got:
        assert r.tokens == [*tok.encode(texts[r.id], add_special_tokens=False).ids, 2] and (r.start, r.n_tokens) == (at, len(r.tokens))
        at += r.n_tokens
    # totals in several blocks, and too many to broadcast
    monkeypatch.setattr(token_files, "FILES_TOGETHER", 1)
    monkeypatch.setattr(token_files, "BROADCAST_FILES", 0)
    assert sorted((r.start, r.n_tokens) for r in token_files.read_metadata(spark, str(tmp_path / "t")).collect()) == [(r.start, r.n_tokens) for r in got]
    few = token_files.read_tokens(spark, str(tmp_path / "t"), 5, 7)
    assert sorted(r.id for r in few.collect()) == [5, 6, 7]
    assert "tokens" not in token_files.read_metadata(spark, str(tmp_path / "t")).columns
    token_files.write_token_files(none, str(tmp_path / "e"), path)
    assert token_files.read_tokens(spark, str(tmp_path / "e")).count() == 0


def test_words_and_marks():
    """Words cut at their marks, and lower-case ones merged straight away, have the library's ids."""
    from tokenizers import Tokenizer

    path, r = token_files.vocabulary("word_bpe_49k.json"), random.Random(1)
    pieces = ["don't", "it's", "É", "é,", "ñandú", "İ", "ŉa", "ª", "a≠", "dog's'", "'s", "rock'n'roll!!", "Bc,", "12a.", "3,4!", "<|endoftext|>", "a<|endoftext|>.", "~", "a~~b~", "ß", "ǅ", "中文.", "ﬁ", "e\u0301.", "\x1c", "½!", "ab_c_", "naïve,", "aͅ,"]
    texts = ["".join(r.choice([*pieces, " ", "\n", "'", ".", "s"]) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    ids, counts = token_files.encode_texts(texts, path)
    at = np.concatenate(([0], np.cumsum(counts)))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert all(ids[at[k] : at[k + 1]].tolist() == e.ids for k, e in enumerate(want))


@pytest.mark.parametrize("known", [900_000, 3])
def test_words_once(monkeypatch, known):
    """Of a stretch of documents each different word is looked at once, without its marks and capitals; forgotten words are encoded again."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "CACHE_WORDS", known)
    monkeypatch.setattr(token_files, "STRETCH", 60)
    monkeypatch.setattr(token_files, "_loaded", {})
    path, r = token_files.vocabulary("word_bpe_49k.json"), random.Random(2)
    texts = [" Reads, reads!! READS\treads\x0b", "", " \n", "Über, reads. <|endoftext|> <B>", "\x1creads\u2003reads", *(" ".join(r.choices(["reads,", "Ñandú!", "'s", "&&&", "H\u0331y.", "it's.", "x1-"], k=r.randint(0, 20))) for _ in range(50))]
    rows = pa.array([*texts[:2], None, *texts[2:]])
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch([x or "" for x in rows.to_pylist()], add_special_tokens=False)]
    got, cuts = [], list(token_files._stretches(pc.fill_null(rows, "")))
    for k, n in cuts:
        ids, counts = token_files.encode_texts(pc.fill_null(rows, "").slice(k, n), path)
        got += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == want and len(cuts) > 10 and [c[0] for c in cuts] == [0, *np.cumsum([c[1] for c in cuts])[:-1]]
    token_files._loaded.clear()
    token_files.encode_texts(texts[:1], path)
    assert set(token_files._loaded[path][2].number) == {b"", b"reads", b",", b"!!"}


def test_capitals_with_marks(spark, tmp_path):
    """Capitals that have no composed form with a mark, while their lower-case letters have one."""
    import unicodedata

    from tokenizers import Tokenizer

    marks = {d[1] for d in (unicodedata.decomposition(chr(c)).split() for c in range(0x110000)) if len(d) == 2 and d[0][0] != "<" and int(d[0], 16) < 128}
    assert {chr(int(m, 16)).encode()[0] for m in marks} == {0xCC}  # encode_texts looks for these bytes
    path = token_files.vocabulary("word_bpe_49k.json")
    pairs = ["H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u030c"]
    texts = [f"{a}{p}{z}" for p in [*pairs, "E\u0301", "e\u0301", "H\u0323\u0331"] for a in ("", "x", "A ") for z in ("", "y", ",", " Bé")]
    ids, counts = token_files.encode_texts(texts, path)
    at = np.concatenate(([0], np.cumsum(counts)))
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))] == [e.ids for e in want]
    assert [len(token_files.encode_texts([t], path)[0]) for t in ("xH\u0331y", "xh\u0331y")] == [4, 5]
    token_files.write_token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "m"), path)
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "m")).collect())
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([len(e.ids) + 1 for e in want])))[:-1].tolist()


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = token_files.vocabulary("byte_bpe_50k.json")
    tok, vocab, r = Tokenizer.from_file(path), bpe.load(path), random.Random(1)
    letters = [*"abcdeéßñ01 \n\t\r    \x85'!?.,#<|>ŁΩж中文😀", "'s", "<|endoftext|>", "  ", "the "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    ids, counts = vocab.encode(texts)
    at, decoded = np.concatenate(([0], np.cumsum(counts))), vocab.decode(ids, counts).to_pylist()
    for k, t in enumerate(texts):
        mine = ids[at[k] : at[k + 1]]
        assert mine.tolist() == tok.encode(t, add_special_tokens=False).ids and decoded[k] == t
    # words of any length, over and under the one that is merged alone, and with equal tokens in a row
    texts = ["".join(r.choice(a) for _ in range(n)) for a in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "éß中", ".-=", "01") for n in (1, 2, 3, 7, 8, 255, 256, 257, 3000)]
    texts += ["\0a b", "a \0b", "b\0a", " a", "  a", "a ", ""]
    vocab.clear()
    ids, counts = vocab.encode(texts * 2)
    at = np.concatenate(([0], np.cumsum(counts)))
    for k, t in enumerate(texts * 2):
        assert ids[at[k] : at[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t[:20]
    # ids that give no UTF-8: what the library's decoder says
    for _ in range(200):
        some = np.array([r.randrange(256) for _ in range(6)])
        assert vocab.decode(some, np.array([3, 3])).to_pylist() == [tok.decode(x.tolist(), skip_special_tokens=False) for x in (some[:3], some[3:])]
    got = {x.id: x for x in bpe.bpe_round_trip(docs, path).collect()}
    for row in rows():
        assert got[row[0]].decoded == (row[1] or "") and got[row[0]].tokens == tok.encode(row[1] or "", add_special_tokens=False).ids
    assert bpe.bpe_round_trip(none, path).count() == 0


def repeats(texts, window=200):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in raws for i in range(len(b) - window + 1))
    out = []
    for b in raws:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = True
        out.append((len(b), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("hot,bits", [(20_000, 64), (1, 64), (20_000, 2)])
def test_suffix_dedup(docs, none, hot, bits):
    """With hot anchors, and with text hashes of two bits, which all meet, too."""
    got = suffix_dedup.suffix_dedup(docs, hot=hot, bits=bits).collect()
    want = [(r[0], *x) for r, x in zip(rows(), repeats([r[1] for r in rows()]), strict=True)]
    assert sorted(((r.id, r.n_bytes, bytes(r.kept)) for r in got), key=repr) == sorted(want, key=repr)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_long_texts_in_blocks(monkeypatch):
    """Texts longer than a block have the same shingles and anchors as in one block."""
    r = random.Random(6)
    text = " ".join("".join(r.choice("abcé") for _ in range(r.randint(1, 9))) + r.choice(["", "", "\n", " \t"]) for _ in range(4000))
    whole, places = jaccard_join.shingles([text, None, "a b", text])[0], suffix_dedup.anchors(np.frombuffer(text.encode(), np.uint8))
    monkeypatch.setattr(jaccard_join, "BLOCK", 100)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    monkeypatch.setattr(jaccard_join, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    assert (jaccard_join.shingles([text])[0] == whole).all() and len(whole) > 3000
    again = suffix_dedup.anchors(np.frombuffer(text.encode(), np.uint8))
    assert (np.repeat(places[0], places[2]) == np.repeat(again[0], again[2])).all() and places[2].sum() == len(text.encode()) - 199


def test_merged_transforms():
    r = random.Random(2)
    parts = [bytes(r.choice(b"ab") for _ in range(300)) for _ in range(12)]
    parts += [parts[0][50:260] + parts[1][:120], b"xyz" * 150]
    seen = Counter(s[i : i + 200] for s in parts for i in range(len(s) - 199))
    for flags, s in zip(suffix_dedup.repeated_windows(parts, shard=700), parts, strict=True):
        assert flags.tolist() == [seen[s[i : i + 200]] > 1 for i in range(len(s) - 199)]


def linked(texts):
    """(shingle sets, linked pairs of places) by brute force."""
    words = [[w for w in re.split(r"[\x20\x09-\x0d]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w] for t in texts]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset()) for w in words]
    return sets, [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 80 * len(a | b)]


def component_ids(ids, sets, pairs):
    up = list(range(len(sets)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i, j in pairs:
        up[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(zip(ids, sets, strict=True))]


@pytest.mark.parametrize("bits,long_", [(64, jaccard_join.LONG), (3, 2)])
def test_jaccard(docs, none, bits, long_):
    """With names of three bits, which all meet, and with lists that are long from three rows on, too."""
    sets, pairs = linked([r[1] or "" for r in rows()])
    want = component_ids([r[0] for r in rows()], sets, pairs)
    assert table(jaccard_join.jaccard_components(docs, bits=bits, long_=long_)) == sorted(want, key=repr)
    assert jaccard_join.jaccard_components(none, bits=bits).count() == 0


def test_jaccard_links(spark):
    """All links between different sets, in families of near copies, small sets and long ones."""
    r = random.Random(8)
    texts = []
    for n in (6, 9, 14, 25, 40, 90):
        base = [r.choice("abcdefghijklmnop") * 2 + str(r.randint(0, 99)) for _ in range(n)]
        for _ in range(7):
            w = list(base)
            for _ in range(r.randint(0, 2)):
                w[r.choice([0, -1])] = f"w{r.randint(0, 9)}"
            texts.append(" ".join(w + base[: r.randint(0, 2)]))
    sets, pairs = linked(texts)
    links, members = jaccard_join.jaccard_links(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), long_=3)
    of = dict(map(tuple, members.collect()))
    want = {frozenset((of[i], of[j])) for i, j in pairs if sets[i] != sets[j]}
    got = [frozenset(p) for p in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 30


def test_jaccard_common_passage(spark):
    """Texts that share half their words, each in a task of its own: no pair of them is looked at."""
    common, n = " ".join(f"c{i}" for i in range(60)), 150
    texts = [(i, common + " " + " ".join(f"x{i}y{k}" for k in range(60))) for i in range(n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(50, "doc_id")
    join = jaccard_join._lists(docs, "doc_id", "text", 64, 8)
    assert jaccard_join._candidates(join, None).count() < n
    assert {r.component_id for r in jaccard_join._labelled(join, 8).collect()} == set(range(n))


def test_drop_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(40))
    given = [(1, base, "k"), (5, base + " more", "k"), (5, "something else " * 9, "k"), (None, base, "k"), (None, "alone here", "k"), (7, None, "k"), (8, "", "k"), (9, "alone here", "k"), (9, "alone here", "k"), (None, "no id at all", None), (None, "no id at all", None)]
    docs = spark.createDataFrame(given, "doc_id long, text string, gone_id string")
    want = [given[i] for i in (0, 2, 5, 6, 7, 8, 9, 10)]
    assert table(jaccard_join.drop_near_duplicates(docs)) == sorted(want, key=repr)
    assert jaccard_join.drop_near_duplicates(docs.where("false")).count() == 0


def test_mixing(docs, none):
    got = mixing.mix_sources(docs, epochs=2, share=(1, 2)).collect()
    total = sum(r.tokens for r in got)
    assert len(got) == len(rows()) and total * 0.2 < sum(r.tokens * r.copies for r in got) <= total // 2
    assert all(r.copies <= 2 or not r.tokens for r in got) and mixing.mix_sources(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    # a row goes by its own leaf, whatever the others with its id do, and columns may be named as in the plan
    named = docs.withColumns({"copies": F.lit(7), "doc": F.lit(8), "epoch": F.lit(9)})
    want = Counter({tuple(map(str, (r[0], r[3]))): 0 for r in rows()})
    for r in got:
        want[str(r.id), str(r.source or None)] += r.copies
    taken = mixing.mixed_documents(named, epochs=2, share=(1, 2))
    assert taken.columns == named.columns
    assert +want == Counter((str(r.doc_id), str(r.source)) for r in taken.collect())
    twice = docs.sparkSession.createDataFrame([(1, "a b", "en", "src1"), (1, "c d e f", "en", "src2"), (2, "g", "en", "src2")], "doc_id long, text string, lang string, source string")
    own = Counter({(r.id, r.source): r.copies for r in mixing.mix_sources(twice, epochs=3, share=(3, 2)).collect()})
    assert +own == Counter((r.doc_id, r.source) for r in mixing.mixed_documents(twice, epochs=3, share=(3, 2)).collect())


def test_urls(spark):
    urls = ["https://A.example.NET/en/1?x", "http://net/", "https://x.org/fr/?q", "http://example.com/de/a#b", "ftp://host", None, "no scheme", "http://net"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "clash")], "page_id long, url string, rule string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.rule_table(spark)).collect()}
    assert got == {0: ("a.example.net", "/en/1", "example.net/en/", "allow"), 1: ("net", "/", "net/", "block"), 2: ("x.org", "/fr/", "org/fr/", "allow"), 3: ("example.com", "/de/a", "example.com/de/", "block"), 4: ("host", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"), 7: ("net", "", None, "allow")}
    assert url_filter.filter_urls(pages, url_filter.rule_table(spark)).count() == 9
    assert {r.verdict for r in url_filter.filter_urls(pages, url_filter.rule_table(spark).where("false"), default="block").collect()} == {"block"}
    assert url_filter.filter_urls(pages.where("false"), url_filter.rule_table(spark)).count() == 0
    # host and path of a rule don't run into each other; of rules of one length the longer host decides, then block
    rules = url_filter.rule_table(spark, [("example.co", "m", "block"), ("org", "", "block"), ("a.net", "/b", "allow"), ("net", "/b/c", "block"), ("x.de", "/", "allow"), ("x.de", "/", "block")])
    pages = spark.createDataFrame(list(enumerate(["http://example.com", "http://q.org/x", "http://a.net/b/c", "http://x.de/"])), "page_id long, url string")
    got = {r.id: (r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules).collect()}
    assert got == {0: (None, "allow"), 1: ("org", "block"), 2: ("a.net/b", "allow"), 3: ("x.de/", "block")}


def test_pipeline(spark):
    """All stages against plain Python, DuckDB for the mixture and the library for the ids."""
    import corpus_pipeline
    import duckdb
    import pyarrow as pa
    from tokenizers import Tokenizer

    docs = documents(spark, SF)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.columns == names
    left = [tuple(r) for r in docs.collect()]
    left = [r for r in left if quality.first_rejection(quality.Text(r[1]), quality.RULES) is None]
    last = {}
    for r in left:
        last[r[1] or ""] = max(r[0], last.get(r[1] or "", -1))
    left = [r for r in left if last[r[1] or ""] == r[0]]
    component = component_ids([r[0] for r in left], *linked([r[1] or "" for r in left]))
    left = [r for r, (i, _, c) in zip(left, component, strict=True) if i == c]
    con = duckdb.connect()
    con.register("documents", pa.table({n: [r[k] for r in left] for k, n in enumerate(names)}))
    kept = {i for i, k in con.execute(f"SELECT doc_id, kept FROM ({mixing.oracle(**corpus_pipeline.MIX)})").fetchall() if k}
    left = [r for r in left if r[0] in kept]
    tok = Tokenizer.from_file(token_files.vocabulary("byte_bpe_50k.json"))
    want = []
    for r in left:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert table(corpus_pipeline.run(spark, SF)) == sorted(want, key=repr) and len(want) > 20


def test_pipeline_stages_alone(spark):
    """Every stage on no rows, and on rows with nulls, repeats and further columns, returns the columns that it was given."""
    import corpus_pipeline

    given = "doc_id long, text string, lang string, source string, n_chars long, copies long, epoch string"
    some = [(1, "a b c", "en", "src1", 5, 1, "x"), (1, "a b c", "en", "src1", 5, 1, "x"), (None, None, None, None, None, None, None), (2, "", "de", "other", 0, 2, "y"), (3, "w" * 5000, None, "src2", 5000, 3, None)]
    for rows_ in ([], some):
        docs = spark.createDataFrame(rows_, given)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.count() <= len(rows_)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows_)
