"""Figures of very large contigs, rows that repeat, sequences that are too short."""

import pytest
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.operators import intervals as I
from readloom.operators import joins as J
from readloom.operators import lengths as L
from readloom.operators import phasing as P


def test_esize_of_large_contigs(spark):
    contigs = spark.range(200).selectExpr("250000000L AS len", "id AS pos")
    assert L.length_report(contigs, "len").first().esize == L.length_stats(contigs, "len").first().esize == 250_000_000.0
    assert L.assembly_stats(contigs, "len").first()["esize"] == 250_000_000


@pytest.fixture(scope="module")
def with_empty(spark):
    """Reads of which some have no bases."""
    return spark.createDataFrame(list(enumerate([30, 0, 10, 0, 20, 20, 0, 20])), "pos long, len long")


def test_points_with_reads_without_bases(with_empty):
    got = {r.percent: (r.nx, r.lx) for r in L.nx_lx(with_empty, "len").collect()}
    assert got == {50: (20, 2), 75: (20, 4), 90: (20, 4), 95: (10, 5), 100: (10, 5)}
    assert {(r.nx, r.lx) for r in L.nx_lx(with_empty.where("len = 0"), "len").collect()} == {(0, 1)}


def test_report_with_reads_without_bases(with_empty):
    r = L.length_report(with_empty, "len").first()
    assert (r.number, r.total, r.median, r.min, r.max, r.n50, r.l50, r.n95, r.l95) == (8, 100, 10, 0, 30, 20, 2, 10, 5) and r.esize == 22.0
    none = L.length_report(with_empty.where("len = 0"), "len").first()
    assert (none.number, none.total, none.n50, none.l50) == (3, 0, 0, 1)


def test_preassembly_with_reads_without_bases(with_empty):
    r = L.preassembly_stats(with_empty, with_empty.where("len != 20"), 0, 100).first()
    assert (r.raw_reads, r.raw_bases, r.raw_n50, r.seed_reads, r.preassembled_reads, r.preassembled_n50, r.preassembled_seed_truncation) == (8, 100, 20, 8, 5, 30, 0.0)


def test_assembly_with_contigs_without_bases(with_empty):
    r = L.assembly_stats(with_empty, "len").first()
    assert (r["sum"], r["N100"], r["L100"], r["N90"], r["L90"], r["N50"], r["L50"], r["esize"]) == (100, 10, 5, 20, 4, 20, 2, 22)


def test_assembly_table_with_contigs_without_bases(with_empty):
    lines = L.assembly_table(L.assembly_stats(with_empty, "len")).first().report.split("\n")
    assert lines[0] == "Assembly statistics" and lines[5].split() == ["10", "min", "(aka", "N100)"] and lines[6].split()[0] == "5"


def test_an_alignment_without_bases_lies_within_others(spark):
    aln = [(1, "x", 0, 100), (2, "x", 50, 50), (3, "x", 0, 0), (4, "x", 100, 100), (5, "x", 50, 50), (6, "x", 100, 30_000), (7, "x", 20_000, 20_000), (8, "y", 60, 60), (9, "x", 49, 50)]
    aln = spark.createDataFrame(aln, "key long, rname string, start long, stop long").selectExpr("*", "60 AS mapq", "0 AS flag")
    x, y = (aln.selectExpr("rname", f"key AS {k}", f"start AS s{k}", f"stop AS e{k}") for k in "ab")
    want = x.join(y, "rname").where("a < b AND sa < eb AND sb < ea").select("a", "b")
    assert sorted(map(tuple, P.overlapping_pairs(aln, empty=True).collect())) == sorted(map(tuple, want.collect())) == [(1, 2), (1, 5), (1, 9), (6, 7)]
    assert sorted(map(tuple, P.overlapping_pairs(aln).collect())) == [(1, 9)]


def test_points_are_whole_numbers(spark):
    """Sums beyond what a double holds exactly: half of them is reached by the second of three equal reads, and by no more."""
    reads = spark.createDataFrame([(2**55 + 1,), (2**55 + 1,), (1,)], "len long")
    assert [(r.nx, r.lx) for r in L.nx_lx(reads, "len", [50]).collect()] == [(2**55 + 1, 2)]


def test_subtract_keeps_rows_that_repeat(spark):
    rows = spark.createDataFrame([(1, "c", 1, 30), (1, "c", 1, 30), (2, "c", 1, 30)], "id long, seq string, start long, end long")
    masks = spark.createDataFrame([("c", 10, 20)], "seq string, start long, end long")
    for merged in (False, True):
        assert sorted(map(tuple, I.subtract(rows, masks, merged=merged).collect())) == sorted((k, "c", a, b) for k in (1, 1, 2) for a, b in ((1, 9), (21, 30)))


def test_subtract_against_the_rule_step_by_step(spark):
    """Masks that begin together, lie in each other, end before a row or have no bases, over several bins."""
    import random

    r = random.Random(6)
    span = lambda n: (a := r.randint(1, 120), a + r.randint(-1, n))
    for merged in (False, True):
        masks = {("s%d" % r.randint(0, 5), *span(9 if k % 5 else 60)) for k in range(90)}
        rows = [(k, "s%d" % r.randint(0, 6), *span(70)) for k in range(150)] + [(900, "s1", 3, 3), (900, "s1", 3, 3)]
        want = []
        for k, seq, a, b in rows:
            if a > b or seq not in {m[0] for m in masks}:
                continue
            hits, at = sorted((p, q) for s, p, q in masks if s == seq and p <= q and q >= a and p <= b), a
            for p, q in hits:
                want += [(k, seq, max(at, a), p - 1)] if max(at, a) < p else []
                at = max(at, q + 1) if merged else q + 1
            want += [(k, seq, max(at, a), b)] if max(at, a) <= b else []
        named = lambda x, first: spark.createDataFrame(sorted(x), f"{first}seq string, start long, end long")
        got = I.subtract(named(rows, "id long, "), named(masks, ""), 25, merged)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_subtract_meets_gaps_instead_of_masks(spark, monkeypatch):
    """Of masks without a gap between them, rows meet those that reach over their start alone."""
    rows = spark.range(200).selectExpr("id", "'c' AS seq", "id + 1 AS start", "id + 900 AS end")
    masks = spark.range(1, 1200).selectExpr("'c' AS seq", "id AS start", "id + 3 AS end")
    made, join = [], I.interval_join

    def counted(*given):
        made.append((out := join(*given)).count())
        return out

    monkeypatch.setattr(I, "interval_join", counted)
    assert I.subtract(rows, masks, 100).count() == 0 and len(made) == 2 and max(made) < 1000


def test_short_sequences_stay(spark):
    d = spark.createDataFrame([("a", "ACGT"), ("b", ""), ("c", "AT" * 20 + "G" * 30 + "C" * 40), ("n", None)], "name string, seq string")
    got = {r.name: (r.header, r.seq) for r in S.reoriented(d, "name", "seq", 20, 10, short=True).collect()}
    alone = S.reoriented(d.where("name = 'c'"), "name", "seq", 20, 10).first()
    assert got["a"] == ("a shifted_by_bp:-0/4", "ACGT") and got["b"] == ("b shifted_by_bp:-0/0", "") and got["c"] == (alone.header, alone.seq)
    assert got["n"][1] is None


def test_a_deep_pile_is_dealt_out(spark):
    """All intervals at one place, in blocks of 50."""
    x = spark.range(400).selectExpr("'c' AS seq", "id AS a", "id % 3 AS start", "id % 3 + 20 AS end")
    y = spark.range(300).selectExpr("'c' AS seq", "id AS b", "CAST(10 AS LONG) AS r_start", "id % 5 + 10 AS r_end")
    pairs = I.interval_join(x, y, ["seq"], 7, block=50)
    assert pairs.count() == pairs.select("a", "b").distinct().count() == 120_000
    binned = [d.withColumn("bin", F.lit(1)) for d in (x, y)]
    deep = J.heavy_keys(*binned, ["seq", "bin"], 50).first()
    assert (deep.in_a, deep.in_b) == (8, 6)
