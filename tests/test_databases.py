"""Databases in one go: numbering, blocks, the last block, sampling, alarms; GFF lines in order."""

import json

import pytest
from pyspark.sql import functions as F

from readloom.operators import databases as D
from readloom.operators import intervals as I
from readloom.operators import lengths as L
from readloom.operators import reports as R
from readloom.operators.overlaps import index_text
from readloom.sources import text

LINES = ["V\t0.2", "F\t0\treads.fasta\tfasta", *[f"S\t{i}\tm1/{i // 2}/0_{n}\t{n}\t0\t{i}\t{n + 9}" for i, n in enumerate([700_000, 500_000, 5, 1_048_576, 40])], "B\t0\t0\t5\t47232"]


@pytest.fixture
def db(spark, tmp_path):
    (tmp_path / "x.rdb").write_text("\n".join(LINES) + "\n")
    return text.read_rdb(spark, str(tmp_path / "x.rdb"))


def lines(x):
    return [r.value for r in x.orderBy(*D.ORDER).collect()]


def names(spark, *headers):
    return spark.createDataFrame([(h,) for h in headers], "header string")


def test_filter(spark, db, tmp_path):
    got = D.filtered_database(db, names(spark, "m1/1/0_5"))
    want = [*LINES[:4], "B\t0\t0\t2\t1200000", "S\t2\tm1/1/0_1048576\t1048576\t0\t3\t1048585", "B\t1\t2\t3\t1048576", "S\t3\tm1/2/0_40\t40\t0\t4\t49", "B\t2\t3\t4\t40"]
    assert lines(got) == want
    D.write_lines(got, D.ORDER, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    assert [x for f in files for x in f.read_text().splitlines()] == want


def test_last_block_may_be_empty(spark, db):
    full = D.filtered_database(db, names(spark, "m1/2/0_40"))
    assert lines(full)[-2:] == ["B\t1\t2\t4\t1048581", "B\t2\t4\t4\t0"]
    none = D.filtered_database(db, names(spark, *[x.split("\t")[2] for x in LINES if x[0] == "S"]))
    assert lines(none) == [*LINES[:2], "B\t0\t0\t0\t0"]


def test_a_name_twice_in_the_blacklist(spark, db):
    with pytest.raises(Exception, match="listed twice"):
        lines(D.filtered_database(db, names(spark, "m1/1/0_5", "m1/1/0_5")))


def test_subsample(spark, db):
    molecules = D.subsampled_database(db, 100, 1, seed=3, whole_molecules=True, block_bases=600_000)
    got = [x.split("\t") for x in lines(molecules) if x[0] == "S"]
    assert [int(x[1]) for x in got] == list(range(len(got))) and len({x[2].split("/")[1] for x in got}) == 1 or len(got) == 3
    one = D.subsampled_database(db, 40, 1, seed=3)
    assert len([x for x in lines(one) if x[0] == "S"]) <= 2
    assert lines(one) == lines(D.subsampled_database(db, 40, 1, seed=3))
    whole = lines(D.subsampled_database(db, 10**9, 1, block_bases=1_200_000))
    assert [x for x in whole if x[0] == "S"] == [x for x in LINES if x[0] == "S"]
    assert [x for x in whole if x[0] == "B"] == ["B\t0\t0\t2\t1200000", "B\t1\t2\t5\t1048621"]  # no empty last one
    assert lines(D.subsampled_database({**db, "seqs": db["seqs"].where("false")}, 10, 1)) == LINES[:2]


@pytest.mark.parametrize("read", [True, False])
def test_alarm_when_coverage_is_not_reached(spark, db, tmp_path, read):
    path = str(tmp_path / "alarms")
    with pytest.raises(Exception, match="not enough reads"), D.alarmed(spark, path):
        if read:
            D.subsampled_database(db, 10**9, 30, fail_low=True)
        else:
            L.length_cutoff(db["seqs"], "seq_len", 10**9, 30, fail_low=True).collect()
    found = json.loads(spark.read.text(path).first().value)
    assert len(found) == 1 and found[0]["severity"] == "ERROR" and "not enough reads" in found[0]["message"]
    with D.alarmed(spark, str(tmp_path / "none")):
        assert L.length_cutoff(db["seqs"], "seq_len", 100, 1).first().cutoff == 1_048_576
    assert not (tmp_path / "none").exists()


def test_coverage_must_be_positive(db):
    for genome, coverage in ((0, 1), (1, 0)):
        with pytest.raises(ValueError, match="positive"):
            D.subsampled_database(db, genome, coverage)


def test_gff_lines_in_order(spark, tmp_path):
    rows = ["##gff-version 3", "#c", "b\ts\tr\t1\t30\t.\t+\t.\tID=2", "a\ts\tr\t1\t30\t.\t+\t.\tID=1", "", "b s r 5 9 . + . ID=3", "##end", "b\ts\tr\t1\t30\t.\t+\t.\tID=2", "zz\ts\tr\t1\t3\t.\t+\t.\tID=9"]
    (tmp_path / "x.gff").write_text("\n".join(rows) + "\n")
    masks = spark.createDataFrame([("a", 30, 40), ("b", 10, 20), ("b", 1, 2)], "seq string, start long, end long")
    got = [r.value for r in I.subtract_lines(text.placed_lines(spark, str(tmp_path / "x.gff")), masks, "m.gff").orderBy(*I.LINE_ORDER).collect()]
    piece = lambda q, a, b, k: f"{q}\ts\tr\t{a}\t{b}\t.\t+\t.\tID={k}"
    assert got == ["##gff-version 3", "##end", "##mask m.gff", "", piece("a", 1, 29, 1), piece("b", 3, 9, 2), piece("b", 21, 30, 2), piece("b", 5, 9, 3), piece("b", 3, 9, 2), piece("b", 21, 30, 2)]


def test_molecules(spark):
    rows = names(spark, "m1/7/0_9", "m1/7/9_20", "odd", "a/b", "m1/8/0_1")
    assert [r.m for r in rows.select(D.molecule().alias("m")).collect()] == ["m1/7", "m1/7", "odd", "a/b", "m1/8"]


def test_small_writers(spark, tmp_path):
    index = spark.createDataFrame([(3, 0, 40), (1, 40, 9)], "n long, pos long, bytes long")
    text.write_pile_index(index, str(tmp_path / "index"))
    assert sorted(map(tuple, text.read_pile_index(spark, str(tmp_path / "index")).collect())) == [(1, 40, 9), (3, 0, 40)]
    assert spark.createDataFrame([("a", 3, 0, 40)], "a_name string, n long, pos long, bytes long").select(index_text()).first()[0] == "a 3 0 40"
    phased = spark.createDataFrame([(5, 2, 1, 0.75, "r5"), (6, 2, -1, 0.5, "r6")], "v long, label long, phase int, freq double, name string")
    text.write_phases(phased, str(tmp_path / "phases"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "phases")).collect()) == ["-1\t-1\t-1\t0.5\tr6", "5\t2\t1\t0.75\tr5"]
    assert json.loads(L.report_json(spark.sql("SELECT 1 AS reads, 2.5D AS mean")).first().report) == {"reads": 1, "mean": 2.5}
    assert [r.x for r in spark.sql("SELECT explode(array(1.005D, 2.675D, -1.125D, 3D)) AS v").select(R.round2(F.col("v")).alias("x")).collect()] == [1.01, 2.68, -1.13, 3.0]
    for name, line in (("b.txt", "r c 1 0 x y 7"), ("a.txt", "r c 2 1 x y 7\nr c 3 1 x y 7")):
        (tmp_path / name).write_text(line + "\n")
    assert tuple(text.read_phases(spark, [str(tmp_path / "b.txt"), str(tmp_path / "a.txt")]).first()) == ("7", "c", 1, 0)
