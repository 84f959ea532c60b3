"""Records of any layout from any split, as whole files have them."""

import random

import pytest

from readloom.sources import fastq
from readloom.sources.text import read_fastq


@pytest.fixture(params=[1_000, 300])
def small_splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def layout(seed, n, marks="@+!5AC"):
    """Qualities full of @ and +, lines of any width, empty lines and empty records."""
    r = random.Random(seed)
    lines, records = [], []
    for i in range(n):
        m = r.choice([0, 1, 7, 60, 61, 300, 4000 if i % 20 == 3 else 30])
        seq, qual = "".join(r.choice("ACGT") for _ in range(m)), "".join(r.choice(marks) for _ in range(m))
        cut = lambda s: [s[k : k + w] for w in [r.choice([10, 60, 5000])] for k in range(0, len(s), w)]
        records.append((f"r{i}", seq, qual))
        lines += [f"@r{i} more of it", *cut(seq), r.choice(["+", f"+r{i}"]), *cut(qual), *[""] * r.choice([0, 0, 0, 1, 3])]
    return lines, records


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_any_layout(spark, small_splits, tmp_path, seed):
    want = []
    for f in range(2):
        lines, records = layout(10 * seed + f, 40)
        (tmp_path / f"{f}.fastq").write_text(["\n", "\r\n"][f].join(lines) + "\n")
        want += records
    (tmp_path / "none.fastq").write_text("\n\n")
    got = rows(read_fastq(spark, str(tmp_path)))
    assert got == sorted(want) == rows(read_fastq(spark, str(tmp_path), whole_files=True))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8


def test_qualities_that_look_like_records(spark, small_splits, tmp_path):
    """Guesses fail all along: qualities repeat the pattern of a record, so only the start of the file tells."""
    quals = ["@AAAAAAAAA", "AAAAAAAAAA", "+AAAAAAAAA", "AAAAAAAAAA"] * 40
    lines = ["@x", *["ACGTACGTAC"] * 160, "+", *quals, "@y z", "AC", "+", "@+"]
    (tmp_path / "x.fastq").write_text("\n".join(lines) + "\n")
    assert rows(read_fastq(spark, str(tmp_path / "x.fastq"))) == [("x", "ACGTACGTAC" * 160, "".join(quals)), ("y", "AC", "@+")]


@pytest.mark.parametrize("text", ["@a\nACGT\n+\n!!!\n", "@a\nAC\n+\n!!!\n@b\nA\n+\n!\n", "@a\nAC\n+\n!!\nstray\n", "@a\nACG\n", "A\n" * 300])
def test_errors_are_those_of_whole_files(spark, small_splits, tmp_path, text):
    (tmp_path / "bad.fastq").write_text("@ok\n" + "ACGT\n" * 60 + "+\n" + "IIII\n" * 60 + text)
    for whole in (True, False):
        with pytest.raises(Exception, match="differ in length"):
            read_fastq(spark, str(tmp_path / "bad.fastq"), whole_files=whole).collect()


def test_ends(spark, small_splits, tmp_path):
    (tmp_path / "x.fastq").write_text("@a b\nAC\n+\n!!\n@last")
    (tmp_path / "empty.fastq").write_text("")
    for whole in (True, False):
        assert rows(read_fastq(spark, str(tmp_path), whole_files=whole)) == [("a", "AC", "!!"), ("last", "", "")]


def test_states():
    sizes, firsts = [2, 4, 1, 4, 2, 3], b"@A+@@C"
    assert fastq.left(sizes, firsts, fastq.START) == (fastq.LETTERS, 3, True)
    assert fastq.left(sizes[3:4], firsts[3:4], fastq.State(fastq.QUALITIES, 9, False)) == (fastq.QUALITIES, 5, False)
    assert fastq.left(sizes[1:2], firsts[1:2], fastq.State(fastq.QUALITIES, 3, False)).mode == fastq.BROKEN
