"""Lines by key through byte spans."""

import random

import pytest
from pyspark.sql import functions as F

from readloom.sources import spans
from readloom.sources.spans import contig_index, index_lines, read_keys, read_spans


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def texts(folder):
    r = random.Random(4)
    out = []
    for f in range(3):
        lines = []
        while len(lines) < 300:
            lines += [f"é{len(lines)}\t{k}\t{'x' * r.randint(0, 30)}" + r.choice(["", "\r"]) for k in [r.choice(["a", "b", "cc", ""])] * r.randint(1, 9)] + r.choice([[], [""], ["alone"]])
        (folder / f"t{f}.txt").write_bytes("\n".join(lines).encode() + (b"\n" if f else b""))
        out.append(lines)
    return out


def place(lines, k):
    return sum(len(x.encode()) + 1 for x in lines[:k])


@pytest.mark.parametrize("limit", [40, 1 << 20])
def test_spans(spark, small_splits, tmp_path, limit):
    lines = texts(tmp_path)
    index = index_lines(spark, str(tmp_path), 1, span_bytes=limit)
    assert index.where(F.col("n") > 1).count() and index.where((F.col("n") > 1) & (F.col("stop") - F.col("start") > limit)).isEmpty()
    keys = spark.createDataFrame([("a",), ("cc",), ("a",), ("nowhere",)], "key string")
    got = [(int(r.file[-5]), r.start, r.value) for r in read_keys(index, keys).collect()]
    want = [(f, place(part, k), x) for f, part in enumerate(lines) for k, x in enumerate(part) if x.split("\t")[1:2] in (["a"], ["cc"])]
    assert sorted(got) == sorted(want)
    assert sorted(r.value for r in read_spans(index).collect()) == sorted(x for part in lines for x in part)


def test_other_bytes_are_not_read(spark, small_splits, tmp_path):
    """All lines of other keys are overwritten after they are indexed."""
    lines = texts(tmp_path)
    index = index_lines(spark, str(tmp_path), 1)
    keys = spark.createDataFrame([("b",)], "key string")
    for f, part in enumerate(lines):
        kept = [x if x.split("\t")[1:2] == ["b"] else "\n" * len(x.encode()) for x in part]
        (tmp_path / f"t{f}.txt").write_bytes("\n".join(kept).encode())
    got = sorted(r.value for r in read_keys(index, keys).collect())
    assert got == sorted(x for part in lines for x in part if x.split("\t")[1:2] == ["b"])


def test_nothing_and_compressed(spark, tmp_path):
    (tmp_path / "none.txt").write_text("")
    assert contig_index(spark, str(tmp_path / "none.txt")).count() == 0
    import gzip

    with gzip.open(tmp_path / "x.paf.gz", "wt") as f:
        f.write("a\tb\n")
    with pytest.raises(Exception, match="no places"):
        index_lines(spark, str(tmp_path / "x.paf.gz"), 0).count()


def test_lines_of_a_file_are_few_spans(spark, tmp_path):
    """Without a key, an index has a row for many lines; all of them are read, from their own places."""
    lines = [f"{i}\té{'x' * (i % 50)}" for i in range(20_000)]
    (tmp_path / "x.txt").write_text("\n".join(lines) + "\n")
    index = index_lines(spark, str(tmp_path / "x.txt"), None, span_bytes=200_000)
    rows = index.collect()
    assert sum(r.n for r in rows) == 20_000 and len(rows) < 100 and max(r.stop - r.start for r in rows) <= 200_000
    got = {r.start: r.value for r in read_spans(index).collect()}
    at = 0
    for x in lines:
        assert got.pop(at) == x
        at += len(x.encode()) + 1
    assert not got


def test_spans_that_follow_each_other_are_read_at_once():
    assert list(spans._joined([("a", 0, 5), ("a", 5, 9), ("b", 9, 12), ("b", 13, 15)])) == [("a", 0, 9), ("b", 9, 12), ("b", 13, 15)]
    for raw in (b"", b"\n", b"a", b"a\n", b"\n\na\n\n", "é\nü".encode(), b"a\xff\nb\n", b"a\r\nb"):
        want = raw.split(b"\n")[: None if raw and not raw.endswith(b"\n") else -1]
        starts, lines = spans._lines_of(raw)
        assert lines.to_pylist() == [x.decode("utf-8", "replace") for x in want]
        assert starts.tolist() == [sum(len(y) + 1 for y in want[:k]) for k in range(len(want))]
