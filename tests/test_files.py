"""Named text files, the files of polishing splits, and what a repeated attempt leaves."""

import os

import pytest
from pyspark.sql import functions as F

from readloom.operators import polish as X
from readloom.sources import storage, text
from readloom.sources.files import BatchesWriter, FilesWriter, _parts, write_files


def read(folder):
    return {f: open(os.path.join(folder, f)).read() for f in os.listdir(folder) if not f.startswith(("_", "."))}


def test_files_in_order(spark, tmp_path):
    rows = spark.range(3000).selectExpr("concat('f.', id % 40, '.txt') AS file", "id", "CAST(id AS STRING) AS value").union(spark.sql("SELECT 'none.txt', 0L, CAST(NULL AS STRING)"))
    write_files(rows.repartition(7), str(tmp_path / "out"), "id")
    got = read(tmp_path / "out")
    assert got.pop("none.txt") == ""
    assert got == {f"f.{k}.txt": "".join(f"{i}\n" for i in range(3000) if i % 40 == k) for k in range(40)}
    write_files(rows.limit(0).union(spark.sql("SELECT 'more', 0L, 'é'")), str(tmp_path / "out"), "id")
    assert len(storage.files_of(str(tmp_path / "out"), "")) == 42 and read(tmp_path / "out")["more"] == "é\n"


def test_lines_of_a_batch_are_written_at_once(tmp_path):
    import pyarrow as pa

    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["file", "value"])
    rows = [[("a", "1"), ("a", None), ("a", "é"), ("b", None)], [("b", ""), ("c", None), ("d", "4")], [("d", "5")]]
    assert [p for x in rows for p in _parts(batch(x))] == [("a", "1\né\n".encode()), ("b", b""), ("b", b"\n"), ("c", b""), ("d", b"4\n"), ("d", b"5\n")]
    writer = BatchesWriter({"path": str(tmp_path)})
    writer.commit([writer.write(map(batch, rows))])
    assert read(tmp_path) == {"a": "1\né\n", "b": "\n", "c": "", "d": "4\n5\n"}


def test_a_task_that_runs_twice(tmp_path):
    """Both attempts write all their lines; the one that counts is committed, and nothing else stays."""
    writer = FilesWriter({"path": str(tmp_path)})
    rows = [("a", "1"), ("a", "2"), ("b", "3")]
    lost = writer.write(iter(rows))
    counted = writer.write(iter(rows))
    assert {n for n, _ in lost.names} == {"a", "b"} and not os.path.exists(tmp_path / "a")
    writer.commit([counted, None])
    assert read(tmp_path) == {"a": "1\n2\n", "b": "3\n"}
    failed = FilesWriter({"path": str(tmp_path)})
    failed.write(iter([("c", "4")]))
    failed.abort([])
    assert set(read(tmp_path)) == {"a", "b"}


def test_wrong_names(tmp_path):
    for rows in ([("a", "1"), ("b", "2"), ("a", "3")], [("x/y", "1")], [(None, "1")]):
        with pytest.raises(ValueError, match="no name of a file"):
            FilesWriter({"path": str(tmp_path)}).write(iter(rows))
    writer = FilesWriter({"path": str(tmp_path / "two")})
    both = [writer.write(iter([("a", "1")])), writer.write(iter([("a", "2")]))]
    with pytest.raises(ValueError, match="one name"):
        writer.commit(both)


@pytest.fixture
def lengths(spark):
    return spark.createDataFrame([("a", 50), ("b", 60), ("c", 10), ("d", 5), ("gone", 9)], "name string, len long")


def paf(read, ctg):
    return "\t".join([read, "9", "0", "9", "+", ctg, "9", "0", "9", "9", "9", "60"])


def test_split_paf(spark, tmp_path, lengths):
    reads = [("r3", "b"), ("r1", "a"), ("r2", "gone"), ("r4", "b"), ("r1", "c"), ("r9", "d"), ("r0", "a")]
    (tmp_path / "x.paf").write_text("\n".join(paf(*r) for r in reads) + "\n")
    bad = spark.createDataFrame([("gone",)], "name string")
    rows = X.split_paf_files(text.placed_lines(spark, str(tmp_path / "x.paf")), lengths, 100, 2, bad)
    write_files(rows, str(tmp_path / "out"), *X.FILE_ORDER)
    # blocks by name: a and b fill one, c and d are the other; four and two reads in two shards
    line = lambda *r: paf(*r) + "\n"
    assert read(tmp_path / "out") == {
        "block.0.ctg_id": "a\nb\n", "block.0.reads": "r1\nr0\nr3\nr4\n", "block.0.paf": line("r1", "a") + line("r0", "a") + line("r3", "b") + line("r4", "b"),
        "block.1.ctg_id": "c\nd\n", "block.1.reads": "r1\nr9\n", "block.1.paf": line("r1", "c") + line("r9", "d"),
        "shard.0.block_ids": "0\n", "shard.1.block_ids": "1\n", "all_shard_ids": "0\n1\n",
    }
    with pytest.raises(Exception, match="no length of the contig"):
        X.split_paf_files(text.placed_lines(spark, str(tmp_path / "x.paf")), lengths.where("name != 'd'"), 100, 2, bad).count()
    (tmp_path / "bad.paf").write_text("r1 a\n")
    with pytest.raises(Exception, match="not a PAF line"):
        X.split_paf_files(text.placed_lines(spark, str(tmp_path / "bad.paf")), lengths, 100, 2).count()


def test_split(spark, tmp_path, lengths):
    pairs = spark.createDataFrame([("r3", "b", 2), ("r1", "a", 1), ("r5", "unknown", 3), ("r4", "b", 0)], "read string, ctg string, at long").withColumns({"file": F.lit("f"), "block_start": F.lit(0).cast("long")})
    write_files(X.split_files(pairs, lengths, 55, 5, shard="s", block="b", ids="ids"), str(tmp_path / "out"), *X.FILE_ORDER)
    assert read(tmp_path / "out") == {"b.0.ctg_id": "a\nb\n", "b.0.reads": "r1\nr4\nr3\n", "s.0.block_ids": "0\n", "ids": "0\n"}
