"""Lines of a large text by key, without reading the rest: an index of byte spans, and a reader of spans.

The index is made in one pass over the text: each split lists the runs of neighbouring lines with one key, by their
place in the split; how many bytes earlier splits hold, a sum over a row a split, makes them places in the file. To
read, an index is filtered or joined like any table, and each task opens the files at its spans.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readloom.operators.running import release, written
from readloom.shipping import ship
from readloom.sources.storage import located

#: Bytes of a span at most, unless one line is longer; so a span fits in a task however many lines its key has.
SPAN_BYTES = 4 << 20


def _runs(change: np.ndarray, sizes: np.ndarray, span_bytes: int) -> np.ndarray:
    """Where runs of lines start: at a change, and where a run would be longer than span_bytes otherwise."""
    starts = np.flatnonzero(change)
    upto = np.concatenate(([0], np.cumsum(sizes)))
    stops = np.append(starts[1:], len(sizes))
    more = []
    for first, stop in zip(*(x[upto[stops] - upto[starts] > span_bytes].tolist() for x in (starts, stops)), strict=True):
        while (first := max(first + 1, int(np.searchsorted(upto, upto[first] + span_bytes, side="right")) - 1)) < stop:
            more.append(first)
    return np.sort(np.concatenate((starts, np.array(more, np.int64))))


def _codes(column: pa.Array) -> np.ndarray:
    """Numbers of the different values, null with one of its own."""
    return column.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)


def index_lines(spark: SparkSession, path: str | list[str], field: int | None, sep: str = "\t", span_bytes: int = SPAN_BYTES) -> DataFrame:
    """(file, key, start, stop, n): half-open byte spans of whole lines whose field (from 0) is the key, and their number of
    lines; the last line's end may lie one byte beyond the file. Compressed files have no places: an error.

    A line without that field has a null key; empty lines have no key either. Without a field, all keys are null.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            if not len(batch):
                continue
            file, block, key, sizes = batch.columns
            sizes = sizes.to_numpy()
            places = np.stack((_codes(file), _codes(block)))
            entered = np.append(True, (places[:, 1:] != places[:, :-1]).any(0))  # a split
            keys = _codes(key)
            first = _runs(entered | np.append(True, keys[1:] != keys[:-1]), sizes, span_bytes)
            begun = np.flatnonzero(entered)
            upto = np.concatenate(([0], np.cumsum(sizes)))
            # what lies before the batch in its first split, and before each later split in the batch
            offset = np.repeat(-upto[begun], np.diff(np.append(begun, len(sizes))))
            now = (file[0].as_py(), block[0].as_py())
            offset[: begun[1] if len(begun) > 1 else None] += at if now == split else 0
            stops = np.append(first[1:], len(sizes))
            split, at = (file[-1].as_py(), block[-1].as_py()), int(upto[-1] + offset[-1])
            taken = pa.array(first)
            yield pa.RecordBatch.from_arrays([file.take(taken), block.take(taken), key.take(taken), pa.array(upto[first] + offset[first]), pa.array(upto[stops] + offset[first]), pa.array(stops - first)], ["file", "block", "key", "start", "stop", "n"])

    ship(spark)
    packed = F.col("_metadata.file_path").rlike(r"\.(gz|bz2|zst|snappy|lz4|deflate)$")
    file = F.when(packed, F.raise_error(F.concat(F.lit("a compressed file has no places: "), F.col("_metadata.file_path"))).cast("string")).otherwise(F.col("_metadata.file_path"))
    lines = spark.read.option("lineSep", "\n").text(path).select(file.alias("file"), F.col("_metadata.file_block_start").alias("block"), (F.get(F.split("value", sep), F.lit(field)) if field is not None else F.lit(None).cast("string")).alias("key"), (F.octet_length("value") + 1).cast("long").alias("size"))
    found = written(lines.mapInArrow(runs, "file string, block long, key string, start long, stop long, n long"), "spans")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a split
    splits = found.groupBy("file", "block").agg(F.max("stop").alias("bytes")).withColumn("from", F.coalesce(F.sum("bytes").over(before), F.lit(0))).select("file", "block", "from")
    placed = found.join(splits, ["file", "block"]).select("file", "key", (F.col("start") + F.col("from")).alias("start"), (F.col("stop") + F.col("from")).alias("stop"), "n")
    index = written(placed, "span-index")
    release(found)
    return index


def _joined(spans: Iterable[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Spans that follow each other as one, up to SPAN_BYTES."""
    file, start, stop = None, 0, 0
    for f, a, b in spans:
        if f == file and a == stop and b - start <= SPAN_BYTES:
            stop = b
        else:
            if file is not None:
                yield file, start, stop
            file, start, stop = f, a, b
    if file is not None:
        yield file, start, stop


def _lines_of(raw: bytes) -> tuple[np.ndarray, pa.Array]:
    """(places, lines) without their ends; bytes that aren't UTF-8 are replaced."""
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data == 10)
    if not len(ends) or ends[-1] < len(data) - 1:
        ends = np.append(ends, len(data))[: None if len(data) else 0]
    starts = np.append(0, ends[:-1] + 1)[: len(ends)].astype(np.int64)
    try:
        raw.decode()
    except UnicodeDecodeError:
        return starts, pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.string())
    offsets = np.append(starts - np.arange(len(starts)), len(data) - np.count_nonzero(data == 10)).astype(np.int32)
    return starts, pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[data != 10].tobytes()))


def read_spans(spans: DataFrame) -> DataFrame:
    """(file, start, value): the lines of half-open byte spans (file, start, stop), each from its own place; nothing else of the files is read but what lies between spans that a task finds next to each other."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, opened = None, None
        try:
            for batch in batches:
                for file, start, stop in _joined(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                    if file != name:
                        if opened:
                            opened.close()
                        where, inner = located(file)
                        name, opened = file, where.open_input_file(inner)
                    opened.seek(start)
                    starts, values = _lines_of(opened.read(stop - start))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(file), len(values)), pa.array(starts + start), values], ["file", "start", "value"])
        finally:
            if opened:
                opened.close()

    ship(spans.sparkSession)
    # spans are short rows for much text: by number, so that they aren't put together into few tasks for being small
    ordered = spans.select("file", "start", "stop").repartitionByRange(int(spans.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", "start").sortWithinPartitions("file", "start")
    return ordered.mapInArrow(lines, "file string, start long, value string")


def read_keys(index: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """(file, start, value) of the lines whose key is among those of keys, distinct or not."""
    return read_spans(index.join(keys.select(F.col(key).alias("key")), "key", "left_semi"))


def contig_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The index of PAF lines by target."""
    return index_lines(spark, path, 5)
