"""Many named text files in one pass, as a Spark data source: each file is written by one task, line after line.

Rows come grouped by file, so a task has one file open at a time. Every attempt writes under names of its own; only when
all tasks are done do the files get their names, and a list of them is left in the folder. A task that is repeated, or run
twice at once, leaves nothing behind that a reader would take for a file.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from readloom.shipping import ship
from readloom.sources.storage import attempt, commit_named, discard_job, located


@dataclass
class Named(WriterCommitMessage):
    """Files of a task: (name, name of the attempt's file)."""

    names: list[tuple[str, str]]


class FilesWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Named:
        """iterator: rows (file, value)."""
        return self.put((row[0], b"" if row[1] is None else row[1].encode() + b"\n") for row in iterator)

    def put(self, parts: Iterable[tuple[str, bytes]]) -> Named:
        """parts: (file, bytes), those of a file together."""
        where, inner = located(self.path)
        where.create_dir(inner, recursive=True)
        names: dict[str, str] = {}
        name, out = None, None
        try:
            for file, data in parts:
                if out is None or file != name:
                    if out:
                        out.close()
                    name = file
                    if not name or "/" in name or name in names:
                        raise ValueError(f"no name of a file, or its lines aren't together: {name}")
                    names[name] = attempt(name, self.job)
                    out = where.open_output_stream(f"{inner.rstrip('/')}/{names[name]}", compression=None)
                out.write(data)
        finally:
            if out:
                out.close()
        return Named(list(names.items()))

    def commit(self, messages: list[Named | None]) -> None:
        commit_named(self.path, [n for m in messages if m for n in m.names], self.job)

    def abort(self, messages: list[Named | None]) -> None:
        discard_job(self.path, self.job)


class BatchesWriter(FilesWriter, DataSourceArrowWriter):
    """The same from Arrow batches: the lines of a file within a batch are written at once."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Named:
        return self.put(part for batch in iterator for part in _parts(batch))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(file, its lines with their ends) of each run of rows of a file."""
    files, values = batch.columns
    codes = files.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
    begun = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else []
    for first, stop in zip(begun, [*begun[1:], len(codes)], strict=True):
        lines = values.slice(first, stop - first).drop_null()
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0]
        yield files[int(first)].as_py(), text.as_buffer().to_pybytes() + b"\n" if len(lines) else b""


class NamedFiles(DataSource):
    """Format `named_files`, to write rows (file, value). Option: path."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, value string"

    def writer(self, schema, overwrite: bool) -> BatchesWriter:  # noqa: ANN001
        return BatchesWriter(self.options)


def write_files(rows: DataFrame, path: str, *order: str | Column) -> None:
    """rows: file (a name without folders) and value, in files of these names, each file's lines in the given order; a null value makes a file without adding a line."""
    ship(rows.sparkSession)
    rows.sparkSession.dataSource.register(NamedFiles)
    placed = rows.repartition("file").sortWithinPartitions("file", *order)
    placed.select(F.col("file"), F.col("value")).write.format("named_files").mode("append").save(path)
