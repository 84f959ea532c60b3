"""FASTQ records of any number of lines, from any part of a file.

Where a split begins, a line may be a header, a piece of a sequence or of qualities, and a quality line may look like any
of them; only what came before tells. So a split is a map from the state at its entry to the state at its exit. Lengths
and first letters of the lines, a twentieth of the text, are written once. Each split first guesses where a record starts
and says how it would be left; then all are asked again with the exits of those before as their entries, and again where
an answer changes an entry, until all agree. What counts is only ever the state that the start of the file leads to. With
entries known, each split hands on its whole records, and pieces of those that cross its ends are put together by record.

A split that lies within one record says so by its number of letters, however its lines look. The driver holds a state a split. Splits must stay the same between the passes (spark.sql.files.* as they are): else an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom import schemas
from readloom.operators.running import release, written
from readloom.shipping import ship

HEAD, LETTERS, QUALITIES, BROKEN = range(4)
#: Lines in a row of the table of lengths; records that a guess must read without a fault.
CHUNK, GUESSED = 100_000, 3


class State(NamedTuple):
    """What the next line is for; letters so far, or qualities still to come; whether the open record's header is in this split."""

    mode: int
    n: int
    own: bool


START = State(HEAD, 0, False)


def _step(mode: int, n: int, size: int, first: int) -> tuple[int, int]:
    """The state after a line of that size (without white space at its ends) and first letter."""
    if mode == HEAD:
        return (HEAD, 0) if not size else (LETTERS, 0) if first == 64 else (BROKEN, 0)
    if mode == LETTERS:
        return (LETTERS, n + size) if first != 43 else (QUALITIES, n) if n else (HEAD, 0)
    if mode == QUALITIES:
        return (QUALITIES, n - size) if size < n else (HEAD, 0) if size == n else (BROKEN, 0)
    return BROKEN, 0


def left(sizes: list[int], firsts: bytes, entry: State, at: int = 0, records: int = 0) -> State:
    """The state after the lines from `at` on; with a number of records, BROKEN or not after so many."""
    mode, n, own, seen = entry.mode, entry.n, False, 0
    for k in range(at, len(sizes)):
        was = mode
        mode, n = _step(mode, n, sizes[k], firsts[k])
        if was == HEAD and mode == LETTERS:
            own, seen = True, seen + 1
            if records and seen > records:
                break
        if mode == BROKEN:
            break
    return State(mode, n, own and mode in (LETTERS, QUALITIES))


def guessed(sizes: list[int], firsts: bytes) -> State:
    """The exit if the first place that reads like records is one."""
    for k in range(len(sizes)):
        if firsts[k] == 64 and left(sizes, firsts, START, k, GUESSED).mode != BROKEN:
            exit_ = left(sizes, firsts, START, k)
            if exit_.mode != BROKEN:
                return exit_
    return START


def _line_table(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """(file, block, chunk, sizes, firsts) of CHUNK lines each."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, chunk, sizes, firsts = None, 0, [], bytearray()

        def row() -> pa.RecordBatch:
            columns = [pa.array([split[0]]), pa.array([split[1]], pa.int64()), pa.array([chunk], pa.int32()), pa.array([np.array(sizes, "<i4").tobytes()], pa.binary()), pa.array([bytes(firsts)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "chunk", "sizes", "firsts"])

        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if split != (file, block) or len(sizes) == CHUNK:
                    if sizes:
                        yield row()
                    chunk = chunk + 1 if split == (file, block) else 0
                    split, sizes, firsts = (file, block), [], bytearray()
                text = value.strip()
                sizes.append(len(text))
                firsts.append(min(ord(value[0]), 255) if value else 0)
        if sizes:
            yield row()

    return written(lines.mapInArrow(packed, "file string, block long, chunk int, sizes binary, firsts binary"), "fastq-lines")


def _entries(table: DataFrame) -> dict[tuple[str, int], tuple[State, int]]:
    """The state at each split's entry, and the split that holds the header of a record that is open there."""
    spark = table.sparkSession
    schema = "file string, block long, mode int, n long, own boolean, letters long, plus boolean"
    sums: dict[tuple[str, int], tuple[int, bool]] = {}

    def through(split: tuple[str, int], entry: State) -> State | None:
        """The exit of a split within a record, which needs no look at its lines."""
        letters, plus = sums[split]
        if entry.mode == QUALITIES and entry.n > letters:
            return State(QUALITIES, entry.n - letters, False)
        return State(LETTERS, entry.n + letters, False) if entry.mode == LETTERS and not plus else None

    def answers(asked: Mapping[tuple[str, int], State] | None) -> dict[tuple[str, int], State]:
        """Exits of all splits by guess, or of those asked from their entries."""

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("chunk")
            sizes, firsts = np.concatenate([np.frombuffer(x, "<i4") for x in rows["sizes"]]).tolist(), b"".join(rows["firsts"])
            file, block, *entry = key
            found = guessed(sizes, firsts) if asked is None else left(sizes, firsts, State(int(entry[0]), int(entry[1]), False))
            return pd.DataFrame([(file, block, *found, sum(sizes), 43 in firsts)], columns=["file", "block", "mode", "n", "own", "letters", "plus"])

        keys = ["file", "block"]
        if asked is None:
            x = table
        else:
            x = table.join(F.broadcast(spark.createDataFrame([(*k, e.mode, e.n) for k, e in asked.items()], "file string, block long, mode int, n long")), keys)  # a row a split at most
            keys += ["mode", "n"]
        rows = x.groupBy(*keys).applyInPandas(run, schema).collect()  # a row a split
        sums.update({(r.file, r.block): (r.letters, r.plus) for r in rows})
        return {(r.file, r.block): State(r.mode, r.n, r.own) for r in rows}

    exits = answers(None)
    splits = sorted(exits)
    known: dict[tuple[tuple[str, int], State], State] = {}
    while True:
        entries: dict[tuple[str, int], tuple[State, int]] = {}
        asked: dict[tuple[str, int], State] = {}
        before, state, origin = None, START, 0
        for split in splits:
            if split[0] != before:
                state, origin = START, split[1]
            bare = State(state.mode, state.n, False)
            entries[split] = bare, origin
            state = known.get((split, bare)) or through(split, bare)
            if state is None:
                asked[split], state = bare, exits[split]
            origin = split[1] if state.own else origin
            before = split[0]
        if not asked:
            return entries
        for split, exit_ in answers(asked).items():
            known[split, asked[split]] = exits[split] = exit_


def _cut_short(name: str) -> str:
    return f"sequence and qualities differ in length: {name}"


def _records(lines: DataFrame, entries: Mapping[tuple[str, int], tuple[State, int]], whole: bool) -> DataFrame:
    """Whole records (name, seq, qual), or else pieces (file, origin, block, name, seq, qual) of records across splits."""
    shared = lines.sparkSession.sparkContext.broadcast(dict(entries))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, origin, out = None, 0, []
        mode, n, name, seq, qual, pieces = HEAD, 0, None, [], [], False

        def done(last: bool = False) -> None:
            """Hands on the open record, if this kind is asked for."""
            nonlocal name, seq, qual, pieces
            if name is not None or seq or qual or pieces:
                if last or pieces:
                    if not whole:
                        out.append((split[0], origin, split[1], name, "".join(seq), "".join(qual)))
                elif whole:
                    out.append((name, "".join(seq), "".join(qual)))
            name, seq, qual, pieces = None, [], [], False

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.string(), pa.string(), pa.string()] if whole else [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["name", "seq", "qual"] if whole else ["file", "origin", "block", "name", "seq", "qual"]
            found = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names)
            out.clear()
            return found

        for batch in batches:
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if split != (file, block):
                    if split:
                        done(mode != HEAD)
                    split = (file, block)
                    if split not in shared.value:
                        raise ValueError("splits have changed between two passes: keep spark.sql.files.* and the number of cores as they are")
                    (mode, n, _), origin = shared.value[split]
                    name, seq, qual, pieces = None, [], [], mode != HEAD
                text, was = value.strip(), mode
                mode, n = _step(mode, n, len(text), min(ord(value[0]), 255) if value else 0)
                if mode == BROKEN:
                    raise ValueError(_cut_short(name or value))
                if was == HEAD:
                    if mode == LETTERS:
                        name, origin = value[1:].split(" ")[0], block
                elif was == LETTERS and mode == LETTERS:
                    seq.append(text)
                elif was == QUALITIES:
                    qual.append(text)
                if was != HEAD and mode == HEAD:
                    done()
            if out:
                yield batch_of()
        if split:
            done(mode != HEAD)
        if out:
            yield batch_of()

    return lines.mapInArrow(rows, schemas.SEQUENCE if whole else "file string, origin long, block long, name string, seq string, qual string")


def read_any_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(name, seq, qual). Sequence and qualities that differ in length are an error, and so is a line between records that is no header; a header that a file ends with is an empty record. The text is read three times: for lengths, for whole records, for records across splits."""
    ship(spark)
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    table = _line_table(spark, lines)
    entries = _entries(table)
    release(table)
    pieces = _records(lines, entries, whole=False).groupBy("file", "origin").agg(F.sort_array(F.collect_list(F.struct("block", "name", "seq", "qual"))).alias("x"))
    name, seq, qual = F.coalesce(*[F.col("x")[0]["name"], F.lit("")]), F.array_join("x.seq", ""), F.array_join("x.qual", "")
    fits = F.when(F.length(seq) == F.length(qual), seq).otherwise(F.raise_error(F.concat(F.lit(_cut_short("")), name)).cast("string"))
    return _records(lines, entries, whole=True).union(pieces.select(name.alias("name"), fits.alias("seq"), qual.alias("qual")))
