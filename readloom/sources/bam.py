"""BAM: compressed alignment files as a Spark data source that reads any part of a file, and writes sorted, indexed parts.

A split reads the records that start in its compressed blocks. It finds its first block by the blocks' headers, and its
first record by trying places until eight records in a row are sound (lengths, targets, names, operations that add up to
the sequence); a record that isn't sound later on is an error, so a wrong start can't pass unseen. Where a file has an
index (.bai) beside it, a filter on rname, and on pos or ref_end, becomes byte spans of that index: other blocks aren't
read. Filters need spark.sql.python.filterPushdown.enabled; read_bam() sets it.

Coordinates count from 0; ref_end is the first place after the alignment.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from readloom import schemas
from readloom.shipping import ship
from readloom.sources.storage import attempt, commit, discard_job, files_of, located

SCHEMA = f"{schemas.SAM}, ref_end int"
TARGETS = "rname string, ref_len int"
#: Bytes of a split, of one read of a file, and records that must be sound in a row before a place counts as a record's start.
SPLIT_BYTES, READ_BYTES, SOUND = 64 << 20, 1 << 20, 8
#: Fixed values of the format: operations, bases by four bits, tag types, the empty last block.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
INTS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}
LAST_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_PAIRS = [a + b for a in BASES for b in BASES]
_CODE = {c: k for k, c in enumerate(BASES)}
#: Index: one level's first bin and how far its bins reach, in powers of two; larger places have no index.
LEVELS, WINDOW, MOST = ((0, 29), (1, 26), (9, 23), (73, 20), (585, 17), (4681, 14)), 14, 1 << 29


def block_size(head: bytes) -> int:
    """Bytes of the block that starts with these, 0 if none does."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return 0
    at, end = 12, 12 + int.from_bytes(head[10:12], "little")
    while at + 6 <= min(end, len(head)):
        if head[at : at + 4] == b"BC\x02\x00":
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + int.from_bytes(head[at + 2 : at + 4], "little")
    return 0


class Blocks:
    """Uncompressed bytes of a file from a block on. A place is (start of its block << 16) + place in the block."""

    def __init__(self, file, size: int, at: int):  # noqa: ANN001
        self.file, self.size, self.next = file, size, at
        self.bytes, self.starts, self.blocks, self.window, self.window_at = bytearray(), [], [], b"", at

    def _raw(self, at: int, n: int) -> bytes:
        if at < self.window_at or at + n > self.window_at + len(self.window):
            self.file.seek(at)
            self.window, self.window_at = self.file.read(max(n, READ_BYTES)), at
        return self.window[at - self.window_at : at - self.window_at + n]

    def more(self) -> bool:
        """One more block, False at the end of the file."""
        if self.next >= self.size:
            return False
        n = block_size(self._raw(self.next, 64))
        if not n:
            raise ValueError(f"no block at byte {self.next}")
        raw = self._raw(self.next, n)
        self.starts.append(len(self.bytes))
        self.blocks.append(self.next)
        self.bytes += unpacked(raw)
        self.next += n
        return True

    def need(self, upto: int) -> bool:
        while len(self.bytes) < upto:
            if not self.more():
                return False
        return True

    def place(self, at: int) -> int:
        k = bisect_right(self.starts, at) - 1
        return (self.blocks[k] << 16) + at - self.starts[k]

    def drop(self, upto: int) -> None:
        """Forgets the bytes before; those that stay count from 0."""
        k = max(0, bisect_right(self.starts, upto) - 1)
        del self.bytes[:upto]
        self.starts, self.blocks = [s - upto for s in self.starts[k:]], self.blocks[k:]

    def records(self, at: int, stop: int) -> Iterator[tuple[int, bytes]]:
        """(place, record) from the byte `at` on, of records that start before the place stop."""
        while True:
            if not self.need(at + 4):
                if at != len(self.bytes):
                    raise ValueError("the file ends within a record")
                return
            place = self.place(at)
            if place >= stop:
                return
            n = int.from_bytes(self.bytes[at : at + 4], "little")
            if n < 32 or not self.need(at + 4 + n):
                raise ValueError(f"the file ends within a record, or has none at {place}")
            yield place, bytes(self.bytes[at + 4 : at + 4 + n])
            at += 4 + n
            if at > READ_BYTES:
                self.drop(at)
                at = 0


def unpacked(raw: bytes) -> bytes:
    """A block's bytes; an error if they aren't what its checksum says."""
    out = zlib.decompress(raw[12 + int.from_bytes(raw[10:12], "little") : -8], -15)
    if struct.unpack("<II", raw[-8:]) != (zlib.crc32(out), len(out)):
        raise ValueError("a block's checksum is wrong")
    return out


def first_block(file, size: int, start: int, stop: int) -> int | None:  # noqa: ANN001
    """Where the first sound block starts in [start, stop). A file without one for more than a block's length is broken."""
    if start == 0:
        return 0
    file.seek(start)
    raw = file.read(1 << 17)  # twice the longest block
    k = raw.find(b"\x1f\x8b\x08\x04")
    while 0 <= k < min(stop - start, 1 << 16):
        try:
            if n := block_size(raw[k : k + 64]):
                unpacked(raw[k : k + n])
                return start + k
        except (ValueError, struct.error, zlib.error):
            pass  # the four bytes stood in a block
        k = raw.find(b"\x1f\x8b\x08\x04", k + 1)
    if stop - start >= 1 << 16 and size - start > 1 << 16:
        raise ValueError(f"no block starts within 65,536 bytes from byte {start}")
    return None


def read_header(blocks: Blocks) -> tuple[list[tuple[str, int]], int]:
    """(targets with lengths, byte after the header)."""

    def number(at: int) -> int:
        if not blocks.need(at + 4):
            raise ValueError("the file ends within its header")
        return struct.unpack_from("<i", blocks.bytes, at)[0]

    if not blocks.need(8) or blocks.bytes[:4] != b"BAM\x01":
        raise ValueError("not a BAM file")
    at = 8 + number(4)
    targets, n = [], number(at)
    at += 4
    for _ in range(n):
        name_n = number(at)
        length = number(at + 4 + name_n)
        targets.append((bytes(blocks.bytes[at + 4 : at + 3 + name_n]).decode(), length))
        at += 8 + name_n
    return targets, at


def sound(raw: bytes | bytearray, at: int, lengths: Sequence[int]) -> int:
    """Bytes of the record at `at` if it is sound, 0 if not, -1 if more bytes are needed."""
    if len(raw) < at + 36:
        return -1
    n, ref, pos, name_n, _, _, ops, _, letters, next_ref, next_pos, _ = struct.unpack_from("<iiiBBHHHiiii", raw, at)
    fixed = 32 + name_n + 4 * ops + (letters + 1) // 2 + letters
    if letters < 0 or name_n < 1 or n < fixed or n > fixed + (1 << 24) or not (-1 <= ref < len(lengths) and -1 <= next_ref < len(lengths)):
        return 0
    if pos < -1 or next_pos < -1 or ref >= 0 and pos > lengths[ref]:
        return 0
    if len(raw) < at + 36 + name_n + 4 * ops:
        return -1
    name = raw[at + 36 : at + 36 + name_n]
    if name[-1] or not all(33 <= c <= 126 for c in name[:-1]):
        return 0
    cigar = np.frombuffer(raw, "<u4", ops, at + 36 + name_n)
    kinds = cigar & 15
    if ops and (kinds.max() > 8 or letters and int((cigar >> 4)[np.isin(kinds, (0, 1, 4, 7, 8))].sum()) != letters):
        return 0
    return n + 4


def first_record(blocks: Blocks, stop: int, lengths: Sequence[int]) -> int | None:
    """The byte where the first record starts whose block is before stop."""
    done = 0
    while blocks.need(done + 36):
        raw = np.frombuffer(bytes(blocks.bytes[done:]), np.uint8).astype(np.uint32)
        number = (raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24).view(np.int32)
        n = len(number) - 32
        fits = (number[:n] >= 33) & (number[4 : n + 4] >= -1) & (number[4 : n + 4] < len(lengths)) & (number[24 : n + 24] >= -1) & (number[24 : n + 24] < len(lengths)) & (raw[12 : n + 12] > 1) & (number[20 : n + 20] >= 0)
        for at in (np.flatnonzero(fits) + done).tolist():
            if blocks.place(at) >> 16 >= stop:
                return None
            end, count = at, 0
            while count < SOUND:
                step = sound(blocks.bytes, end, lengths)
                while step < 0 and blocks.more():
                    step = sound(blocks.bytes, end, lengths)
                if step < 0 and end == len(blocks.bytes) and count:
                    count = SOUND  # the file ends with a sound record
                    break
                if step <= 0:
                    break
                end, count = end + step, count + 1
                if not blocks.need(end):
                    count = 0
                    break
            if count == SOUND:
                return at
        done += max(n, 0)
        if blocks.place(done) >> 16 >= stop or not blocks.more():
            return None
    return None


def _tags(raw: bytes, at: int) -> list[str]:
    out = []
    while at < len(raw):
        key, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind == "A":
            text, at = f"A:{chr(raw[at])}", at + 1
        elif kind in INTS:
            text, at = f"i:{struct.unpack_from('<' + INTS[kind], raw, at)[0]}", at + struct.calcsize(INTS[kind])
        elif kind == "f":
            text, at = f"f:{struct.unpack_from('<f', raw, at)[0]:g}", at + 4
        elif kind in "ZH":
            end = raw.index(0, at)
            text, at = f"{kind}:{raw[at:end].decode()}", end + 1
        elif kind == "B":
            sub, n = chr(raw[at]), int.from_bytes(raw[at + 1 : at + 5], "little")
            code = "f" if sub == "f" else INTS[sub]
            values = struct.unpack_from(f"<{n}{code}", raw, at + 5)
            text, at = f"B:{','.join([sub, *[f'{v:g}' if sub == 'f' else str(v) for v in values]])}", at + 5 + n * struct.calcsize(code)
        else:
            raise ValueError(f"tag {key} has the unknown type {kind}")
        out.append(f"{key}:{text}")
    return out


def decoded(raw: bytes, targets: Sequence[tuple[str, int]]) -> tuple:
    """A record's columns."""
    ref, pos, name_n, mapq, _, ops, flag, letters, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", raw)
    at = 32 + name_n
    name = raw[32 : at - 1].decode()
    cigar = struct.unpack_from(f"<{ops}I", raw, at)
    at += 4 * ops
    packed = raw[at : at + (letters + 1) // 2]
    seq = "".join([_PAIRS[b] for b in packed])[:letters] or "*"
    at += len(packed)
    qual = raw[at : at + letters]
    qual = "*" if not letters or qual[0] == 255 else bytes([q + 33 for q in qual]).decode()
    rname = targets[ref][0] if ref >= 0 else "*"
    rnext = "*" if next_ref < 0 else "=" if next_ref == ref else targets[next_ref][0]
    end = pos + sum(c >> 4 for c in cigar if c & 15 in (0, 2, 3, 7, 8))
    return name, flag, rname, pos, mapq, "".join([f"{c >> 4}{OPS[c & 15]}" for c in cigar]) or "*", rnext, next_pos + 1, tlen, seq, qual, _tags(raw, at + letters), end


def _tag_bytes(tag: str) -> bytes:
    key, kind, value = tag.split(":", 2)
    head = key.encode()
    if kind == "i":
        v = int(value)
        sub = next(k for k, lo, hi in (("c", -128, 127), ("C", 0, 255), ("s", -32768, 32767), ("S", 0, 65535), ("i", -(1 << 31), (1 << 31) - 1), ("I", 0, (1 << 32) - 1)) if lo <= v <= hi)
        return head + sub.encode() + struct.pack("<" + INTS[sub], v)
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "B":
        sub, *values = value.split(",")
        code = "f" if sub == "f" else INTS[sub]
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(values)}{code}", len(values), *[float(v) if sub == "f" else int(v) for v in values])
    return head + kind.encode() + value.encode() + (b"" if kind == "A" else b"\0")


def bin_of(start: int, end: int) -> int:
    """The smallest bin that holds all of [start, end)."""
    return next((first + (start >> shift) for first, shift in reversed(LEVELS) if start >> shift == (end - 1) >> shift), 0)


def encoded(row: Sequence, numbers: dict[str, int]) -> tuple[bytes, int, int, int]:
    """(record, target, start, end) of a row of SAM's columns; a target that isn't in the header is an error."""
    name, flag, rname, pos, mapq, cigar, rnext, pnext, tlen, seq, qual, tags = row[:12]
    ref = numbers[rname] if rname not in (None, "*") else -1
    next_ref = -1 if rnext in (None, "*") else ref if rnext == "=" else numbers[rnext]
    parts = [(int(n), OPS.index(o)) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "*")]
    end = pos + sum(n for n, o in parts if o in (0, 2, 3, 7, 8))
    letters = "" if seq in (None, "*") else seq
    codes = [_CODE.get(c, 15) for c in letters.upper()] + [0] * (len(letters) % 2)
    packed = bytes([a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True)])
    quals = b"\xff" * len(letters) if qual in (None, "*") else bytes([c - 33 for c in qual.encode()])
    name = (name or "*").encode() + b"\0"
    bin_ = bin_of(pos, max(end, pos + 1)) if 0 <= pos and end <= MOST else 4680 if pos < 0 else 0
    head = struct.pack("<iiBBHHHiiii", ref, pos, len(name), mapq, bin_, len(parts), flag, len(letters), next_ref, (pnext or 0) - 1, tlen or 0)
    body = head + name + b"".join(struct.pack("<I", n << 4 | o) for n, o in parts) + packed + quals + b"".join(map(_tag_bytes, tags or ()))
    return struct.pack("<i", len(body)) + body, ref, pos, max(end, pos + 1)


class _Deflater:
    """A file's blocks, written as they fill up."""

    FULL = 0xFF00

    def __init__(self, out):  # noqa: ANN001
        self.out, self.at, self.held = out, 0, bytearray()

    def place(self) -> int:
        return (self.at << 16) + len(self.held)

    def write(self, data: bytes) -> None:
        if self.held and len(self.held) + len(data) > self.FULL:
            self.flush()
        for k in range(0, len(data), self.FULL):
            self.held += data[k : k + self.FULL]
            if len(self.held) >= self.FULL:
                self.flush()

    def flush(self) -> None:
        for k in range(0, len(self.held), self.FULL):
            part = bytes(self.held[k : k + self.FULL])
            deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
            body = deflate.compress(part) + deflate.flush()
            block = LAST_BLOCK[:16] + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
            self.out.write(block)
            self.at += len(block)
        self.held = bytearray()


class Index:
    """Of each target: chunks (first place, last place) by bin, and the first place of a record that reaches each window."""

    def __init__(self, n: int):
        self.bins: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(n)]
        self.windows: list[list[int]] = [[] for _ in range(n)]

    def add(self, ref: int, start: int, end: int, first: int, last: int) -> None:
        chunks = self.bins[ref].setdefault(bin_of(start, end), [])
        if chunks and chunks[-1][1] == first:
            chunks[-1] = (chunks[-1][0], last)
        else:
            chunks.append((first, last))
        windows = self.windows[ref]
        for w in range(start >> WINDOW, ((end - 1) >> WINDOW) + 1):
            windows += [0] * (w + 1 - len(windows))
            windows[w] = windows[w] or first

    def spans(self, ref: int, start: int, end: int) -> list[tuple[int, int]]:
        """Places between which all records are that may overlap [start, end), in order and apart."""
        if ref >= len(self.bins) or start >= end:
            return []
        windows = self.windows[ref]
        w = min(start >> WINDOW, max(len(windows) - 1, 0))
        least = next((x for x in windows[w:] if x), 0) if start >> WINDOW < len(windows) else 0
        # a window without a record takes the next one's place, which is later than any record that reaches it
        wanted = {first + k for first, shift in LEVELS for k in range(start >> shift, min((end - 1) >> shift, (MOST - 1) >> shift) + 1)} if end - start < 1 << 26 else set(self.bins[ref])
        out: list[tuple[int, int]] = []
        for a, b in sorted(c for k in wanted & set(self.bins[ref]) for c in self.bins[ref][k] if c[1] > least):
            a = max(a, least)
            if out and a >> 16 <= out[-1][1] >> 16:
                out[-1] = (out[-1][0], max(b, out[-1][1]))
            else:
                out.append((a, b))
        return out

    def to_bytes(self) -> bytes:
        out = [b"BAI\x01", struct.pack("<i", len(self.bins))]
        for bins, windows in zip(self.bins, self.windows, strict=True):
            out.append(struct.pack("<i", len(bins)))
            for k, chunks in sorted(bins.items()):
                out.append(struct.pack("<Ii", k, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
            out.append(struct.pack("<i", len(windows)) + b"".join(struct.pack("<Q", x) for x in windows))
        return b"".join(out)

    @classmethod
    def of(cls, raw: bytes) -> Index:
        if raw[:4] != b"BAI\x01":
            raise ValueError("not an index")
        found, at = cls(int.from_bytes(raw[4:8], "little")), 8
        for ref in range(len(found.bins)):
            n, at = int.from_bytes(raw[at : at + 4], "little"), at + 4
            for _ in range(n):
                k, m = struct.unpack_from("<Ii", raw, at)
                chunks, at = [struct.unpack_from("<QQ", raw, at + 8 + 16 * i) for i in range(m)], at + 8 + 16 * m
                if k <= 37449:  # beyond are counts, not records
                    found.bins[ref][k] = chunks
            n, at = int.from_bytes(raw[at : at + 4], "little"), at + 4
            found.windows[ref] = list(struct.unpack_from(f"<{n}Q", raw, at))
            at += 8 * n
        return found


@dataclass
class Part(InputPartition):
    """A file's bytes [start, stop), or places if exact."""

    path: str
    start: int
    stop: int
    exact: bool


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [f for p in options["path"].split(",") for f in files_of(p, ".bam")]
        self.split, self.targets_only = int(options.get("split_bytes", SPLIT_BYTES)), options.get("targets") == "true"
        self.rname, self.low, self.high = None, 0, MOST

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds for an index; Spark still filters the rows."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if isinstance(f, EqualTo) and column == "rname":
                self.rname = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and column == "pos":
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and column in ("ref_end", "pos"):
                self.low = max(self.low, f.value - (column == "ref_end" and isinstance(f, GreaterThanOrEqual)))
            yield f

    def partitions(self) -> Sequence[Part]:
        if self.targets_only:
            return [Part(self.paths[0], 0, 0, False)] if self.paths else []
        out = []
        for path in self.paths:
            where, inner = located(path)
            size, index = where.get_file_info(inner).size, where.get_file_info(f"{inner}.bai")
            if self.rname not in (None, "*") and index.is_file:
                with where.open_input_file(inner) as f, where.open_input_stream(f"{inner}.bai") as g:
                    names = [t for t, _ in read_header(Blocks(f, size, 0))[0]]
                    if self.rname in names:
                        for a, b in Index.of(g.read()).spans(names.index(self.rname), self.low, self.high):
                            out.append(Part(path, a, b, True))
            else:
                out += [Part(path, a, min(a + self.split, size), False) for a in range(0, size, self.split)]
        return out

    def read(self, partition: Part | None) -> Iterator[tuple]:
        if partition is None:  # no part of any file is wanted
            return
        where, inner = located(partition.path)
        size = where.get_file_info(inner).size
        with where.open_input_file(inner) as f:
            head = Blocks(f, size, 0)
            targets, at = read_header(head)
            if self.targets_only:
                yield from targets
                return
            lengths = [n for _, n in targets]
            if partition.exact:
                blocks = Blocks(f, size, partition.start >> 16)
                at, stop = partition.start & 0xFFFF, partition.stop
            else:
                start, stop = first_block(f, size, partition.start, partition.stop), partition.stop << 16
                if start is None:
                    return
                head.need(at + 1)
                if start <= head.place(min(at, max(len(head.bytes) - 1, 0))) >> 16:
                    blocks = head
                else:
                    blocks = Blocks(f, size, start)
                    at = first_record(blocks, partition.stop, lengths)
                    if at is None:
                        return
            for _, raw in blocks.records(at, stop):
                yield decoded(raw, targets)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class BamWriter(DataSourceWriter):
    """Each task's rows as one file with the whole header; with an index if rows come in order."""

    def __init__(self, options: dict):
        self.path, self.job = options["path"], uuid.uuid4().hex
        self.targets = [(n, int(k)) for n, k in (x.split("\t") for x in options.get("header", "").split("\n") if x)]

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        name = attempt(f"part-{context.partitionId() if context else 0:05d}.bam", self.job)
        where, inner = located(self.path)
        where.create_dir(inner, recursive=True)
        numbers, index, last, ordered = {n: k for k, (n, _) in enumerate(self.targets)}, Index(len(self.targets)), (-1, -1), True
        text = ("@HD\tVN:1.6\n" + "".join(f"@SQ\tSN:{n}\tLN:{k}\n" for n, k in self.targets)).encode()
        with where.open_output_stream(f"{inner}/{name}", compression=None) as out:
            blocks = _Deflater(out)
            blocks.write(b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(self.targets)) + b"".join(struct.pack("<i", len(n.encode()) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in self.targets))
            blocks.flush()
            for row in iterator:
                raw, ref, start, end = encoded(row, numbers)
                if blocks.held and len(blocks.held) + len(raw) > blocks.FULL:
                    blocks.flush()
                first = blocks.place()
                blocks.write(raw)
                key = (ref if ref >= 0 else len(self.targets), start)
                ordered, last = ordered and key >= last and end <= MOST, key
                if ref >= 0 and start >= 0 and ordered:
                    index.add(ref, start, end, first, blocks.place())
            blocks.flush()
            out.write(LAST_BLOCK)
        if not ordered:
            return Written([name])
        with where.open_output_stream(f"{inner}/{name}.bai", compression=None) as out:
            out.write(index.to_bytes())
        return Written([name, f"{name}.bai"])

    def commit(self, messages: list[Written | None]) -> None:
        commit(self.path, [n for m in messages if m for n in m.names], self.job)

    def abort(self, messages: list[Written | None]) -> None:
        discard_job(self.path, self.job)


class Bam(DataSource):
    """Format `bam`. Options: path (files or folders, between commas), split_bytes, targets=true for (rname, ref_len) of the first file; header (lines of target, tab, length) to write."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return TARGETS if self.options.get("targets") == "true" else SCHEMA

    def reader(self, schema) -> BamReader:  # noqa: ANN001
        return BamReader(self.options)

    def writer(self, schema, overwrite: bool) -> BamWriter:  # noqa: ANN001
        return BamWriter(self.options)


def _registered(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Bam)


def read_bam(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(records, targets) of a file or folder, as read_sam() gives them, and ref_end."""
    _registered(spark)
    x = spark.read.format("bam").option("split_bytes", split_bytes).load(path)
    nm = F.regexp_extract(F.array_join("tags", "\t"), r"(?:^|\t)NM:i:(\d+)", 1)
    x = x.withColumns({"seq_len": F.length("seq"), "nm": F.nullif(nm, F.lit("")).cast("int")})
    return x, spark.read.format("bam").option("targets", "true").load(path)


def bam_region(records: DataFrame, rname: str, start: int, end: int) -> DataFrame:
    """Records of read_bam() that overlap [start, end) of a target; an index beside the file keeps other blocks unread."""
    return records.where((F.col("rname") == rname) & (F.col("pos") < end) & (F.col("ref_end") > start))


def write_bam(records: DataFrame, targets: DataFrame, path: str) -> None:
    """A folder of sorted, indexed parts. records: SAM's columns, pos from 0; targets (rname, ref_len), in the header by name, are as many as a header holds: every file has them all."""
    _registered(records.sparkSession)
    named = sorted((r.rname, r.ref_len) for r in targets.select("rname", "ref_len").collect())
    numbers = records.sparkSession.createDataFrame([(n, k) for k, (n, _) in enumerate(named)], "rname string, _ref int")
    columns = [x.strip().split(" ")[0] for x in schemas.SAM.split(", ")]
    placed = records.select(*columns).join(F.broadcast(numbers), "rname", "left").withColumn("_ref", F.coalesce("_ref", F.lit(len(named))))
    placed = placed.repartitionByRange("_ref", "pos", "qname").sortWithinPartitions("_ref", "pos", "qname")
    placed.select(*columns).write.format("bam").option("header", "\n".join(f"{n}\t{k}" for n, k in named)).mode("append").save(path)
