"""Compressed alignment files: the same records as their text, from any split, and only the indexed bytes for a region."""

import glob
import gzip
import io
import random
import struct

import pytest
from pyspark.sql import functions as F

from readloom.sources import bam, storage
from readloom.sources.text import read_sam

TARGETS = [("c1", 300_000), ("c2", 90_000), ("empty", 10)]


def sam_lines(n=400):
    r = random.Random(2)
    lines = ["@HD\tVN:1.6", *[f"@SQ\tSN:{t}\tLN:{k}" for t, k in TARGETS]]
    for i in range(n):
        m = r.choice([20, 51, 300, 4000 if i % 40 == 0 else 33])
        seq = "".join(r.choice("ACGTN") for _ in range(m + 5))
        qual = "".join(chr(33 + r.randint(0, 60)) for _ in seq) if i % 3 else "*"
        tags = r.choice([[], [f"NM:i:{r.choice([0, 3, 200, 70000])}", "RG:Z:a b"], ["XX:A:q", "ff:f:0.5", "nn:i:-7", "BB:B:s,1,-2,3", "FB:B:f,0.5,2"]])
        t, k = TARGETS[i % 2]
        if i % 29 == 0:
            lines.append("\t".join([f"u{i}", "4", "*", "0", "0", "*", "*", "0", "0", seq if i % 2 else "*", qual if i % 2 else "*", *tags]))
        else:
            lines.append("\t".join([f"r{i}/x", str(r.choice([0, 16, 256])), t, str(r.randint(1, k - 5000)), str(r.randint(0, 60)), f"5S{m - 4}M2D3I1M", r.choice(["*", "=", "c2" if t == "c1" else "c1"]), str(r.choice([0, 77])), str(r.randint(-9, 9)), seq, qual, *tags]))
    return lines


def blocked(payload, sizes):
    """payload in blocks of these sizes, cut anywhere, with empty blocks between."""
    import zlib

    out, at = io.BytesIO(), 0
    while at < len(payload):
        part = payload[at : at + sizes()]
        at += len(part)
        deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
        body = deflate.compress(part) + deflate.flush()
        out.write(bam.LAST_BLOCK[:16] + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part)))
        if at % 5 == 0:
            out.write(bam.LAST_BLOCK)
    out.write(bam.LAST_BLOCK)
    return out.getvalue()


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    (folder / "x.sam").write_text("\n".join(sam_lines()) + "\n")
    text, targets = read_sam(spark, str(folder / "x.sam"))
    bam.write_bam(text, targets, str(folder / "out"))
    return folder, text, targets


def rows(df):
    return sorted(map(tuple, df.drop("ref_end").collect()), key=repr)


@pytest.mark.parametrize("split", [700, 9_000, 1 << 26])
def test_same_as_text(spark, both, split):
    folder, text, targets = both
    got, heads = bam.read_bam(spark, str(folder / "out"), split)
    assert got.drop("ref_end").columns == text.columns and rows(got) == rows(text)
    assert {tuple(r) for r in heads.collect()} == {tuple(r) for r in targets.collect()} == set(TARGETS)


def test_blocks_are_gzip_members(both):
    for f in glob.glob(f"{both[0]}/out/*.bam"):
        with open(f, "rb") as g:
            assert gzip.decompress(g.read()).startswith(b"BAM\x01")


@pytest.mark.parametrize("split", [1_000, 40_000])
def test_records_over_many_blocks(spark, both, split):
    """As other tools cut them: anywhere; with a record longer than a split."""
    folder, text, _ = both
    long = ("long", 0, "c2", 7, 9, "90000M", "*", 0, 0, "ACGT" * 22_500, "*", ["NM:i:1"])
    known = [r for r in text.select(*text.columns[:12]).collect()]
    known.insert(200, long)
    head = b"BAM\x01" + struct.pack("<ii", 0, len(TARGETS)) + b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", k) for n, k in TARGETS)
    numbers = {n: k for k, (n, _) in enumerate(TARGETS)}
    r = random.Random(split)
    path = folder / f"cut{split}.bam"
    path.write_bytes(blocked(head + b"".join(bam.encoded(x, numbers)[0] for x in known), lambda: r.choice([37, 300, 900, 6000])))
    got = bam.read_bam(spark, str(path), split)[0].select(*text.columns[:12])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, known), key=repr)


def test_a_record_byte_for_byte():
    """As the format's description lays it out."""
    row = ("r", 16, "c2", 9, 30, "2M1I", "=", 12, -3, "ACG", "!#%", ["NM:i:2", "ZZ:Z:q"])
    want = struct.pack("<iiBBHHHiiii", 1, 9, 2, 30, 4681, 2, 16, 3, 1, 11, -3) + b"r\0" + struct.pack("<II", 2 << 4, 1 << 4 | 1) + bytes([0x12, 0x40, 0, 2, 4]) + b"NMc\x02" + b"ZZZq\0"
    raw, ref, start, end = bam.encoded(row, {"c1": 0, "c2": 1})
    assert (raw, ref, start, end) == (struct.pack("<i", len(want)) + want, 1, 9, 11)
    assert bam.decoded(want, TARGETS) == (*row, 11)


@pytest.mark.parametrize(("start", "end"), [(0, 300_000), (50_000, 50_400), (16_384, 32_768), (299_000, 299_999)])
def test_region(spark, both, start, end):
    folder, text, _ = both
    got = bam.bam_region(bam.read_bam(spark, str(folder / "out"))[0], "c1", start, end)
    length = F.expr("aggregate(regexp_extract_all(cigar, '([0-9]+)[MDN=X]', 1), 0, (a, x) -> a + CAST(x AS INT))")
    want = text.where((F.col("rname") == "c1") & (F.col("pos") < end) & (F.col("pos") + length > start))
    assert rows(got) == rows(want)


def test_bytes_outside_a_region_are_not_read(spark, both, tmp_path):
    """All blocks but those of the index's spans (and the header's) are overwritten."""
    folder, text, targets = both
    bam.write_bam(text.coalesce(1), targets, str(tmp_path / "one"))
    whole = bam.bam_region(bam.read_bam(spark, str(tmp_path / "one"))[0], "c2", 30_000, 40_000)
    want = rows(whole)
    assert want
    for f in glob.glob(f"{tmp_path}/one/*.bam"):
        raw = bytearray(open(f, "rb").read())
        blocks = bam.Blocks(io.BytesIO(raw), len(raw), 0)
        bam.read_header(blocks)
        keep = [(0, blocks.next)]
        index = bam.Index.of(open(f"{f}.bai", "rb").read())
        for a, b in index.spans(1, 30_000, 40_000):
            reader = bam.Blocks(io.BytesIO(raw), len(raw), a >> 16)
            while reader.next <= b >> 16 and reader.more():
                pass
            keep.append((a >> 16, reader.next))
        clean = bytes(raw)
        raw[:] = b"\xee" * len(raw)
        for a, b in keep:
            raw[a:b] = clean[a:b]
        open(f, "wb").write(raw)
    assert rows(bam.bam_region(bam.read_bam(spark, str(tmp_path / "one"))[0], "c2", 30_000, 40_000)) == want
    with pytest.raises(Exception, match="no block at byte"):
        bam.read_bam(spark, str(tmp_path / "one"))[0].collect()


def test_target_without_records_or_unknown(spark, both):
    records = bam.read_bam(spark, str(both[0] / "out"))[0]
    assert bam.bam_region(records, "empty", 0, 10).count() == 0 == bam.bam_region(records, "nowhere", 0, 10).count()
    assert records.where("rname = '*'").count() == both[1].where("rname = '*'").count()


def test_cut_short(spark, both, tmp_path):
    f = sorted(glob.glob(f"{both[0]}/out/*.bam"), key=lambda f: -len(open(f, "rb").read()))[0]
    raw = open(f, "rb").read()
    blocks = bam.Blocks(io.BytesIO(raw), len(raw), 0)
    while blocks.next < len(raw) // 2:
        blocks.more()
    (tmp_path / "cut.bam").write_bytes(raw[: blocks.next - 1])
    with pytest.raises(Exception, match="block|record|ends|decompress|incomplete"):
        bam.read_bam(spark, str(tmp_path / "cut.bam"))[0].collect()
    (tmp_path / "no.bam").write_bytes(b"not compressed at all")
    with pytest.raises(Exception, match="block"):
        bam.read_bam(spark, str(tmp_path / "no.bam"))[1].collect()


def test_a_repeated_attempt_leaves_one_file(tmp_path):
    (tmp_path / "older.bam").write_text("")
    first, again = storage.attempt("part-0.bam", "job1"), storage.attempt("part-0.bam", "job1")
    for n in (first, again):
        (tmp_path / n).write_text("")
    storage.commit(str(tmp_path), [again], "job1")
    assert storage.files_of(str(tmp_path), ".bam") == sorted(f"{tmp_path}/{n}" for n in ("older.bam", again))
    assert not (tmp_path / first).exists()
    failed = storage.attempt("part-0.bam", "job2")
    (tmp_path / failed).write_text("")
    assert f"{tmp_path}/{failed}" not in storage.files_of(str(tmp_path), ".bam")
    storage.discard_job(str(tmp_path), "job2")
    assert not (tmp_path / failed).exists()


def test_appended_parts(spark, both, tmp_path):
    _, text, targets = both
    for _ in range(2):
        bam.write_bam(text.limit(5), targets, str(tmp_path / "out"))
    assert bam.read_bam(spark, str(tmp_path / "out"))[0].count() == 10


def test_index_round_trip():
    r, index = random.Random(1), bam.Index(2)
    records = sorted((r.randint(0, 1), r.randint(0, 400_000), r.choice([1, 50, 20_000])) for _ in range(900))
    for k, (ref, start, n) in enumerate(records):
        index.add(ref, start, start + n, k << 16, (k + 1) << 16)
    again = bam.Index.of(index.to_bytes())
    for ref, low, high in [(0, 0, 10), (0, 100_000, 100_001), (1, 16_384, 200_000), (1, 390_000, 500_000)]:
        spans = again.spans(ref, low, high)
        got = {k for a, b in spans for k in range(a >> 16, b >> 16)}
        want = {k for k, (f, s, n) in enumerate(records) if f == ref and s < high and s + n > low}
        assert want <= got and len(got) < len(records) / 2 + 200
        assert index.spans(ref, low, high) == spans
