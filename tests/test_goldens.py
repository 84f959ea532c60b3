"""Golden values: verdicts on chimeras, overhangs, containment, alignments, databases, k-mers and splits."""

import os

import pytest
from pyspark.sql import functions as F

from readloom.functions import sequence as S
from readloom.operators import alignment as A
from readloom.operators import blocks as B
from readloom.operators import lengths as L
from readloom.operators import overlaps as O
from readloom.operators import phasing as P
from readloom.operators import polish as X
from readloom.operators import reports as R
from readloom.operators import sampling as M
from readloom.operators import tracking as T
from readloom.sources import text
from readloom.streaming.flags import merged_flags

def lines(spark, tmp_path, given, **how):
    (tmp_path / "x").write_text(given)
    return text.read_overlaps(spark, str(tmp_path / "x"), **how)


def pile(name, spans, clipped=()):
    """Lines of a pile over a read of 1,000 letters; overlaps numbered in clipped end within both reads."""
    return [f"{name} {name}x{k} -9 99.0 0 {start} {stop} 1000 0 {5 if k in clipped else 0} {stop - start} {900 if k in clipped else stop - start} 3" for k, (start, stop) in enumerate(spans)]


def test_chimera_verdicts(spark, tmp_path):
    left, right = [(10 * k, 440 + 10 * k) for k in range(5)], [(520 + 10 * k, 1000) for k in range(5)]
    rows = [
        *pile("two", left + right),  # nothing between 480 and 520
        *pile("bridged", [*left, *right, (0, 1000)]),
        *pile("clipped", [*left, *right, (0, 1000)], clipped=range(5)),  # bridged, but the left half's overlaps end early
        *pile("even", [(10 * k, 1000 - 10 * k) for k in range(9)]),
        *pile("one", [(0, 1000)]),
    ]
    x = lines(spark, tmp_path, "\n".join(rows) + "\n")
    verdicts = lambda depth, least: {r.a_name for r in O.gap_in_coverage(x, depth, least).collect() if r.gap}
    # average depths, without the stretch before the last end: 2.3 and 2.86
    assert verdicts(4, 0.0) == {"two", "clipped"} and verdicts(4, 2.5) == {"clipped"} and verdicts(4, 3.0) == set()
    assert verdicts(6, 0.0) == {"clipped"}  # only the bridge reaches a depth of six
    assert {r.a_name for r in O.gap_in_coverage(x, 4).collect()} == {"two", "bridged", "clipped", "even", "one"}


def test_overhang(spark, tmp_path):
    three, five = ("0 3000 10000 10000", "0 0 7000 10000", "1 3000 10000 10000"), ("0 0 7000 10000", "0 3000 10000 10000", "1 0 7000 10000")
    cases = [(s, b, least, least <= 3000) for s, *bs in (three, five) for b in bs for least in (1000, 3000, 5000)]
    cases += [(a, f"{rev} {b}", least, True) for a, b in (("0 500 9500 10000", "0 9000 10000"), ("0 0 9000 10000", "500 9500 10000")) for rev in (0, 1) for least in (1, 1000)]
    cases += [("0 0 7000 10000", "0 0 7000 10000", 3000, True), ("0 1000 9000 10000", "0 1000 9000 10000", 500, True)]
    x = lines(spark, tmp_path, "".join(f"{i} B -10000 100.00 {a} {b} overlap\n" for i, (a, b, _, _) in enumerate(cases)))
    for least in {c[2] for c in cases}:
        got = {int(r.a_name): r.ok for r in x.select("a_name", O.enough_overhang(least).alias("ok")).collect()}
        assert all(got[i] == want for i, (_, _, at, want) in enumerate(cases) if at == least)


#: Pairs, lengths of A and B, identity, tag and the rest; least length and identity; which lines stay.
CONTAINED = [
    (["001 001 0 0 100 overlap", "001 002 0 0 100 overlap", "001 003 0 0 100 3", "001 004 0 0 100 5", "001 005 0 0 100 contains", "005 008 0 0 100 overlap", "006 009 0 0 100 overlap foo", "008 009 0 0 100 overlap foo bar", "011 001 0 0 100 contained", "016 006 0 0 100 contained", "021 011 0 0 100 overlap", "026 016 0 0 100 overlap"], 0, 0.0, [1, 2, 3, 6, 7]),
    (["001 002 9 2 100 overlap", "001 003 9 3 100 overlap", "001 004 2 9 100 overlap", "001 005 3 9 100 overlap"], 3, 0.0, [1, 3]),
    (["001 012 2 9 100 contains", "001 013 3 9 100 contains", "012 022 9 9 100 overlap", "013 023 9 9 100 overlap"], 3, 0.0, [2]),
    (["001 002 9 9 100 overlap", "001 003 9 9 98 overlap"], 3, 99.0, [0]),
]


@pytest.mark.parametrize("pairs,min_len,min_idt,stay", CONTAINED)
def test_contained(spark, tmp_path, pairs, min_len, min_idt, stay):
    p = [x.split(" ", 5) for x in pairs]
    given = [f"{a} {b} -1 {float(idt):.3f} 0 0 0 {la} 0 0 0 {lb} {tag}" for a, b, la, lb, idt, tag in p]
    got = O.contained_filter(lines(spark, tmp_path, "\n".join(given) + "\n", extra=True), min_len, min_idt)
    assert sorted(r[0] for r in got.select(O.overlap_text("tagplus")).collect()) == sorted(given[i] for i in stay)
    text.write_overlaps(got, str(tmp_path / "out"), trailer=True)
    assert spark.read.text(str(tmp_path / "out")).where("value = '---'").count() == 1 and text.read_overlaps(spark, str(tmp_path / "out")).count() == len(stay)


def test_reads_without_length(spark, tmp_path):
    x = lines(spark, tmp_path, "1 2 -5 99.0 0 0 0 0 0 0 0 0 5\n1 3 -5 99.0 0 0 0 0 0 0 5 9 3\n")
    assert O.stage1_flags(x, gap_filter=True, sample_rate=1.0, min_len=0).count() == 0 and O.gap_in_coverage(x, 2).first().gap is False


SAM = "@SQ\tSN:myseq\tLN:7\n" + "".join(f"{q}\t{flag}\tmyseq\t{pos}\t60\t{c}\t*\t0\t0\t{s}\t*\n" for q, flag, pos, c, s in (("alnA", 2064, 1, "7=", "GATTACA"), ("alnA", 2064, 1, "5S7=5S", "AAAAAGATTACAGGGGG"), ("alnA", 2064, 1, "6S7=5S", "AAAAAAGATTACAGGGGG"), ("alnA", 2064, 1, "5S7=6S", "AAAAAGATTACAGGGGGG"), ("alnB", 16, 2, "5S3=9S", "AAAAAGATTACAGGGGG"), ("alnC", 0, 2, "9S3=5S", "AAAAAGATTACAGGGGG")))


def test_alignments(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    aln, targets = text.read_sam(spark, str(tmp_path / "a.sam"))
    a = aln.where("qname = 'alnA'")
    kept = lambda clip, margin, mask="0": A.clip_count(a, targets, max_clipping=clip, margin=margin, exclude=A.flag_mask(mask)).first()
    assert [tuple(kept(*x)) for x in ((5, 0), (5, -1), (6, -1), (0, 0, "0x800"))] == [(4, 0), (2, 2), (4, 0), (0, 4)]
    assert sorted(tuple(r) for r in A.enrich(a).select("xb", "xe", "xr", "xq", "xp").collect()) == [(0, 7, 7, x, -1.0) for x in (7, 17, 18, 18)]
    paf = A.to_paf(aln, targets)
    want = ["alnA 7 0 7 - myseq 7 0 7 7 7 60", "alnA 17 5 12 - myseq 7 0 7 7 7 60", "alnA 18 5 12 - myseq 7 0 7 7 7 60", "alnA 18 6 13 - myseq 7 0 7 7 7 60", "alnB 17 9 12 - myseq 7 1 4 3 3 60", "alnC 17 9 12 + myseq 7 1 4 3 3 60"]
    text.write_paf(paf, str(tmp_path / "paf"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "paf")).collect()) == sorted(w.replace(" ", "\t") for w in want)
    assert text.read_paf(spark, str(tmp_path / "paf")).count() == 6
    got = {(r.qname, r.header, r.part) for r in A.region_sequences(aln, "myseq:1-3", exclude=0, flip=True).collect()}
    assert got == {("alnA", "alnA len:2", "AT"), ("alnB", "alnB len:2", "TC"), ("alnC", "alnC len:2", "AC")}
    with pytest.raises(ValueError):
        A.parse_region("myseq")


def test_database(spark, tmp_path):
    rows = ["V\t0.2", "F\t0\tsubreads.bam\tbam", "S\t0\tseq/0/0_10000\t10000\t0\t0\t10000", "S\t1\tseq/1/0_20000\t20000\t0\t10000\t20000", "S\t2\tseq/2/0_30000\t30000\t0\t30000\t30000", "B\t0\t0\t3\t60000"]
    (tmp_path / "raw.db").write_text("\n".join(rows) + "\nX\tskipped\n")
    db = text.read_rdb(spark, str(tmp_path / "raw.db"))
    text.write_rdb(db, str(tmp_path / "copy"))
    files = sorted(os.listdir(tmp_path / "copy"))
    assert "".join((tmp_path / "copy" / f).read_text() for f in files if f.startswith("part")) == "\n".join(rows) + "\n"
    raw = db["seqs"].select(F.col("seq_id").alias("pos"), F.col("seq_len").alias("len"))
    preads = spark.createDataFrame([(0, 9000), (1, 18000), (2, 25000)], "pos long, len long")
    got = L.preassembly_stats(raw, preads, 0, 52000).first().asDict()
    want = {"genome_length": 52000, "length_cutoff": 0, "raw_reads": 3, "raw_bases": 60000, "raw_mean": 20000.0, "raw_n50": 30000, "raw_p95": 30000, "raw_coverage": 1.15, "raw_esize": 23333.33, "seed_reads": 3, "seed_bases": 60000, "seed_mean": 20000.0, "seed_n50": 30000, "seed_p95": 30000, "seed_coverage": 1.15, "seed_esize": 23333.33, "preassembled_reads": 3, "preassembled_bases": 52000, "preassembled_mean": 17333.33, "preassembled_n50": 18000, "preassembled_p95": 25000, "preassembled_coverage": 1.0, "preassembled_esize": 19807.69, "preassembled_yield": 0.87, "preassembled_seed_fragmentation": 1.0, "preassembled_seed_truncation": 2666.67}
    assert got == want and len(got) == 26
    none = L.preassembly_stats(raw.where("false"), preads.where("false"), 0, 52000).first()
    assert (none.raw_reads, none.raw_n50, none.preassembled_yield, none.preassembled_seed_truncation) == (0, 0, 0.0, -1.0)
    twice = spark.createDataFrame([("seq/0/0_10000",), ("seq/0/0_10000",)], "header string")
    with pytest.raises(Exception, match="twice"):
        M.without_blacklisted(db["seqs"], twice, "header").collect()


def test_kmers_after_runs_of_other_letters(spark):
    """Another letter than ACGT passes over k more letters, read or not, and those may be such letters too."""

    def rule(s, k):
        out, run, i = [], 0, 0
        while i < len(s):
            if s[i] in "ACGT":
                run += 1
                if run >= k:
                    out.append(i - k + 1)
                i += 1
            else:
                run, i = 0, i + k + 1
        return out

    texts = ["ACGTACNNGTACGTACG", "ACGTACNGNTACGTACGT", "NNNN", "", "AC", "ACG", "NACGNACGNACGACG", "ACGNNNNNNACGTACG" * 5]
    got = S.kmers(spark.createDataFrame(list(enumerate(texts)), "key long, seq string"), "key", "seq", 3).where("strand = 'fwd'")
    found = {}
    for r in got.collect():
        found.setdefault(r.key, []).append(r.pos)
    assert {k: sorted(v) for k, v in found.items()} == {i: rule(t, 3) for i, t in enumerate(texts) if rule(t, 3)}
    words = spark.createDataFrame([("k", "ACGT")], "key string, seq string")
    assert S.has_kmer(S.kmers(words, "key", "seq", 3), spark.createDataFrame([(6,), (7,)], "kmer long")).collect()[0].kmer == 6
    with pytest.raises(ValueError):
        S.kmers(words, "key", "seq", 32)


def test_kmers_of_a_long_text(spark):
    """A text longer than what is looked at together has the same k-mers, none twice."""
    import random

    r = random.Random(3)
    s = "".join(r.choice("ACGTACGTACGTN" if i % 900 < 20 else "ACGT") for i in range(2 * S.PIECE + 777))
    want, run, i = [], 0, 0
    while i < len(s):
        run = run + 1 if s[i] != "N" else 0
        if run >= 7:
            want.append(i - 6)
        i += 1 if s[i] != "N" else 8
    got = S.kmers(spark.createDataFrame([(1, s)], "key int, seq string"), "key", "seq", 7).where("strand = 'fwd'").select("pos", S.kmer_text(F.col("kmer"), 7).alias("w")).toPandas()
    assert sorted(got["pos"]) == want and all(s[p : p + 7] == w for p, w in zip(got["pos"][::997], got["w"][::997], strict=True))


def test_splits(spark):
    #: Shards, weights and rows in each shard.
    cases = [(1, [42], [1]), (2, [42, 2], [1, 1]), (3, [1, 1, 1, 1], [2, 1, 1]), (3, [1, 1], [1, 1]), (3, [1, 2, 3, 4], [3, 1]), (4, [1, 2, 3, 4], [2, 1, 1]), (4, [4, 3, 2, 1], [1, 1, 1, 1]), (3, [4, 3, 2, 1], [1, 1, 2]), (4, [4191650, 4009608, 4154778, 4096102], [1, 2, 1])]
    for n, weights, want in (*cases, (2, [0, 0, 0], [3]), (2, [], [])):
        df = spark.createDataFrame([(i * 2, w) for i, w in enumerate(weights)], "o long, w long")
        got = [r["count"] for r in B.split_table(df, "o", "w", n).groupBy("shard").count().orderBy("shard").collect()]
        assert got == want
    bins = [([4191650, 4009608, 4154778, 4096102, 99], 4, [[1, 4], [3], [2], [0]]), ([4_191_650, 4_009_608, 4_154_778, 4_096_102, 500_000], 4, [[3], [2], [0], [1, 4]]), ([1, 3, 5, 2, 4, 6], 2, [[2, 4, 0], [5, 1, 3]]), ([1, 2, 2], 3, [[0], [2], [1]])]
    for weights, n, want in bins:
        assert B.largest_first(n, weights) == want
    df = spark.createDataFrame(list(enumerate(bins[0][0])), "i long, w long")
    assert {(r.i, r.bin) for r in B.largest_first_table(df, "i", "w", 4).collect()} == {(i, b) for b, held in enumerate(bins[0][2]) for i in held}


def test_polish(spark, tmp_path):
    lens = X.unique_lengths(spark.createDataFrame([("a", 5), ("b", 5)], "name string, len long"), spark.createDataFrame([("c", 5)], "name string, len long"))
    with pytest.raises(Exception, match="twice"):
        X.unique_lengths(lens, lens).collect()
    pairs = X.contig_reads(spark.createDataFrame([(f"r{i}", "abcd"[i % 4]) for i in range(9)], "read string, ctg string"), spark.createDataFrame([("d",)], "name string"), lens)
    blocks = X.contig_blocks(pairs, lens, 6)
    assert sorted(map(tuple, blocks.collect())) == [("a", 5, 0), ("b", 5, 0), ("c", 5, 1)]
    assert sorted(map(tuple, X.block_shards(pairs, blocks, 2).collect())) == [(0, 5, 0), (1, 2, 1)]
    X.write_parts(pairs.join(blocks, "ctg"), "block", "read", str(tmp_path / "parts"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "parts" / "block=1")).collect()) == ["r2", "r6"]


def test_tables_of_reads(spark, tmp_path):
    (tmp_path / "r2c").write_text("0 10 m1 ctgA\n1 11 m2 ctgA\n2 10 m1 ctgA\n3 10 m1 ctgB\n")
    (tmp_path / "phases").write_text("0 ctgA 1 0 x y m1\n1 ctgA 2 1 x y m1\n2 ctgA -1 0 x y m2\n")
    assert sorted(map(tuple, text.read_read_contigs(spark, str(tmp_path / "r2c")).collect())) == [("10", "ctgA"), ("10", "ctgB"), ("11", "ctgA")]
    (tmp_path / "bad").write_text("0 10 m1\n")
    with pytest.raises(Exception, match="not four"):
        text.read_read_contigs(spark, str(tmp_path / "bad")).collect()
    phases = text.read_phases(spark, str(tmp_path / "phases"))
    assert sorted(map(tuple, phases.collect())) == [("m1", "ctgA", 2, 1), ("m2", "ctgA", -1, 0)]
    reads = spark.createDataFrame([(1, "m1"), (2, "m2"), (3, "m3")], "id long, oid string")
    assert T.phases_by_read(reads, phases).count() == 2
    (tmp_path / "a.fai").write_text("ctgA\t100\t6\t80\t81\n")
    assert tuple(text.read_lengths(spark, str(tmp_path / "a.fai")).first()) == ("ctgA", 100)
    (tmp_path / "l.fofn").write_text("x.m4\n\n/abs/y.m4\n")
    (tmp_path / "l.json").write_text('["x.m4", "/abs/y.m4"]')
    for name in ("l.fofn", "l.json"):
        assert text.listed_files(spark, str(tmp_path / name)) == [f"{tmp_path}/x.m4", "/abs/y.m4"]
    assert [r.path.rsplit("/", 1)[1] for r in text.found_files(spark, str(tmp_path), "*.fai").collect()] == ["a.fai"]
    assert sorted(r.name for r in text.read_names(spark, str(tmp_path / "l.fofn")).collect()) == ["/abs/y.m4", "x.m4"] and text.read_names(spark, None) is None
    (tmp_path / "g.gff").write_text("##gff\nctg\tsrc\tregion\t1\t10\t.\t+\t.\tcov=1,2,3;cov2=2.5,0.5;gaps=0,1\n")
    assert tuple(text.gff_coverage(text.read_gff(spark, str(tmp_path / "g.gff"))).first())[:8] == ("ctg", 0, 10, "+", 1.0, 2.0, 3.0, 2.5)


def test_orientation(spark, tmp_path):
    seq = "AT" * 20 + "G" * 30 + "C" * 40
    d = spark.createDataFrame([("a", seq, "".join(chr(33 + i % 60) for i in range(len(seq))))], "name string, seq string, qual string")
    at = S.least_skew(d, "name", "seq", 20, 10).first()["shift"]
    r = S.reoriented(d, "name", "seq", 20, 10, qual="qual").first()
    row = d.first()
    assert r.header == f"a shifted_by_bp:-{at}/{len(seq)}" and r.seq == seq[at:] + seq[:at] and r.qual == row.qual[at:] + row.qual[:at]
    none = S.reoriented(d, "name", "seq", 20, 10, d.select("name").where("false")).first()
    assert none.seq == seq and none.header.endswith(f"-0/{len(seq)}")
    with pytest.raises(Exception, match="longer than the window"):
        S.reoriented(d, "name", "seq", 500, 200).collect()
    back = S.randomized(d, "name", "seq", 7).first()
    n = int(back.header.split("-")[1].split("/")[0])
    assert back.seq == seq[n:] + seq[:n] and 0 <= n <= len(seq)
    text.write_fastq(S.reoriented(d, "name", "seq", 20, 10, qual="qual"), str(tmp_path / "fq"))
    assert tuple(text.read_fastq(spark, str(tmp_path / "fq")).first()) == ("a", r.seq, r.qual)
    text.write_fasta(S.reoriented(d, "name", "seq", 20, 10), str(tmp_path / "fa"))
    assert tuple(text.read_fasta(spark, str(tmp_path / "fa")).first()) == ("a", r.seq)


def test_four_line_records(spark, tmp_path):
    """Records of four lines from parts of files, also where a quality line looks like a header."""
    want = {(f"r{f}_{i}", "ACGT" * (i % 5 + 1), "@II+" * (i % 5 + 1)) for f in range(2) for i in range(300)}
    for f in range(2):
        (tmp_path / f"{f}.fastq").write_text("".join(f"@r{f}_{i} x\n{'ACGT' * (i % 5 + 1)}\n+\n{'@II+' * (i % 5 + 1)}\n" for i in range(300)) + "\n" * f)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        x = text.read_fastq(spark, str(tmp_path / "*.fastq"), four_lines=True)
        assert {tuple(r) for r in x.collect()} == want and x.count() == 600
        (tmp_path / "bad.fastq").write_text("@a\nAC\n+\nI\n")
        with pytest.raises(Exception, match="not a record"):
            text.read_fastq(spark, str(tmp_path / "bad.fastq"), four_lines=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_report_forms(spark):
    d = spark.createDataFrame([("it's", "pre.7.m4", "mv/12/0_9")], "v string, f string, h string")
    c = R.override({"a": "1"}, R.parse_config(F.lit("b=x y;c=it's")))
    assert d.select(R.config_lines(c)).first()[0] == "a=1\nb='x y'\nc='it'\"'\"'s'"
    assert d.select(R.unknown_settings({"b": ""}, R.parse_config(F.lit("b=1;z=2")))).first()[0] == ["z"]
    assert d.select(R.block_of_file(F.col("f")), R.movie_parts(F.col("h")).zmw).first()[:] == (7, "12")
    assert '"severity": "ERROR"' in R.alarm("E", "m") and R.alarm("E", "m") != R.alarm("E", "m")
    t = spark.createDataFrame([("a", 1, True, 2.5), ("b", 9, False, 0.0)], "name string, len long, circular boolean, coverage double")
    assert '"values":["b","a"]' in R.contig_report(t).first()[0]
    assert R.column_report(t).first()[0] == '{"name":["b","a"],"len":[9,1],"circular":[false,true],"coverage":[0.0,2.5]}'
    e = spark.createDataFrame([(1, 2, 5), (2, 3, 15)], "a long, b long, w long")
    p = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "v long, phase int")
    assert {r.v: r.within for r in P.within_phase(e, p).collect()} == {1: 1.0, 2: 0.25, 3: 0.0}


def test_flags_as_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 8)], "name string, flags int").write.parquet(str(tmp_path / "in"))
    q = merged_flags(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("flags_now").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("flags_now").collect())) == [("a", 3), ("b", 8)]
