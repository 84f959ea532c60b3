"""Golden cases of the library's operators."""

import pytest
from pyspark.sql import functions as F

from readloom import schemas
from readloom.functions import cigar as C
from readloom.functions import sequence as S
from readloom.operators import blocks as B
from readloom.operators import intervals as I
from readloom.operators import lengths as L
from readloom.operators import overlaps as O
from readloom.operators import phasing as P
from readloom.operators import reports as R
from readloom.operators import tracking as T
from readloom.sources import text


def one(df):
    return df.first()[0]


def test_lengths(spark):
    d = spark.createDataFrame([(50,), (40,), (30,)], "n int")
    r = L.length_stats(d, "n").first()
    assert (r.total, r["mean"], r["median"], r["max"], round(r.esize)) == (120, 40, 40, 50, 42)
    assert {x.percent: (x.nx, x.lx) for x in L.nx_lx(d, "n", (50, 90, 100)).collect()} == {50: (40, 2), 90: (30, 3), 100: (30, 3)}
    empty = L.length_stats(d.where("n > 99"), "n").first()
    assert (empty.total, empty["median"], empty.esize) == (0, 0, 0.0)


def test_cutoff(spark):
    d = spark.createDataFrame([(n,) for n in (5852, 11983, 24292, 5105)], "n int")
    assert one(L.length_cutoff(d, "n", 36000, 1)) == 11983
    assert one(L.length_cutoff(d, "n", 10**6, 1)) == 5105
    with pytest.raises(Exception, match="not enough"):
        L.length_cutoff(d, "n", 10**6, 1, True).collect()


def test_subtract(spark):
    rows = spark.createDataFrame([(1, "a", 30, 40), (2, "b", 1, 100), (3, "none", 1, 5)], "id long, seq string, start long, end long")
    masks = spark.createDataFrame([("a", 34, 38), ("b", 10, 50), ("b", 20, 30)], "seq string, start long, end long")
    assert sorted(tuple(r) for r in I.subtract(rows, masks).collect()) == [(1, "a", 30, 33), (1, "a", 39, 40), (2, "b", 1, 9), (2, "b", 31, 100)]
    assert sorted(tuple(r) for r in I.subtract(rows, masks, merged=True).where("id = 2").collect()) == [(2, "b", 1, 9), (2, "b", 51, 100)]


def test_sequences(spark):
    d = spark.createDataFrame([("k", "TTgCNNaa")], "key string, seq string")
    assert one(d.select(S.revcomp(F.col("seq")))) == "ttNNGcAA"
    seeds = S.kmers(spark.createDataFrame([("k", "ATCGGCTACTATT")], "key string, seq string"), "key", "seq", 12)
    assert {(r.pos, r.strand): r.kmer for r in seeds.collect()} == {(0, "fwd"): 3578995, (0, "rev"): 3328355, (1, "fwd"): 14315983, (1, "rev"): 832088}
    words = [r.w for r in seeds.orderBy("kmer").select(S.kmer_text(F.col("kmer"), 12).alias("w")).collect()]
    assert words == ["AATAGTAGCCGA", "ATAGTAGCCGAT", "ATCGGCTACTAT", "TCGGCTACTATT"]


def test_cigar(spark):
    d = spark.createDataFrame([("5S90M5H", 95), ("3H10M", 10), ("7S", 7)], "c string, n int")
    got = [tuple(r) for r in d.select(*C.end_clips(F.col("c"))).collect()]
    assert got == [(5, -5), (-3, 0), (7, 0)]
    assert [tuple(r) for r in d.select(*C.query_span(F.col("c"), F.col("n"))).limit(2).collect()] == [(5, 95, 100), (3, 13, 13)]


def test_blocks(spark):
    d = spark.createDataFrame([(i, (i + 1) * 10_000) for i in range(10)], "i long, w long")
    assert [tuple(r) for r in B.block_table(d, "i", "w", 80_000).orderBy("block").collect()] == [(0, 0, 4, 100000), (1, 4, 6, 110000), (2, 6, 8, 150000), (3, 8, 9, 90000), (4, 9, 10, 100000)]
    bins = B.largest_first(2, [5, 4, 3, 2])
    assert sorted(i for b in bins for i in b) == [0, 1, 2, 3] and len(bins) == 2


def test_reports(spark):
    d = spark.createDataFrame([("x/raw_reads.1.raw_reads.2.las", "ctg.s1-01"), ("raw_reads.1.las", "ctg.s2")], "p string, n string")
    assert [tuple(r) for r in d.select(R.stale_las(F.col("p")), R.renamed(F.col("n")), R.is_haplotig(F.col("n"))).collect()] == [(True, "s1_01", True), (False, "s2", False)]
    assert one(spark.range(1).select(R.thousands(F.lit(-1000000)))) == "-1,000,000"


def test_overlap_text(spark, tmp_path):
    line = "000000001 000001050 -9662 98.670 0 0 9656 9656 1 626 10288 12247 contained"
    (tmp_path / "a.m4").write_text(line + "\n---\n")
    x = text.read_overlaps(spark, str(tmp_path / "a.m4"))
    assert x.count() == 1 and one(x.select(O.overlap_text())) == line
    (tmp_path / "b.m4").write_text("too short\n")
    with pytest.raises(Exception, match="too few"):
        text.read_overlaps(spark, str(tmp_path / "b.m4")).collect()


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one x\nAC\nGT\n>two\nGG\n")
    assert sorted(tuple(r) for r in text.read_fasta(spark, str(tmp_path / "a.fasta")).collect()) == [("one", "ACGT"), ("two", "GG")]
    (tmp_path / "a.fastq").write_text("@r1 y\nAC\nGT\n+\n@I\nII\n@r2\nA\n+\nI\n")
    assert sorted(tuple(r) for r in text.read_fastq(spark, str(tmp_path / "a.fastq")).collect()) == [("r1", "ACGT", "@III"), ("r2", "A", "I")]


def test_empty_overlaps(spark):
    none = spark.createDataFrame([], schemas.OVERLAP)
    assert O.stage1_flags(none).count() == 0 and O.stage2_best(none).count() == 0
    assert O.coverage_stats(none).first()["n"] == 0


def test_phasing(spark):
    edges = spark.createDataFrame([(1, 2, 900), (2, 3, 900), (7, 8, 900)], "a long, b long, w long")
    assert {r.v: r.label for r in P.graph_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert {r.v for r in P.anneal(edges, sweeps=5).collect()} == {1, 2, 3, 7, 8}


def test_components_are_whole_or_an_error(spark):
    path = spark.createDataFrame([(v, v + 1) for v in range(40)], "a long, b long")
    assert {r.label for r in P.graph_components(path).collect()} == {0}
    with pytest.raises(RuntimeError):
        P.graph_components(path, rounds=1)


def test_phasing_separates_reads(spark):
    """Two groups of alike reads come apart, each read more often in its phase than delta, once sweeps below half the first heat outweigh the others."""
    import itertools

    edges = spark.createDataFrame([(a, b, 900 if a % 2 == b % 2 else 1) for a, b in itertools.combinations(range(16), 2)], "a long, b long, w long")
    got = {r.v: r.phase for r in P.anneal(edges, sweeps=4000).collect()}
    assert {got[0], got[1]} == {0, 1} and all(got[v] == got[v % 2] for v in range(16))


def test_phasing_in_parts(spark):
    """Parts of a component that exchange their phases find the same two groups, and a part is never larger than asked."""
    import itertools

    edges = spark.createDataFrame([(a, b, 900 if a % 2 == b % 2 else 1) for a, b in itertools.combinations(range(16), 2)] + [(100, 101, 900)], "a long, b long, w long")
    got = {r.v: (r.phase, r.freq) for r in P.anneal(edges, sweeps=1500, delta=0.0, part_size=6).collect()}
    assert set(got) == {*range(16), 100, 101} and all(0.5 <= f <= 1 for _, f in got.values())
    assert all(got[v][0] == got[v % 2][0] for v in range(16)) and got[0][0] != got[1][0]


def test_phasing_query_has_the_defaults(spark, monkeypatch):
    import inspect

    from readloom.plans import read_queries

    assert inspect.signature(P.anneal).parameters["sweeps"].default == 1000
    monkeypatch.setattr(P, "anneal", lambda edges, **given: (edges, given))
    edges, given = read_queries.QUERIES["phase_anneal"][0](spark, "/root/testdata/sf0.001")
    got = {(r.a, r.b): r.w for r in edges.collect()}
    at = {r.doc_id: (r.doc_id // 64, r.doc_id % 64 * 400, r.doc_id % 64 * 400 + len(r.text)) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert given == {} and min(got.values()) >= 1
    assert set(got) == {(x, y) for x in at for y in at if x < y and at[x][0] == at[y][0] and max(at[x][1], at[y][1]) < min(at[x][2], at[y][2])}


def test_overlapping_reads(spark):
    aln = [(1, "x", 0, 100, 60, 0), (2, "x", 99, 30_000, 20, 16), (3, "x", 100, 200, 60, 0), (4, "y", 0, 100, 60, 0), (5, "x", 0, 100, 19, 0), (6, "x", 0, 100, 60, 256), (7, "x", 50, 50, 60, 0), (3, "x", 150, 260, 60, 2048), (1, "x", 25_000, 25_100, 60, 0)]
    aln = spark.createDataFrame(aln, "key long, rname string, start long, stop long, mapq int, flag int")
    assert sorted(map(tuple, P.overlapping_pairs(aln).collect())) == [(1, 2), (2, 3)]
    seeds = spark.createDataFrame([(1, 5), (1, 6), (2, 6), (3, 9)], "key long, kmer long")
    assert sorted(map(tuple, P.overlap_edges(seeds, aln).collect())) == [(1, 2, 334), (2, 3, 1)]


def test_greedy_blocks_fold_over_ranges(spark):
    import random

    from readloom.operators import blocks

    r = random.Random(4)
    for target in (1, 50, 4_000, 10**9):
        rows = [(i * 3, r.randint(0, 90)) for i in range(400)] + [(10_000, None)]
        want, block, at = [], -1, target
        for o, w in rows:
            block, at = (block + 1, w or 0) if at >= target else (block, at + (w or 0))
            want.append((o, w or 0, block))
        df = spark.createDataFrame(rows, "o long, w long").repartition(3)
        assert sorted(map(tuple, blocks.greedy_blocks(df, "o", "w", target).collect())) == want
    assert blocks.greedy_blocks(spark.createDataFrame([], "o long, w long"), "o", "w", 5).count() == 0


def test_split_over_several_ranges(spark):
    """Shards end in several ranges, and several in one; against the rule step by step."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n, weights in ((7, [(i * 37) % 11 for i in range(200)]), (50, [1] * 60), (5, [0] * 30 + [100] + [0] * 30), (12, [1000, *[1] * 99])):
            got = [r["count"] for r in B.split_table(spark.createDataFrame(list(enumerate(weights)), "o long, w long"), "o", "w", n).groupBy("shard").count().orderBy("shard").collect()]
            want, at, left, groups = [], 0, sum(weights), min(n, len(weights))
            while at < len(weights):
                share, took, size = -(-left // groups), 0, 0
                while at < len(weights) and (took < share or not left or groups == 1):
                    took, size, at = took + weights[at], size + 1, at + 1
                left, groups = left - took, groups - 1
                want.append(size)
                if not left and at < len(weights) and not any(weights[at:]):
                    want[-1], at = want[-1] + len(weights) - at, len(weights)
            assert got == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_best_partners_in_batches(spark, tmp_path):
    hits = spark.range(3000).selectExpr("id AS q", "id * 7 % 50 AS t", "id * 13 % 997 + 2000 AS len")
    best = T.BestPartners(spark, str(tmp_path / "best"), n=5)
    assert best.best().count() == 0 and best.batches() == set()
    for k in (2, 0, 1):
        assert best.add(f"b{k}", hits.where(f"q % 3 = {k}"))
        assert not best.add(f"b{k}", hits.where(f"q % 3 = {k}"))
    assert sorted(map(tuple, best.best().select("q", "t", "len").collect())) == sorted(map(tuple, T.top_partners(hits, 5).select("q", "t", "len").collect()))
    assert best.batches() == {"b0", "b1", "b2"} and len(list((tmp_path / "best").glob("v*"))) == 2
    (tmp_path / "best" / "v00000009").mkdir()  # an update that didn't come to its end
    assert T.BestPartners(spark, str(tmp_path / "best"), n=5).best().count() == 250
