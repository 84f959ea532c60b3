"""Queries on lengths, intervals, tracking, blocks, sequences, alignments and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions import cigar as C
from readloom.functions import sequence as S
from readloom.operators import alignment as A
from readloom.operators import blocks as B
from readloom.operators import contigs as N
from readloom.operators import intervals as I
from readloom.operators import lengths as L
from readloom.operators import phasing as P
from readloom.operators import reports as R
from readloom.operators import sampling as M
from readloom.operators import seeds as K
from readloom.operators import tracking as T
from readloom.plans.views import ALN, OVL, plain, table, view

docs = lambda s, d: table(s, d, "documents")
aln = lambda s, d: view(s, d, ALN)
WA = f"WITH a AS ({plain(ALN)})"
r6 = lambda c: F.round(c, 6)

# --- lengths ---
_ORDERED = "WITH l AS (SELECT n_chars AS len, sum(n_chars) OVER w AS upto, row_number() OVER w AS rn, sum(n_chars) OVER () AS total, count(*) OVER () AS n FROM documents WINDOW w AS (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING))"
GENOME = 100_000


def _preassembly(s: SparkSession, d: str) -> DataFrame:
    raw = docs(s, d).select(F.col("doc_id").alias("pos"), F.col("n_chars").alias("len"))
    preads = table(s, d, "labels").select("doc_id").distinct().join(docs(s, d), "doc_id").select(F.col("doc_id").alias("pos"), F.expr("n_chars * 9 div 10").alias("len"))
    return L.preassembly_stats(raw, preads, 2000, GENOME)


def _side_sql(k: str, t: str) -> str:
    return f"""{k} AS (SELECT count(*) AS {k}_reads, CAST(sum(len) AS BIGINT) AS {k}_bases, floor(avg(len) * 100 + 0.5) / 100 AS {k}_mean, max(CASE WHEN 2 * upto >= total THEN len END) AS {k}_n50,
  max(CASE WHEN rn = CAST(floor(n * (1 - 0.95::DOUBLE)) AS BIGINT) + 1 THEN len END) AS {k}_p95, floor(CAST(sum(len) AS DOUBLE) / {GENOME} * 100 + 0.5) / 100 AS {k}_coverage, floor(CAST(sum(len * len) AS DOUBLE) / sum(len) * 100 + 0.5) / 100 AS {k}_esize
  FROM (SELECT len, row_number() OVER w AS rn, sum(len) OVER w AS upto, sum(len) OVER () AS total, count(*) OVER () AS n FROM {t} WINDOW w AS (ORDER BY len DESC, pos ROWS UNBOUNDED PRECEDING)))"""


_PRE = f"""WITH r AS (SELECT doc_id AS pos, n_chars AS len FROM documents), s AS (SELECT * FROM r WHERE len >= 2000), p AS (SELECT doc_id AS pos, n_chars * 9 // 10 AS len FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
{_side_sql("raw", "r")}, {_side_sql("seed", "s")}, {_side_sql("preassembled", "p")}, c AS (SELECT floor(avg(r.len - p.len) * 100 + 0.5) / 100 AS preassembled_seed_truncation FROM p JOIN r USING (pos))
SELECT *, {GENOME} AS genome_length, 2000 AS length_cutoff, floor(CAST(preassembled_bases AS DOUBLE) / seed_bases * 100 + 0.5) / 100 AS preassembled_yield, 1.0::DOUBLE AS preassembled_seed_fragmentation FROM raw, seed, preassembled, c"""

# --- intervals ---
_ROWS = "SELECT o_orderkey AS id, CAST(o_custkey % 40 AS STRING) AS seq, o_orderkey % 5000 + 1 AS start, o_orderkey % 5000 + 1 + o_custkey % 700 AS end FROM {orders}"
_MASKS = "SELECT DISTINCT CAST(l_suppkey % 35 AS STRING) AS seq, l_orderkey % 5000 + 1 AS start, l_orderkey % 5000 + 1 + l_linenumber * 9 AS end FROM {lineitem} WHERE l_linenumber < 3 AND l_suppkey % 7 = 0"
_SPANS = "SELECT CAST(user_id AS STRING) AS seq, CAST(event_id % 7 + 1 AS BIGINT) AS span, CAST(floor(value) AS BIGINT) AS cov_mean, CAST(floor(value) AS BIGINT) - 1 AS cov_min, CAST(floor(value) AS BIGINT) + 2 AS cov_max FROM {events}"


def _subtract_sql(merged: bool) -> str:
    before = "max(m.e) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" if merged else "lag(m.e) OVER w"
    reach = "max(m.e) OVER (PARTITION BY r.id)" if merged else "m.e"
    return f"""WITH r AS ({plain(_ROWS).replace("start,", "s,").replace("AS end", "AS e")}), m AS ({plain(_MASKS).replace("AS start", "AS s").replace("AS end", "AS e")}),
h AS (SELECT r.id, r.seq, r.s, r.e, m.s AS ms, coalesce({before} + 1, r.s) AS f, lead(m.s) OVER w IS NULL AS z, {reach} AS q FROM r JOIN m ON r.seq = m.seq AND m.e >= r.s AND m.s <= r.e WINDOW w AS (PARTITION BY r.id ORDER BY m.s, m.e)),
x AS (SELECT id, seq, greatest(f, s) AS a, ms - 1 AS b FROM h UNION ALL SELECT id, seq, greatest(q + 1, s), e FROM h WHERE z UNION ALL SELECT id, seq, s, e FROM r WHERE seq IN (SELECT seq FROM m) AND id NOT IN (SELECT id FROM h))
SELECT id, seq, a AS start, b AS "end" FROM x WHERE a <= b"""


def _rows(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, _ROWS)


def _overlaps(s: SparkSession, d: str) -> DataFrame:
    x = view(s, d, OVL).select("a_name", F.col("b_name").alias("x"), F.col("a_start").cast("long").alias("start"), F.col("a_end").cast("long").alias("end")).where("start <= end").distinct()
    return I.interval_join(x, x.select("a_name", F.col("x").alias("y"), F.col("start").alias("r_start"), F.col("end").alias("r_end")), ["a_name"], 500).where("x < y").groupBy("a_name").agg(F.count("*").alias("n"), F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("bases"))


# --- tracking ---
_HITS = "SELECT CAST(l_suppkey AS BIGINT) AS q, CAST(l_partkey AS BIGINT) AS t, max(CAST(floor(l_extendedprice) AS BIGINT)) AS len FROM {lineitem} GROUP BY l_suppkey, l_partkey"
_PLACED = "SELECT CAST(s_suppkey AS BIGINT) AS q, s_nationkey AS ctg FROM {supplier}"
_PHASES = "SELECT CAST(s_suppkey AS BIGINT) AS id, s_nationkey AS ctg, CAST(s_suppkey % 4 AS INT) - 1 AS block, CAST(s_suppkey % 2 AS INT) AS phase FROM {supplier}"
_TOP = f"WITH h AS ({plain(_HITS)}), b AS (SELECT q, t, len FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY len DESC, q DESC) AS rn FROM h WHERE len >= 2500) WHERE rn <= 5)"

# --- sequences: letters of texts as bases ---
_SEQ = "SELECT doc_id AS key, translate(text, 'ehiodsrulm', 'acgtACGTNN') AS seq FROM {documents}"
seqs = lambda s, d: view(s, d, _SEQ)
WS = f"WITH q AS ({plain(_SEQ)})"
_WIN = """, p AS (SELECT key, seq, unnest(generate_series(0, length(seq) - 201, 50)) AS pos FROM q WHERE length(seq) > 200), v AS (SELECT key, pos, substring(seq, pos + 1, 201) AS w FROM p),
g AS (SELECT key, CAST(pos AS INT) AS pos, length(regexp_replace(w, '[^gG]', '', 'g')) AS g, length(regexp_replace(w, '[^cC]', '', 'g')) AS c FROM v),
k AS (SELECT key, pos, CASE WHEN g + c = 0 THEN NULL ELSE CAST(g - c AS DOUBLE) / (g + c) END AS skew FROM g), z AS (SELECT *, sum(coalesce(skew, 0.0)) OVER (PARTITION BY key ORDER BY pos) AS accum FROM k)"""
_KSEQ = "SELECT doc_id AS key, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACGTACGTACG') AS seq FROM {documents}"
_K = 12
#: Other letters end a stretch of k-mers, but for those among the _K letters after one that does.
def kmer_sql(source: str, p: str = "") -> str:
    """CTEs down to {p}k (key, pos, strand, kmer), of source (key, seq)."""
    return f"""{p}q AS (SELECT key, regexp_replace(upper(seq), '[^ACGT]', 'N', 'g') AS s FROM ({source})),
{p}o AS (SELECT key, s, list_filter(list_transform(string_split(s, ''), lambda c, i: CASE WHEN c = 'N' THEN i - 1 END), lambda i: i IS NOT NULL) AS o FROM {p}q),
{p}e AS (SELECT key, s, list_append(list_reduce(list_prepend([{-_K - 1}::BIGINT], list_transform(o, lambda i: [i::BIGINT])), lambda a, i: CASE WHEN i[1] > a[len(a)] + {_K} THEN list_concat(a, i) ELSE a END), length(s)) AS e FROM {p}o),
{p}r AS (SELECT key, s, unnest(list_zip(e[:-2], e[2:])) AS r FROM {p}e), {p}p AS (SELECT key, s, unnest(generate_series(r[1] + {_K} + 1, r[2] - {_K})) AS pos FROM {p}r WHERE r[1] + {_K} + 1 <= r[2] - {_K}),
{p}w AS (SELECT key, CAST(pos AS INT) AS pos, substring(s, pos + 1, {_K}) AS w FROM {p}p),
{p}b AS (SELECT key, pos, 'fwd' AS strand, w FROM {p}w UNION ALL SELECT key, pos, 'rev', translate(reverse(w), 'ACGT', 'TGCA') FROM {p}w),
{p}k AS (SELECT key, pos, strand, CAST(list_reduce(list_transform(string_split(translate(w, 'ACGT', '0123'), ''), lambda x: CAST(x AS BIGINT)), lambda a, x: a * 4 + x) AS BIGINT) AS kmer FROM {p}b)"""


WK = "WITH " + kmer_sql(plain(_KSEQ))
kmers = lambda s, d: S.kmers(view(s, d, _KSEQ), "key", "seq", _K)

# --- alignments ---
TARGETS = "SELECT CAST(n_nationkey AS STRING) AS rname, CAST(900 + n_nationkey * 10 AS INT) AS ref_len FROM {nation}"
WT = WA + f", t AS ({plain(TARGETS)})"


def _phased(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("qname"), (F.col("o_custkey") % 25).cast("string").alias("ctg"), F.lit(1).alias("block"), (F.col("o_orderkey") % 3 - 1).cast("int").alias("phase"), F.lit(0).alias("rest"))


# --- graph ---
_EDGES_ALL = "SELECT DISTINCT CAST(c_custkey AS BIGINT) AS a, CAST(1000000 + c_nationkey * 50 + c_custkey % 45 AS BIGINT) AS b FROM {customer}"


#: Documents as reads along contigs of 64: one starts every 400 bases.
_READ_ALN = "SELECT doc_id AS key, CAST(doc_id div 64 AS STRING) AS rname, doc_id % 64 * 400 AS start, doc_id % 64 * 400 + length(text) AS stop, 60 AS mapq, 0 AS flag FROM {documents}"


def _anneal(s: SparkSession, d: str) -> DataFrame:
    return P.anneal(P.read_overlap_edges(view(s, d, _KSEQ), view(s, d, _READ_ALN), _K))


_CONFIG = "genome=5M; coverage = 30\nmin_len=500;"
_NAMES = "SELECT page_id, concat(CASE WHEN page_id % 3 = 0 THEN 'raw_reads.' ELSE 'preads.' END, CAST(page_id AS STRING), CASE WHEN page_id % 2 = 0 THEN '.las' WHEN page_id % 3 = 0 THEN concat('.raw_reads.', CAST(page_id + 1 AS STRING), '.las') ELSE concat('.preads.', CAST(page_id + 1 AS STRING), '.las') END) AS f, concat('ctg.s', CAST(page_id AS STRING), CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN '-01' ELSE '-02' END, ' x-y') AS h FROM {pages}"

QUERIES = {
    "len_nx_lx": (lambda s, d: L.nx_lx(docs(s, d), "n_chars"), _ORDERED + " SELECT CAST(p AS INT) AS percent, max(len) AS nx, min(rn) AS lx FROM l, (VALUES (50), (75), (90), (95), (100)) v(p) WHERE 100 * upto >= p * total GROUP BY p"),
    "len_stats": (lambda s, d: L.length_stats(docs(s, d), "n_chars").select("number", "total", r6("mean").alias("mean"), "min", "max", r6("esize").alias("esize"), "median"), _ORDERED + " SELECT count(*) AS number, CAST(sum(len) AS BIGINT) AS total, round(avg(len), 6) AS mean, min(len) AS min, max(len) AS max, round(CAST(sum(len * len) AS DOUBLE) / sum(len), 6) AS esize, max(CASE WHEN rn = n // 2 + 1 THEN len END) AS median FROM l"),
    "len_percentile": (lambda s, d: L.percentile_desc(docs(s, d), "n_chars", 0.95), _ORDERED + " SELECT max(CASE WHEN rn = CAST(floor(n * (1 - 0.95::DOUBLE)) AS BIGINT) + 1 THEN len END) AS value FROM l"),
    "len_cutoff": (lambda s, d: L.length_cutoff(docs(s, d), "n_chars", GENOME, 10), _ORDERED + f" SELECT coalesce(max(CASE WHEN upto >= {GENOME * 10} THEN len END), min(len)) AS cutoff FROM l"),
    "preassembly_stats": (_preassembly, _PRE),
    "rdb_filter": (lambda s, d: M.without_blacklisted(docs(s, d).select("doc_id", "n_chars"), table(s, d, "labels").where("toxic = 1").select("doc_id").distinct(), "doc_id"), "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    "rdb_subsample": (lambda s, d: M.subsample(docs(s, d).select("doc_id", "n_chars"), "doc_id", "n_chars", GENOME, 8, [F.expr("doc_id * 7919 % 10007")]), f"SELECT doc_id, n_chars FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id * 7919 % 10007, doc_id) - n_chars AS b FROM documents) WHERE b < {GENOME * 8}"),
    "rdb_subsample_umc": (lambda s, d: M.subsample(table(s, d, "conversations").select("conv_id", "turn", F.length("text").alias("len")), "conv_id", "len", 10_000, 3, [F.expr("conv_id * 7919 % 10007"), F.col("turn")]), "WITH c AS (SELECT conv_id, turn, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn, length(text)) AS rn FROM conversations), f AS (SELECT conv_id, sum(len) OVER (ORDER BY conv_id * 7919 % 10007, turn, conv_id) - len AS b FROM c WHERE rn = 1) SELECT conv_id, turn, CAST(len AS INT) AS len FROM c WHERE conv_id IN (SELECT conv_id FROM f WHERE b < 30000)"),
    "combine_to_target": (lambda s, d: B.greedy_blocks(docs(s, d), "doc_id", "n_chars", 20_000), "WITH RECURSIVE n AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k FROM documents), f AS (SELECT k, doc_id, n_chars, n_chars AS t, 0 AS block FROM n WHERE k = 1 UNION ALL SELECT n.k, n.doc_id, n.n_chars, CASE WHEN t >= 20000 THEN n.n_chars ELSE t + n.n_chars END, CASE WHEN t >= 20000 THEN block + 1 ELSE block END FROM f JOIN n ON n.k = f.k + 1) SELECT doc_id, n_chars, CAST(block AS INT) AS block FROM f"),
    "rdb_reblock": (lambda s, d: B.block_table(docs(s, d), "doc_id", "n_chars", 20_000), "WITH RECURSIVE n AS (SELECT n_chars, row_number() OVER (ORDER BY doc_id) AS k FROM documents), f AS (SELECT k, n_chars, n_chars AS t, 0 AS block FROM n WHERE k = 1 UNION ALL SELECT n.k, n.n_chars, CASE WHEN t >= 20000 THEN n.n_chars ELSE t + n.n_chars END, CASE WHEN t >= 20000 THEN block + 1 ELSE block END FROM f JOIN n ON n.k = f.k + 1) SELECT CAST(block AS INT) AS block, min(k) - 1 AS first, max(k) AS stop, CAST(sum(n_chars) AS BIGINT) AS total FROM f GROUP BY block"),
    "shard_triangular": (lambda s, d: B.shard_triangular(s, 25, 7).select("shard", "t", "qs", "qe"), "WITH c AS (SELECT t, q, row_number() OVER (ORDER BY t, q) - 1 AS k FROM range(25) a(t), range(25) b(q) WHERE t <= q), s AS (SELECT t, q, CASE WHEN k < 3 * 47 THEN k // 47 ELSE 3 + (k - 141) // 46 END AS shard FROM c) SELECT CAST(shard AS INT) AS shard, t, min(q) AS qs, max(q) + 1 AS qe FROM s GROUP BY shard, t"),
    "shard_columns": (lambda s, d: B.shard_columns(s, 5, 25, 7), "WITH s AS (SELECT q, CASE WHEN q < 16 THEN q // 4 ELSE 4 + (q - 16) // 3 END AS shard FROM range(25) b(q)), g AS (SELECT shard, min(q) AS qs, max(q) + 1 AS qe FROM s GROUP BY shard) SELECT CAST(shard AS INT) AS shard, t, qs, qe FROM g, range(5) a(t)"),
    "gff_summary": (lambda s, d: I.span_summary(view(s, d, _SPANS), F.col("span")).select("seq", r6("cov_mean").alias("cov_mean"), "cov_min", "cov_max"), f"SELECT seq, round(CAST(sum(cov_mean * span) AS DOUBLE) / sum(span), 6) AS cov_mean, min(cov_min) AS cov_min, max(cov_max) AS cov_max FROM ({plain(_SPANS)}) GROUP BY seq"),
    "gff_subtract": (lambda s, d: I.subtract(_rows(s, d), view(s, d, _MASKS), 1000), _subtract_sql(False)),
    "gff_subtract_merged": (lambda s, d: I.subtract(_rows(s, d), view(s, d, _MASKS), 1000, merged=True), _subtract_sql(True)),
    "interval_overlap_join": (_overlaps, f"WITH x AS (SELECT DISTINCT a_name, b_name AS x, CAST(a_start AS BIGINT) AS s, CAST(a_end AS BIGINT) AS e FROM ({plain(OVL)}) WHERE a_start <= a_end) SELECT p.a_name, count(*) AS n, CAST(sum(least(p.e, q.e) - greatest(p.s, q.s)) AS BIGINT) AS bases FROM x p JOIN x q ON p.a_name = q.a_name AND p.x < q.x AND p.s <= q.e AND q.s <= p.e GROUP BY p.a_name"),
    "track_topn": (lambda s, d: T.top_partners(view(s, d, _HITS), 5), _TOP + " SELECT * FROM b"),
    "track_phase_exclude": (lambda s, d: T.exclude_other_phase(view(s, d, _HITS).withColumn("t", F.col("t") % 100 + 1).distinct(), view(s, d, _PHASES)), f"WITH h AS (SELECT DISTINCT q, t % 100 + 1 AS t, len FROM ({plain(_HITS)})), p AS ({plain(_PHASES)}) SELECT h.* FROM h LEFT JOIN p x ON h.q = x.id LEFT JOIN p y ON h.t = y.id WHERE NOT coalesce(x.ctg = y.ctg AND x.block = y.block AND x.block <> -1 AND x.phase <> y.phase, false)"),
    "track_rank": (lambda s, d: T.contig_rank(T.top_partners(view(s, d, _HITS), 5), view(s, d, _PLACED)), _TOP + f", p AS ({plain(_PLACED)}), g AS (SELECT t, ctg, count(*) AS n, CAST(-sum(len) AS BIGINT) AS score FROM b JOIN p USING (q) GROUP BY t, ctg) SELECT g.*, CAST(row_number() OVER (PARTITION BY t ORDER BY score, ctg) - 1 AS INT) AS rank, CAST(EXISTS (SELECT 1 FROM p WHERE p.q = g.t AND p.ctg = g.ctg) AS INT) AS in_ctg FROM g"),
    "revcomp": (lambda s, d: seqs(s, d).select("key", F.md5(S.revcomp(F.col("seq")).cast("binary")).alias("h"), F.md5(S.revcomp(F.col("seq"), True).cast("binary")).alias("h_fixed")), WS + " SELECT key, md5(translate(reverse(seq), 'ATGCacg', 'TACGtgc')) AS h, md5(translate(reverse(seq), 'ATGCacgt', 'TACGtgca')) AS h_fixed FROM q"),
    "base_counts": (lambda s, d: seqs(s, d).select("key", S.base_counts(F.col("seq")).alias("c"), r6(S.gc_fraction(F.col("seq"))).alias("gc_part")).select("key", "c.*", "gc_part"), WS + ", n AS (SELECT key, " + ", ".join(f"CAST(length(regexp_replace(seq, '[^{x}{x.upper()}]', '', 'g')) AS INT) AS {x}" for x in "acgt") + " FROM q) SELECT *, CAST(g + c AS INT) AS gc, CAST(a + t AS INT) AS at, CAST(a + c + g + t AS INT) AS okay, round(CASE WHEN a + c + g + t = 0 THEN NULL ELSE CAST(g + c AS DOUBLE) / (a + c + g + t) END, 6) AS gc_part FROM n"),
    "gc_skew": (lambda s, d: S.windows(seqs(s, d), "key", "seq", 200, 50).select("key", "pos", r6("skew").alias("skew"), r6("accum").alias("accum")), WS + _WIN + " SELECT key, pos, round(skew, 6) AS skew, round(accum, 6) AS accum FROM z"),
    "gc_skew_pieces": (lambda s, d: N.piece_windows(N.cut_pieces(seqs(s, d), "key", "seq", 1000), "key", 200, 50).select("key", F.col("pos").cast("int").alias("pos"), r6("skew").alias("skew"), r6("accum").alias("accum")), WS + _WIN + " SELECT key, pos, round(skew, 6) AS skew, round(accum, 6) AS accum FROM z"),
    "least_skew_pieces": (lambda s, d: N.least_skew_place(N.cut_pieces(seqs(s, d), "key", "seq", 1000), "key", 200, 50), WS + _WIN + ", m AS (SELECT key, min_by(pos, (round(accum, 9), pos)) AS shift FROM z GROUP BY key) SELECT key, CAST(coalesce(shift, 0) AS BIGINT) AS shift FROM q LEFT JOIN m USING (key) WHERE length(seq) > 0"),
    "rotate_min_skew": (lambda s, d: S.least_skew(seqs(s, d), "key", "seq", 200, 50).join(seqs(s, d), "key").select("key", "shift", F.md5(S.rotate_left(F.col("seq"), F.col("shift")).cast("binary")).alias("h")), WS + _WIN + ", m AS (SELECT key, min_by(pos, (round(accum, 9), pos)) AS shift FROM z GROUP BY key) SELECT key, shift, md5(substring(seq, shift + 1) || substring(seq, 1, shift)) AS h FROM m JOIN q USING (key)"),
    "kmers": (kmers, WK + " SELECT * FROM k"),
    "kmer_shared": (lambda s, d: K.read_hits(view(s, d, _KSEQ).where("key % 2 = 1"), view(s, d, _KSEQ).where("key % 2 = 0"), _K).select("key_a", "key_b", F.col("shared").alias("n")), WK + ", x AS (SELECT DISTINCT key, kmer FROM k) SELECT p.key AS key_a, q.key AS key_b, count(*) AS n FROM x p JOIN x q ON p.kmer = q.kmer AND p.key % 2 = 0 AND q.key % 2 = 1 GROUP BY p.key, q.key"),
    "kmer_search": (lambda s, d: K.read_search(view(s, d, _KSEQ), view(s, d, _KSEQ).where("key % 50 = 0"), _K), WK + " SELECT p.key AS key_a, q.key AS key_b, count(*) AS n, CAST(sum(p.pos) AS BIGINT) AS pos_a, CAST(sum(q.pos) AS BIGINT) AS pos_b, CAST(sum(CASE WHEN p.strand = q.strand THEN 1 ELSE 0 END) AS BIGINT) AS same, bit_xor(p.kmer * 1000003 + p.pos * 4099 + q.pos) AS mark FROM k p JOIN k q ON p.kmer = q.kmer AND p.key % 50 = 0 GROUP BY p.key, q.key"),
    "kmer_hits": (lambda s, d: K.read_hits(view(s, d, _KSEQ), view(s, d, _KSEQ).where("key % 50 = 0"), _K), WK + " SELECT p.key AS key_a, q.key AS key_b, count(*) AS hits, count(DISTINCT p.kmer) AS shared FROM k p JOIN k q ON p.kmer = q.kmer AND p.key % 50 = 0 GROUP BY p.key, q.key"),
    "kmer_order": (lambda s, d: K.seeds_in_order(kmers(s, d)).groupBy("key").agg(F.count("*").alias("n"), F.min("nth").alias("first"), F.max("nth").alias("last"), F.bit_xor(F.expr("nth * 31 + pos")).alias("mark")), WK + ", nth AS (SELECT key, pos, row_number() OVER (ORDER BY kmer, pos, key, strand) - 1 AS nth FROM k) SELECT key, count(*) AS n, min(nth) AS first, max(nth) AS last, bit_xor(nth * 31 + pos) AS mark FROM nth GROUP BY key"),
    "kmer_difference": (lambda s, d: S.kmer_difference(kmers(s, d).where("key % 2 = 0"), kmers(s, d).where("key % 2 = 1")).groupBy("key").agg(F.count("*").alias("n")), WK + " SELECT key, count(*) AS n FROM k WHERE key % 2 = 0 AND kmer NOT IN (SELECT kmer FROM k WHERE key % 2 = 1) GROUP BY key"),
    "kmer_similarity": (lambda s, d: P.read_similarity(view(s, d, _KSEQ), docs(s, d).select(F.col("doc_id").alias("a"), (F.col("doc_id") + 20).alias("b")), _K), WK + ", x AS (SELECT DISTINCT key, kmer FROM k), z AS (SELECT key, count(*) AS n FROM x GROUP BY key) SELECT p.key AS a, q.key AS b, CAST(1000 * count(*) // (zp.n + zq.n) + 1 AS BIGINT) AS w FROM x p JOIN x q ON p.kmer = q.kmer AND q.key = p.key + 20 JOIN z zp ON zp.key = p.key JOIN z zq ON zq.key = q.key GROUP BY p.key, q.key, zp.n, zq.n"),
    "kmer_text": (lambda s, d: kmers(s, d).select("key", "pos", "strand", S.kmer_text(F.col("kmer"), _K).alias("word")), WK + " SELECT key, pos, strand, w AS word FROM b"),
    "cigar_clips": (lambda s, d: aln(s, d).select("qname", "pos", "cigar", *[c.cast("long").alias(k) for k, c in zip(("left", "right"), C.end_clips(F.col("cigar")), strict=True)], C.total(F.col("cigar"), "MDN=X").alias("span")), WA + ' SELECT qname, pos, cigar, s1 AS "left", CAST(-h1 AS BIGINT) AS "right", m1 + 50 + d1 AS span FROM a'),
    "bam_tags_enrich": (lambda s, d: A.enrich(aln(s, d)).select("qname", "pos", "mapq", "xb", "xe", "xr", "xq", "xp"), WA + " SELECT qname, pos, mapq, CAST(pos AS BIGINT) AS xb, pos + m1 + 50 + d1 AS xe, m1 + 50 + d1 AS xr, s1 + m1 + 52 AS xq, round(coalesce(100.0::DOUBLE * CAST(seq_len - s1 - nm AS DOUBLE) / (seq_len - s1), -1), 6) AS xp FROM a"),
    "bam_qname_coverage": (lambda s, d: A.well_covered(aln(s, d), 0.95), WA + " SELECT DISTINCT qname FROM (SELECT file, qname FROM a GROUP BY file, qname HAVING CAST(sum(seq_len - s1) AS DOUBLE) / max(seq_len + h1) >= 0.95)"),
    "bam_filter_clipped": (lambda s, d: A.drop_clipped(aln(s, d), view(s, d, TARGETS), 5, 25, 256).select("qname", "rname", "pos", "flag", "cigar"), WT + " SELECT qname, a.rname, pos, flag, cigar FROM a JOIN t ON a.rname = t.rname WHERE flag & 256 = 0 AND NOT ((s1 > 5 AND pos > 25) OR (h1 > 5 AND pos + m1 + 50 + d1 + 25 < ref_len))"),
    "bam2paf": (lambda s, d: A.to_paf(aln(s, d), view(s, d, TARGETS)), WT + " SELECT qname, CAST(seq_len + h1 AS BIGINT) AS qlen, CAST(CASE WHEN flag & 16 > 0 THEN h1 ELSE s1 END AS BIGINT) AS qstart, CAST(CASE WHEN flag & 16 > 0 THEN seq_len + h1 - s1 ELSE seq_len END AS BIGINT) AS qend, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS strand, a.rname AS tname, ref_len AS tlen, CAST(pos AS BIGINT) AS tstart, pos + m1 + 50 + d1 AS tend, m1 + 50 + d1 - coalesce(nm, 0) AS matches, m1 + 50 + d1 AS aln_len, mapq FROM a JOIN t ON a.rname = t.rname"),
    "paf_filter": (lambda s, d: A.keep_targets(A.to_paf(aln(s, d), view(s, d, TARGETS)), table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("name"))).select("qname", "tname", "tstart"), WA + " SELECT qname, rname AS tname, CAST(pos AS BIGINT) AS tstart FROM a WHERE rname IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1)"),
    "read2ctg_augment": (lambda s, d: A.augment_read_contigs(_phased(s, d), aln(s, d)), WA + ", p AS (SELECT CAST(o_orderkey AS VARCHAR) AS qname, CAST(o_custkey % 25 AS VARCHAR) AS ctg, 1 AS block, CAST(o_orderkey % 3 - 1 AS INT) AS phase, 0 AS rest FROM orders WHERE o_orderkey % 3 <> 0) SELECT * FROM p UNION ALL SELECT qname, rname, -1, -1, -1 FROM a WHERE mapq >= 1 AND flag & 1796 = 0 AND qname NOT IN (SELECT qname FROM p)"),
    "contig_table": (lambda s, d: R.contig_table(table(s, d, "supplier").select(F.concat_ws("|", F.col("s_suppkey").cast("string"), F.lit("x")).alias("name"), F.col("s_nationkey").alias("len")), table(s, d, "supplier").where("s_suppkey % 5 = 0").select(F.concat_ws("|", F.col("s_suppkey").cast("string"), F.lit("x")).alias("name")), I.span_summary(view(s, d, _SPANS), F.col("span"))).withColumn("coverage", r6("coverage")), f"WITH g AS (SELECT seq, CAST(sum(cov_mean * span) AS DOUBLE) / sum(span) AS c FROM ({plain(_SPANS)}) GROUP BY seq) SELECT CAST(s_suppkey AS VARCHAR) || '|x' AS name, s_nationkey AS len, s_suppkey % 5 = 0 AS circular, round(coalesce(c, 0.0), 6) AS coverage FROM supplier LEFT JOIN g ON seq = CAST(s_suppkey AS VARCHAR)"),
    "las_cleanup_select": (lambda s, d: view(s, d, _NAMES).where(R.stale_las(F.col("f"))).select("page_id", "f"), f"SELECT page_id, f FROM ({plain(_NAMES)}) WHERE regexp_matches(f, '^raw_reads\\.\\d+\\.raw_reads\\.\\d+\\.las$') OR regexp_matches(f, '^preads\\.\\d+\\.preads\\.\\d+\\.las$')"),
    "haplotig_split": (lambda s, d: view(s, d, _NAMES).select("page_id", R.is_haplotig(F.col("h")).alias("haplotig")), f"SELECT page_id, contains(split_part(h, ' ', 1), '-') AS haplotig FROM ({plain(_NAMES)})"),
    "header_rename": (lambda s, d: view(s, d, _NAMES).select("page_id", R.renamed(F.split_part("h", F.lit(" "), F.lit(1))).alias("name")), "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 's' || page_id WHEN 1 THEN 's' || page_id || '_01' ELSE '' END AS name FROM pages"),
    "thousands": (lambda s, d: table(s, d, "orders").select("o_orderkey", R.thousands(-F.col("o_orderkey") * 1000).alias("n")), "SELECT o_orderkey, format('{:,}', -o_orderkey * 1000) AS n FROM orders"),
    "config_merge": (lambda s, d: s.range(1).select(F.to_json(R.override({"coverage": "40", "ploidy": "2"}, R.parse_config(F.lit(_CONFIG)))).alias("config")), """SELECT '{"coverage":"30","genome":"5M","min_len":"500","ploidy":"2"}' AS config"""),
    "graph_components": (lambda s, d: P.graph_components(view(s, d, _EDGES_ALL)), f"WITH RECURSIVE e AS ({plain(_EDGES_ALL)}), q AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS v, a AS l FROM q UNION SELECT q.b, r.l FROM r JOIN q ON r.v = q.a) SELECT v, min(l) AS label FROM r GROUP BY v"),
    "phase_anneal": (_anneal, None),
}
