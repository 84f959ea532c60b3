"""Queries that write the given tables in a file format of the field and read them back by other means than whole scans of text, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import alignment as A
from readloom.operators import databases as D
from readloom.operators import intervals as I
from readloom.operators import polish as X
from readloom.operators import tracking as T
from readloom.operators.running import place, shared_dir, totals_before
from readloom.plans.read_queries import _HITS, _MASKS, _PLACED, _ROWS, _TOP, TARGETS, WA, WT, _subtract_sql
from readloom.plans.views import ALN, plain, table, view
from readloom.plans.report_queries import _FOLD, _SPLIT
from readloom.sources import bam, files, spans, text


def _folder(s: SparkSession, name: str) -> str:
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


# --- alignments as BAM ---
def _bam(s: SparkSession, d: str) -> DataFrame:
    """The alignments, with letters by place, through sorted and indexed BAM files."""
    tags = F.when(F.col("nm").isNotNull(), F.array(F.concat(F.lit("NM:i:"), F.col("nm").cast("string")))).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))
    rows = view(s, d, ALN).withColumns({"rnext": F.lit("*"), "pnext": F.lit(0), "tlen": F.lit(0), "seq": F.expr("substring(repeat('ACGTTGCA', 30), 1 + pos % 8, seq_len)"), "qual": F.expr("repeat('I', seq_len)"), "tags": tags})
    path = _folder(s, "bam")
    bam.write_bam(rows, view(s, d, TARGETS), path)
    return bam.read_bam(s, path)[0]


def _shown(x: DataFrame) -> DataFrame:
    return x.select("qname", "flag", "rname", "pos", "mapq", "cigar", F.coalesce("nm", F.lit(-1)).alias("nm"), F.col("ref_end").cast("long").alias("ref_end"), F.md5(F.col("seq").cast("binary")).alias("seq_md5"), F.length("qual").alias("qual_n"))


_BAM_SQL = WA + " SELECT qname, flag, rname, pos, mapq, cigar, coalesce(nm, -1) AS nm, CAST(pos + m1 + 50 + d1 AS BIGINT) AS ref_end, md5(substring(repeat('ACGTTGCA', 30), 1 + pos % 8, seq_len)) AS seq_md5, seq_len AS qual_n FROM a"


# --- PAF lines by contig ---
def _paf_by_contig(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "paf")
    text.write_paf(A.to_paf(view(s, d, ALN), view(s, d, TARGETS)), path)
    contigs = table(s, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").cast("string").alias("key"))
    return text.paf_lines(spans.read_keys(spans.contig_index(s, path), contigs)).select("qname", "qlen", "qstart", "qend", "strand", "tname", "tstart", "tend", "mapq")


# --- FASTQ of several lines a record ---
_LETTERS = "SELECT doc_id, regexp_replace(text, '[^A-Za-z]', ''{g}) AS seq, translate(regexp_replace(text, '[^A-Za-z]', ''{g}), 'aeiouns', '@+@+!IJ') AS qual FROM {documents}"


def _fastq(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "fastq")
    text.write_fastq(view(s, d, _LETTERS.replace("{g}", "")).select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(" more")).alias("header"), "seq", "qual"), path)
    return text.read_fastq(s, path).select("name", F.length("seq").alias("n"), *[F.md5(F.col(c).cast("binary")).alias(f"{c}_md5") for c in ("seq", "qual")])


# --- lines of databases ---
def _lines(x: DataFrame, order: list[str]) -> DataFrame:
    """(nth, value): the lines with their number."""
    keys = [*order, "value"]
    return totals_before(place(x.withColumn("one", F.lit(1).cast("long")), keys), keys, {"nth": "one"}).select("nth", "value")


def _database(s: SparkSession, d: str) -> dict[str, DataFrame]:
    """A sequence for each document, with its bytes' place in one file, through the text format."""
    docs = table(s, d, "documents")
    placed = totals_before(place(docs.select(F.col("doc_id").alias("seq_id"), F.col("n_chars").alias("seq_len"), (F.col("n_chars") + 20).alias("data_len")), ["seq_id"]), ["seq_id"], {"offset": "data_len"})
    seqs = placed.select("seq_id", F.concat_ws("/", F.lit("m"), F.expr("CAST(seq_id div 3 AS STRING)"), F.concat(F.lit("0_"), F.col("seq_len").cast("string"))).alias("header"), "seq_len", F.lit(0).alias("file_id"), "offset", "data_len")
    path = _folder(s, "database")
    text.write_rdb({"versions": s.createDataFrame([("0.2",)], "version string"), "files": s.createDataFrame([(0, "reads.fasta", "fasta")], "file_id long, path string, format string"), "seqs": seqs}, path)
    return text.read_rdb(s, path)


def _toxic(s: SparkSession, d: str) -> DataFrame:
    gone = table(s, d, "labels").where("toxic = 1").select("doc_id").distinct().join(table(s, d, "documents"), "doc_id")
    return gone.select(F.concat_ws("/", F.lit("m"), F.expr("CAST(doc_id div 3 AS STRING)"), F.concat(F.lit("0_"), F.col("n_chars").cast("string"))).alias("header")).distinct()


_DB = """WITH RECURSIVE s AS (SELECT doc_id, 'm/' || doc_id // 3 || '/0_' || n_chars AS header, n_chars AS len, CAST(sum(n_chars + 20) OVER (ORDER BY doc_id) - n_chars - 20 AS BIGINT) AS off, n_chars + 20 AS size FROM documents)"""
_DB_LINES = """,
n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS nth FROM k),
f AS (SELECT nth, len, len AS t, 0 AS block FROM n WHERE nth = 0 UNION ALL SELECT n.nth, n.len, CASE WHEN t >= {target} THEN n.len ELSE t + n.len END, CASE WHEN t >= {target} THEN block + 1 ELSE block END FROM f JOIN n ON n.nth = f.nth + 1),
b AS (SELECT block, min(nth) AS first, max(nth) + 1 AS stop, CAST(sum(len) AS BIGINT) AS bases FROM f GROUP BY block),
l AS (SELECT 0 AS a, 0 AS o, 0 AS z, concat_ws(chr(9), 'V', '0.2') AS value UNION ALL SELECT 1, 0, 0, concat_ws(chr(9), 'F', 0, 'reads.fasta', 'fasta')
  UNION ALL SELECT 2, nth, 0, concat_ws(chr(9), 'S', nth, header, len, 0, off, size) FROM n UNION ALL SELECT 2, stop - 1, 1, concat_ws(chr(9), 'B', block, first, stop, bases) FROM b{more})
SELECT row_number() OVER (ORDER BY a, o, z) - 1 AS nth, value FROM l"""
_LAST = " UNION ALL SELECT 2, stop, 2, concat_ws(chr(9), 'B', block + 1, stop, stop, 0) FROM b WHERE block = (SELECT max(block) FROM b) AND bases >= {target}"
_FILTERED = _DB + ", x AS (SELECT header FROM s WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)), k AS (SELECT * FROM s WHERE header NOT IN (SELECT header FROM x))" + _DB_LINES.format(target=20_000, more=_LAST.format(target=20_000))
_SAMPLED = _DB + """, g AS (SELECT *, 'm/' || doc_id // 3 AS name, sha256('5:' || header) AS o FROM s), h AS (SELECT name, min(o) AS o, arg_min(len, o) AS len FROM g GROUP BY name),
u AS (SELECT name, sum(len) OVER (ORDER BY o, name) - len AS before FROM h), k AS (SELECT s.* FROM s JOIN g USING (doc_id) WHERE g.name IN (SELECT name FROM u WHERE before < 600000))""" + _DB_LINES.format(target=50_000, more="")


# --- GFF lines ---
def _gff_text(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s, "gff")
    rows = view(s, d, _ROWS).select("id", F.concat_ws("\t", "seq", F.lit("src"), F.lit("region"), *[F.col(c).cast("string") for c in ("start", "end")], F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID="), F.col("id").cast("string"))).alias("value"))
    heads = s.createDataFrame([(-3, "##gff-version 3"), (-2, "# not kept"), (-1, "##of the orders")], "id long, value string")
    D.write_lines(heads.union(rows), ["id"], path)
    return _lines(I.subtract_lines(text.placed_lines(s, path), view(s, d, _MASKS), "masks.gff", 1000), I.LINE_ORDER)


_GFF = f"""WITH p AS ({_subtract_sql(False)}), l AS (SELECT 0 AS a, '' AS seq, k AS id, 0 AS s, v AS value FROM (VALUES (0, '##gff-version 3'), (1, '##of the orders')) t(k, v)
  UNION ALL SELECT 1, '', k, 0, v FROM (VALUES (0, '##mask masks.gff'), (1, '')) t(k, v) UNION ALL SELECT 2, seq, id, start, concat_ws(chr(9), seq, 'src', 'region', start, "end", '.', '+', '.', 'ID=' || id) FROM p)
SELECT row_number() OVER (ORDER BY a, seq, id, s) - 1 AS nth, value FROM l"""

# --- polishing files ---
def _split_paf(s: SparkSession, d: str) -> DataFrame:
    """(file, start, value): each line of the files that are written, by its byte."""
    paf, out = _folder(s, "paf"), _folder(s, "split")
    lines = A.to_paf(view(s, d, ALN), view(s, d, TARGETS))
    D.write_lines(lines.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in lines.columns]).alias("value")), ["value"], paf)
    lengths = view(s, d, TARGETS).select(F.col("rname").alias("name"), F.col("ref_len").cast("long").alias("len"))
    gone = table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").cast("string").alias("name"))
    files.write_files(X.split_paf_files(text.placed_lines(s, paf), lengths, 3000, 3, gone), out, *X.FILE_ORDER)
    found = spans.read_spans(spans.index_lines(s, out, None))
    return found.select(F.substring_index("file", "/", -1).alias("file"), "start", "value")


_SPLIT_PAF = WT.replace("WITH ", "WITH RECURSIVE ", 1) + """, p AS (SELECT concat_ws(chr(9), qname, seq_len + h1, CASE WHEN flag & 16 > 0 THEN h1 ELSE s1 END, CASE WHEN flag & 16 > 0 THEN seq_len + h1 - s1 ELSE seq_len END, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END, a.rname, ref_len, pos, pos + m1 + 50 + d1, m1 + 50 + d1 - coalesce(nm, 0), m1 + 50 + d1, mapq) AS line, qname, a.rname AS ctg, ref_len
  FROM a JOIN t ON a.rname = t.rname WHERE a.rname NOT IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 2)),
n AS (SELECT ctg, CAST(ref_len AS BIGINT) AS w, row_number() OVER (ORDER BY ctg) AS k FROM (SELECT DISTINCT ctg, ref_len FROM p))""" + _FOLD.format(cols="ctg", ncols="n.ctg", n="n", target=3000) + """, b AS (SELECT ctg, CAST(block AS BIGINT) AS block FROM f), wt AS (SELECT block, block + 1 AS k, count(*) AS w FROM p JOIN b USING (ctg) GROUP BY block)""" + _SPLIT.format(n="wt", n_shards=3) + """,
u AS (SELECT 'block.' || block || '.paf' AS file, ctg, line AS o, 0 AS i, line AS value FROM p JOIN b USING (ctg) UNION ALL SELECT 'block.' || block || '.reads', ctg, line, 0, qname FROM p JOIN b USING (ctg)
  UNION ALL SELECT 'block.' || block || '.ctg_id', ctg, '', 0, ctg FROM b UNION ALL SELECT 'shard.' || shard || '.block_ids', '', '', k, CAST(k - 1 AS VARCHAR) FROM z UNION ALL SELECT DISTINCT 'all_shard_ids', '', '', shard, CAST(shard AS VARCHAR) FROM z)
SELECT file, CAST(coalesce(sum(octet_length(encode(value)) + 1) OVER (PARTITION BY file ORDER BY ctg, o, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, value FROM u"""

# --- best partners in batches ---
def _rank_lines(s: SparkSession, d: str) -> DataFrame:
    """The hits come in three batches, the second one twice."""
    hits, best = view(s, d, _HITS), T.BestPartners(s, _folder(s, "partners"), 5)
    for k in (0, 1, 1, 2):
        best.add(f"part{k}", hits.where(f"q % 3 = {k}"))
    return _lines(T.rank_lines(T.contig_rank(best.best(), view(s, d, _PLACED))), ["t", "rank"])


_RANK_LINES = _TOP + f""", p AS ({plain(_PLACED)}), g AS (SELECT t, ctg, count(*) AS n, CAST(-sum(len) AS BIGINT) AS score FROM b JOIN p USING (q) GROUP BY t, ctg),
r AS (SELECT g.*, row_number() OVER (PARTITION BY t ORDER BY score, ctg) - 1 AS rank, CAST(EXISTS (SELECT 1 FROM p WHERE p.q = g.t AND p.ctg = g.ctg) AS INT) AS own FROM g)
SELECT row_number() OVER (ORDER BY t, rank) - 1 AS nth, concat_ws(' ', t, ctg, n, rank, score, own) AS value FROM r"""

QUERIES = {
    "track_rank_lines": (_rank_lines, _RANK_LINES),
    "split_paf": (_split_paf, _SPLIT_PAF),
    "fastq_records": (_fastq, f"WITH x AS ({plain(_LETTERS).replace('{g}', ", 'g'")}) SELECT 'd/' || doc_id AS name, CAST(length(seq) AS INT) AS n, md5(seq) AS seq_md5, md5(qual) AS qual_md5 FROM x"),
    "rdb_filtered_lines": (lambda s, d: _lines(D.filtered_database(_database(s, d), _toxic(s, d), 20_000), D.ORDER), _FILTERED),
    "rdb_subsampled_lines": (lambda s, d: _lines(D.subsampled_database(_database(s, d), 60_000, 10, seed=5, whole_molecules=True, block_bases=50_000), D.ORDER), _SAMPLED),
    "gff_subtract_text": (_gff_text, _GFF),
    "bam_round_trip": (lambda s, d: _shown(_bam(s, d)), _BAM_SQL),
    "bam_region": (lambda s, d: _shown(bam.bam_region(_bam(s, d), "7", 100, 260)), _BAM_SQL + " WHERE rname = '7' AND pos < 260 AND pos + m1 + 50 + d1 > 100"),
    "paf_lines_by_contig": (
        _paf_by_contig,
        WT + " SELECT qname, CAST(seq_len + h1 AS INT) AS qlen, CAST(CASE WHEN flag & 16 > 0 THEN h1 ELSE s1 END AS INT) AS qstart, CAST(CASE WHEN flag & 16 > 0 THEN seq_len + h1 - s1 ELSE seq_len END AS INT) AS qend, CASE WHEN flag & 16 > 0 THEN '-' ELSE '+' END AS strand, a.rname AS tname, CAST(pos AS INT) AS tstart, CAST(pos + m1 + 50 + d1 AS INT) AS tend, mapq"
        " FROM a JOIN t ON a.rname = t.rname WHERE a.rname IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 1)",
    ),
}
