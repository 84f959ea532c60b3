"""Queries that write the given tables in a text format of the field and read them back, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.operators import databases as D
from readloom.operators import reports as R
from readloom.operators.running import shared_dir
from readloom.plans.overlap_queries import QUERIES as OVERLAPS
from readloom.plans.read_queries import _EDGES_ALL, _SEQ, ALN, OVL, WA, WS, plain, table, view
from readloom.sources import text


def _through(s: SparkSession, name: str, write: Callable[[str], None], read: Callable[[str], DataFrame]) -> DataFrame:
    path = f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"
    write(path)
    return read(path)


def _as_lines(s: SparkSession, name: str, lines: DataFrame, read: Callable[[str], DataFrame]) -> DataFrame:
    """lines: value."""
    return _through(s, name, lines.select("value").write.text, read)


def _tabs(*columns: str) -> "F.Column":
    return F.concat_ws("\t", *[F.expr(f"CAST({c} AS STRING)") for c in columns]).alias("value")


_CONTIGS = "SELECT CAST(s_suppkey AS STRING) AS name, CAST(length(s_name) * 100 + s_nationkey AS BIGINT) AS len FROM {supplier}"
_HEADERS = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN concat('m', CAST(o_custkey AS STRING), '/', CAST(o_orderkey AS STRING)) ELSE concat('m', CAST(o_custkey AS STRING), '/', CAST(o_orderkey AS STRING), '/0_', CAST(o_orderkey % 900 AS STRING)) END AS header, concat('block.', CAST(o_custkey AS STRING), '.', CAST(o_orderkey % 7 AS STRING), '.reads') AS file FROM {orders}"


def _sam(s: SparkSession, d: str) -> DataFrame:
    x = view(s, d, ALN)
    heads = table(s, d, "nation").select(F.concat(F.lit("@SQ\tSN:"), F.col("n_nationkey").cast("string"), F.lit("\tLN:"), (F.col("n_nationkey") + 900).cast("string")).alias("value"))
    tag = F.when(F.col("nm").isNotNull(), F.concat(F.lit("NM:i:"), F.col("nm").cast("string")))
    line = F.concat_ws("\t", *[F.expr(f"CAST({c} AS STRING)") for c in ("qname", "flag", "rname", "pos + 1", "mapq", "cigar", "'*'", "0", "0", "repeat('A', seq_len)", "'*'")], tag)
    return _as_lines(s, "sam", heads.union(x.select(line)), lambda p: text.read_sam(s, p)[0]).select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq_len", F.coalesce("nm", F.lit(-1)).alias("nm"), F.size("tags").alias("n_tags"))


def _index_lines(s: SparkSession, d: str) -> DataFrame:
    return _through(s, "index", lambda p: text.write_pile_index(OVERLAPS["m4_pile_index"][0](s, d), p), lambda p: text.read_pile_index(s, p))


def _phase_rows(s: SparkSession, d: str) -> DataFrame:
    """Lines between tabs as they are written, one column."""
    rows = view(s, d, _EDGES_ALL).select(F.col("a").alias("v"), F.col("b").alias("label"), F.expr("CAST(a % 3 - 1 AS INT) AS phase"), F.expr("CAST(a % 100 AS DOUBLE) / 128 AS freq"), F.concat(F.lit("r"), F.col("a").cast("string")).alias("name"))
    return _through(s, "phases", lambda p: text.write_phases(rows, p), s.read.text)


QUERIES = {
    "overlap_lines": (
        lambda s, d: _through(s, "m4", lambda p: text.write_overlaps(view(s, d, OVL), p, trailer=True), lambda p: text.read_overlaps(s, p)).withColumn("idt", F.round("idt", 3)),
        f"SELECT a_name, b_name, score, round(idt, 3) AS idt, a_rev, a_start, a_end, a_len, b_rev, b_start, b_end, b_len, tag FROM ({plain(OVL)})",
    ),
    "pile_index_lines": (_index_lines, f"SELECT n, pos, bytes FROM ({OVERLAPS['m4_pile_index'][1]})"),
    "fasta_records": (
        lambda s, d: _through(s, "fasta", lambda p: text.write_fasta(view(s, d, _SEQ).select(F.concat_ws(" ", F.col("key").cast("string"), F.lit("more")).alias("name"), F.regexp_replace("seq", r"[^A-Za-z]", "").alias("seq")), p), lambda p: text.read_fasta(s, p)).select("name", F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("h")),
        WS + ", l AS (SELECT CAST(key AS VARCHAR) AS name, regexp_replace(seq, '[^A-Za-z]', '', 'g') AS s FROM q) SELECT name, CAST(length(s) AS INT) AS n, md5(s) AS h FROM l",
    ),
    "sam_records": (_sam, WA + " SELECT qname, flag, rname, pos, mapq, cigar, seq_len, coalesce(nm, -1) AS nm, CASE WHEN nm IS NULL THEN 0 ELSE 1 END AS n_tags FROM a"),
    "gff_records": (
        lambda s, d: _as_lines(s, "gff", table(s, d, "orders").select(_tabs("o_custkey % 40", "'src'", "'region'", "o_orderkey + 1", "o_orderkey + 9", "'.'", "'+'", "'.'", "concat('cov=1,', o_custkey % 9, ',', o_custkey % 9 + 2, ';cov2=', o_custkey % 9, '.5,0.25;gaps=0,', o_orderkey % 3)")), lambda p: text.gff_coverage(text.read_gff(s, p))),
        "SELECT CAST(o_custkey % 40 AS VARCHAR) AS seq, CAST(o_orderkey AS INT) AS start, CAST(o_orderkey + 9 AS INT) AS \"end\", '+' AS strand, 1.0::DOUBLE AS cov_min, CAST(o_custkey % 9 AS DOUBLE) AS cov_median, CAST(o_custkey % 9 + 2 AS DOUBLE) AS cov_max, o_custkey % 9 + 0.5::DOUBLE AS cov_mean, 0.25::DOUBLE AS cov_sd, 0.0::DOUBLE AS n_gaps, CAST(o_orderkey % 3 AS DOUBLE) AS tot_gaps FROM orders",
    ),
    "contig_lengths": (lambda s, d: _as_lines(s, "fai", view(s, d, _CONTIGS).select(_tabs("name", "len", "0", "80", "81")), lambda p: text.read_lengths(s, p)), plain(_CONTIGS)),
    "read_contig_lines": (
        lambda s, d: _as_lines(s, "read2ctg", table(s, d, "lineitem").select(F.concat_ws(" ", F.lit("p"), F.col("l_partkey").cast("string"), F.lit("o"), (F.col("l_suppkey") % 25).cast("string")).alias("value")), lambda p: text.read_read_contigs(s, p)),
        "SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS rid, CAST(l_suppkey % 25 AS VARCHAR) AS ctg FROM lineitem",
    ),
    "phase_lines": (
        lambda s, d: _as_lines(s, "phased", table(s, d, "supplier").select(F.concat_ws(" ", F.lit("r"), *[F.expr(f"CAST({c} AS STRING)") for c in ("s_nationkey", "s_suppkey % 4", "s_suppkey % 2")], F.lit("x"), F.lit("y"), F.col("s_suppkey").cast("string")).alias("value")), lambda p: text.read_phases(s, p)),
        "SELECT CAST(s_suppkey AS VARCHAR) AS oid, CAST(s_nationkey AS VARCHAR) AS ctg, CAST(s_suppkey % 4 AS INT) AS block, CAST(s_suppkey % 2 AS INT) AS phase FROM supplier",
    ),
    "phased_reads": (_phase_rows, f"SELECT concat_ws(chr(9), CASE WHEN a % 3 = 0 THEN -1 ELSE a END, CASE WHEN a % 3 = 0 THEN -1 ELSE b END, a % 3 - 1, CAST(a % 100 AS DOUBLE) / 128, 'r' || a) AS value FROM ({plain(_EDGES_ALL)})"),
    "name_list": (lambda s, d: _as_lines(s, "names", table(s, d, "customer").select(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")).alias("value")), lambda p: text.read_names(s, p)), "SELECT DISTINCT c_mktsegment AS name FROM customer"),
    "movie_parts": (
        lambda s, d: view(s, d, _HEADERS).select("o_orderkey", R.movie_parts(F.col("header")).alias("m"), R.block_of_file(F.col("file")).alias("block"), D.molecule().alias("molecule")).select("o_orderkey", "m.movie", "m.zmw", "m.span", "block", "molecule"),
        f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN split_part(header, '/', 1) END AS movie, CASE WHEN o_orderkey % 5 > 0 THEN split_part(header, '/', 2) END AS zmw, CASE WHEN o_orderkey % 5 > 0 THEN split_part(header, '/', 3) END AS span, CAST(o_orderkey % 7 AS INT) AS block, CASE WHEN o_orderkey % 5 > 0 THEN split_part(header, '/', 1) || '/' || split_part(header, '/', 2) ELSE header END AS molecule FROM ({plain(_HEADERS)})",
    ),
    "round2": (lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", R.round2(F.expr("l_partkey % 1000 / 8")).alias("x")), "SELECT l_orderkey, l_linenumber, round(CAST(l_partkey % 1000 AS DOUBLE) / 8, 2) AS x FROM lineitem"),
}
