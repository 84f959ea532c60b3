"""Bindings of the driver's tables to the record types, in SQL that both engines read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages")

#: Overlaps shaped from line items, integer arithmetic only.
OVL = """SELECT CAST(a AS STRING) AS a_name, CAST(b AS STRING) AS b_name, CAST(-(q * 100 + ln) AS BIGINT) AS score, 100.0 - 100.0 * d AS idt, ok % 5 = 0 AS a_rev,
  CAST(a_start AS INT) AS a_start, CAST(CASE WHEN ln % 3 = 1 THEN 1000 + (a % 7) * 100 ELSE a_start + 200 + ok % 200 END AS INT) AS a_end, CAST(1000 + (a % 7) * 100 AS INT) AS a_len,
  ok % 3 = 0 AS b_rev, CAST(b_start AS INT) AS b_start, CAST(CASE WHEN ok % 4 = 1 THEN 1000 + (b % 7) * 100 ELSE b_start + 200 + ln * 30 END AS INT) AS b_end, CAST(1000 + (b % 7) * 100 AS INT) AS b_len,
  CASE WHEN ln = 7 AND ok % 10 = 3 THEN 'contains' WHEN ok % 607 = 0 THEN 'contained' WHEN ok % 613 = 0 THEN 'c' WHEN ok % 617 = 0 THEN 'C' WHEN ok % 37 = 0 THEN 'none' WHEN ok % 41 = 0 THEN '?' WHEN ok % 43 = 0 THEN 'overlap' WHEN rf = 'R' THEN 'u' WHEN a_start = 0 THEN '5' ELSE '3' END AS tag
FROM (SELECT l_partkey AS a, (l_orderkey * 7 + l_linenumber * 13) % (SELECT max(p_partkey) FROM {part}) + 1 AS b, l_orderkey AS ok, l_linenumber AS ln, CAST(l_quantity AS BIGINT) AS q, l_discount AS d, l_returnflag AS rf,
  CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE (l_suppkey * 31 + l_orderkey) % 600 END AS a_start, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE (l_orderkey * 17) % 600 END AS b_start FROM {lineitem}) t"""

#: Alignments: clips, matches, an insertion and a deletion.
ALN = """SELECT CAST(l_orderkey AS STRING) AS qname, CAST(l_suppkey % 4 AS STRING) AS file, CAST(CASE WHEN l_linenumber = 5 THEN 256 WHEN l_orderkey % 2 = 0 THEN 16 ELSE 0 END AS INT) AS flag, CAST(l_suppkey % 25 AS STRING) AS rname,
  CAST(l_partkey % 500 AS INT) AS pos, CAST(l_linenumber * 9 AS INT) AS mapq, CAST(l_linenumber + 2 AS BIGINT) AS s1, CAST(50 + l_orderkey % 40 AS BIGINT) AS m1, CAST(1 + l_suppkey % 3 AS BIGINT) AS d1, CASE WHEN l_orderkey % 4 = 0 THEN 3 ELSE 0 END AS h1,
  concat(CAST(l_linenumber + 2 AS STRING), 'S', CAST(50 + l_orderkey % 40 AS STRING), 'M2I30M', CAST(1 + l_suppkey % 3 AS STRING), 'D20M', CASE WHEN l_orderkey % 4 = 0 THEN '3H' ELSE '' END) AS cigar,
  CAST(l_linenumber + 54 + 50 + l_orderkey % 40 AS INT) AS seq_len, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_linenumber + 3 AS INT) END AS nm FROM {lineitem}"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of sql, with tables in braces."""
    named = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **named)


def plain(sql: str) -> str:
    """The same for DuckDB, where tables are views."""
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql
