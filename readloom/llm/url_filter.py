"""URL filters by hashed host-suffix and path-prefix expressions (DataFrame functions only).

Each URL is expanded into every expression that a rule of the given shapes could have: the last labels
of its host, and a prefix of its path, with a slash between (hosts have none). Expressions meet the rules in an equi-join on a short hash prefix;
then full digests are compared, and of the rules that fit the longest decides (then the longer host, then block).

Defined results: a null URL, or one without ://, has an empty host and path and fits no rule; rows that
repeat are returned as often as they come; without rules, or without a fitting one, the verdict is the
default; an empty table gives an empty result; other columns are ignored. Every label and every
character counts: neither hosts nor paths are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of the digest that are joined on.
SHORT = 8


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; rules: (host, path, action), hosts in lower case, action allow or block.

    The distinct pairs of label count and path length among the rules, two short lists of numbers, are brought to the
    driver: hosts have 127 labels and rule paths 2,048 characters at most, so they are bounded however many rules there are.
    """
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action")).dropna().distinct()
    rules = rules.withColumns({"rule": F.concat("r_host", "r_path"), "labels": F.size(F.split("r_host", r"\.")), "path_n": F.length("r_path")})
    shapes = sorted(map(tuple, rules.select("labels", "path_n").distinct().collect()))
    rules = rules.withColumn("digest", F.sha2(F.concat("r_host", F.lit("/"), "r_path"), 256)).select(F.substring("digest", 1, SHORT).alias("short"), F.col("digest").alias("r_digest"), "rule", F.struct(F.length("rule").alias("n"), F.length("r_host").alias("h"), (F.col("r_action") == "block").alias("b"), "rule", "r_action").alias("weight"))

    host, path = host_and_path("url")
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).groupBy("id", "url").agg(F.count("*").alias("times"))
    urls = urls.select("id", "url", "times", host.alias("host"), path.alias("path"))
    if not shapes:
        best = urls.withColumn("best", F.lit(None).cast("struct<rule:string,r_action:string>"))
    else:
        labels, lengths = (f"array({', '.join(map(str, x))})" for x in zip(*shapes, strict=True))
        forms = F.expr(f"array_distinct(transform(arrays_zip({labels}, {lengths}), s -> concat(substring_index(host, '.', -s.`0`), '/', substring(path, 1, s.`1`))))")
        spread = urls.withColumn("form", F.explode(forms)).withColumn("digest", F.sha2("form", 256)).withColumn("short", F.substring("digest", 1, SHORT))
        hits = spread.drop("form").join(rules, "short", "left")
        best = hits.groupBy("id", "url").agg(F.first("times").alias("times"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("digest") == F.col("r_digest"), F.col("weight"))).alias("best"))
    out = best.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_action", F.lit(default)).alias("verdict"), "times")
    return out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("_", "times")


#: The rules of the query: host, path, action.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in rules) + " AS t(host, path, action)")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark)).withColumnRenamed("id", "page_id")


_VALUES = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
ORACLE = rf"""
WITH r(rh, rp, action) AS (VALUES {_VALUES}),
t AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
u AS (SELECT k, page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM t),
f AS (SELECT u.k, r.rh || r.rp AS rule, action, row_number() OVER (PARTITION BY u.k ORDER BY length(r.rh || r.rp) DESC, length(r.rh) DESC, action DESC) AS n
      FROM u JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN f ON u.k = f.k AND f.n = 1
"""
