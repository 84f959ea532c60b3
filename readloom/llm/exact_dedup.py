"""Exact deduplication by content-defined chunk recipes (DataFrame functions only).

A text is cut where its own content says so, so equal texts have equal chunks. A chunk's identifier
is its SHA-256, verified: every distinct chunk moves once through a shuffle to find digests that
stand for several contents, and in such a case the contents take the digest's place. A document is
then its ordered list of identifiers, and only those lists are compared; long texts don't move again.

Defined results: a null text counts as empty, all empty texts are one group; a null id never wins
against an id; rows that repeat both id and text are one document listed twice and share a verdict;
an empty table gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import documents, materialize, text_or_empty

#: Chunks of at least MIN characters end at the first boundary, and at MAX at the latest.
CHUNK_MIN, CHUNK_MAX = 256, 4096
BOUNDARY = r"[a-mA-M][n-zN-Z,;][\s.]"


def chunk_pattern(least: int = CHUNK_MIN, most: int = CHUNK_MAX, boundary: str = BOUNDARY) -> str:
    """Its matches, put together, are the whole text: the last branch takes what has no boundary, and the tail."""
    return rf"(?s).{{{least},{most - 1}}}?(?:(?<={boundary})|\z)|.{{1,{most}}}"


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = CHUNK_MIN, most: int = CHUNK_MAX, digest_bits: int = 256) -> DataFrame:
    """(id, recipe, text_sha256): the ordered verified identifiers of each row's chunks. Fewer bits of a digest (a multiple of 8) are for tests."""
    text = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("body"))
    chunks = F.regexp_extract_all("body", F.lit(chunk_pattern(least, most)), F.lit(0))
    digest = lambda c: F.unhex(F.sha2(c, 256) if digest_bits == 256 else F.substring(F.sha2(c, 256), 1, digest_bits // 4))
    moved = text.select(F.explode(chunks).alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk").distinct()
    shared = materialize(moved.groupBy("digest").count().where("count > 1").select("digest"), "chunk-collisions")
    own = text.select("id", F.transform(chunks, digest).alias("recipe"), F.sha2("body", 256).alias("text_sha256"), "body")
    if shared.isEmpty():
        return own.drop("body")
    # one digest, several contents: those contents stand for themselves
    hit = own.select(F.col("id").alias("hit_id"), F.col("text_sha256").alias("hit_sha"), F.explode("recipe").alias("digest")).join(shared, "digest", "left_semi").select("hit_id", "hit_sha").distinct().withColumn("hit", F.lit(True))
    spelt = F.transform(chunks, lambda c: F.encode(c, "UTF-8"))
    met = own.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("text_sha256") == F.col("hit_sha")), "left")
    return met.select("id", F.when(F.col("hit"), spelt).otherwise(F.col("recipe")).alias("recipe"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = CHUNK_MIN, most: int = CHUNK_MAX, digest_bits: int = 256) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, n_chunks) of every row; of equal texts the largest id stays."""
    rows = recipes(docs, id_col, text_col, least, most, digest_bits)
    groups = rows.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    # A group of many copies is a hot key; joined on one more key, both sides are shuffled for the join alone, and Spark may split it.
    keyed = lambda d: d.withColumn("list_hash", F.xxhash64("recipe"))
    out = keyed(rows).join(keyed(groups), ["recipe", "list_hash"])
    return out.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text stays under a larger doc_id."""
    gone = exact_dedup(docs).where("NOT kept").select(F.col("id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")).distinct()
    sha = F.sha2(text_or_empty(), 256)
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.gone_id) & (sha == gone.gone_sha), "left_anti")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id").drop("n_chunks")


ORACLE = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
