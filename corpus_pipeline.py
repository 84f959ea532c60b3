"""A training corpus from raw documents: rules, copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as a
Parquet table in the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from readloom.llm.common import discard, documents, materialize
from readloom.llm.token_files import vocabulary

#: Of the tokens that come in, 19 of 20 are asked for, each document once at most.
MIX = {"share": (19, 20), "epochs": 1}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go.

    A null or empty text has too few words and goes; rows that repeat are judged alike; rows that stay keep all their
    columns, whatever their names; no rows in, no rows out.
    """
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays.

    Null counts as the empty text; a null id never wins against an id; rows that repeat id and text stay or go together, and
    so do those without an id; columns stay as they are; no rows in, no rows out.
    """
    return exact_dedup.drop_exact_duplicates(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links reach from each other, the one with the smallest id stays.

    Texts without a word are linked with nothing and stay; rows are told apart by id and text, so of several with one id only
    those under a smaller one go; a row without an id goes if its component has an id; columns stay as they are; no rows in, no
    rows out.
    """
    return jaccard_join.drop_near_duplicates(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token budget of each domain, language and source is met. As MIX asks for nearly all tokens of documents that come once at most, few leaves are cut, and the shares stay close to what came in.

    Null texts have no tokens, null languages and sources are the empty one; rows that repeat are taken or left together;
    columns stay as they are; no rows in, no rows out.
    """
    return mixing.mixed_documents(docs, **MIX)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole text, and the text that they decode to, as digests.

    A null text is the empty one and has no ids; every row gives a row, those that repeat too; the columns are doc_id,
    n_tokens, ids_sha256 and decoded_sha256; no rows in, no rows out.
    """
    return bpe.bpe_digests(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: The last stage's merges can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
