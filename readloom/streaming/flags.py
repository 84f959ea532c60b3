"""Incremental merge of read flags: bit-or is associative, so files of flags can come in as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readloom.operators.overlaps import merge_flags


def merged_flags(spark: SparkSession, path: str) -> DataFrame:
    """Streaming frame (name, flags) over Parquet files of flags under path; write it in complete or update mode."""
    return merge_flags(spark.readStream.schema("name string, flags int").parquet(path))
