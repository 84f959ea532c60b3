"""Running sums over whole tables, and where lineage is cut.

A table is dealt out by ranges of its order; sums run within a range, and a small table with one row a
range gives what came before it. No task sorts more than its range.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Name of the column that place() adds.
PART = "_part"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one in local mode, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: what it was made from isn't computed again, and Spark knows its size."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def release(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for table in tables:
        path = _written.pop(table, None)
        if path:
            spark = table.sparkSession
            name = spark._jvm.org.apache.hadoop.fs.Path(path)
            name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


def keep(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, its partitions and their order as they are; spark.cleaner.referenceTracking.cleanCheckpoints has Spark remove it."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def place(df: DataFrame, keys: list[str]) -> DataFrame:
    """df in ranges of the keys and sorted within them, with the number of the range; checkpointed, so that the ranges stay."""
    return keep(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(PART, F.spark_partition_id()))


def totals_before(placed: DataFrame, keys: list[str], sums: Mapping[str, str]) -> DataFrame:
    """placed with, for each new column, the sum of a column over all earlier rows; nulls add nothing."""
    parts = placed.groupBy(PART).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_own_{out}") for out, c in sums.items()])
    earlier = W.orderBy(PART).rowsBetween(W.unboundedPreceding, -1)  # a row a range
    parts = parts.select(PART, *[F.coalesce(F.sum(f"_own_{out}").over(earlier), F.lit(0)).alias(f"_own_{out}") for out in sums])
    within = W.partitionBy(PART).orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    rows = placed.withColumns({out: F.coalesce(F.sum(c).over(within), F.lit(0)) for out, c in sums.items()})
    return rows.join(F.broadcast(parts), PART).withColumns({out: F.col(out) + F.col(f"_own_{out}") for out in sums}).drop(*[f"_own_{out}" for out in sums])


def value_before(placed: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """placed with the column's value in the row before, null in the first."""
    last = placed.groupBy(PART).agg(F.max_by(F.struct(column), F.struct(*keys)).alias("_last"))
    last = last.select(PART, F.lag("_last").over(W.orderBy(PART)).alias("_last"))  # a row a range
    within = W.partitionBy(PART).orderBy(*keys)
    rows = placed.withColumns({out: F.lag(column).over(within), "_nth": F.row_number().over(within)})
    return rows.join(F.broadcast(last), PART).withColumn(out, F.when(F.col("_nth") == 1, F.col(f"_last.{column}")).otherwise(F.col(out))).drop("_last", "_nth")
