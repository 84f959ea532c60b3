"""What the training-data operators share: shared folder, tables in it, names of columns."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.shipping import ship as ship

#: Words are runs of anything but ASCII white space; bytes.split() parts at exactly these six.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
_tables: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a temporary one in local mode, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Cuts the lineage: df as a written table in the shared folder, which outlives any executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes tables that materialize() wrote, once all that reads them is written itself."""
    for table in tables:
        path = _tables.pop(table, None)
        if path:
            spark = table.sparkSession
            name = spark._jvm.org.apache.hadoop.fs.Path(path)
            name.getFileSystem(spark._jsc.hadoopConfiguration()).delete(name, True)


def text_or_empty(col: str = "text") -> "F.Column":
    return F.coalesce(F.col(col), F.lit(""))


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a vocabulary file: itself if printable, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}
