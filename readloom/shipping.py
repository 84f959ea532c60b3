"""The package on executors that have no copy of it."""

from __future__ import annotations

import tempfile
from pathlib import Path
from zipfile import ZipFile

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: Spark serves the driver's archive of it to every executor."""
    context = spark.sparkContext
    if context.applicationId in _shipped or not _PACKAGE.is_dir():  # within an archive, Spark has it already
        return
    archive = Path(tempfile.mkdtemp(prefix="spark-code-")) / f"{_PACKAGE.name}.zip"
    with ZipFile(archive, "w") as z:
        for file in sorted(_PACKAGE.rglob("*.py")):
            z.write(file, file.relative_to(_PACKAGE.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
