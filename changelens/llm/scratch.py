"""Written intermediates in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Folders made for sessions without spark.checkpoint.dir, by application.
_MADE: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; in local mode, below a temporary folder where that is unset.

    On a cluster the folder must be shared by all executors, so there an unset one is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _MADE:
            _MADE[app] = tempfile.mkdtemp(prefix="changelens-")
        base = _MADE[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def named(column: str) -> str:
    """A column's name as Spark reads it, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """df as a table in shared storage: lineage is cut, and a lost executor costs only its own tasks."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """This package for the session's Python workers, once; they need no copy of their own.

    The driver packs it and Spark's file server hands it out, so nothing is read from the driver's folder by others.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    path = f"{tempfile.mkdtemp(prefix='changelens-')}/changelens.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for module in sorted((root / "changelens").rglob("*.py")):
            archive.write(module, module.relative_to(root))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
