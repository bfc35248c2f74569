"""A folder that the driver and all executors share, for files that a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode, where it may be unset, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="tessera-scratch-"))
    return _own[0]


def path(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/tessera/{name}-{uuid.uuid4().hex}"


def saved(rows: DataFrame, name: str) -> DataFrame:
    """The rows, computed once and read from a scratch folder from now on."""
    spark = rows.sparkSession
    to = path(spark, name)
    rows.write.parquet(to)
    return spark.read.schema(rows.schema).parquet(to)
