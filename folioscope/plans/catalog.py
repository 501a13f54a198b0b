"""Where operators register: name -> function(spark, sf_dir), and name -> SQL over the same tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def spread(df: DataFrame, rows: int, each: int, *keys: str) -> DataFrame:
    """``df`` of ``rows`` rows dealt out by ``keys``, about ``each`` of them to a task: for work that makes much of small rows, where
    neither a table's few row groups nor the bytes of a shuffle tell how much a task will hold."""
    return df.repartition(max(1, -(-rows // each)), *keys)


def scratch(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-written-", dir="/tmp")  # Spark runs in this process: tests
    return f"{folder}/fixed-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the cluster's shared checkpoint folder: fixed rows, no lineage."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
