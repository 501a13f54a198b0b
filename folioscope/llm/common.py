"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ASCII white space of the word rule, and the ASCII letters.
SPACE = "\x20\x09-\x0d"
WORD = f"[^{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; one of our own only where none is set and Spark runs in this process (tests)."""
    held = spark.conf.get("spark.checkpoint.dir", None)
    if held is None:
        jsc = spark.sparkContext._jsc.sc()
        now = jsc.getCheckpointDir()
        if now.isDefined():
            return now.get()
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        held = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(held)
    return held


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: lineage ends, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts both sides and broadcasts neither. Spark sizes an exploded table, and one read back from
    Parquet, by the bytes of its files, which can be a hundredth of what its rows take in the driver."""
    return df.hint("merge")


def smallest(df: DataFrame, by: str, key: str, n: int, salts: int = 8) -> DataFrame:
    """The ``n`` rows of each ``by`` with the smallest ``key``; first per salt, so that no group meets whole in a task."""
    salt = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(salts))
    few = df.withColumn("_salt", salt)
    for part in ([by, "_salt"], [by]):
        place = F.row_number().over(Window.partitionBy(*part).orderBy(key))
        few = few.withColumn("_place", place).filter(F.col("_place") <= n)
    return few.drop("_salt", "_place")


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that stand in no column of ``df``, in any case."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def columns(df: DataFrame) -> list[Column]:
    """All columns of ``df``, dotted names too."""
    return [F.col(f"`{c}`") for c in df.columns]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def only(df: DataFrame, *names: str) -> DataFrame:
    """Take the named columns; further columns never reach an operator's own names."""
    return df.select(*[F.col(f"`{n}`") for n in names])
