"""Sinks that merge micro-batches into tables: deliveries, profiles, and the retry of work in flight.

Every batch writes its own part, named by its number, and replaces it when it runs again; so a batch that is replayed
after a crash leaves the tables as they were. Readers put the parts together by key. Use the functions with
``writeStream.foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.plans.catalog import query, scratch, table
from folioscope.streaming.delivery import BODY, TOLERANCE, routed

Batch = Callable[[DataFrame, int], None]


def _put(rows: DataFrame, folder: str, batch_id: int, *by: str) -> None:
    """Write a batch's part of a table; what the batch wrote before is replaced."""
    rows = rows.withColumn("batch_id", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", *by).parquet(folder)


def _table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A table of parts, empty before its first batch."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """The delivered rows (event_id, ts, status, batch_id, day) of all batches; `accept` at most once per event_id."""
    return _table(spark, f"{folder}/deliveries", "event_id long, ts timestamp, status string, batch_id long, day date")


def deliver(folder: str) -> Batch:
    """Route a batch of rows(event_id, ts, header, age, size, signed): the first rule that speaks against each, or accept.

    An id is a duplicate if an earlier batch accepted it or the batch itself does so with an earlier time. A delivery that is
    sent again has its old time, so only the days of the batch are read from the table. A null id is never a duplicate.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = routed(batch.withColumn("seen", F.lit(False))).withColumn("day", F.to_date("ts"))
        days = [r["day"] for r in rows.select("day").distinct().collect()]  # as many as days in a batch
        held = deliveries(spark, folder).filter((F.col("batch_id") != batch_id) & (F.col("status") == "accept") & F.col("day").isin(days))
        held = held.select("event_id", F.lit(True).alias("held"))
        first = Window.partitionBy("event_id", "status").orderBy("ts")
        rows = rows.join(held, "event_id", "left").withColumn("k", F.row_number().over(first))
        again = F.col("event_id").isNotNull() & ((F.col("k") > 1) | F.coalesce("held", F.lit(False)))
        status = F.when((F.col("status") == "accept") & again, "duplicate").otherwise(F.col("status"))
        _put(rows.select("event_id", "ts", status.alias("status"), "day"), f"{folder}/deliveries", batch_id, "day")

    return merge


def profile_parts(folder: str) -> Batch:
    """Add a batch of rows(file, key) to a profile, as counts by key and file."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        _put(batch.groupBy("key", "file").agg(F.count("*").alias("n")), f"{folder}/profile", batch_id)

    return merge


def finalised(spark: SparkSession, folder: str) -> DataFrame:
    """Key, n, files of everything added so far, on demand; a file seen by several batches counts once."""
    rows = _table(spark, f"{folder}/profile", "key string, file long, n long, batch_id long").groupBy("key", "file").agg(F.sum("n").alias("n"))
    return rows.groupBy("key").agg(F.sum("n").alias("n"), F.count("file").alias("files"))


def compacted(spark: SparkSession, folder: str, into: str) -> None:
    """The parts of a profile as one in a new folder; its batch is the last one's, so that the stream can go on there."""
    parts = _table(spark, f"{folder}/profile", "key string, file long, n long, batch_id long")
    last = parts.agg(F.max("batch_id")).first()[0]
    if last is not None:
        _put(parts.groupBy("key", "file").agg(F.sum("n").alias("n")), f"{into}/profile", last)


def pending(spark: SparkSession, manifest: DataFrame, folder: str, most: int = 3) -> DataFrame:
    """The sources of manifest(source, ...) that have no result and have not failed ``most`` times."""
    done = results(spark, folder).select("source")
    return manifest.join(done, "source", "left_anti").join(failed(spark, folder, most).select("source"), "source", "left_anti")


def results(spark: SparkSession, folder: str) -> DataFrame:
    tried = _table(spark, f"{folder}/tries", "source long, result string, error string, batch_id long")
    return tried.filter("error is null").groupBy("source").agg(F.min_by("result", "batch_id").alias("result"))


def failed(spark: SparkSession, folder: str, most: int = 3) -> DataFrame:
    """The poison table: source, tries, the last error of what failed ``most`` times and never succeeded."""
    tried = _table(spark, f"{folder}/tries", "source long, result string, error string, batch_id long")
    sums = tried.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("good"), F.count("*").alias("tries"), F.max_by("error", "batch_id").alias("error"))
    return sums.filter((F.col("good") == 0) & (F.col("tries") >= most)).select("source", "tries", "error")


def attempt(folder: str, work: Callable[[object], str], manifest: Callable[[SparkSession], DataFrame], most: int = 3) -> Batch:
    """Each batch tries what is pending of the manifest, ``work`` being given the content of each source.

    An exception of ``work`` is that source's failure and stops no other; a lost executor or a crash loses no more than the
    batch, which Spark runs again. After ``most`` failed batches a source is poison and left out.
    """

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for source, content in zip(frame["source"], frame["content"], strict=True):
                try:
                    out.append((source, work(content), None))
                except Exception as e:  # the file's own fault, kept as a row
                    out.append((source, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["source", "result", "error"])

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        others = _table(spark, f"{folder}/tries", "source long, result string, error string, batch_id long").filter(F.col("batch_id") != batch_id)
        sums = others.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("good"), F.count("*").alias("tries"))
        settled = sums.filter((F.col("good") > 0) | (F.col("tries") >= most)).select("source")
        rows = manifest(spark).select("source", "content").join(settled, "source", "left_anti")
        _put(rows.mapInPandas(tried, "source long, result string, error string"), f"{folder}/tries", batch_id)

    return merge


def _replayed(spark: SparkSession, sink: Batch, batches: list[DataFrame]) -> None:
    """Run batches as a stream would that crashes after the second: that one comes twice."""
    for n, batch in enumerate(batches):
        sink(batch, n)
        if n == 1:
            sink(batch, n)


_SENT = "event_id % 700 - 350"
_DELIVERED = f"""event_id, ts, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'x' ELSE 'v1=1' END AS header, CAST({_SENT} AS INT) AS age, CAST(value * 20000 AS BIGINT) AS size, event_id % 17 <> 0 AS signed"""


@query(f"""WITH d AS (SELECT {_DELIVERED} FROM events), s AS (SELECT *, CASE WHEN header IS NULL THEN 'no header' WHEN header NOT LIKE '%v1=%' THEN 'malformed' WHEN abs(age) > {TOLERANCE} THEN 'out of tolerance'
WHEN size > {BODY} THEN 'too large' WHEN NOT signed THEN 'mismatch' ELSE 'accept' END AS status FROM d), twice AS (SELECT *, 0 AS b FROM s WHERE event_id % 2 = 0 UNION ALL SELECT *, 1 FROM s WHERE event_id % 3 = 0 UNION ALL SELECT *, 2 FROM s WHERE event_id % 2 = 1)
SELECT event_id, b AS batch_id, CASE WHEN status = 'accept' AND row_number() OVER (PARTITION BY event_id ORDER BY b) > 1 THEN 'duplicate' ELSE status END AS status FROM twice""")
def j4_delivery_sinks(spark, sf_dir):
    """Events delivered in three batches, some of them again in the second; the second is replayed."""
    rows, folder = table(spark, sf_dir, "events").selectExpr(*_split(_DELIVERED)), scratch(spark)
    _replayed(spark, deliver(folder), [rows.filter("event_id % 2 = 0"), rows.filter("event_id % 3 = 0"), rows.filter("event_id % 2 = 1")])
    return deliveries(spark, folder).select("event_id", "batch_id", "status")


def _split(columns: str) -> list[str]:
    """Columns of a list none of whose calls hold commas."""
    return [c.strip() for c in columns.split(",")]


@query("SELECT event_type AS key, count(*) AS n, count(DISTINCT user_id) AS files FROM events GROUP BY event_type")
def j7_incremental_profile(spark, sf_dir):
    """The profile of events added in three batches, the second replayed."""
    rows, folder = table(spark, sf_dir, "events").selectExpr("event_id", "event_type AS key", "user_id AS file"), scratch(spark)
    _replayed(spark, profile_parts(folder), [rows.filter(f"event_id % 3 = {b}") for b in range(3)])
    return finalised(spark, folder)


def _half(content: str) -> str:
    if len(content) % 7 == 0:
        raise ValueError("odd length")
    return str(len(content) // 2)


@query("""SELECT doc_id AS source, CASE WHEN length(text) % 7 <> 0 THEN CAST(length(text) // 2 AS VARCHAR) END AS result, CASE WHEN length(text) % 7 = 0 THEN 3 ELSE 0 END AS tries,
CASE WHEN length(text) % 7 = 0 THEN 'ValueError: odd length' END AS error FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL""")
def j11_retry(spark, sf_dir):
    """Every document worked on until it has a result or has failed three times; five batches, the second replayed."""
    folder = scratch(spark)
    manifest = table(spark, sf_dir, "documents").filter("text is not null and doc_id is not null").select(F.col("doc_id").alias("source"), F.col("text").alias("content"))
    _replayed(spark, attempt(folder, _half, partial(_same, manifest)), [manifest] * 5)
    return results(spark, folder).join(failed(spark, folder), "source", "full").select("source", "result", F.coalesce("tries", F.lit(0)).alias("tries"), "error")


def _same(df: DataFrame, _: SparkSession) -> DataFrame:
    return df
