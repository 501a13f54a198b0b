"""Approximate nearest neighbours over balanced posting lists.

Centroids are fitted by k-means on a bounded sample (at most ``sample_rows``, smallest hash first); every row is
indexed. A vector goes to its nearest centroid and, near a boundary, to each other one within ``near`` times that
distance. Centroids are found through an in-memory graph: each is tied to its nearest centroids and a best-first walk
settles them nearest first. A query reads the lists whose centroid lies within ``prune`` times its nearest one's
distance, and at least the share ``least`` of all lists: both follow the table, neither is a ceiling. There is one
list per ``rows_per_list`` rows, up to ``max_lists`` (the bound of what is broadcast: centroids alone); beyond it lists
grow. A list above ``list_rows`` rows is dealt to slots by hash and its queries, where they are more than that, to
turns, so no task holds a list or a crowd of queries that grows. Per slot only the best k of a query leave the task.

Distances are Euclidean in double precision on the original vectors; ties go to the smaller vec_id. Rows with a null
vec_id, a null, empty or all-zero vector, or a null or non-finite component take no part, nor do vectors whose length
is not the commonest. Rows that repeat a vec_id count once, with their smallest distance. A query that finds fewer than
k in its lists reads all lists, so it gets all candidates there are. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, table, written


class Centroids:
    def __init__(self, sample: np.ndarray, k: int, rounds: int = 8, ties: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
        for _ in range(rounds):
            at = self._nearest(sample, c)
            size = np.bincount(at, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, at, sample)
            c[size > 0] = total[size > 0] / size[size > 0, None]
            if (size == 0).any():  # an empty list takes a point of the fullest ones: keeps the lists balanced
                full = np.flatnonzero(at == size.argmax())
                c[size == 0] = sample[rng.choice(full, int((size == 0).sum()))]
        self.c, norm = c, (c * c).sum(1)
        near = [np.argsort(norm - 2 * c[i : i + 512] @ c.T, axis=1)[:, 1 : ties + 1] for i in range(0, len(c), 512)]
        self.graph = np.concatenate(near)
        self.starts = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int))

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        n = (c * c).sum(1)
        return np.concatenate([(n - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)])

    def search(self, x: np.ndarray, ratio: float, least: int) -> list[int]:
        """Best-first walk of the graph: centroids within ``ratio`` times the nearest distance, ``least`` at least."""
        seen = np.zeros(len(self.c), bool)
        seen[self.starts] = True
        d = ((self.c[self.starts] - x) ** 2).sum(1)
        front = list(zip(d.tolist(), self.starts.tolist()))
        heapq.heapify(front)
        settled, best = [], float("inf")
        while front:
            a, i = heapq.heappop(front)
            best = min(best, a)
            if a > best * ratio * ratio and len(settled) >= max(least, 16):
                break
            settled.append((a, i))
            ties = self.graph[i]
            ties = ties[~seen[ties]]
            if len(ties):
                seen[ties] = True
                for b, j in zip(((self.c[ties] - x) ** 2).sum(1).tolist(), ties.tolist()):
                    heapq.heappush(front, (b, j))
        settled.sort()
        return [i for n, (a, i) in enumerate(settled) if n < least or a <= best * ratio * ratio]


def _usable(rows: DataFrame) -> DataFrame:
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad)
    return rows.filter(F.exists(v, lambda x: x != 0))


def _meet(k: int):
    def run(a: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        x, ids, out = np.array(a["embedding"].tolist(), np.float64), a["vec_id"].to_numpy(), []
        for query, v in zip(q["vec_id"], q["embedding"]):
            d = np.sqrt(((x - np.asarray(v, np.float64)) ** 2).sum(axis=1))
            at = np.lexsort((ids, d))
            at = at[ids[at] != query][:k]
            out.append((np.full(len(at), query), ids[at], d[at]))
        query, found, score = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"query_id": query, "vec_id": found, "score": score})

    return run


def _read(posted: DataFrame, sizes: DataFrame, asked: DataFrame, k: int, list_rows: int) -> DataFrame:
    """query_id, vec_id, score: the best k of each list that asked(vec_id, embedding, list) names."""
    crowds = asked.groupBy("list").agg(F.ceil(F.count("*") / F.lit(list_rows)).cast("int").alias("turns"))
    plan = written(crowds.join(sizes, "list"))
    left = posted.join(plan, "list").withColumn("slot", F.expr("cast(pmod(xxhash64(vec_id), slots) as int)"))
    left = left.withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)"))).drop("slots", "turns")
    right = asked.join(plan, "list").withColumn("turn", F.expr("cast(pmod(xxhash64(vec_id, 1), turns) as int)"))
    right = right.withColumn("slot", F.explode(F.expr("sequence(0, slots - 1)"))).drop("slots", "turns")
    pairs = left.groupBy("list", "slot", "turn").cogroup(right.groupBy("list", "slot", "turn"))
    found = pairs.applyInPandas(_meet(k), "query_id long, vec_id long, score double")
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))


def neighbours(
    rows: DataFrame, queries: DataFrame, k: int = 10, sample_rows: int = 65_536, rows_per_list: int = 50,
    max_lists: int = 8192, near: float = 1.04, prune: float = 1.15, least: float = 0.15, list_rows: int = 4000,
) -> DataFrame:
    """query_id, rank, vec_id, score. ``queries`` has the columns of ``rows``."""
    spark = rows.sparkSession
    rows, queries = _usable(only(rows, "vec_id", "embedding")), _usable(only(queries, "vec_id", "embedding"))
    wide = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if wide is None:
        return spark.createDataFrame([], schema)
    rows, queries = (x.filter(F.size("embedding") == wide["d"]) for x in (rows, queries))
    lists = int(min(max_lists, max(8, wide["count"] // rows_per_list)))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(sample_rows, 20 * lists)).toPandas()
    held = spark.sparkContext.broadcast(Centroids(np.array(sample["embedding"].tolist(), np.float64), lists))

    def chosen(ratio: float, at_least: int):
        @F.pandas_udf("array<int>")
        def of(vectors: pd.Series) -> pd.Series:
            return pd.Series([held.value.search(np.asarray(x, np.float64), ratio, at_least) for x in vectors])

        return of("embedding")

    posted = written(rows.select("vec_id", "embedding", F.explode(chosen(near, 1)).alias("list")))
    sizes = written(posted.groupBy("list").agg(F.ceil(F.count("*") / F.lit(list_rows)).cast("int").alias("slots")))
    probed = F.explode(chosen(prune, max(1, int(least * lists))))
    asked = written(queries.select("vec_id", "embedding", probed.alias("list")))
    found = written(_read(posted, sizes, asked, k, list_rows))
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    short = written(queries.join(full, queries.vec_id == full.query_id, "left_anti"))
    if not short.isEmpty():
        rest = short.withColumn("list", F.explode(F.expr(f"sequence(0, {lists - 1})")))
        found = found.join(short, found.query_id == short.vec_id, "left_anti").union(_read(posted, sizes, rest, k, list_rows))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours(rows, rows.filter("vec_id % 100 = 0"))
