"""SimHash near-duplicates: 64-bit fingerprints linked at a Hamming distance of at most ``radius``.

Fingerprints are made per document in Arrow batches. Equal fingerprints collapse to one node before any search.
A single vantage-point tree over random 64-bit values cannot be sharded: distances lie at 32 +/- 4, so a boundary
zone of +/- 4 holds most values and each level would copy them. Shards are therefore cut in two steps. First, by
pigeonhole: of ``b`` bit blocks, ``radius`` differing bits leave b - radius untouched, so every choice of b - radius
blocks is a key and no link is lost; ``b`` grows with the number of fingerprints (`blocks_for`), so that chance
partners stay rarer than rows. Second, every key's rows are cut into rings by Hamming distance to the key's vantage
point; by the triangle bound a link joins one ring (of width radius + 1) or two neighbours, so each value visits its
own ring and the next. Inside a ring a vantage-point tree with leaves of 16 answers range queries in batches and drops
what a flood fill has seen, so that one edge per member leaves it and not all pairs.

A key with more than ``shard_rows`` fingerprints would be too much for one task. Its rows meet at midpoints instead:
two values within ``radius`` share a value that each reaches by radius / 2 flips of the bits outside the key, and all
rows of one midpoint are linked. That is exact, needs no pairs and folds before the shuffle. Components come from
large-star/small-star rounds over the written edges.

Nulls: a null text has fingerprint zero, as has a text without words. A row without doc_id keeps its fingerprint, but
takes no part in links; its component_id is that of its fingerprint, if any. Rows of one doc_id count as one node.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, columns, only, spare, table, unsent, written

_TABLE = {ord(a): b for a, b in zip(UPPER, LOWER)}
_SPLIT = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}
_FOLD = _TABLE | _SPLIT


def fingerprint(text: str | None, size: int = 4) -> int:
    """Majority bits of the XXH64 of all ``size``-word shingles, repeats included."""
    words = [w for w in (text or "").translate(_FOLD).split(" ") if w]
    if not words:
        return 0
    if len(words) < size:
        shingles = [" ".join(words)]
    else:
        shingles = [" ".join(s) for s in zip(*(words[i:] for i in range(size)))]
    ones, step = np.zeros(64, np.int64), 1 << 14
    for at in range(0, len(shingles), step):
        part = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles[at : at + step]], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """(doc_id, fp) per row; fp holds the 64 bits as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, size)) for t in texts], dtype="int64")

    return only(docs, "doc_id", "text").select("doc_id", of("text").alias("fp"))


def blocks_for(rows: int, radius: int) -> list[tuple[int, int]]:
    """(low bit, width) of the fewest blocks at which a row meets under one chance partner in eight per key."""
    b = radius + 3
    while b < 16 and rows * 8 > 1 << (64 * (b - radius) // b):
        b += 1
    cuts = [64 * i // b for i in range(b + 1)]
    return [(low, high - low) for low, high in zip(cuts, cuts[1:])]


class VantageTree:
    """Tree over unsigned 64-bit values; a batch of queries descends together, pruned by the triangle bound."""

    def __init__(self, values: np.ndarray, leaf: int = 16):
        self.values, self.leaf, self.nodes = values, leaf, []
        self.home = np.zeros(len(values), np.int64)
        self._build(np.arange(len(values)), -1)
        self.left = np.array([n[4] for n in self.nodes])
        self.live = np.ones(len(values), bool)

    def _build(self, at: np.ndarray, parent: int) -> int:
        me, vantage = len(self.nodes), self.values[at[0]] if len(at) else None
        self.nodes.append([vantage, -1, at, parent, len(at), -1, -1])
        if len(at) > self.leaf:
            d = np.bitwise_count(self.values[at] ^ vantage)
            cut = int(np.median(d))
            if not (d > cut).any():
                cut -= 1
            if cut >= 0:
                self.nodes[me][1] = cut
                self.nodes[me][5] = self._build(at[d <= cut], me)
                self.nodes[me][6] = self._build(at[d > cut], me)
                return me
        self.home[at] = me
        return me

    def near(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) positions within ``radius``, of the values not yet dropped."""
        got, stack = [], [(0, np.arange(len(queries)))]
        while stack:
            me, asked = stack.pop()
            vantage, cut, at, _, _, inner, outer = self.nodes[me]
            if not len(asked) or not self.left[me]:
                continue
            if inner < 0:
                at = at[self.live[at]]
                step = max(1, (1 << 20) // max(1, len(at)))
                for i in range(0, len(asked), step):
                    q, v = np.nonzero(np.bitwise_count(queries[asked[i : i + step], None] ^ self.values[at]) <= radius)
                    got.append((asked[i + q], at[v]))
                continue
            d = np.bitwise_count(queries[asked] ^ vantage).astype(np.int64)
            stack.append((inner, asked[d - radius <= cut]))
            stack.append((outer, asked[d + radius > cut]))
        if not got:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])

    def drop(self, at: np.ndarray) -> None:
        self.live[at] = False
        node = self.home[at]
        while len(node):
            np.subtract.at(self.left, node, 1)
            node = np.array([self.nodes[n][3] for n in node])
            node = node[node >= 0]


def _flood(values: np.ndarray, ids: np.ndarray, radius: int, most: int = 64) -> np.ndarray:
    """Edges that span the local components. Seeds go in batches where they find little, alone where they find much."""
    tree, edges, start, size = VantageTree(values), [np.empty((0, 2), np.int64)], 0, 1
    while start < len(values):
        seeds = start + np.flatnonzero(tree.live[start : start + 16 * size])[:size]
        if not len(seeds):
            start += 16 * size
            continue
        start, front, found = int(seeds[-1]) + 1, seeds, 0
        if size == 1:
            tree.drop(seeds)
        while len(front):
            asked, hit = tree.near(values[front], radius)
            if size == 1:  # one component: any one link of a member will do
                hit, at = np.unique(hit, return_index=True)
                asked = asked[at]
            edges.append(np.column_stack((ids[front[asked]], ids[hit])))
            hit = np.unique(hit)
            front = hit if size == 1 else np.setdiff1d(hit, front, assume_unique=True)
            tree.drop(hit)
            found += len(front)
        size = min(most, 2 * size) if found <= 4 * size else max(1, size // 8)
    return np.concatenate(edges)


def _shard_edges(radius: int):
    def edges(part: pd.DataFrame) -> pd.DataFrame:
        shard, fp = part["shard"].to_numpy(), part["fp"].to_numpy().view(np.uint64)
        ids = part["rep"].to_numpy()
        starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
        ends = np.r_[starts[1:], len(shard)]
        many = ends - starts > 1
        got = [np.empty((0, 2), np.int64)]
        for s, e in zip(starts[many].tolist(), ends[many].tolist()):
            if e - s == 2:
                if (int(fp[s]) ^ int(fp[s + 1])).bit_count() <= radius:
                    got.append(ids[s:e].reshape(1, 2))
            else:
                got.append(_flood(fp[s:e], ids[s:e], radius))
        both = np.concatenate(got)
        both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
        return pd.DataFrame({"a": both[:, 0], "b": both[:, 1]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # All but the last shard are whole.
            cut = int(np.searchsorted(held["shard"].to_numpy(), held["shard"].iloc[-1])) if len(held) else 0
            if cut > 0:
                yield edges(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield edges(held)

    return run


def _midpoints(dense: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Edges within keys too large for a task, of dense(n, bits, fp, rep)."""
    flips = []
    for n, mask in enumerate(masks):
        free = [1 << i for i in range(64) if not mask >> i & 1]
        for k in range(radius // 2 + radius % 2 + 1):
            flips += [(n, _signed(sum(c))) for c in combinations(free, k)]
    flips = dense.sparkSession.createDataFrame(flips, "n int, flip long")
    # The flips are a constant of the radius and the blocks: some hundred per key.
    points = dense.join(F.broadcast(flips), "n").select("n", "rep", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    low = points.groupBy("n", "mid").agg(F.min("rep").alias("low"), F.count("*").alias("k")).filter("k > 1").drop("k")
    return unsent(points).join(low, ["n", "mid"]).filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))


def links(nodes: DataFrame, radius: int = 4, shard_rows: int = 65_536) -> DataFrame:
    """Edges (a, b) between ids of ``nodes(fp, rep)`` that span the same components as all links do."""
    blocks = blocks_for(nodes.count(), radius)
    masks = [sum(((1 << wide) - 1) << low for low, wide in c) for c in combinations(blocks, len(blocks) - radius)]
    keys = [F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for n, m in enumerate(masks)]
    keyed = nodes.select("fp", "rep", F.explode(F.array(*keys)).alias("k")).select("fp", "rep", "k.n", "k.bits")
    sizes = keyed.groupBy("n", "bits").agg(F.count("*").alias("size"), F.min("fp").alias("vantage"))
    sizes = sizes.filter("size > 1")
    keyed = written(unsent(keyed).join(sizes, ["n", "bits"]))
    ring = (F.bit_count(F.col("fp").bitwiseXOR(F.col("vantage"))) / F.lit(radius + 1)).cast("int")
    shards = keyed.filter(F.col("size") <= shard_rows)
    shards = shards.select("fp", "rep", "n", "bits", F.explode(F.array(ring, ring + 1)).alias("ring"))
    # Two shards with one hash would be searched together: more comparisons, never a false link.
    shards = shards.select("fp", "rep", F.xxhash64("n", "bits", "ring").alias("shard"))
    shards = shards.repartition("shard").sortWithinPartitions("shard")
    found = shards.mapInPandas(_shard_edges(radius), "a long, b long")
    dense = keyed.filter(F.col("size") > shard_rows)
    if not dense.isEmpty():
        found = found.union(_midpoints(dense, masks, radius))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of ``edges(a, b)`` but the smallest of each component, which names it."""
    now, before = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), None
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = unsent(both).join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        star = unsent(star).join(low, "a")
        star = star.select("a", F.col("m").alias("b")).union(star.select(F.col("b").alias("a"), F.col("m").alias("b")))
        now = written(star.filter("a > b").distinct())
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == before:
            break
        before = sign
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")


def near_duplicates(docs: DataFrame, radius: int = 4, shard_rows: int = 65_536, size: int = 4) -> DataFrame:
    """doc_id, fp, component_id per row of ``docs``."""
    rows = written(fingerprints(docs, size))
    nodes = rows.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"))
    nodes = written(nodes)
    # One doc_id with several texts is one node: its fingerprints are linked through the smallest id of each.
    same = unsent(rows).join(rows.groupBy("doc_id").agg(F.count_distinct("fp").alias("k")).filter("k > 1"), "doc_id")
    bound = unsent(same).join(nodes, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(written(links(nodes, radius, shard_rows).union(bound)))
    named = nodes.join(found, nodes.rep == found.id, "left").select(
        "fp", F.coalesce("component", "rep").alias("component_id")
    )
    return unsent(rows).join(named, "fp", "left").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group linked at a shingle similarity of 0.8: that of the smallest doc_id.

    Rows without doc_id stay. Of rows that share a doc_id one stays, that of the smallest text hash; only such rows are shuffled for it.
    """
    from . import neardup  # builds on this module

    (row,) = spare(docs, "row")
    losers = neardup.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id")
    kept = docs.join(losers, "doc_id", "left_anti")
    again = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 and doc_id is not null").select("doc_id")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")
    one = kept.join(again, "doc_id", "left_semi").withColumn(row, F.row_number().over(first)).filter(F.col(row) == 1)
    return kept.join(again, "doc_id", "left_anti").select(*columns(docs)).unionByName(one.select(*columns(docs)))
