"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over up to ten consecutive words; the words under its zeros are ignored, so a passage with some
words replaced still hits. The masks lose nothing that the rule below counts: every stretch of ten words with two of
them replaced, and every stretch of eight with one replaced, holds all words of some mask (a test goes through them
all), and an overlap of 8 to 14 aligned words with a share of 0.8 holds such a stretch. Benchmark windows are hashed under every mask to a table of (seed, item, place), which Spark
partitions as it likes. Each text is hashed under the same masks, and hashes that stand in the table are joined with
it. What keeps the join small is a Bloom filter of the table's seeds, ``filter_bits`` bits whatever the benchmark's
size, made from partial filters and broadcast: only hashes that pass it leave the scan. A false pass is met by no row
of the join; a benchmark too large for the filter makes the join larger, never the result another.

A hit fixes a diagonal (text position less item position); the item is then compared word by word along it, and the
overlap counts if some run of ``window`` aligned words (all words of a shorter item) agrees in at least ``share`` of
its places. Items of fewer than ``least`` words count only whole and word for word: their seed is the item itself.

Words are runs of letters and digits, lower case. Null and empty texts have no words and are clean; items without
words, text or id match nothing. Equal texts are searched apart and judged alike; items with one id count as one.
A null doc_id is an id like any other. Extra columns stay as they are. An empty benchmark leaves all clean, an empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, spare, table, unsent, written

# Masks of six words found by search over all masks of at most ten places.
MASKS = ("111111", "1101111", "11110011", "110101011", "1110010011")
WORDS = re.compile(r"[^\W_]+")
CHUNK = 16  # bits of a position within its piece of the filter
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) % (1 << 64) | 1 for i in range(32)], np.uint64)
_BIT = (128 >> np.arange(8)).astype(np.uint8)
FOUND = "text_key string, items array<long>, best double"


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _ids(text: str | None, cache: _Ids) -> np.ndarray:
    return np.array(list(map(cache.__getitem__, WORDS.findall((text or "").lower()))), np.uint64)


def _masked_all(ids: np.ndarray, masks: tuple[str, ...]) -> list[np.ndarray]:
    """Hashes of all windows under each mask. The words' products are shared by the masks."""
    wide = min(max(map(len, masks), default=0), len(ids))
    times, out = [ids * _ODD[i] for i in range(wide)], []
    for mask in masks:
        n = len(ids) - len(mask) + 1
        if n <= 0:
            out.append(np.empty(0, np.uint64))
            continue
        h = np.full(n, int(mask, 2) << 8 | len(mask), np.uint64)
        for i, bit in enumerate(mask):
            if bit == "1":
                h += times[i][i : i + n]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append(h ^ (h >> np.uint64(29)))
    return out


def _seeds(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = _Ids()
        for batch in batches:
            out = []
            for item, text in zip(batch["item"], batch["text"]):
                ids = _ids(text, cache)
                masks = MASKS if len(ids) >= least else ("1" * len(ids),)
                for h in _masked_all(ids, masks) if len(ids) else ():
                    h = h.view(np.int64)
                    out.append(pd.DataFrame({"seed": h, "item": item, "place": np.arange(len(h), dtype=np.int32), "wide": len(ids)}))
            if out:
                yield pd.concat(out)

    return run


def _position(h: np.ndarray, bits: int, turn: int) -> np.ndarray:
    """The first, second or third bit of the filter that a seed sets."""
    return ((h >> np.uint64((0, 18, 64 - bits)[turn])) & np.uint64((1 << bits) - 1)).view(np.int64)


def _filter(seeds: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of the seeds: 2 ** bits bits, joined from pieces that each partition fills."""

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in (_position(batch["seed"].to_numpy().view(np.uint64), bits, turn) for turn in range(3)):
                for piece in np.unique(at >> CHUNK):
                    own = held.setdefault(int(piece), np.zeros(1 << CHUNK, bool))
                    own[at[at >> CHUNK == piece] & ((1 << CHUNK) - 1)] = True
        if held:
            yield pd.DataFrame({"piece": list(held), "bits": [np.packbits(b).tobytes() for b in held.values()]})

    def both(rows: pd.DataFrame) -> pd.DataFrame:
        joined = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in rows["bits"]])
        return pd.DataFrame({"piece": rows["piece"][:1], "bits": [joined.tobytes()]})

    pieces = seeds.select("seed").mapInPandas(part, "piece int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pieces.groupBy("piece").applyInPandas(both, "piece int, bits binary").collect():
        size = (1 << CHUNK) // 8
        out[r["piece"] * size : (r["piece"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _scan(held, masks: tuple[str, ...], bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, table_ = _Ids(), held.value
        for batch in batches:
            out = []
            for key, text in zip(batch["text_key"], batch["text"]):
                ids, seeds, places = _ids(text, cache), [], []
                for h in _masked_all(ids, masks):
                    at = None
                    for turn in range(3):
                        where = _position(h if at is None else h[at], bits, turn)
                        hit = np.flatnonzero(table_[where >> 3] & _BIT[where & 7])
                        at = hit if at is None else at[hit]
                        if not len(at):
                            break
                    seeds.append(h[at].view(np.int64))
                    places.append(at)
                if sum(map(len, seeds)):
                    out.append((key, text, np.concatenate(seeds), np.concatenate(places).astype(np.int32)))
            yield pd.DataFrame(out, columns=["text_key", "text", "seeds", "places"])

    return run


def overlap(ids: np.ndarray, item: np.ndarray, shift: int, window: int, least: int) -> float:
    """The best share of agreeing words in a run of ``window`` along a diagonal; whole and exact for a short item."""
    low, high = max(0, -shift), min(len(item), len(ids) - shift)
    need = min(window, len(item))
    if high - low < need or not need:
        return 0.0
    same = np.r_[0, np.cumsum(ids[low + shift : high + shift] == item[low:high])]
    best = float((same[need:] - same[:-need]).max() / need)
    return best if len(item) >= least or best == 1.0 else 0.0


def _verified(window: int, share: float, least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, out = _Ids(), []
        for batch in batches:
            for key, text, asked in zip(batch["text_key"], batch["text"], batch["asked"]):
                ids, found = _ids(text, cache), {}
                for a in asked:
                    item = _ids(a["words"], cache)
                    best = max(overlap(ids, item, int(s), window, least) for s in a["shifts"])
                    if best >= share:
                        found[int(a["item_id"])] = max(best, found.get(int(a["item_id"]), 0.0))
                if found:
                    out.append((key, sorted(found), max(found.values())))
            yield pd.DataFrame(out, columns=["text_key", "items", "best"])
            out = []

    return run


def overlaps(
    docs: DataFrame, bench: DataFrame, window: int = 13, share: float = 0.8, least: int = 8, filter_bits: int = 26
) -> DataFrame:
    """text_key (md5 of the text), items (sorted item_ids found), best (share of agreeing words) of texts that hold any."""
    spark = docs.sparkSession
    items = only(bench, "item_id", "text").filter("item_id is not null and text is not null")
    items = items.withColumn("item", F.xxhash64("item_id", "text")).dropDuplicates(["item"])
    seeds = written(items.mapInPandas(_seeds(least), "seed long, item long, place int, wide int"))
    short = [r["wide"] for r in seeds.filter(F.col("wide") < least).select("wide").distinct().collect()]  # under ``least`` values
    masks = (*MASKS, *("1" * n for n in sorted(short) if n != len(MASKS[0])))
    held = spark.sparkContext.broadcast(_filter(seeds, filter_bits))
    texts = only(docs, "text").filter("text is not null").select(F.md5("text").alias("text_key"), "text")
    schema = "text_key string, text string, seeds array<long>, places array<int>"
    passed = written(texts.mapInPandas(_scan(held, masks, filter_bits), schema))
    held.unpersist()
    hits = passed.select("text_key", F.explode(F.arrays_zip("seeds", "places")).alias("h"))
    hits = hits.select("text_key", F.col("h.seeds").alias("seed"), F.col("h.places").alias("at"))
    hits = unsent(hits).join(seeds, "seed")
    hits = hits.groupBy("text_key", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("shifts"))
    asked = hits.join(items.withColumnRenamed("text", "words"), "item").groupBy("text_key").agg(
        F.collect_list(F.struct("item_id", "words", "shifts")).alias("asked")
    )
    found = passed.select("text_key", "text").dropDuplicates(["text_key"]).join(asked, "text_key")
    return written(found.mapInPandas(_verified(window, share, least), FOUND))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, items (ids, comma-joined), best_share."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    found = overlaps(docs, table(spark, sf_dir, "benchmark"))
    rows = docs.select("doc_id", F.md5("text").alias("text_key")).join(found, "text_key", "left")
    items = F.coalesce("items", F.expr("cast(array() as array<long>)"))
    return rows.select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.size(items).cast("long").alias("n_items"),
        F.array_join(items.cast("array<string>"), ",").alias("items"),
        F.coalesce("best", F.lit(0.0)).alias("best_share"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that hold no benchmark passage; null and empty texts stay."""
    (own,) = spare(docs, "bad")
    bad = overlaps(docs, table(spark, sf_dir, "benchmark")).select(F.col("text_key").alias(own))
    return docs.join(bad, F.md5(F.col("text")) == F.col(own), "left_anti")
