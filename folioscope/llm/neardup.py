"""Near-duplicates of the pipeline: five-word shingle sets linked at a Jaccard similarity of at least ``least``.

Candidates come from SimHash: the 64-bit fingerprints of the sets, linked by the vantage-point search of ``simhash`` at
``RADIUS`` bits, which finds every such pair. At 0.8 two fingerprints differ by some nine bits, and a radius that wide
leaves pigeonhole keys of a few bits; so what lies beyond the radius is found by MinHash bands besides (24 bands of 5: a
pair at 0.8 shares a band with probability 0.9999). Every link is verified on the exact sets of shingle hashes.

Equal sets collapse to one node. Nodes of one fingerprint, and those that share a band key, are tied to the smallest of
them, a star and no pairs; each connected piece of all ties is searched whole. A piece of up to ``weight`` shingles is one flood fill. A heavier
one is first held against one pivot per piece; what the pivot links needs no comparison with its like, and only the
rest meets all others, in cells of bounded weight.

A text of fewer than five words is one shingle; null texts and texts without words share the empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only, unsent, written
from .simhash import _FOLD, _signed, components, links

BANDS, ROWS, RADIUS = 24, 5, 4
SLICE = 500  # texts whose sets a worker holds at once
_RNG = np.random.default_rng(11)
_A = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 of the ``size``-word shingles."""
    words = [w for w in (text or "").translate(_FOLD).split(" ") if w]
    if len(words) < size:
        held = [" ".join(words)] if words else []
    else:
        held = [" ".join(s) for s in zip(*(words[i:] for i in range(size)))]
    return np.unique(np.array([xxhash.xxh64_intdigest(s, 42) for s in held], np.uint64))


def bands(held: np.ndarray) -> np.ndarray:
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), 1024):
        low = np.minimum(low, (_A * held[None, at : at + 1024] + _B).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(b.tobytes()) for b in low.reshape(BANDS, ROWS)], np.uint64).view(np.int64)


def majority(held: np.ndarray) -> int:
    """SimHash of a set: the bits that over half of its hashes have, as a signed long."""
    ones, step = np.zeros(64, np.int64), 1 << 14
    for at in range(0, len(held), step):
        ones += np.unpackbits(held[at : at + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return _signed(int.from_bytes(np.packbits(2 * ones > len(held)).tobytes(), "big"))


def _name(held: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(held.tobytes())], np.uint64).view(np.int64)[0])


def _sketch(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        held = shingles(t)
        rows.append((_name(held), len(held), majority(held), bands(held)))
    return pd.DataFrame(rows, columns=["sid", "n", "fp", "bands"])


def _own_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Shingle sets in place of texts. One doc_id can have several texts: the set must be the node's own."""
    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.iloc[at : at + SLICE]
            sets = [shingles(t) for t in part["text"]]
            own = np.array([_name(s) for s in sets], np.int64) == part["sid"].to_numpy()
            part = part.drop(columns="text")
            part["held"] = [s.tobytes() for s in sets]
            yield part[own]


def _linker(least: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        """Edges between the probes of a cell and all its members: a flood fill where all are probes."""
        sets = [np.frombuffer(b, np.uint64) for b in part["held"]]
        size = np.array([len(s) for s in sets])
        rep, probe = part["rep"].to_numpy(), part["probe"].to_numpy()
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if size.sum() else np.empty(0, np.int64)
        own, starts = np.repeat(np.arange(len(sets)), size), np.r_[0, np.cumsum(size)]
        flag, flood, edges = np.zeros(len(codes) + 1, bool), bool(probe.all()), []

        def near(i: int) -> np.ndarray:
            mine = codes[starts[i] : starts[i + 1]]
            flag[mine] = True
            both = np.bincount(own[flag[codes]], minlength=len(sets))
            flag[mine] = False
            return np.flatnonzero((both >= least * (size[i] + size - both)) & (both > 0))

        seen = np.zeros(len(sets), bool)
        for first in np.flatnonzero(probe):
            if flood and seen[first]:
                continue
            seen[first], front = True, [first]
            while front:
                i = front.pop()
                hits = near(i)
                hits = hits[~seen[hits]] if flood else hits[hits != i]
                edges += [(int(rep[i]), int(rep[j])) for j in hits]
                if flood:
                    seen[hits] = True
                    front.extend(hits.tolist())
        return pd.DataFrame(edges, columns=["a", "b"]).astype("int64")

    return run


def ties(nodes: DataFrame) -> DataFrame:
    """Candidate links (a, b) between the sids of ``nodes(sid, fp, bands)``: by fingerprint, and by band beyond its radius."""
    prints = written(nodes.groupBy("fp").agg(F.min("sid").alias("rep")))
    near = links(prints, RADIUS).select("a", "b")
    equal = unsent(nodes.select("sid", "fp")).join(prints, "fp").select(F.col("sid").alias("a"), F.col("rep").alias("b"))
    keys = nodes.select("sid", F.posexplode("bands").alias("band", "key"))
    groups = keys.groupBy("band", "key").agg(F.min("sid").alias("low"), F.count("*").alias("k")).filter("k > 1").drop("k")
    far = unsent(keys).join(groups, ["band", "key"]).select(F.col("sid").alias("a"), F.col("low").alias("b"))
    return near.union(equal).union(far).filter("a <> b").distinct()


def edges(docs: DataFrame, nodes: DataFrame, least: float, weight: int) -> DataFrame:
    """Verified links (a, b) between the reps of ``nodes(sid, n, fp, bands, rep)``."""
    pieces = components(written(ties(nodes))).withColumnRenamed("id", "sid").withColumnRenamed("component", "piece")
    pieces = written(pieces.union(pieces.select(F.col("piece").alias("sid"), "piece").distinct()))
    heavy = unsent(nodes).join(pieces, "sid").select("sid", "n", "rep", "piece")
    sums = heavy.groupBy("piece").agg(F.ceil(F.sum("n") / F.lit(weight)).cast("int").alias("parts"))
    member = heavy.join(sums, "piece")
    held = unsent(only(docs, "doc_id", "text")).join(member, F.col("doc_id") == F.col("rep"))
    held = held.select("piece", "parts", "sid", "rep", "n", "text").mapInPandas(
        _own_sets, "piece long, parts int, sid long, rep long, n long, held binary"
    )
    held = written(held.dropDuplicates(["sid"]))
    out, link = "a long, b long", _linker(least)
    small = held.filter("parts = 1").select("piece", "rep", "held", F.lit(True).alias("probe"))
    found = small.groupBy("piece").applyInPandas(link, out)
    large = held.filter("parts > 1")
    if large.isEmpty():
        return found
    pivots = large.groupBy("piece").agg(F.min_by(F.struct("rep", "held"), "sid").alias("p"))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        def one(a: bytes, b: bytes) -> bool:
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            return both > 0 and both >= least * (len(a) + len(b) - both)

        return pd.Series([one(a, b) for a, b in zip(x, y)], dtype=bool)

    # At most one row per heavy piece.
    large = written(large.join(F.broadcast(pivots), "piece").withColumn("linked", alike("held", "p.held")).withColumn("pivot", F.col("p.rep")).drop("p"))
    star = large.filter("linked and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    rest = large.filter("not linked").groupBy("piece").agg(F.ceil(F.sum("n") / F.lit(weight)).cast("int").alias("slots"))
    large = large.join(rest, "piece")
    part, slot = F.expr("pmod(xxhash64(sid), parts)"), F.expr("pmod(xxhash64(sid, 1), slots)")
    base = large.withColumn("part", part).withColumn("slot", F.explode(F.expr("sequence(0l, slots - 1l)"))).withColumn("probe", F.lit(False))
    asked = large.filter("not linked").withColumn("slot", slot).withColumn("part", F.explode(F.expr("sequence(0l, parts - 1l)"))).withColumn("probe", F.lit(True))
    cols = ["piece", "part", "slot", "rep", "held", "probe"]
    more = base.select(*cols).unionByName(asked.select(*cols)).groupBy("piece", "part", "slot").applyInPandas(link, out)
    return found.union(star).union(more.filter("a <> b"))


def near_duplicates(docs: DataFrame, least: float = 0.8, weight: int = 1_000_000) -> DataFrame:
    """doc_id, component_id per row of ``docs``; component_id is the smallest doc_id of its links."""
    sketch = F.pandas_udf(_sketch, "sid long, n long, fp long, bands array<long>")
    rows = written(only(docs, "doc_id", "text").withColumn("s", sketch("text")).select("doc_id", "s.*"))
    nodes = rows.filter("doc_id is not null").groupBy("sid").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")
    )
    nodes = written(nodes)
    # One doc_id with several texts is one node: its sets are linked through the smallest id of each.
    ids = rows.select("doc_id", "sid")
    same = unsent(ids).join(ids.groupBy("doc_id").agg(F.count_distinct("sid").alias("k")).filter("k > 1"), "doc_id")
    bound = unsent(same).join(nodes.select("sid", "rep"), "sid").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(written(edges(docs, nodes, least, weight).union(bound)))
    named = nodes.join(found, nodes.rep == found.id, "left").select("sid", F.coalesce("component", "rep").alias("component_id"))
    return unsent(ids).join(named, "sid", "left").select("doc_id", "component_id")
