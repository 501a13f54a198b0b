"""Substring dedup by relative Lempel-Ziv factors against indexed reference blocks.

The reference is the whole corpus. Its blocks are cut by content: the leftmost least hash of the 6-word grams inside a
20-word window (its anchor) names the block, so equal windows always lie in one block at one offset, whatever surrounds
them. A document falls into phrases, the runs of windows with one anchor, and each phrase meets the only block that can
hold a source for it. A block is an index from the phrase's words to its earliest place. Parsing is greedy: a phrase
whose whole word sequence starts earlier is taken at once as part of a factor; where a block holds phrases that differ
(the borders of a factor, where text around a repeated passage is not the same), the phrase is checked window by
window, by its words, against the earliest place of each window. Neighbouring matches join to factors; one of n windows
covers n + 19 words.

Phrases and windows are told apart by digests of their words' bytes, 128 bits in all (a phrase: 64 of its words and 64
of its anchor). What repeats inside one batch of rows is settled there: only the earliest place of a phrase or window
leaves a batch, and a block known to differ sends a mark. So a passage in a third of all rows reaches a task as one row
per batch. Texts are read again only for the phrases whose block differs between batches.

Null or empty text: no words. A null doc_id counts as the smallest. Identical rows share doc_id and starts, so none is
earlier than the other; rows of one doc_id with other texts count as one document. Texts under 20 words keep all their
words. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, table, written

WINDOW, GRAM = 20, 6
_BASE = 0x9E3779B97F4A7C15
PHRASE, MARK, PLACE, FACTOR = range(4)  # kinds of row; a mark tells that a block holds phrases that differ
_FIELDS = [("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]
_SCHEMA = pa.schema(_FIELDS)
_DDL = "kind int, a long, b long, doc long, row long, start int, n int"
_NONE = np.empty(0, np.int64)


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of every run of ``n`` words."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for i in range(n):
        h = h * np.uint64(_BASE) + ids[i : i + len(h)]
    return _mix(h)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # on the six ASCII blanks, as bytes are


class Spelling:
    """The words of a text joined by one space, and where each begins."""

    def __init__(self, held: list[bytes]):
        self.data = b" ".join(held)
        self.at = np.r_[0, np.cumsum(np.fromiter(map(len, held), np.int64, len(held)) + 1)]

    def digests(self, first: np.ndarray, end: np.ndarray, of) -> list:
        data = self.data
        return [of(data[a:b]) for a, b in zip(self.at[first].tolist(), (self.at[end] - 1).tolist())]

    def places(self, starts: np.ndarray) -> np.ndarray:
        """128-bit digest of each window, as two longs."""
        got = b"".join(self.digests(starts, starts + WINDOW, xxhash.xxh3_128_digest))
        return np.frombuffer(got, np.int64).reshape(-1, 2)


def phrases(held: list[bytes], ids: _Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) of each phrase of at least WINDOW words."""
    of = np.array(list(map(ids.__getitem__, held)), np.uint64)
    grams = _grams(of, GRAM)
    wide = np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1)
    anchor = wide.argmin(axis=1) + np.arange(len(wide))
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return grams[anchor[starts]].view(np.int64), starts, np.diff(np.r_[starts, len(wide)])


def _out(kind: int, a, b, doc, row, start, n) -> pa.RecordBatch:
    size = len(start)
    fill = lambda x: x if isinstance(x, np.ndarray) else np.full(size, x, np.int64)
    cols = [fill(kind).astype(np.int32), fill(a), fill(b), fill(doc), fill(row), fill(start).astype(np.int32), fill(n).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], schema=_SCHEMA)


def _fold(a: np.ndarray, b: np.ndarray, doc: np.ndarray, start: np.ndarray):
    """Order by (a, b, doc, start), group number, and which rows start later than the earliest of their group."""
    order = np.lexsort((start, doc, b, a))
    a, b, doc, start = a[order], b[order], doc[order], start[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)[group] if len(a) else _NONE
    return order, group, (doc != doc[head]) | (start != start[head])


def _windows(texts: list[Spelling], doc, row, which, start, n) -> Iterator[pa.RecordBatch]:
    """Places of the windows of phrases; those settled within the batch as factors."""
    per = [np.arange(s, s + k) for s, k in zip(start.tolist(), n.tolist())]
    if not per:
        return
    at, of = np.concatenate(per), np.repeat(which, n)
    turn = np.argsort(of, kind="stable")
    at, of = at[turn], of[turn]
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    hashed = np.concatenate([texts[of[s]].places(at[s:e]) for s, e in zip(cuts, np.r_[cuts[1:], len(of)])])
    order, _, later = _fold(hashed[:, 0], hashed[:, 1], doc[of], at)
    at, of, hashed = at[order], of[order], hashed[order]
    keep = ~later
    yield _out(PLACE, hashed[keep, 0], hashed[keep, 1], doc[of[keep]], row[of[keep]], at[keep], 1)
    yield _out(FACTOR, 0, 0, doc[of[later]], row[of[later]], at[later], 1)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, text) to phrases, marks, window places and settled factors."""
    ids = _Ids()
    for batch in batches:
        docs, rows = batch["doc"].to_numpy(), batch["row"].to_numpy(zero_copy_only=False)
        texts, which, block, digest, start, n = [], [], [_NONE], [_NONE], [_NONE], [_NONE]
        for i, text in enumerate(batch["text"]):
            held = words(text.as_py())
            if len(held) < WINDOW:
                continue
            anchors, first, count = phrases(held, ids)
            spelling = Spelling(held)
            digest.append(np.array(spelling.digests(first, first + count + WINDOW - 1, xxhash.xxh3_64_intdigest), np.uint64).view(np.int64))
            which.append(np.full(len(first), len(texts)))
            texts.append((i, spelling))
            block.append(anchors)
            start.append(first)
            n.append(count)
        if not texts:
            continue
        at = np.array([i for i, _ in texts])
        doc, row, texts = docs[at], rows[at], [s for _, s in texts]
        which, block, digest, start, n = (np.concatenate(x) for x in (which, block, digest, start, n))
        order, group, later = _fold(block, digest, doc[which], start)
        which, block, digest, start, n = (x[order] for x in (which, block, digest, start, n))
        yield _out(FACTOR, 0, 0, doc[which[later]], row[which[later]], start[later], n[later])
        edge = np.r_[True, block[1:] != block[:-1]]
        number = np.cumsum(edge) - 1
        kinds = group[np.r_[np.flatnonzero(edge)[1:] - 1, len(group) - 1]] - group[edge] + 1  # phrases of each block
        mixed = (kinds > 1)[number]
        marks = block[edge][kinds > 1]
        yield _out(MARK, marks, 0, 0, 0, np.zeros(len(marks), np.int64), 0)
        keep = ~later & ~mixed
        yield _out(PHRASE, block[keep], digest[keep], doc[which[keep]], row[which[keep]], start[keep], n[keep])
        open_ = ~later & mixed
        yield from _windows(texts, doc, row, which[open_], start[open_], n[open_])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (a, b, doc, start): factors of phrases, and as PLACE the phrases to be checked by window."""
    for held in _whole(batches):
        kind, block, digest, doc, row, start, n = (held[f].to_numpy(zero_copy_only=False) for f, _ in _FIELDS)
        edge = np.r_[True, block[1:] != block[:-1]]
        number = np.cumsum(edge) - 1
        spoken = kind == PHRASE
        low = np.full(number[-1] + 1, np.iinfo(np.int64).max)
        high = np.full(number[-1] + 1, np.iinfo(np.int64).min)
        np.minimum.at(low, number[spoken], digest[spoken])
        np.maximum.at(high, number[spoken], digest[spoken])
        mixed = low < high
        np.logical_or.at(mixed, number, kind == MARK)
        block, digest, doc, row, start, n, number = (x[spoken] for x in (block, digest, doc, row, start, n, number))
        if not len(block):
            continue
        order, _, later = _fold(block, digest, doc, start)
        doc, row, start, n, mixed = doc[order], row[order], start[order], n[order], mixed[number[order]]
        yield _out(FACTOR, 0, 0, doc[later], row[later], start[later], n[later])
        ask = mixed & ~later
        yield _out(PLACE, 0, 0, doc[ask], row[ask], start[ask], n[ask])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold all rows of each of their blocks; the last block of a batch waits for the next."""
    held = None
    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        block = held["a"].to_numpy()
        if not len(block):
            continue
        cut = int(np.flatnonzero(np.r_[True, block[1:] != block[:-1]])[-1])
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, row, text, asked) to the places of the windows asked for."""
    for batch in batches:
        docs, rows = batch["doc"].to_numpy(), batch["row"].to_numpy()
        texts = [Spelling(words(t.as_py())) for t in batch["text"]]
        which, start, n = [], [], []
        for i, asked in enumerate(batch["asked"].to_pylist()):
            for x in asked:
                which.append(i)
                start.append(x["start"])
                n.append(x["n"])
        yield from _windows(texts, docs, rows, np.array(which), np.array(start), np.array(n))


def factors(rows: DataFrame) -> DataFrame:
    """(doc, row, found): the windows, as (start, n) runs, of each row of rows(doc, row, text) that also start earlier."""
    parsed = written(rows.mapInArrow(_parse, _DDL))
    blocks = parsed.filter(F.col("kind") <= MARK).repartition("a").sortWithinPartitions("a")
    settled = written(blocks.mapInArrow(_settle, _DDL))
    asked = settled.filter(F.col("kind") == PLACE).groupBy("doc", "row").agg(F.collect_set(F.struct("start", "n")).alias("asked"))
    again = rows.join(asked, ["doc", "row"]).select("doc", "row", "text", "asked")
    checked = written(again.mapInArrow(_check, _DDL))
    places = parsed.filter(F.col("kind") == PLACE).union(checked.filter(F.col("kind") == PLACE)).select("a", "b", "doc", "row", "start")
    # Places are dealt out once: in order, the first of a window is its earliest.
    order = Window.partitionBy("a", "b").orderBy("doc", "start")
    later = places.withColumn("first", F.first(F.struct("doc", "start")).over(order)).filter(F.struct("doc", "start") > F.col("first"))
    runs = ["doc", "row", "start", "n"]
    settled = parsed.union(settled).union(checked).filter(F.col("kind") == FACTOR).select(*runs).union(later.select("doc", "row", "start", F.lit(1).alias("n")))
    return settled.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "n")).alias("found"))


def cut(text: str | None, found) -> tuple[int, int, list[tuple[int, int]], str]:
    """Words, words removed, the factors (first word, end) and the kept words joined by one space."""
    held = words(text)
    if found is None or not len(found):
        return len(held), 0, [], b" ".join(held).decode()
    gone = np.zeros(len(held) + 1, np.int64)
    first = np.array([f["start"] for f in found])
    np.add.at(gone, first, 1)
    np.add.at(gone, first + np.array([f["n"] for f in found]) + WINDOW - 1, -1)
    covered = np.cumsum(gone)[:-1] > 0
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    spans = [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]
    kept, past = [], 0
    for a, b in [*spans, (len(held), len(held))]:
        kept += held[past:a]
        past = b
    return len(held), int(covered.sum()), spans, b" ".join(kept).decode()


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, spans (factors joined), kept (text) per row."""
    least = F.lit(-(1 << 63))
    rows = only(docs, "doc_id", "text").withColumn("doc", F.coalesce("doc_id", least))
    rows = rows.withColumn("row", F.xxhash64("text"))
    found = factors(rows.select("doc", "row", "text"))

    @F.pandas_udf("n_words long, n_removed long, spans array<struct<first:int,end:int>>, kept string")
    def apply(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        got = []
        for t, s in zip(texts, found):
            n, gone, spans, kept = cut(t, s)
            got.append((n, gone, [{"first": a, "end": b} for a, b in spans], kept))
        return pd.DataFrame(got, columns=["n_words", "n_removed", "spans", "kept"])

    joined = rows.join(found, ["doc", "row"], "left")
    return joined.select("doc_id", apply("text", "found").alias("k")).select("doc_id", "k.*")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same rows in SQL: windows as texts of 20 words, each held against the earliest place of its like.
SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM doc),
place AS (SELECT doc_id, i, array_to_string(w[i + 1 : i + 20], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM doc WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM place) WHERE k > 1),
mark AS (SELECT word.doc_id, word.i, word.word, max(later.i) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS UNBOUNDED PRECEDING) AS last
  FROM word LEFT JOIN later ON later.doc_id = word.doc_id AND later.i = word.i),
kept AS (SELECT doc_id, count(*) FILTER (last IS NOT NULL AND i - last < 20) AS n_removed,
  coalesce(string_agg(word, ' ' ORDER BY i) FILTER (last IS NULL OR i - last >= 20), '') AS kept FROM mark GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM doc LEFT JOIN kept ON kept.doc_id = doc.doc_id
"""
