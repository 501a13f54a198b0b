"""Periodic run detection by a suffix automaton whose link tree is walked by link-cut access.

A run is a stretch of words with smallest period q, words q apart being identical, at least ``least`` words long and
three periods long, that no neighbouring word extends. For a stretch of words the suffix automaton is built, and its
link tree becomes a link-cut forest. Access to the state of the prefix that ends at word i recolours the path to the
root with i; each preferred path met on the way holds one colour, the last end c of all its substrings before i. With l
the longest substring of such a piece, the words from i - l - q to i have period q = i - c. l >= 2q makes this a run
whose smallest period is q, and l + q its exact length so far, because longer suffixes have no later end than shorter
ones. The last i that tells a start and a period ends the run.

Only words that a run can hold are walked: a run of L words matches its first L - q >= 16 words with the ones q later,
so every one of its words lies in a 16-word window that occurs twice in the text. Windows are compared by a 64-bit
product hash over a batch of texts; a chance collision only makes more words be walked, never fewer.

Null or empty text, or no words: no runs, an empty collapsed text. Repeated rows are treated apart and alike. Ties
cannot arise: start and period name a run. No documents: no rows. Extra columns are kept, whatever their names. Rows
stay where they are: nothing is shuffled, and a task holds one stretch of about a million characters at a time, or one
text if that is longer.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import SPACE, WORD, only, table

LEAST = 24
TIMES = 3
SEED = 16  # words of the first window a run repeats: LEAST - LEAST // TIMES
CHARS = 1 << 20
RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
FOUND = "runs array<struct<start:bigint,length:bigint,period:bigint>>, n_words bigint, collapsed string"


class Automaton:
    """Suffix automaton of words given as numbers; state 1 is the root, 0 stands for none. ``ends`` has each prefix's state."""

    def __init__(self, words: list[int]):
        room = 2 * len(words) + 2
        self.length, self.link = array("i", bytes(4 * room)), array("i", bytes(4 * room))
        self.word, self.to = array("i", b"\xff" * (4 * room)), array("i", bytes(4 * room))  # the first edge of a state
        self.more: dict[int, dict[int, int]] = {}  # its further ones
        self.size = 2
        self.ends = array("i", [0])
        last = 1
        for w in words:
            last = self._append(last, w)
            self.ends.append(last)

    def _edge(self, state: int, word: int) -> int:
        if self.word[state] == word:
            return self.to[state]
        held = self.more.get(state)
        return held.get(word, 0) if held else 0

    def _lead(self, state: int, word: int, to: int) -> None:
        if self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, to
        else:
            self.more.setdefault(state, {})[word] = to

    def _append(self, last: int, word: int) -> int:
        length, link = self.length, self.link
        new = self.size
        self.size += 1
        length[new] = length[last] + 1
        at = last
        while at and not (goes := self._edge(at, word)):
            self._lead(at, word, new)
            at = link[at]
        if not at:
            link[new] = 1
        elif length[goes] == length[at] + 1:
            link[new] = goes
        else:
            split = self.size
            self.size += 1
            length[split], link[split] = length[at] + 1, link[goes]
            self.word[split], self.to[split] = self.word[goes], self.to[goes]
            if goes in self.more:
                self.more[split] = dict(self.more[goes])
            while at and self._edge(at, word) == goes:
                self._lead(at, word, split)
                at = link[at]
            link[goes] = link[new] = split
        return new


class Coloured:
    """Link-cut forest over an automaton's links: preferred paths are splay trees by depth, a path's colour is at its top."""

    def __init__(self, grown: Automaton):
        self.up = array("i", grown.link)
        self.left, self.right, self.colour = (array("i", bytes(4 * len(self.up))) for _ in range(3))
        self.length = grown.length

    def _turn(self, x: int) -> None:
        """Move x above its parent in its splay tree."""
        up, left, right = self.up, self.left, self.right
        p = up[x]
        g = up[p]
        if left[p] == x:
            held = left[p] = right[x]
            right[x] = p
        else:
            held = right[p] = left[x]
            left[x] = p
        if held:
            up[held] = p
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x
        else:
            self.colour[x] = self.colour[p]  # p was the top
        up[x], up[p] = g, x

    def _raise(self, x: int) -> None:
        up, left, right = self.up, self.left, self.right
        while (p := up[x]) and (left[p] == x or right[p] == x):
            g = up[p]
            if left[g] == p or right[g] == p:
                self._turn(p if (left[g] == p) == (left[p] == x) else x)
            self._turn(x)

    def access(self, state: int, colour: int) -> list[tuple[int, int]]:
        """Recolour the path from ``state`` to the root; (old colour, longest length) of each coloured piece on it."""
        met, below, x = [], 0, state
        while x:
            self._raise(x)
            old = self.colour[x]
            if old:
                met.append((old, self.length[x]))
            if cut := self.right[x]:
                self.colour[cut] = old
            self.right[x] = below
            below, x = x, self.up[x]
        self.colour[below] = colour
        return met


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of ``words``, by start, then period."""
    grown = Automaton(words)
    tree = Coloured(grown)
    ends: dict[tuple[int, int], int] = {}
    for i in range(1, len(words) + 1):
        for last, length in tree.access(grown.ends[i], i):
            period = i - last
            if length >= (times - 1) * period and length + period >= least:
                ends[i - length - period, period] = i
    return sorted((start, end - start, period) for (start, period), end in ends.items())


def _stretches(codes: np.ndarray, sizes: list[int]) -> list[list[tuple[int, int]]]:
    """For each text the stretches (start, end), in words of the text, that its runs lie in."""
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    if len(codes) < SEED:
        return out
    text = np.repeat(np.arange(len(sizes)), sizes)
    odd = np.uint64(0x9E3779B97F4A7C15)
    h = (codes.astype(np.uint64) + np.uint64(1)) * odd
    h ^= h >> np.uint64(29)
    width = 1
    while width < SEED:  # windows of twice the words from two neighbouring ones
        h = h[:-width] * odd + (h[width:] ^ (h[width:] >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        width *= 2
    whole = np.flatnonzero(text[: len(h)] == text[SEED - 1 :])
    key = h[whole] ^ (text[whole].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.unique(whole[order[np.concatenate([np.flatnonzero(same), np.flatnonzero(same) + 1])]])
    if not len(twice):
        return out
    edge = np.flatnonzero((np.diff(twice) > SEED) | (np.diff(text[twice]) != 0))
    for a, b in zip(np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(twice) - 1]]), strict=True):
        of = int(text[twice[a]])
        begin, end = int(twice[a] - starts[of]), int(twice[b] + SEED - starts[of])
        if end - begin >= LEAST:
            out[of].append((begin, end))
    return out


def _found(texts: list[str]) -> Iterator[tuple[list[tuple[int, int, int]], int, str]]:
    words = [re.findall(WORD, t) for t in texts]
    known: dict[str, int] = {}
    codes = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64)
    at = 0
    for ws, stretches in zip(words, _stretches(codes, [len(ws) for ws in words]), strict=True):
        own = codes[at : at + len(ws)]
        at += len(ws)
        runs = [(a + s, n, q) for a, b in stretches for s, n, q in runs_of(own[a:b].tolist())]
        if runs:
            drop = np.zeros(len(ws) + 1, np.int64)
            for s, n, q in runs:
                drop[s + q] += 1
                drop[s + n] -= 1
            ws = [w for w, d in zip(ws, np.cumsum(drop), strict=False) if not d]
        yield runs, len(own), " ".join(ws)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, text = batch.columns
        texts = [t or "" for t in text.to_pylist()]
        ends = np.cumsum([len(t) for t in texts])
        begin = 0
        while begin < len(texts):
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + CHARS, "right")))
            runs, sizes, left = zip(*_found(texts[begin:end]), strict=True)
            runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in rs] for rs in runs]
            more = [pa.array(runs, RUNS), pa.array(sizes, pa.int64()), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays([row.slice(begin, end - begin), *more], ["row", "runs", "n_words", "collapsed"])
            begin = end


def periodic(docs: DataFrame) -> DataFrame:
    """``docs`` with a struct ``run_report`` of each text's runs, by start, then period, its words and what is left when each
    run keeps its first period. A column of that name is replaced."""
    kept = docs.drop("run_report")
    held = kept.select(F.struct(*[F.col(f"`{c}`") for c in kept.columns]).alias("row"), F.col("text"))
    shape = StructType([held.schema["row"], *StructType.fromDDL(FOUND).fields])
    return held.mapInArrow(_batches, shape).select("row.*", F.struct("runs", "n_words", "collapsed").alias("run_report"))


def planted(text: Column, doc_id: Column) -> Column:
    """The query's text: for one in ten ids the words from one of them on repeat with a period; null ids change nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
    n = F.size(words)
    a = F.when(n > 0, g % n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    a, p = a.cast("int"), p.cast("int")
    again = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole = F.concat(F.slice(words, F.lit(1), a), F.slice(again, F.lit(1), n - a))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(whole, " ")).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    docs = docs.select("doc_id", planted(F.col("text"), F.col("doc_id")).alias("text"))
    runs, report = F.col("runs"), periodic(docs).select("doc_id", "run_report.*")
    # length / period compared as fractions: longer * other period, ties to the first in order.
    best = F.aggregate(
        runs, F.get(runs, F.lit(0)),
        lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b),
    )
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    report = report.withColumn("best", best)
    return report.select(
        "doc_id", "n_words", F.size(runs).cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
