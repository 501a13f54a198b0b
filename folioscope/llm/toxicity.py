"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence has a logit: a bias plus the weights of its words and of their four-letter prefixes, hashed into ``SLOTS``.
The document's score is the noisy-or of its sentences, 1 - prod(1 - p). Only document labels are used; the gradient
of the noisy-or shares the blame among sentences, and `sentences` then returns those that offend.

Training reads a bounded sample, at most ``per_class`` labelled ids of each class (smallest hash first), and of those
the texts of up to ``most_chars`` code points; scoring reads every text whole. Null and empty texts have one empty
sentence: the bias. Rows without label, or without doc_id, train nothing. A doc_id labelled
twice trains with its larger label. No labelled rows: all scores are that of the starting bias.
Repeated rows are scored alike; a null doc_id is never held out; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, smallest, table, written

SLOTS = 1 << 18
SENTENCE = re.compile(r"[.!?\n]+")
WORDS = re.compile(r"[^\W_]+")


def _slots(word: str) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(word, 1) % SLOTS, xxhash.xxh64_intdigest(word[:4], 2) % SLOTS


class Model:
    def __init__(self, start: float = -10.0):
        self.w, self.b, self.known = np.zeros(SLOTS, np.float32), start, {}

    def weight(self, word: str) -> float:
        got = self.known.get(word)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            a, b = _slots(word)
            got = self.known[word] = float(self.w[a]) + float(self.w[b])
        return got

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of each sentence, in code points."""
        text, out, at = text or "", [], 0
        for m in [*SENTENCE.finditer(text), None]:
            end = m.start() if m else len(text)
            words = WORDS.findall(text[at:end].lower())
            if words:
                z = self.b + sum(map(self.weight, words))
                out.append((at, end, 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))))
            at = m.end() if m else end
        return out

    def score(self, text: str | None) -> float:
        found = self.sentences(text) or [(0, 0, 1 / (1 + math.exp(-self.b)))]
        return min(1.0, max(0.0, -math.expm1(sum(math.log1p(-min(p, 1 - 1e-12)) for *_, p in found))))

    def fit(self, texts: list[str], labels: list[int], epochs: int = 12, rate: float = 0.5, thin: float = 0.01, rare: int = 5, bias_rate: float = 0.1):
        """Adagrad over documents; log(1 - P) is the sum of log(1 - p) of the sentences."""
        bags = []
        for text in texts:
            ids, of = [], []
            for k, s in enumerate(x for x in SENTENCE.split(text) if WORDS.search(x)):
                for w in WORDS.findall(s.lower()):
                    ids += _slots(w)
                    of += (k, k)
            bags.append((np.array(ids, np.int64), np.array(of, np.int64), (of[-1] + 1) if of else 0))
        seen = np.bincount(np.concatenate([np.unique(ids) for ids, *_ in bags] or [np.empty(0, np.int64)]), minlength=SLOTS)
        for k, (ids, of, n) in enumerate(bags):  # a word of one or two documents proves nothing
            bags[k] = (ids[seen[ids] >= rare], of[seen[ids] >= rare], n)
        gw, gb, rng = np.full(SLOTS, 1e-3, np.float32), 1e-3, np.random.default_rng(3)
        for _ in range(epochs):
            for i in rng.permutation(len(bags)):
                ids, of, n = bags[i]
                if not n:
                    continue
                z = np.clip(self.b + np.bincount(of, self.w[ids], n), -30, 30)
                p = 1 / (1 + np.exp(-z))
                clean = np.exp(np.log1p(-np.minimum(p, 1 - 1e-9)).sum())
                push = p if not labels[i] else -p * clean / max(1 - clean, 1e-9)
                hit, back = np.unique(ids, return_inverse=True)
                g = np.bincount(back, push[of]).astype(np.float32)
                gw[hit] += g * g
                w = self.w[hit] - rate * g / np.sqrt(gw[hit])
                self.w[hit] = np.sign(w) * np.maximum(np.abs(w) - rate * thin / np.sqrt(gw[hit]), 0)
                d = float(push.sum())
                gb += d * d
                self.b -= bias_rate * d / math.sqrt(gb)
        self.known = {}
        return self


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_chars: int = 20_000) -> Model:
    """Train on documents joined to labels(doc_id, toxic); the join carries ids and labels first, texts last."""
    marks = only(labels, "doc_id", "toxic").filter("doc_id is not null and toxic is not null")
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = written(smallest(marks.withColumn("key", F.xxhash64("doc_id")), "toxic", "key", per_class))
    texts = only(docs, "doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)) <= most_chars)
    # At most ``per_class`` rows of each class.
    got = texts.join(F.broadcast(marks), "doc_id").select("doc_id", "text", "toxic").toPandas()
    got = got.sort_values(["doc_id", "text"]).drop_duplicates()
    return Model().fit([t or "" for t in got["text"]], [int(x) for x in got["toxic"]]) if len(got) else Model()


def scored(model: Model, spark: SparkSession, text: Column) -> Column:
    """Struct column: score, and the offending sentences with probability of at least one half."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            spans = [{"start": a, "end": b, "p": p} for a, b, p in held.value.sentences(t) if p >= 0.5]
            rows.append((held.value.score(t), spans))
        return pd.DataFrame(rows, columns=["score", "spans"])

    return of(text)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(fold != 0))
    s = scored(model, spark, F.col("text"))
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), s.alias("s"))
    return rows.select(
        "doc_id", "held_out", "s.score", (F.col("s.score") >= 0.5).cast("int").alias("predicted"),
        F.size("s.spans").cast("long").alias("n_offending"),
    )
