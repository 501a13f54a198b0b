"""Language ID by a byte convolutional network.

Filters of widths 2, 3 and 4 over byte embeddings, max pooling over a fixed-length window, softmax over the languages;
trained in numpy by Adam. A text is cut into windows of ``window`` bytes (the last one padded with zeros), batches of
windows go through the network, and the mean log-probability over all windows of the whole text decides.

Training reads only text and non-null lang of the rows given to ``fit``: up to ``per_lang`` different texts of each
language, the smallest by a hash of the text, and of each up to ``cuts`` stretches spread over the text. That bound is
a parameter. Copies of a text count once, so no copied text is a language's whole sample.

Null text, or text without letters: `und`, score 0. Ties go to the smaller language code. No labelled rows: every text
is `und`. Repeated rows are scored alike; a null doc_id is never held out and trains nothing; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, only, smallest, spare, table, written

WIDTHS = (2, 3, 4)
LETTER = regex.compile(r"\p{L}")


class Net:
    def __init__(self, langs: list[str], window: int, emb: int = 8, filters: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs, self.window, self.tables = langs, window, None
        f32 = lambda *s, k=0.3: (rng.standard_normal(s) * k).astype(np.float32)
        self.p = {"E": f32(256, emb)} | {f"K{w}": f32(w * emb, filters, k=(w * emb) ** -0.5) for w in WIDTHS}
        self.p |= {f"c{w}": np.zeros(filters, np.float32) for w in WIDTHS}
        self.p |= {"W": f32(filters * len(WIDTHS), len(langs), k=0.1), "b": np.zeros(len(langs), np.float32)}

    def forward(self, x: np.ndarray):
        e, cols, tops, pools = self.p["E"][x], {}, {}, []
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            cols[w] = np.concatenate([e[:, i : i + n] for i in range(w)], axis=2)
            h = cols[w] @ self.p[f"K{w}"]
            tops[w] = h.argmax(axis=1)
            pools.append(np.maximum(h.max(axis=1) + self.p[f"c{w}"], 0))
        pool = np.concatenate(pools, axis=1)
        z = pool @ self.p["W"] + self.p["b"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True)), cols, tops, pool

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The log-probabilities of ``forward``. A filter is linear in the bytes, so tables per byte pair stand for it."""
        if self.tables is None:
            emb, one = self.p["E"].shape[1], {}
            for w in WIDTHS:
                one[w] = [self.p["E"] @ self.p[f"K{w}"][i * emb : (i + 1) * emb] for i in range(w)]
            self.tables = {
                w: [(i, (t[i][:, None] + t[i + 1][None]).reshape(1 << 16, -1)) for i in range(0, w - 1, 2)] + ([(w - 1, t[w - 1])] if w % 2 else [])
                for w, t in one.items()
            }
        x = x.astype(np.intp)
        pair, pools = (x[:, :-1] << 8) | x[:, 1:], []
        for w, parts in self.tables.items():
            n, h = x.shape[1] - w + 1, None
            for i, t in parts:
                got = np.take(t, (x if len(t) == 256 else pair)[:, i : i + n], axis=0)
                h = got if h is None else np.add(h, got, out=h)
            pools.append(np.maximum(h.max(axis=1) + self.p[f"c{w}"], 0))
        z = np.concatenate(pools, axis=1) @ self.p["W"] + self.p["b"]
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def step(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        logp, cols, tops, pool = self.forward(x)
        dz = np.exp(logp)
        dz[np.arange(len(y)), y] -= 1
        dz /= len(y)
        g = {"W": pool.T @ dz, "b": dz.sum(0), "E": np.zeros_like(self.p["E"])}
        dpool = (dz @ self.p["W"].T) * (pool > 0)
        nf, rows = self.p["b"].shape and pool.shape[1] // len(WIDTHS), np.arange(len(y))[:, None]
        for k, w in enumerate(WIDTHS):
            d = dpool[:, k * nf : (k + 1) * nf]
            seen = cols[w][rows, tops[w]]
            g[f"c{w}"] = d.sum(0)
            g[f"K{w}"] = np.einsum("nfi,nf->if", seen, d)
            de = d[:, :, None] * self.p[f"K{w}"].T[None]
            emb = self.p["E"].shape[1]
            for i in range(w):
                np.add.at(g["E"], x[rows, tops[w] + i], de[:, :, i * emb : (i + 1) * emb])
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 11):
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                part, t = order[at : at + batch], t + 1
                for k, g in self.step(x[part], y[part]).items():
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.99 * v.get(k, 0) + 0.01 * g * g
                    self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def windows(self, text: str) -> np.ndarray:
        data = np.frombuffer(text.encode(), np.uint8)
        n = -(-len(data) // self.window)
        return np.pad(data, (0, n * self.window - len(data))).reshape(n, self.window)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        x, total = self.windows(text), np.zeros(len(self.langs))
        for at in range(0, len(x), 32):
            total += self.scores(x[at : at + 32]).sum(axis=0)
        p = np.exp(total / len(x) - (total / len(x)).max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, p[best]))


def fit(labelled: DataFrame, window: int = 256, per_lang: int = 600, cuts: int = 4) -> Net:
    """Train on a bounded sample: at most ``per_lang`` rows per language, ``cuts`` stretches of each."""
    rows = only(labelled, "text", "lang").filter("lang is not null and text is not null and length(text) > 0")
    key = F.xxhash64("text")
    span = F.greatest(F.length("text") - window, F.lit(1))
    at = lambda i: F.pmod(F.xxhash64(F.lit(i), key), span).cast("int") + 1
    rows = rows.select("lang", key.alias("key"), F.array(*[F.substring("text", at(i), F.lit(window)) for i in range(cuts)]).alias("cuts"))
    # Keys first: only the chosen texts' stretches travel.
    keys = written(smallest(rows.select("lang", "key").distinct(), "lang", "key", per_lang))
    got = rows.join(keys, ["lang", "key"]).groupBy("lang", "key").agg(F.first("cuts").alias("cuts")).toPandas()
    langs = sorted(got["lang"].unique())
    net, xs, ys = Net(langs, window), [], []
    for _, r in got.sort_values(["lang", "key"]).iterrows():
        for cut in r["cuts"]:
            if LETTER.search(cut):
                xs.append(net.windows(cut)[0])
                ys.append(langs.index(r["lang"]))
    return net.fit(np.array(xs), np.array(ys)) if xs else Net([], window)


def predicted(net: Net, spark: SparkSession, text: Column) -> Column:
    """Struct column lang_pred, score."""
    held = spark.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return of(text)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    net = fit(docs.filter(fold != 1))
    p = predicted(net, spark, F.col("text"))
    return docs.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), p.alias("p")).select("doc_id", "held_out", "p.*")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.4) -> DataFrame:
    """Keep the documents whose language is told with a score of at least ``least``."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    net = fit(docs.filter(fold != 1))
    p = predicted(net, spark, F.col("text"))
    (own,) = spare(docs, "prediction")
    kept = docs.withColumn(own, p).filter((F.col(f"{own}.lang_pred") != "und") & (F.col(f"{own}.score") >= least))
    return kept.select(*columns(docs))
