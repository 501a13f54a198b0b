"""BPE encoding and decoding by a traversal of a prefix trie.

The distinct pre-token words of a stretch of texts go into a trie, here as a sorted list: neighbours share their longest
common prefix, which is a depth-first walk. Each node keeps its last token. The encoding of a prefix is the encoding
of a shorter prefix plus one token, and there is exactly one token for which that holds: it ends the prefix, and it
and the last token before it stand when encoded together. So a node needs only the last-token states of its
ancestors, and a shared prefix is encoded once. Whether two tokens stand together is found by undoing their merges,
and kept. Decoding looks ids up in the byte table. The vocabulary file is read by each worker from ``path``.

A null text is the empty text: no ids. Rows are independent, so repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table

CACHE_WORDS = 250_000
PAIRS = 250_000
STRETCH = 1_000_000
LONG = 48


def _alphabet() -> dict[str, int]:
    """Printable stand-ins of the byte-level alphabet: visible Latin-1 stands for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        back = _alphabet()
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in t) for t, i in held["model"]["vocab"].items() if t not in self.special}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])
        as_id = lambda t: self.id_of[bytes(back[c] for c in t)]
        self.merge = {}
        self.rank, self.split = dict.fromkeys(self.bytes_of, -1), {}
        for rank, (a, b) in enumerate(pairs):
            pair, whole = (as_id(a), as_id(b)), as_id(a + b)
            self.merge.setdefault(pair, (rank, whole))
            if whole not in self.split:
                self.split[whole], self.rank[whole] = pair, rank
        self.ends = ahocorasick.Automaton()  # all tokens that end at a byte, in one pass
        for t, i in self.id_of.items():
            self.ends.add_word(t.decode("latin-1"), (i, len(t)))
        self.ends.make_automaton()
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.stands: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.cache: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, used on single tokens."""
        ids = [self.id_of[bytes((b,))] for b in data]
        while len(ids) > 1:
            best = min(((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merge[ids[i], ids[i + 1]][1]]
        return ids

    def _apart(self, a: int, b: int) -> bool:
        """Undo the merges of two tokens, last one first: no merge across their border may have come sooner."""
        ranks, limit = self.rank, 1 << 60
        while True:
            across = self.merge.get((a, b))
            if across is not None and across[0] < limit:
                return False
            if ranks[a] > ranks[b]:
                limit, a = ranks[a], self.split[a][1]
            elif ranks[b] < 0:
                return True
            else:  # at one rank the left place merges first
                limit, b = ranks[b] + 1, self.split[b][0]

    def fits(self, before: int, token: int) -> bool:
        if before < 0:
            known = self.alone.get(token)
            if known is None:
                known = self.alone[token] = self.merged(self.bytes_of[token]) == [token]
            return known
        if len(self.stands) > PAIRS:
            self.stands.clear()
        known = self.stands[before, token] = self._apart(before, token)
        return known

    def walk(self, words: list[str]) -> None:
        """Depth-first over the trie of ``words``; fills the cache with their ids as packed bytes."""
        last, size, past = [-1], [0], b""
        fits, stands, spell = self.fits, self.stands, self.packed
        for word in sorted(w.encode() for w in words):
            n = min(len(word), len(past))
            shared = 0
            while shared < n and word[shared] == past[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            done = shared
            for at, (token, wide) in self.ends.iter(word.decode("latin-1")):
                if at < done:
                    continue
                before = last[at + 1 - wide]
                known = stands.get((before, token))
                if fits(before, token) if known is None else known:
                    last.append(token)
                    size.append(wide)
                    done += 1
            if done < len(word):
                raise ValueError("the vocabulary lacks a byte")
            ids, at = [], len(word)
            while at:
                ids.append(spell[last[at]])
                at -= size[at]
            ids.reverse()
            self.cache[word.decode()] = b"".join(ids)
            past = word

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.words.findall(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [*self.words.findall(text[at : m.start()]), m.group()]
            at = m.end()
        return out + self.words.findall(text[at:])

    @staticmethod
    def chunks_of(text: str) -> list[str]:
        """Cut before each space that a visible character follows: no pre-token word crosses such a place."""
        parts = text.split(" ")
        if all(c and not c[0].isspace() for c in parts[1:]):
            return parts
        out, run = [], parts[:1]
        for c in parts[1:]:
            if c and not c[0].isspace():
                out.append(" ".join(run))
                run = [c]
            else:
                run.append(c)
        return [*out, " ".join(run)]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed little-endian ids per text; one trie per stretch of about ``STRETCH`` characters."""
        held, size = [], 0
        for text in texts:
            text = text or ""
            if self.cut is not None and self.cut.search(text):
                held.append((self.pieces(text), []))
            else:
                first, *rest = self.chunks_of(text)
                held.append((self.words.findall(first), rest))
            size += len(text)
            if size >= STRETCH:
                yield from self._stretch(held)
                held, size = [], 0
        yield from self._stretch(held)

    def _stretch(self, held: list[tuple[list[str], list[str]]]) -> Iterator[bytes]:
        cache, chunks = self.cache, self.chunks
        if len(cache) > CACHE_WORDS:
            cache.clear()
        if len(chunks) > CACHE_WORDS:
            chunks.clear()
        for t, i in self.special.items():
            cache[t] = self.packed[i]
        fresh = {c: self.words.findall(" " + c) for c in set().union(*[rest for _, rest in held]) if c not in chunks}
        need = {w for words in fresh.values() for w in words if w not in cache}
        need |= {w for first, _ in held for w in first if w not in cache}
        self.walk(list(need))
        for c, words in fresh.items():
            chunks[c] = b"".join([cache[w] for w in words])
        for first, rest in held:
            yield b"".join([*[cache[w] for w in first], *[chunks[c] for c in rest]])
        for known in (fresh, need):  # long ones rarely come again and would fill the caches
            for c in known:
                if len(c) > LONG:
                    (chunks if known is fresh else cache).pop(c)

    def forget(self) -> None:
        """Empty the caches: a worker outlives its task, and what it keeps adds to the memory of every later stage."""
        for held in (self.cache, self.chunks, self.stands, self.alone):
            held.clear()

    def decode(self, packed: bytes) -> str:
        return b"".join(map(self.table.__getitem__, memoryview(packed).cast("I"))).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(text: Column, path: str | None = None) -> Column:
    """Binary column: the ids as little-endian unsigned 32-bit integers."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(list(codec(path).encode(texts)))

    return of(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    @F.pandas_udf("string")
    def of(packed: pd.Series) -> pd.Series:
        return pd.Series([codec(path).decode(bytes(p)) for p in packed])

    return of(ids)


def tokenised(docs: DataFrame, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (array<int>, unless ``keep_ids`` is off), n_tokens, ids_sha256, decoded_sha256 per row."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    own = ["ids"] * keep_ids + ["n_tokens", "ids_sha256", "decoded_sha256"]

    @F.pandas_udf("ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(path)
        try:
            for texts in batches:
                rows = []
                for ids in c.encode(texts):
                    back = c.decode(ids).encode()
                    held = [np.frombuffer(ids, "<i4")] if keep_ids else []
                    rows.append((*held, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back).hexdigest()))
                yield pd.DataFrame(rows, columns=own)
        finally:
            c.forget()

    return only(docs, "doc_id", "text").select("doc_id", of("text").alias("d")).select("doc_id", "d.*")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenised(table(spark, sf_dir, "documents"), keep_ids=False)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document with their digests: what a training job reads."""
    return tokenised(docs)
