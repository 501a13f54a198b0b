"""Licence scan by a positional rare-token index, in DataFrame functions only.

Each text keeps only its licence words with their positions. Corpus document counts give each licence word its IDF,
and each file's licence words are ranked by it. A template is looked up by the file's highest-IDF word of its mandatory
key phrase: every place of that word, at every offset the phrase has it at, is a place where the template may start
(position less offset). There the postings of the template are intersected with the file's words by relative position;
the template counts if at least ``share`` of its IDF weight stands at its own offsets, and the key phrase stands whole.
As the phrase must stand whole, its words stand at every place that counts, so one of them finds all such places,
whatever rare words of the template stand elsewhere in the file or are missing from the notice.
A file without a template's words has no place to look at; one with many has windows of twice the template's length to
read for each, so long files cost in proportion. Nothing is shuffled but the counts of the licence words.

Null or empty text: no words, no labels, score 0. Repeated rows are judged apart and alike. With no documents there
are no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, only, table, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Base phrases, templates (the notices that licences ask for, and short references), the key phrase of
# each, and words too common to index.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
_GNU_END = (
    " but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"
    " see the gnu {0}general public license for more details you should have received a copy of the gnu {0}general"
    " public license along with this program"
)
TEMPLATES = {
    "agpl": "gnu affero general public license",
    "agpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
    " affero general public license as published by the free software foundation either version 3 of the license or at"
    " your option any later version this program is distributed in the hope that it will be useful" + _GNU_END.format("affero "),
    "apache-2.0": "licensed under the apache license version 2 0",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in"
    " compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"
    " unless required by applicable law or agreed to in writing software distributed under the license is distributed"
    " on an as is basis without warranties or conditions of any kind either express or implied see the license for the"
    " specific language governing permissions and limitations under the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided"
    " that the following conditions are met redistributions of source code must retain the above copyright notice this"
    " list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright"
    " notice this list of conditions and the following disclaimer in the documentation and or other materials provided"
    " with the distribution",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-text": "this work is licensed under a creative commons attribution 4 0 international license",
    "gpl-2-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
    " general public license as published by the free software foundation either version 2 of the license or at your"
    " option any later version this program is distributed in the hope that it will be useful" + _GNU_END.format(""),
    "gpl-3-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu"
    " general public license as published by the free software foundation either version 3 of the license or at your"
    " option any later version this program is distributed in the hope that it will be useful" + _GNU_END.format(""),
    "gpl-3.0": "licensed under the gnu general public license version 3",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is"
    " hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "lgpl": "gnu lesser general public license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and"
    " associated documentation files the software to deal in the software without restriction including without"
    " limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
    " and to permit persons to whom the software is furnished to do so subject to the following conditions the above"
    " copyright notice and this permission notice shall be included in all copies or substantial portions of the"
    " software the software is provided as is without warranty of any kind express or implied including but not limited"
    " to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-start": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mit-use": "released under the mit license",
    "mpl-2.0": "terms of the mozilla public license v 2 0",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the"
    " mpl was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify"
    " publish use compile sell or distribute this software either in source code form or as a compiled binary for any"
    " purpose commercial or non commercial and by any means",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be"
    " held liable for any damages arising from the use of this software permission is granted to anyone to use this"
    " software for any purpose including commercial applications and to alter it and redistribute it freely",
}
KEYS = {
    "agpl": "affero general public", "agpl-notice": "affero general public license", "apache-2.0": "apache license version 2",
    "apache-notice": "required by applicable law", "bsd": "binary forms", "bsd-text": "must reproduce",
    "cc-by": "cc by 4", "cc-by-nc": "cc by nc", "cc-by-sa": "cc by sa", "cc-by-text": "creative commons attribution 4",
    "gpl-2-notice": "version 2", "gpl-3-notice": "version 3", "gpl-3.0": "public license version 3",
    "isc-text": "permission notice appear", "lgpl": "lesser general public", "mit-text": "merge publish distribute sublicense",
    "mit-start": "hereby granted free", "mit-use": "mit license", "mpl-2.0": "mozilla public license",
    "mpl-notice": "source code form", "unlicense": "unencumbered software released", "zlib-text": "held liable",
}
COMMON = frozenset("a all an and any are as at be by do either for form from if in including is it no not of on one or other persons see so that the this to use was whom will with you your".split()) - {"by"}


class Template:
    def __init__(self, label: str, idf: dict[str, float]):
        self.label, self.words = label, TEMPLATES[label].split()
        key = KEYS[label].split()
        at = next(i for i in range(len(self.words)) if self.words[i : i + len(key)] == key)
        held = {i for i in range(len(self.words)) if self.words[i] not in COMMON}  # no key phrase has a common word
        total = sum(idf[self.words[i]] for i in held)
        self.posts = [(self.words[i] if i in held else None, idf[self.words[i]] / total if i in held else 0.0, at <= i < at + len(key)) for i in range(len(self.words))]
        self.keys = len(key)
        self.offsets: dict[str, list[int]] = {}
        for i in range(at, at + len(key)):
            self.offsets.setdefault(self.words[i], []).append(i)


def _vocabulary() -> list[str]:
    held = {w for p in PHRASES.values() for w in p.split()}
    for text in TEMPLATES.values():
        held |= {w for w in text.split() if w not in COMMON}
    return sorted(held)


def _part(t: Template, ranked: Column) -> Column:
    """The largest share of the template's weight at a place where its key phrase stands, 0 if nowhere."""
    size = len(t.words)
    posts = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).alias("p"), F.lit(k).alias("k")) for w, p, k in t.posts])
    offsets = F.create_map(*[x for w, at in t.offsets.items() for x in (F.lit(w), F.array(*map(F.lit, at)))])
    own = F.array(*[F.lit(w) for w in t.offsets])
    rare = F.get(F.filter(ranked, lambda w: F.array_contains(own, w)), F.lit(0))

    def places(h: Column, k: Column) -> Column:
        near = F.slice("hits", F.greatest(k + 1 - size, F.lit(1)), F.lit(2 * size))

        def share(off: Column) -> Column:
            start = h["i"] - off
            here = F.filter(near, lambda x: (x["i"] >= start) & (x["i"] < start + size))
            here = F.transform(here, lambda x: F.struct(x["w"].alias("w"), F.get(posts, x["i"] - start).alias("t")))
            here = F.filter(here, lambda x: x["w"] == x["t"]["w"])
            key = F.size(F.filter(here, lambda x: x["t"]["k"]))
            part = F.aggregate(here, F.lit(0.0), lambda a, x: a + x["t"]["p"])
            return F.when(key == t.keys, part).otherwise(0.0)

        return F.when(h["w"] == rare, F.array_max(F.transform(F.element_at(offsets, h["w"]), share)))

    return F.when(rare.isNull(), 0.0).otherwise(F.coalesce(F.array_max(F.transform("hits", places)), F.lit(0.0)))


def scan(docs: DataFrame, share: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    vocabulary = _vocabulary()
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    rows = only(docs, "doc_id", "text").select("doc_id", words.alias("words"))
    numbered = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(w.alias("w"), i.alias("i"))))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_compact(numbered).alias("hits"))
    rows = written(rows)

    def follows(h, k, text):
        first, *rest = text.split()
        ok = h["w"] == first
        for n, w in enumerate(rest, 1):
            nxt = F.get("hits", k + n)
            ok = ok & F.coalesce((nxt["w"] == w) & (nxt["i"] == h["i"] + n), F.lit(False))
        return ok

    def place(h, k):
        label = F.lit(None)
        for name, text in PHRASES.items():
            label = F.when(follows(h, k, text), F.lit(name)).otherwise(label)
        return F.struct(h["i"].cast("long").alias("i"), label.alias("l"))

    base = F.filter(F.transform("hits", place), lambda p: p["l"].isNotNull())
    rows = rows.withColumn("base", base)

    counts = rows.select(F.explode(F.array_distinct(F.col("hits.w"))).alias("w")).groupBy("w").count()
    seen = {r["w"]: r["count"] for r in counts.collect()}  # at most one row per vocabulary word
    total = rows.count()
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) + 1 for w in vocabulary}
    place_of = F.create_map(*[x for n, w in enumerate(sorted(vocabulary, key=lambda w: (-idf[w], w))) for x in (F.lit(w), F.lit(n))])
    ranked = F.array_sort(F.transform(F.array_distinct(F.col("hits.w")), lambda w: F.struct(F.element_at(place_of, w).alias("n"), w.alias("w"))))
    rows = rows.withColumn("ranked", F.transform(ranked, lambda r: r["w"]))
    templates = [Template(label, idf) for label in TEMPLATES]
    found = [F.struct(F.lit(t.label).alias("l"), _part(t, F.col("ranked")).alias("p")) for t in templates]
    rows = rows.withColumn("found", F.filter(F.array(*found), lambda f: f["p"] >= share - 1e-9))
    names = F.array_distinct(F.col("base.l"))
    part = F.least(F.lit(1.0), F.round(F.coalesce(F.array_max("found.p"), F.lit(0.0)), 6))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.i").alias("first_word"), F.array_max("base.i").alias("last_word"),
        F.array_join(F.array_sort(names), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(names, F.col("found.l"))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(part).alias("score"),
    )


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
