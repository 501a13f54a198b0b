"""Long texts, clashing names and seeds that the first tests did not reach."""

from __future__ import annotations

import html as entities
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from folioscope.llm import bpe, decontam, html, langid, licences, pii, simhash
from folioscope.llm.common import spare


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def test_every_replaced_pattern_keeps_a_seed():
    def kept(n, gone):
        return any(
            all(b == "0" or at + i not in gone for i, b in enumerate(m)) for m in decontam.MASKS for at in range(n - len(m) + 1)
        )

    assert all(kept(8, {i}) for i in range(8))
    assert all(kept(9, {i}) for i in range(9))
    for n in (10, 11, 12, 13, 14):
        assert all(kept(n, set(gone)) for gone in itertools.combinations(range(n), 2))


def test_replaced_items_are_all_found(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(5000)]
    items, texts = [], []
    for n in range(8, 15):
        for _ in range(6):
            item = rng.sample(vocabulary, n)
            items.append((len(items), " ".join(item)))
            for gone in [()] + rng.sample(list(itertools.combinations(range(n), 1 if n < 10 else 2)), 8):
                words = [f"other{rng.random()}".replace(".", "") if i in gone else w for i, w in enumerate(item)]
                texts.append((len(texts), " ".join(rng.sample(vocabulary, 5) + words + rng.sample(vocabulary, 5)), len(items) - 1))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string, of bigint")
    found = decontam.overlaps(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    missed = docs.withColumn("text_key", F.md5("text")).join(found, "text_key", "left").filter("items is null or not array_contains(items, of)")
    assert missed.count() == 0


@pytest.mark.parametrize("text", ["123 abc " * 250_000, "1" * 400_000, "1 " * 300_000, "+1 2" * 100_000, "1." * 200_000, "a@b.c " * 60_000])
def test_pii_of_very_long_texts(spark, text):
    rows = spark.createDataFrame([(1, text), (2, "x"), (3, None)], "_rid bigint, text string")
    found = pii.matches(rows, 0).groupBy("_rid", "kind").agg(F.count("*").alias("n"), F.max("end").alias("last")).collect()
    n = {(r["_rid"], pii.KINDS[r["kind"]]): (r["n"], r["last"]) for r in found}
    assert n == ({(1, "email"): (60_000, 60_000 * 6 - 1)} if text[0] == "a" else {(1, "ip"): (50_000, len(text) - 1)} if text == "1." * 200_000 else {})


def test_stages_keep_clashing_columns(spark, tmp_path, monkeypatch):
    names = ["_rid", "_cut", "_row", "_p", "_bad", "rid", "cut", "row", "prediction", "bad", "RID_", "a.b", "s", "rows"]
    base = "the house of the people and the water of the river that they have seen in the morning and"
    texts = [None, "", " ", "mail me at a@b.co now please", base + " more", base + " more", "one two three four five six seven eight nine ten"]
    rows = [(i if i != 2 else None, t, "en", "k", 1, *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows + rows[3:4], schema)
    bench = spark.createDataFrame([(1, "one two three four zero six seven eight nine ten")], "item_id bigint, text string")
    monkeypatch.setattr(decontam, "table", lambda *_: bench)
    held = {(r["doc_id"], r["_rid"], r["_cut"], r["_row"], r["a.b"]) for r in docs.collect()}
    sizes = {}
    for name, stage in (("language", langid.stage), ("copies", simhash.stage), ("bench", decontam.stage), ("pii", pii.stage)):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        sizes[name] = len(got)
        assert {(r["doc_id"], r["_rid"], r["_cut"], r["_row"], r["a.b"]) for r in got} <= held
        assert stage(spark, docs.limit(0), "").count() == 0
    assert sizes == {"language": sizes["language"], "copies": 5, "bench": 7, "pii": 8}
    assert [r["text"] for r in pii.stage(spark, docs, "").filter("doc_id = 3").collect()] == ["mail me at [EMAIL] now please"] * 2
    assert bpe.stage(spark, docs, "").count() == 8 and bpe.stage(spark, docs.limit(0), "").count() == 0
    assert spare(docs, "rid", "x", "X") == ["rid__", "x", "X_"]


def test_licences_with_rare_words_elsewhere(spark):
    notice = licences.TEMPLATES["mit-text"]
    gone = notice.replace("noninfringement", "quiet use")
    texts = [
        notice, gone, gone + ". unrelated talk of noninfringement here", "sublicense noninfringement merchantability " + gone,
        "merge publish distribute sublicense and sell. " + gone, notice.replace("merge publish", "merge print"),
        licences.TEMPLATES["zlib-text"].replace("freely", "often") + " freely given", "talk of noninfringement", "",
    ]
    got = {r["doc_id"]: r["labels"].split(",") for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert sorted(i for i in got if "mit-text" in got[i]) == [0, 1, 2, 3, 4]
    assert [i for i in got if "zlib-text" in got[i]] == [6]


@pytest.mark.parametrize("names, kept", [
    ("class='share price'", True), ("class='related work'", True), ("id=comment-on-law", True), ("class='social history'", True), ("class='ad'", False),
    ("class='share-buttons'", False), ("id='related_posts_3'", False), ("class='comments list'", False), ("role=navigation", False), ("class=text", True),
])
def test_html_names_of_parts_and_subjects(names, kept):
    page = f"<main><h1>T</h1><div {names}><p>The share price rose.</p></div><p class='related work'>Earlier studies</p></main>"
    assert html.extract(page) == "\n".join(["T", *["The share price rose."] * kept, "Earlier studies"])


def test_html_of_the_given_pages(spark):
    """The pages' generator puts the article's heading and paragraphs, split by break elements, in `article`; adverts inside are `ad`."""
    want = {}
    for r in html.table(spark, "/root/testdata/sf0.001", "pages").collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        inner = re.sub(r"<div class=\"ad\">.*?</div>", "", inner, flags=re.S)
        parts = [re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", b) for b in re.split(r"</?(?:p|h1|div)\b[^>]*>", inner)]
        want[r["page_id"]] = "\n".join(t for t in (re.sub(r"\s+", " ", entities.unescape(b)).strip() for b in parts) if t)
    got = {r["page_id"]: r["text"] for r in html.op8_html(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_places_are_dealt_out_once(spark, capsys):
    from folioscope.llm import substrings

    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(i, i, f"a{i} {text} b{i}") for i in range(3)], "doc long, row long, text string")
    found = substrings.factors(rows)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("hashpartitioning(a#") == 1
    assert {r["doc"]: sum(x["n"] for x in r["found"]) for r in found.collect()} == {1: 41, 2: 41}


def test_a_worker_keeps_no_words_after_its_task(spark):
    from folioscope.llm import bpe
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, f"some words {i} of a text") for i in range(50)], "doc_id long, text string").coalesce(1)
    assert bpe.tokenised(docs).filter("n_tokens > 0").count() == 50
    path = bpe.public_tokenizers.path("byte_bpe_50k.json")
    held = F.udf(lambda _: sum(map(len, (lambda c: (c.cache, c.chunks, c.stands))(bpe.codec(path)))), "long")
    assert spark.range(4).select(held("id").alias("n")).agg(F.max("n")).first()[0] == 0


def test_near_dedup_ties_by_fingerprint(spark):
    from folioscope.llm import neardup

    apart = iter(range(10**6))
    rows = [(1, 0b0), (2, 0b1111), (3, (1 << 40) - 1), (4, (1 << 40) - 1), (5, 0x5555555555555555)]  # no two share a band
    nodes = spark.createDataFrame([(s, fp, [next(apart) for _ in range(neardup.BANDS)]) for s, fp in rows], "sid long, fp long, bands array<long>")
    assert {frozenset(r) for r in neardup.ties(nodes).collect()} == {frozenset((1, 2)), frozenset((3, 4))}
    texts = [" ".join(f"w{i + k}" for i in range(400)) for k in (0, 1, 1000)]
    a, b, c = (neardup.majority(neardup.shingles(t)) & (2**64 - 1) for t in texts)
    assert (a ^ b).bit_count() <= neardup.RADIUS < (a ^ c).bit_count()
