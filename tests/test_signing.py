"""Signatures in one pass over a text, held against the same rules as DataFrames."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions.scalars import decode_entities
from folioscope.operators import drawings, signing
from folioscope.sources import markup

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_signatures_need_no_shuffle(spark):
    rows = drawings.signatures(spark.createDataFrame([(1, "<svg><path d='M1 2l3 4'/></svg>"), (None, "<g/>"), (2, None)], "id int, svg string"), "id", "svg")
    assert "Exchange" not in plan(rows)
    assert {r["id"]: (r["total"], r["points"], r["paths"], r["bbox"] and tuple(r["bbox"])) for r in rows.collect()} == {
        1: (2, 2, {"M": 1, "L": 1}, (1, 2, 3, 4)), None: (1, 0, {}, None), 2: (0, 0, {}, None)
    }


def test_texts_are_scanned_once_per_version(spark):
    for run in (drawings.d13_drawing_baseline, drawings.d13_baseline_pass, drawings.d14_drawing_compare):
        said = plan(run(spark, SF))
        assert said.count("MapInArrow") == 2 and "Window" not in said and "Generate" not in said


def test_versions_meet_without_a_broadcast(spark):
    assert "Broadcast" not in plan(drawings.d14_drawing_compare(spark, SF))


def test_signatures_meet_in_tasks_of_bounded_rows(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(drawings, "spread", lambda df, rows, each, *keys: (dealt.append((rows, each, keys)), df.repartition(3, *keys))[1])
    drawings.d14_drawing_compare(spark, SF)
    assert [d for d in dealt if d[2] == ("doc",)] == [(1500, 100_000, ("doc",))] * 2


def test_paths_as_in_frames(spark):
    draw = random.Random(3)
    number = lambda: draw.choice(("1", "-2", ".5", "3.", "-1e1", "4E-1", "0", "7"))
    paths = ["".join(draw.choice("MmLlHhVvCcSsQqTtAaZz") + " ".join(number() for _ in range(draw.choice((0, 1, 2, 3, 4, 6, 7, 14)))) for _ in range(draw.randrange(7))) for _ in range(400)]
    want = {i: ({}, []) for i in range(len(paths))}
    for r in drawings.path_steps(spark.createDataFrame(list(enumerate(paths)), "id int, d string"), "id").orderBy("id", "step").collect():
        counts, points = want[r["id"]]
        counts[r["command"]] = counts.get(r["command"], 0) + 1
        points += [(round(p["x"], 6), round(p["y"], 6)) for p in r["points"]]
    for i, d in enumerate(paths):
        counts = {}
        points = [(round(x, 6) + 0.0, round(y, 6) + 0.0) for x, y in signing.walked(d, counts)]
        assert (counts, points) == want[i], d


def test_matrices_as_in_frames(spark):
    draw = random.Random(4)
    number = lambda: draw.choice(("1", "-2", "0.5", "30", "90", "3e0"))
    turn = lambda: f"{draw.choice(('translate', 'scale', 'rotate', 'skewX', 'skewY', 'matrix', 'other'))}({' '.join(number() for _ in range(draw.choice((0, 1, 2, 3, 6))))})"
    tag = lambda: draw.choice(("</g>", "<g>", f"<g transform='{turn()} {turn()}'>", f"<line x1='1' y1='2' x2='3' y2='5' transform='{turn()}'/>", "<line x2='1' y2='1'/>"))
    texts = ["".join(tag() for _ in range(12)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, svg string")
    opens = drawings.opened(docs, "id", "svg").filter("not closing").select("id", "pos", "alone", "depth", markup.attribute("attrs", "transform").alias("transform"), "name", *[F.coalesce(markup.attribute("attrs", k), F.lit("0")).cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")])
    rows = opens.filter("name = 'line'").join(drawings.placed(opens, "id"), ["id", "pos"], "left")
    want = {}
    for r in rows.collect():
        a, b, c, d, e, f = r["ctm"] or (1, 0, 0, 1, 0, 0)
        want.setdefault(r["id"], []).extend((a * x + c * y + e, b * x + d * y + f) for x, y in ((r["x1"], r["y1"]), (r["x2"], r["y2"])))
    for i, text in enumerate(texts):
        got = dict(zip(signing._TYPES, signing.signature(text)))
        points = want.get(i, [])
        assert got["points"] == len(points)
        if points:
            assert [got[k] for k in ("min_x", "max_x", "min_y", "max_y")] == pytest.approx([f(p[i] for p in points) for i in (0, 1) for f in (min, max)], abs=1e-9), text


def test_odd_numbers_and_references_as_in_spark(spark):
    words = ["1", " 2 ", "+3.", ".5e-1", "1d", "2F", "0x1p3", "0x.8p+1", "1e999", "-1e999", "nan", "NaN", "-NaN", "-inf", "+Infinity", "INF", "", "x", "1_0", "٣", "--1", "1e", "\x016\x02", "infinit"]
    want = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.col("w").try_cast("double").alias("d"))
    assert {r["w"]: str(r["d"]) for r in want.collect()} == {w: str(signing.double(w)) for w in words}
    texts = ["&amp;lt;", "&#65;&#x42;", "&#38;lt;", "&#0;", "&#xD800;", "&#1114112;", "&#99999999;", "&#65279;", "&&#66;&", "&#;", "a&quot;&apos;&gt;", "&#128512;"]
    want = spark.createDataFrame([(t,) for t in texts], "t string").select("t", decode_entities(F.col("t")).alias("d"))
    assert {r["t"]: r["d"] for r in want.collect()} == {t: signing.decoded(t) for t in texts}


def test_long_texts_are_linear():
    text = "<svg>" + "<g transform='scale(1)'>" * 20_000 + "<path d='m1 1" + "l1 0 0 1" * 20_000 + "'/>" + "</g>" * 20_000 + "</svg>"
    got = dict(zip(signing._TYPES, signing.signature(text)))
    assert (got["total"], got["points"], got["max_x"], got["max_y"]) == (20_002, 40_001, 20_001, 20_001)
