"""Line breaking and column packing on hand-worked paragraphs, and against a plain reading on drawn ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import layout

PARAGRAPH = "id int, width double, indent double, margin_left double, margin_right double, margin_top double, margin_bottom double, line_height double"
RUN = "id int, run int, text string, size double, font string"
ONE = [("f", c, 1.0) for c in "abcdefghijklmnopqrstuvwxyz"] + [("f", " ", 1.0), ("f", "i", 0.5), ("g", "a", 2.0)]


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def broken(spark, paragraphs, runs):
    widths = spark.createDataFrame([x for x in ONE if x != ("f", "i", 1.0)], "font string, ch string, width double")
    rows = layout.lines(spark.createDataFrame(paragraphs, PARAGRAPH), spark.createDataFrame(runs, RUN), widths, "id", unknown=3.0)
    return [tuple(r) for r in rows.orderBy("id", "line").collect()]


def test_lines(spark):
    full = lambda i, w, **k: (i, w, *[k.get(c) for c in ("indent", "left", "right", "top", "bottom", "leading")])
    paragraphs = [
        full(1, 8.0), full(2, 8.0, indent=4.0, left=1.0, right=1.0, top=5.0, bottom=7.0, leading=2.0), full(3, 0.0), full(4, 20.0), full(5, 20.0), full(6, 5.0), full(7, 5.0)
    ]
    runs = [
        (1, 0, "  ab cd  ef ", 1.0, "f"), (1, 1, " gh\r\n\n ij", 1.0, "f"),
        (2, 0, "ab cd ef gh", 1.0, "f"), (3, 0, "abc d", 1.0, "f"), (5, 0, "", 1.0, "f"), (5, 1, None, 2.0, "f"),
        (6, 0, "ab ", None, "f"), (6, 1, "a", 1.0, "g"), (7, 0, "é a\tb", 1.0, "f"),
    ]
    got = broken(spark, paragraphs, runs)
    text = lambda i: [r[2] for r in got if r[0] == i]
    assert text(1) == ["ab cd", "ef gh", "", "ij"]
    assert [r[8] for r in got if r[0] == 1] == [0.0] * 4 and [r[9] for r in got if r[0] == 1] == [False, True, True, True]
    assert [r[3] for r in got if r[0] == 1] == [5.0, 5.0, 0.0, 1.5]
    assert [r[2:] for r in got if r[0] == 2] == [
        ("ab", 2.0, 1.0, 2.0, 5.0, 5.0, 0.0, False), ("cd ef", 5.0, 1.0, 2.0, 1.0, 0.0, 0.0, False), ("gh", 2.0, 1.0, 2.0, 1.0, 0.0, 7.0, True)
    ]
    assert text(3) == ["abc", "d"]  # a line has a point at least, and a word at least
    assert [r[2:6] for r in got if r[0] in (4, 5)] == [("", 0.0, 12.0, 12 * 1.2)] * 2
    assert [r[2:5] for r in got if r[0] == 6] == [("ab", 24.0, 12.0), ("a", 2.0, 1.0)]
    assert text(7) == ["é a", "b"]  # a tab is a space, an unknown character three wide


def test_lines_of_drawn_paragraphs(spark):
    rng = random.Random(3)
    paragraphs, runs, want = [], [], {}
    for i in range(60):
        width, indent = float(rng.randint(1, 30)), float(rng.randint(-3, 6))
        text = "".join(rng.choice(["a", "bb", "ccc", " ", "  ", "\n", "i"]) for _ in range(rng.randint(0, 80)))
        paragraphs.append((i, width, indent, None, None, None, None, None))
        runs.append((i, 0, text, 1.0, "f"))
        measure = lambda s: sum(0.5 if c == "i" else 1.0 for c in s)
        out, line, room = [], "", max(1.0, width - indent)
        for part in text.split("\n"):
            words = part.split(" ")
            gap = ""
            for k, word in enumerate(words):
                if k and line:
                    gap += " "
                if not word:
                    continue
                if line and measure(line + gap + word) > room:
                    out.append(line)
                    line, room = word, max(1.0, width)
                else:
                    line += (gap if line else "") + word
                gap = ""
            out.append(line)
            line, room = "", max(1.0, width)
        if len(out) > 1 and not part.strip(" "):
            out.pop()  # a break ends its line and opens none
        want[i] = out
    got = broken(spark, paragraphs, runs)
    for i in want:
        assert [r[2] for r in got if r[0] == i] == want[i], i


def test_columns_and_overset(spark):
    placed = [(1, p, l, h, 0.0, 0.0) for p, l, h in [(0, 0, 6.0), (0, 1, 5.0), (1, 0, 5.0), (2, 0, 30.0), (2, 1, 1.0)]] + [(2, 0, n, 9.0, 1.0, 2.0) for n in range(3)]
    boxes = spark.createDataFrame([(1, 10.0, 3), (2, 10.0, None)], "box int, height double, columns int")
    got = layout.columns(boxes, spark.createDataFrame(placed, "box int, par int, line int, height double, before double, after double"), "box", "par").orderBy("box", "par", "line")
    assert [r["column"] for r in got.collect()] == [0, 1, 1, 2, 2, 0, 0, 0]
    width, over = layout.column_width(*[F.col(c) for c in ("w", "n", "gap", "big", "page", "x")])
    rows = spark.createDataFrame([(100.0, 3, 5.0, 12.0, 600.0, 50.0), (20.0, 2, 5.0, 12.0, 600.0, 50.0), (10.0, 1, 9.0, 12.0, 60.0, 50.0), (50.0, None, None, 12.0, 60.0, 0.0)], "w double, n int, gap double, big double, page double, x double")
    assert [tuple(r) for r in rows.select(width, over).collect()] == [(30.0, False), (532.0, True), (12.0, True), (50.0, False)]
