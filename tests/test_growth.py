"""Work that grows with the tables is dealt out by rows, and takes no more steps per row than it needs."""

from __future__ import annotations

import random
import time

import pandas as pd
import pytest

from folioscope.functions import charsets
from folioscope.operators import drawings, formats, joins

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def test_drawings_are_dealt_out_by_orders(spark):
    assert drawings.drawn(spark, SF).select("doc").rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/orders.parquet").count() // 10_000)


def test_formats_are_dealt_out_by_parts(spark):
    assert formats._formats(spark, SF).select("p_partkey").rdd.getNumPartitions() == -(-spark.read.parquet(f"{SF}/part.parquet").count() // 5_000)


def test_pages_with_undefined_bytes_are_read_at_once():
    data = b"abc\x81\x80" * 1_000_000
    start = time.perf_counter()
    (text,) = charsets._decoded(pd.Series([data]), pd.Series(["windows1252"]))
    assert time.perf_counter() - start < 0.5
    assert text == "abc\x81€" * 1_000_000
    for page in (c for c in set(charsets.CODECS.values()) if c.startswith("cp125")):
        label = next(k for k, v in charsets.CODECS.items() if v == page)
        for x in range(256):
            (one,) = charsets._decoded(pd.Series([bytes([x])]), pd.Series([label]))
            assert one == (bytes([x]).decode(page, "ignore") or chr(x))


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_pixels_meet_in_cells(spark, capsys, radius):
    draw = random.Random(radius)
    side = lambda: [(i, x, y, draw.randrange(3)) for i in range(2) for x in range(-6, 9) for y in range(-3, 8) if draw.random() < 0.1]
    a, b = side(), side()
    make = lambda rows: spark.createDataFrame(rows, "img int, x int, y int, c int")
    found = joins.ink_neighbours(make(a), make(b), radius)
    found.explain()
    assert "sequence(" not in capsys.readouterr().out
    far = lambda p, q: max(abs(p[1] - q[1]), abs(p[2] - q[2]))
    low = lambda d: min((x for x in d if x <= radius), default=None)
    want = {p[:3]: (low([far(p, q) for q in b if q[0] == p[0]]), low([far(p, q) for q in b if q[0] == p[0] and q[3] == p[3]])) for p in a}
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found.collect()} == want
