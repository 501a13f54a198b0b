"""Merging sinks on real streams that crash and start again; properties and ink on hand-made fixtures."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import ink
from folioscope.sources import properties
from folioscope.streaming import merge


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def streamed(spark, rows, schema, sink, root, crash_at=None):
    """Run ``sink`` over one file of rows per batch; a crash comes after the sink has written, as if the commit were lost."""
    source = root / "in"
    for n, part in enumerate(rows):
        if not (source / f"{n}").exists():
            spark.createDataFrame(part, schema).coalesce(1).write.json(str(source / f"{n}"))
    crashed = []

    def step(batch, n):
        sink(batch, n)
        if n == crash_at and not crashed:
            crashed.append(n)
            raise RuntimeError("crash")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(source))
        q = stream.writeStream.foreachBatch(step).option("checkpointLocation", str(root / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    if crash_at is not None:
        with pytest.raises(Exception, match="crash"):
            run()
    run()
    assert (crash_at is None) or crashed == [crash_at]


SENT = "event_id long, ts timestamp, header string, age int, size long, signed boolean"


def test_deliveries_survive_a_crash(spark, tmp_path):
    good = lambda i, t: (i, f"2024-01-0{t} 00:00:00", "v1=1", 0, 10, True)
    rows = [
        [good(1, 1), good(1, 1), good(2, 1), (3, "2024-01-01 00:00:00", None, 0, 10, True), (None, "2024-01-01 00:00:00", "v1=1", 0, 10, True)],
        [good(2, 1), good(3, 1), good(4, 2), (4, "2024-01-02 00:00:00", "v1=1", 0, 10, False)],
        [good(4, 2), good(5, 3), good(3, 1), (6, "2024-01-03 00:00:00", "v1=1", 301, 10, True), (7, "2024-01-03 00:00:00", "bad", 0, 10, True), good(None, 3)],
    ]
    rows = [[(r[0], __import__("datetime").datetime.fromisoformat(r[1]), *r[2:]) for r in part] for part in rows]
    streamed(spark, rows, SENT, merge.deliver(str(tmp_path / "t")), tmp_path, crash_at=1)
    got = merge.deliveries(spark, str(tmp_path / "t")).collect()
    assert sorted((r["event_id"] or 0, r["status"]) for r in got) == sorted([
        (0, "accept"), (0, "accept"), (1, "accept"), (1, "duplicate"), (2, "accept"), (2, "duplicate"), (3, "no header"), (3, "accept"), (3, "duplicate"),
        (4, "accept"), (4, "mismatch"), (4, "duplicate"), (5, "accept"), (6, "out of tolerance"), (7, "malformed"),
    ])


def test_profile_survives_a_crash_and_compacts(spark, tmp_path):
    rows = [[("a", 1), ("a", 1), ("b", 1)], [("a", 2), ("a", 1)], [("c", None), ("b", 1)]]
    streamed(spark, rows, "key string, file long", merge.profile_parts(str(tmp_path / "t")), tmp_path, crash_at=1)
    want = {("a", 4, 2), ("b", 2, 1), ("c", 1, 0)}
    assert {tuple(r) for r in merge.finalised(spark, str(tmp_path / "t")).collect()} == want
    merge.compacted(spark, str(tmp_path / "t"), str(tmp_path / "u"))
    assert {tuple(r) for r in merge.finalised(spark, str(tmp_path / "u")).collect()} == want
    merge.profile_parts(str(tmp_path / "u"))(spark.createDataFrame([("c", 3)], "key string, file long"), 3)
    assert ("c", 2, 1) in {tuple(r) for r in merge.finalised(spark, str(tmp_path / "u")).collect()}
    assert merge.finalised(spark, str(tmp_path / "none")).count() == 0


def test_retry_leaves_poison_aside(spark, tmp_path):
    ticks, manifest = [[(n,)] for n in range(5)], [(1, "ok"), (2, "bad"), (3, None), (4, "flaky")]

    def work(content):
        import os

        if content == "flaky":
            path = str(tmp_path / "flaky")
            with open(path, "a") as f:
                f.write("x")
            if os.path.getsize(path) < 2:
                raise OSError("not yet")
        return content.upper().replace("BAD", str(1 / 0) if content == "bad" else "")

    def given(s):
        return s.createDataFrame(manifest, "source long, content string")

    folder = str(tmp_path / "t")
    streamed(spark, ticks, "n int", merge.attempt(folder, work, given), tmp_path, crash_at=2)
    assert {tuple(r) for r in merge.results(spark, folder).collect()} == {(1, "OK"), (4, "FLAKY")}
    poison = {r["source"]: (r["tries"], r["error"].split(":")[0]) for r in merge.failed(spark, folder).collect()}
    assert poison == {2: (3, "ZeroDivisionError"), 3: (3, "AttributeError")}
    assert merge.pending(spark, given(spark), folder).count() == 0
    assert merge.pending(spark, given(spark), str(tmp_path / "none")).count() == 4


def test_properties_of_any_depth(spark):
    events = [
        {"t": "a", "p": {"w": {"v": 1.5, "u": "in"}, "g": {"v": 2, "u": ""}, "s": "x" * 130, "n": 3, "b": True, "z": None, "o": {"v": 1}}},
        {"t": "b", "s": "text"},
        {"t": "c", "p": {"l": [{"k": {"v": 1, "u": "%"}, "m": [{"d": "deep"}, [1]]}, 5, None, {"k": "y"}], "e": []}},
        {"t": "d", "p": "no object"},
    ]
    rows = [(1, json.dumps({"ok": True, "events": events})), (2, "{broken"), (3, None), (4, '{"ok":false}'), (5, '{"events":[]}')]
    found = properties.exploded(spark.createDataFrame(rows, "file int, envelope string"), "file", "envelope")
    assert [(r["file"], r["pos"], r["t"], r["s"]) for r in found.orderBy("pos").collect()] == [(1, i, e["t"], e.get("s")) for i, e in enumerate(events)]
    got = {(r["key"], r["kind"], r["unit"], r["value"], r["items"]) for r in properties.properties(found, "file", "pos").collect()}
    assert got == {
        ("w", "measure", "in", 1.5, None), ("g", "measure", "(generic)", 2.0, None), ("s", "string", None, None, None), ("n", "number", None, 3.0, None),
        ("b", "boolean", None, None, None), ("z", "object", None, None, None), ("o", "object", None, None, None), ("l", "vector", None, None, 4),
        ("l[].k", "measure", "%", 1.0, None), ("l[].k", "string", None, None, None), ("l[].m", "vector", None, None, 2), ("l[].m[].d", "string", None, None, None),
        ("e", "vector", None, None, 0),
    }
    profile = {r["key"]: r for r in properties.property_profile(properties.properties(found, "file", "pos"), "file", "pos").collect()}
    assert (profile["l[].k"]["n"], profile["l[].k"]["files"], profile["l[].k"]["kinds"], profile["l[].k"]["units"]) == (2, 1, {"measure": 1, "string": 1}, {"%": 1})
    assert profile["s"]["samples"] == ['"' + "x" * 119 + "…"] and profile["l"]["samples"] == ['{"length":4}'] and profile["b"]["units"] is None
    events = {r["t"]: (r["n"], r["files"], r["keys"]) for r in properties.event_profile(found, "file").collect()}
    assert events["c"] == (1, 1, {"l": 1, "e": 1}) and events["b"] == (1, 1, None)


def plain_agreement(a, b, w, h):
    """Pictures as {(x, y): (r, g, b)}; by going through every place."""
    mask = lambda p: {k for k, c in p.items() if 255 - min(c) > 32}

    def alike(c, d):
        c, d = [255 - v for v in c], [255 - v for v in d]
        dot = sum(x * y for x, y in zip(c, d))
        return dot > 0 and dot >= 0.97 * (sum(x * x for x in c) * sum(x * x for x in d)) ** 0.5

    def radius(p, q, k, colour):
        return min((max(abs(k[0] - m[0]), abs(k[1] - m[1])) for m in mask(q) if max(abs(k[0] - m[0]), abs(k[1] - m[1])) <= 2 and (not colour or alike(p[k], q[m]))), default=9)

    ra, rb = {k: radius(a, b, k, True) for k in mask(a)}, {k: radius(b, a, k, True) for k in mask(b)}
    near = {k: radius(a, b, k, False) for k in mask(a)}
    inks = len(ra) + len(rb)
    score = [1.0 if not inks else round((sum(r <= k for r in ra.values()) + sum(r <= k for r in rb.values())) / inks, 4) for k in range(3)]
    gaps = [max(abs(x - y) for x, y in zip(a.get((x, y), (255,) * 3), b.get((x, y), (255,) * 3))) for x in range(w) for y in range(h)]
    lost = {k for k, r in ra.items() if r > 1}
    added = {k for k, r in rb.items() if r > 1} - lost
    return (len(ra), len(rb), *score, sum(r > 2 and near[k] > 2 for k, r in ra.items()), sum(r > 2 and near[k] <= 2 for k, r in ra.items()), gaps.count(0), sum(g <= 16 for g in gaps), len(lost), len(added), len({*ra, *rb} - lost - added))


def test_ink_against_every_place(spark):
    rng = random.Random(6)
    colours = [(0, 0, 0), (120, 120, 120), (230, 230, 230), (200, 0, 0), (255, 120, 120), (0, 0, 90), (250, 250, 255)]
    pictures, sizes, rows = {}, [], []
    for img in range(12):
        w, h = rng.randint(4, 14), rng.randint(4, 14)
        for side in (0, 1):
            sw, sh = w - side * (img % 3), h - (1 - side) * (img % 2)
            held = {} if img == 0 else {(rng.randrange(sw), rng.randrange(sh)): rng.choice(colours) for _ in range(rng.randint(0, 25))}
            pictures[img, side] = held
            sizes.append((img, side, sw, sh))
            rows += [(img, side, *k, *c) for k, c in held.items()]
    pixels = spark.createDataFrame(rows, "img int, side int, x int, y int, r int, g int, b int")
    got = ink.agreement(pixels, spark.createDataFrame(sizes, "img int, side int, w long, h long"))
    cols = ("ink0", "ink1", "score0", "score1", "score2", "lost", "recoloured", "exact", "close", "diff_lost", "diff_added", "diff_agreed")
    for r in got.collect():
        assert tuple(r[c] for c in cols) == pytest.approx(plain_agreement(pictures[r["img"], 0], pictures[r["img"], 1], r["w"], r["h"]), abs=1e-4), r["img"]
        assert r["diff_background"] == r["total"] - r["diff_lost"] - r["diff_added"] - r["diff_agreed"]
    assert got.count() == 12
