"""Report files: order, header, safe cells, summary, over several parts."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.sources import reports


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def results(spark):
    w = lambda code, message, page=None, count=None: (code, message, page, count)
    rows = [
        ("=b.doc", "/x/b", 2048, "converted", [("pdf", "b.pdf"), ("pdf", ""), ("svg", "b,1.svg")], 2, [], None, None, ("pdf", True, "asked"), 1234),
        ("é.doc", None, 10, "converted-with-caveats", [], 1, [w("X", "first", 3), w("SHADOW_DROPPED", "s", 2, 5), w("X", "second", 1, 2), w("X", "third", 3)], None, "see \"note\"\n", ("svg", False, None), None),
        ("c.doc", None, None, "converted-with-caveats", None, None, [w("A", "only")], ["the disk is full"], None, None, None),
        ("d.doc", None, 0, "failed", [], 0, None, [], "no", None, 5), ("e.doc", None, 5, "skipped", [], 0, [], ["p"], None, None, 5),
    ]
    return spark.createDataFrame(rows, reports.RESULT)


def parts(path):
    return [p.read_bytes().decode() for p in sorted(Path(path).glob("part-*"))]


def test_csv_report(spark, tmp_path):
    reports.write_csv(results(spark), str(tmp_path / "r"))
    text = "".join(parts(tmp_path / "r"))
    lines = text.split("\r\n")
    assert lines[0] == "﻿" + ",".join(reports.COLUMNS) and text.count("﻿") == 1 and lines[-1] == ""
    assert lines[1] == "d.doc,0,0 B,Could not be converted,yes,0,,,,,,no"
    assert lines[2] == 'c.doc,,,"Converted, but something was lost",yes,,,,,,the disk is full; only,'
    assert lines[3] == 'é.doc,10,10 B,"Converted, but something was lost",yes,1,,svg,no,,"A shadow is missing. (5 times, page 2); first (4 times, pages 1 and 3)","see ""note""\n"'
    assert lines[4] == "'=b.doc,2048,2.0 KB,Converted,no,2,\"b.pdf; b,1.svg\",pdf; svg,yes,asked,,"
    assert lines[5] == "e.doc,5,5 B,Skipped,yes,0,,,,,p,"


def test_json_report(spark, tmp_path):
    reports.write_json(results(spark), str(tmp_path / "r"), command="convert", root=None)
    head, *files = [json.loads(x) for x in "".join(parts(tmp_path / "r")).splitlines()]
    assert head["command"] == "convert" and "root" not in head
    assert head["summary"] == {"total": 5, "failed": 1, "unreadable": 0, "converted-with-caveats": 2, "converted": 1, "skipped": 1, "attention": 4, "written": 4, "outputs": 3}
    assert [f["file"] for f in files] == ["d.doc", "c.doc", "é.doc", "=b.doc", "e.doc"]
    assert files[3]["seconds"] == 1.23 and files[3]["outputs"][1] == {"format": "pdf", "path": ""} and "note" not in files[3]
    assert files[1]["lost"] == ["the disk is full", "only"]


def test_empty_and_large_reports(spark, tmp_path):
    reports.write_csv(results(spark).limit(0), str(tmp_path / "e"))
    assert "".join(parts(tmp_path / "e")).count("\r\n") == 1
    many = results(spark).crossJoin(spark.range(3000)).withColumn("source", F.format_string("%06d", "id")).drop("id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so little is one part
    try:
        reports.write_csv(many, str(tmp_path / "m"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = parts(tmp_path / "m")
    assert len(got) > 1 and got[0].startswith("﻿") and sum(x.count("﻿") for x in got) == 1
    words = list(reports.OUTCOMES.values())
    ranks = [next(i for i, w in enumerate(words) if f"{w}," in line or f'"{w}"' in line) for line in "".join(got).split("\r\n")[1:-1]]
    assert ranks == sorted(ranks) and len(ranks) == 15_000
