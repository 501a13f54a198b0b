"""Nothing is broadcast whose size Spark only guesses: exploded tables, and those read back from Parquet."""

from __future__ import annotations

import pytest

from folioscope.llm import common, decontam, neardup, pii, simhash


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def guessed(df) -> list[str]:
    """The inner joins by broadcast in the plan of ``df`` with a side that no shuffle measures while the query runs: Spark may
    send that side, whatever it holds, once it has found the other one large."""
    found = []

    def walk(node) -> bool:
        kids = [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            kids = [node.initialPlan()]
        measured = [walk(k) for k in kids]
        if node.nodeName() == "BroadcastHashJoin" and node.joinType().toString() == "Inner" and not all(measured):
            found.append(node.simpleStringWithNodeId())
        return node.nodeName() == "Exchange" or any(measured)

    walk(df._jdf.queryExecution().executedPlan())
    return found


@pytest.fixture
def plans(spark, monkeypatch):
    """What the tables written meanwhile would broadcast by guess."""
    seen = []

    def over(*modules):
        for m in modules:
            monkeypatch.setattr(m, "written", lambda df: (seen.extend(guessed(df)), common.written(df))[1])
        return seen

    return over


def test_simhash_broadcasts_nothing_by_guess(spark, plans):
    seen = plans(simhash)
    rows = [(i, " ".join(f"w{i // 3}-{k}" for k in range(40))) for i in range(30)] + [(1, "another text of that id")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert (seen + guessed(got)) == []
    assert {r["component_id"] for r in got.collect()} == set(range(0, 30, 3))
    dense = spark.range(40).selectExpr("0 as n", "0l as bits", "id as fp", "id as rep")
    assert guessed(simhash._midpoints(dense, [0xFFFF], 2)) == []


def test_near_dedup_broadcasts_nothing_by_guess(spark, plans):
    seen = plans(simhash, neardup)
    rows = [(i, " ".join(f"w{i // 3}-{k}" for k in range(40 - i % 3))) for i in range(30)] + [(1, "another text of that id, of some words")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert (seen + guessed(got)) == []
    assert {r["component_id"] for r in got.collect()} == set(range(0, 30, 3))


def test_decontamination_broadcasts_nothing_by_guess(spark, plans):
    seen = plans(decontam)
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b one two three four zero six seven eight nine ten c"), (2, "nothing of it")], "doc_id long, text string")
    got = decontam.overlaps(docs, bench)
    assert seen == [] and [r["items"] for r in got.collect()] == [[1]]


def test_pii_broadcasts_nothing_by_guess(spark, plans):
    seen = plans(pii)
    rows = [(i, f"write to who@x.org of zanzibar {i}" if i < 4 else f"plain text {i}") for i in range(400)]
    got = pii.spans(spark.createDataFrame(rows, "_rid long, text string"))
    assert (seen + guessed(got)) == []
    assert {(r["_rid"], r["kind"]) for r in got.collect()} >= {(i, k) for i in range(4) for k in (0, 4)}
