import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scalars
from folioscope.operators import joins, ordered
from folioscope.plans import registry
from folioscope.sources import corpus, markup, pictures
from folioscope.streaming import delivery

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations pages labels benchmark embeddings".split()


@pytest.fixture(scope="module")
def spark():
    return (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").getOrCreate()
    )


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(registry.ORACLE[name]).df()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_units(spark):
    lit, nan = F.lit, F.lit(float("nan"))
    cases = [(1, "in", 72), (8.5, "in", 612), (12, "pt", 12), (1440, "twip", 72), (1, "", 72), (50, "%", None)]
    assert [one(spark, scalars.to_points(lit(float(v)), lit(u))) for v, u, _ in cases] == [w for *_, w in cases]
    assert one(spark, scalars.to_points(nan, lit("in"))) is None and one(spark, scalars.to_degrees(lit(-46.0))) == -46
    assert [one(spark, scalars.to_fraction(x)) for x in (lit(1.4), lit(-0.2), nan, lit(None).cast("double"), lit(float("inf")))] == [1, 0, None, None, None]
    assert [one(spark, scalars.to_multiplier(lit(x))) for x in (1.15, 115.0, 0.0, -1.0)] == [1.15, 1.15, None, None]
    sizes = (0, 999, 21 * 1024, 1536, 5 * 1024**2)
    assert [one(spark, scalars.human_bytes(lit(n))) for n in sizes] == ["0 B", "999 B", "21 KB", "1.5 KB", "5.0 MB"]
    assert one(spark, scalars.human_bytes(nan)) == ""


def test_texts(spark):
    lit = F.lit
    loss = scalars.describe_loss(lit("Shadow"), lit(3), F.array(lit(1), lit(3)))
    assert one(spark, loss) == "Shadow (3 times, pages 1 and 3)"
    assert one(spark, scalars.describe_loss(lit("Shadow"), lit(1), F.expr("cast(array() as array<int>)"))) == "Shadow"
    cells = {"Spring, 1998": '"Spring, 1998"', 'He "hi"': '"He ""hi"""', "\t=1": "\"'\t=1\"", '=A("b"),x': '"\'=A(""b""),x"', "rate=12": "rate=12", " p ": '" p "', "": ""}
    assert {c: one(spark, scalars.csv_cell(lit(c))) for c in cells} == cells
    assert one(spark, scalars.decode_entities(lit("&#65;&#x20AC;&#128512;&amp;lt; &#0; &#xD800; &quot;&apos;&nope;"))) == "A\u20ac\U0001f600&lt; &#0; &#xD800; \"'&nope;"
    assert one(spark, scalars.tokens(lit("a\u00a0 b\r\nc"))) == ["a", "\u00a0 ", "b", "\r\n", "c"]
    assert [one(spark, scalars.parse_color(lit(c))) for c in ("#fff", "#0000ff", "red", "#12")] == [16777215, 255, None, None]
    assert one(spark, scalars.stem_of(lit("a/b/ .PUB"), "pub")) == "publication"
    assert tuple(one(spark, scalars.split_locale(lit("root@x=1")))) == ("", "", "")


def test_names_that_bring_their_number(spark):
    rows = [(1, "a"), (2, "A"), (3, "a (2)"), (4, "a"), (5, "a (3)"), (6, "b"), (7, "a (2)")]
    df = spark.createDataFrame([(i, "d", s) for i, s in rows], "source int, folder string, stem string")
    got = {r["source"]: r["name"] for r in ordered.claim_names(df).collect()}
    assert len({n.lower() for n in got.values()}) == len(rows)
    assert got[1] == "a" and got[3] == "a (2)" and got[5] == "a (3)" and got[6] == "b"


def test_ink_cases(spark):
    def counts(a, b):
        make = lambda p: spark.createDataFrame([(1, x, y, c) for x, y, c in p], "img int, x int, y int, c int")
        rows = joins.ink_neighbours(make(a), make(b)).collect()
        return sum(r["r"] is not None for r in rows), sum(r["any_r"] is None for r in rows), sum(r["any_r"] is not None and r["r"] is None for r in rows)

    marks = [(i, 5, 0) for i in range(0, 40, 4)]
    assert counts(marks, marks) == (10, 0, 0)
    assert counts(marks, [(x, y + 3, c) for x, y, c in marks]) == (0, 10, 0)
    assert counts(marks, [(x, y, 1) for x, y, c in marks]) == (0, 0, 10)


def test_files_and_sinks(spark, tmp_path):
    for name in ("A.PUB", "b.pub", "~$b.pub", "c.txt"):
        (tmp_path / "in" / "deep").mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / "deep" / name).write_bytes(b"x" * 3)
    assert [r["path"].rsplit("/", 1)[1] for r in corpus.files(spark, str(tmp_path / "in")).collect()] == ["A.PUB", "b.pub"]
    rows = spark.createDataFrame([("=1", None), ("a,b", 2)], "name string, n int")
    corpus.write_csv(rows, str(tmp_path / "csv"), ["name", "n"])
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*")))
    assert text == "\ufeffname,n\r\n'=1,\r\n\"a,b\",2\r\n"
    for run in ("1", "2"):
        corpus.snapshot(rows, str(tmp_path / "base"), run)
    assert spark.read.parquet(str(tmp_path / "base")).groupBy("run_id").count().count() == 2


def test_streams(spark, tmp_path):
    """Late and repeated deliveries: each id once, profile and sessions as on the table."""
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    for half in (0, 1):  # two files, out of order, the second with repeats
        part = events.filter((F.col("event_id") % 2 == half) | ((F.col("event_id") % 10 == 0) & F.lit(bool(half))))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(make, mode):
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        name = f"out_{make.__name__}_{mode}".strip("<>").replace("<lambda>", "x")
        q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    once = run(delivery.deduplicated, "append")
    assert once.count() == events.count() == once.select("event_id").distinct().count()

    def deduplicated_profile(stream):
        return delivery.profile(stream.dropDuplicates(["event_id"]))

    got = run(deduplicated_profile, "complete")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in delivery.profile(events).collect()}


def test_signatures(spark):
    import hmac as h

    good = h.new(b"k", b"5.body", "sha256").hexdigest()
    rows = [(f"v1={good}", True), (f"t=5,v1=00, v1={good}", True), ("v1=zz", False), (None, False), ("", False)]
    df = spark.createDataFrame([(a, b) for a, b in rows], "header string, want boolean")
    out = df.select("want", delivery.verified(F.lit("body"), F.lit("5"), F.col("header"), "k").alias("got")).collect()
    assert all(r["want"] == r["got"] for r in out)


def filtered(rows, step):
    """Each line under another of the five filters."""
    out, above = b"", bytes(len(rows[0]))
    for y, row in enumerate(rows):
        at = lambda r, i: r[i] if i >= 0 else 0
        kind, line = y % 5, []
        for i, v in enumerate(row):
            a, b, c = at(row, i - step), above[i], at(above, i - step)
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, best)[kind]) % 256)
        out, above = out + bytes([kind, *line]), row
    return out


def test_pictures(spark):
    import random

    r = random.Random(5)
    lines = lambda n, h=11: [bytes(r.randrange(256) for _ in range(n)) for _ in range(h)]
    over = lambda v, a: int(v * a / 255 + (255 - a) + 0.5)
    cases, want = [], {}

    def case(img, width, depth, kind, rows, step, colour, *extra):
        cases.append((img, pictures.packed(width, len(rows), depth, kind, filtered(rows, step), *extra)))
        ink = {(x, y): colour(row, x) for y, row in enumerate(rows) for x in range(width)}
        want[img] = {(x, y, *c) for (x, y), c in ink.items() if 255 - min(c) > 32}

    case("rgb", 7, 8, 2, lines(21), 3, lambda w, x: tuple(w[3 * x : 3 * x + 3]))
    case("rgba", 6, 8, 6, lines(24), 4, lambda w, x: tuple(over(v, w[4 * x + 3]) for v in w[4 * x : 4 * x + 3]))
    case("grey alpha", 5, 8, 4, lines(10), 2, lambda w, x: (over(w[2 * x], w[2 * x + 1]),) * 3)
    case("grey 16", 5, 16, 0, lines(10), 2, lambda w, x: (w[2 * x],) * 3)
    case("grey 1", 13, 1, 0, lines(2), 1, lambda w, x: (255 * (w[x // 8] >> (7 - x % 8) & 1),) * 3)
    case("grey 4", 3, 4, 0, lines(2), 1, lambda w, x: (17 * (w[x // 2] >> (4 - x % 2 * 4) & 15),) * 3)
    case("clear grey", 9, 8, 0, [bytes([7, 9] * 4 + [7])] * 6, 1, lambda w, x: (255 if w[x] == 7 else w[x],) * 3, (b"tRNS", b"\0\7"))
    colours = [(10, 20, 30), (250, 250, 250), (0, 0, 0), (90, 0, 0)]
    pick = lambda w, x: w[x // 4] >> (6 - x % 4 * 2) & 3
    case("palette", 10, 2, 3, lines(3), 1, lambda w, x: tuple(over(v, (255, 255, 40, 255)[pick(w, x)]) for v in colours[pick(w, x)]),
         (b"PLTE", bytes(sum(colours, ()))), (b"tRNS", bytes([255, 255, 40])))
    case("wide", 9000, 8, 0, lines(9000, 10), 1, lambda w, x: (w[x],) * 3)
    case("white", 4, 8, 0, [b"\xff" * 4] * 2, 1, lambda w, x: (w[x],) * 3)
    good = pictures.packed(2, 2, 8, 0, bytes(6))
    bad = {
        "empty": b"", "null": None, "cut": good[:-20], "short": pictures.packed(2, 3, 8, 0, bytes(6)), "filter": pictures.packed(1, 1, 8, 0, b"\x09\0"),
        "huge": pictures.packed(20_000, 20_000, 8, 0, b""), "outside": pictures.packed(1, 1, 8, 3, b"\0\5", (b"PLTE", bytes(6))), "depth": pictures.packed(1, 1, 3, 0, bytes(2)),
    }
    rows = pictures.ink_pixels(spark.createDataFrame(cases + list(bad.items()), "img string, content binary")).collect()
    for img, pixels in want.items():
        assert {tuple(p)[1:6] for p in rows if p["img"] == img} == pixels, img
    assert {p["img"] for p in rows if p["problem"]} == set(bad) and not any(p["problem"] and p["x"] is not None for p in rows)


def test_planned_outputs(spark, tmp_path):
    root = tmp_path / "out"
    (root / "d").mkdir(parents=True)
    for name in ("a.docx", "A (2).docx", "b.pptx"):
        (root / "d" / name).write_bytes(b"old")
    held = spark.createDataFrame([("d", "a", "docx"), ("d", "A (2)", "docx"), ("d", "b", "pptx")], "folder string, stem string, ext string")
    rows = [(1, "d", "a", "docx", b"1"), (2, "d", "A", "docx", b"2"), (3, "d", "b", "docx", b"3"), (4, "d", "c", "docx", None), (5, "e", "a", "docx", b"5")]
    files = spark.createDataFrame(rows, "source int, folder string, stem string, ext string, content binary")
    plan = lambda p: {r["source"]: (r["name"], r["action"]) for r in corpus.planned(files.drop("content"), held, F.lit(p)).collect()}
    rest = {3: ("b.docx", "write"), 4: ("c.docx", "write"), 5: ("a.docx", "write")}
    assert plan("skip") == rest | {1: ("a.docx", "skip"), 2: ("A (3).docx", "write")}
    assert plan("overwrite") == rest | {1: ("a.docx", "write"), 2: ("A (3).docx", "write")}
    done = corpus.write_outputs(files, held, F.lit("rename"), root.as_uri()).collect()
    assert {r["source"]: r["name"] for r in done} == {k: n for k, (n, _) in rest.items()} | {1: "a (3).docx", 2: "A (4).docx"}
    for r in done:
        assert (root / r["folder"] / r["name"]).read_bytes() == (b"" if r["source"] == 4 else str(r["source"]).encode())
    assert (root / "d" / "a.docx").read_bytes() == b"old" and not list(root.rglob("*.part"))


def test_nesting_never_falls_below_zero(spark):
    tags = [("li", True), ("ul", False), ("li", False), ("li", True), ("ul", True), ("ul", True), ("ul", False)]
    df = spark.createDataFrame([(1, i, n, c, False) for i, (n, c) in enumerate(tags)], "page_id int, pos int, name string, closing boolean, alone boolean")
    got = {r["pos"]: (r["depth"], r["level"]) for r in markup.nested(df, "page_id").collect()}
    assert got == {1: (0, 0), 2: (1, 1), 6: (0, 0)}


def test_deadlines_and_progress(spark, tmp_path):
    import time

    def batch(rows):
        at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))
        df = spark.createDataFrame(rows, "request_id string, s int, kind string, budget_s int")
        df.select("request_id", at.alias("ts"), "kind", "budget_s").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times

    batch([("late", 0, "sign", 10), ("quick", 0, "sign", 10), ("quick", 5, "answer", 10), ("slow", 0, "sign", 10), ("slow", 8, "sign", 10), ("mute", 0, "sign", 10)])
    batch([("slow", 15, "answer", 10), ("late", 12, "answer", 10), ("quick", 13, "answer", 10)])
    batch([("clock", 900, "sign", 10_000_000)])
    batch([("mute", 950, "answer", 10), ("clock", 950, "sign", 10_000_000)])
    schema = "request_id string, ts timestamp, kind string, budget_s int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = delivery.deadlines(stream, "1 minute").writeStream.format("memory").queryName("settled").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["request_id"], r["outcome"], r["at_ms"] - 1_700_000_000_000) for r in spark.table("settled").collect())
    assert got == [("late", "silent", 10_000), ("mute", "silent", 10_000), ("quick", "answered", 5_000), ("slow", "answered", 15_000)]

    beats = []
    listener = delivery.Progress(beats.append)
    spark.streams.addListener(listener)
    try:
        files = spark.readStream.schema("o_orderkey long, o_orderstatus string").parquet(f"{SF}/orders.parquet*")
        rows = files.select(F.when(F.col("o_orderstatus") == "F", "skipped").otherwise("ok").alias("outcome"), (F.col("o_orderkey") % 7 == 0).alias("attention"))
        delivery.counted(rows).writeStream.format("noop").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
        orders = spark.read.parquet(f"{SF}/orders.parquet")
        for _ in range(100):
            if listener.totals["done"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    odd = orders.filter("o_orderkey % 7 = 0").count()
    skipped = orders.filter("o_orderkey % 7 <> 0 and o_orderstatus = 'F'").count()
    total = orders.count()
    assert listener.totals == {"done": total, "attention": odd, "skipped": skipped, "converted": total - odd - skipped} and beats[-1] == listener.totals
