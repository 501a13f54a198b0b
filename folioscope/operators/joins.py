"""Lookups and pairings: map lookups of single files become joins over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.plans.catalog import query, table

# Sentences for codes, families for fonts, languages for locale ids.
PLAIN = {"error": "Something went wrong", "purchase": "A sale", "signup": "A new reader"}
FAMILIES = {"part 1": "Liberation Serif", "part 2": "Liberation Sans"}
LOCALES = {1: "ar", 2: "bg", 3: "ca", 4: "zh", 5: "cs", 6: "da", 7: "de", 8: "el", 9: "en"}
LOCALE_EXCEPTIONS = {2057: "en-GB", 1033: "en-US"}


def _pairs(spark, rows, schema):
    return spark.createDataFrame(list(rows.items()), schema)


_EVENTS = "CASE WHEN turn % 4 = 1 THEN 'style' WHEN turn % 4 = 3 AND conv_id % 2 = 0 THEN 'page' ELSE 'draw' END"
_STYLE = "CASE WHEN (turn + conv_id) % 3 <> 0 THEN length(text) END"  # some styles are empty, and replace the one before


@query(f"""WITH e AS (SELECT conv_id, turn, {_EVENTS} AS t, {_STYLE} AS v FROM conversations),
g AS (SELECT *, count(*) FILTER (WHERE t <> 'style') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS grp FROM e),
l AS (SELECT *, max(CASE WHEN t = 'style' THEN turn END) OVER (PARTITION BY conv_id, grp ORDER BY turn ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT l.conv_id, l.turn, l.s IS NOT NULL AS styled, coalesce(e.v, -1) AS style FROM l LEFT JOIN e ON e.conv_id = l.conv_id AND e.turn = l.s WHERE l.t = 'draw'""")
def d1_style_latch(spark, sf_dir):
    """The last style, empty or not, goes to the next drawing and is used up; a page's end clears it. Windows only, no join."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_EVENTS).alias("t"), F.struct(F.expr(_STYLE).alias("v")).alias("v"))
    rows = rows.withColumn("grp", F.count_if(F.col("t") != "style").over(w))
    latch = Window.partitionBy("conv_id", "grp").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("s", F.last(F.when(F.col("t") == "style", F.col("v")), ignorenulls=True).over(latch))
    return rows.filter("t = 'draw'").select("conv_id", "turn", F.col("s").isNotNull().alias("styled"), F.coalesce("s.v", F.lit(-1)).alias("style"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'MISSING_ASSET' ELSE 'q' || max(l.quality) END AS asset FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id, l.doc_id""")
def d2_asset_resolve(spark, sf_dir):
    """A reference finds its asset or becomes a warning."""
    found = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(found, "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("q").isNull(), "MISSING_ASSET").otherwise(F.concat(F.lit("q"), F.col("q"))).alias("asset"))


@query("""SELECT d.doc_id, coalesce(max(l.toxic), 0) = 1 AS expected, d.doc_id % 9 = 0 AS failed, coalesce(max(l.toxic), 0) = 1 AND d.doc_id % 9 <> 0 AS now_passes
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.doc_id""")
def d4_expected_failures(spark, sf_dir):
    """Failures on the list are expected; those on it that passed are told."""
    listed = table(spark, sf_dir, "labels").groupBy("doc_id").agg((F.max("toxic") == 1).alias("expected"))
    rows = table(spark, sf_dir, "documents").select("doc_id").join(listed, "doc_id", "left")
    expected, failed = F.coalesce("expected", F.lit(False)), F.col("doc_id") % 9 == 0
    return rows.select("doc_id", expected.alias("expected"), failed.alias("failed"), (expected & ~failed).alias("now_passes"))


_SIDES = """c AS (SELECT conv_id, turn, length(text) AS ink, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE turn % 5 <> 4),
r AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 0 ELSE length(text) END AS ink, turn + 1 AS i FROM conversations),
n AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.n, 0) AS rn, coalesce(b.n, 0) AS cn, coalesce(lead, 0) AS lead FROM
(SELECT conv_id, count(*) AS n, coalesce(min(CASE WHEN ink > 0 THEN i END) - 1, count(*)) AS lead FROM r GROUP BY conv_id) a FULL JOIN (SELECT conv_id, count(*) AS n FROM c GROUP BY conv_id) b ON a.conv_id = b.conv_id),
s AS (SELECT *, least(lead, greatest(0, rn - cn)) AS strip FROM n)"""


def _sides(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("ink"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    cand = rows.filter("turn % 5 <> 4").withColumn("i", F.row_number().over(w))
    ref = rows.select("conv_id", "turn", F.when(F.col("turn") == 0, 0).otherwise(F.col("ink")).alias("ink"), (F.col("turn") + 1).alias("i"))
    lead = F.coalesce(F.min(F.when(F.col("ink") > 0, F.col("i"))) - 1, F.count("*"))
    counts = ref.groupBy("conv_id").agg(F.count("*").alias("rn"), lead.alias("lead")).join(
        cand.groupBy("conv_id").agg(F.count("*").alias("cn")), "conv_id", "full"
    ).fillna(0)
    strip = F.least("lead", F.greatest(F.lit(0), F.col("rn") - F.col("cn")))
    return ref, cand, counts.select("conv_id", "rn", "cn", "lead", strip.alias("strip"))


@query(f"WITH {_SIDES} SELECT conv_id, rn, cn, lead, strip FROM s")
def f9_blank_strip(spark, sf_dir):
    """leading blank reference pages go, at most as many as the reference has too many."""
    return _sides(spark, sf_dir)[2]


@query(f"""WITH {_SIDES} SELECT c.conv_id, c.i AS page, c.ink AS cand, r.ink AS ref FROM c JOIN s ON s.conv_id = c.conv_id JOIN r ON r.conv_id = c.conv_id AND r.i = c.i + s.strip""")
def d5_page_pairs(spark, sf_dir):
    """Pages pair by number once the strip is taken; extra pages stay unpaired."""
    ref, cand, counts = _sides(spark, sf_dir)
    left = cand.join(counts.select("conv_id", "strip"), "conv_id").select("conv_id", F.col("i").alias("page"), F.col("ink").alias("cand"), (F.col("i") + F.col("strip")).alias("i"))
    return left.join(ref.select("conv_id", "i", F.col("ink").alias("ref")), ["conv_id", "i"]).select("conv_id", "page", "cand", "ref")


@query(f"""WITH {_SIDES}, p AS (SELECT c.conv_id, least(c.ink, r.ink) * 1.0 / greatest(c.ink, r.ink, 1) AS score FROM c JOIN s ON s.conv_id = c.conv_id JOIN r ON r.conv_id = c.conv_id AND r.i = c.i + s.strip)
SELECT s.conv_id, floor(coalesce(m, 0) * least(rn - strip, cn) / greatest(rn - strip, cn, 1) * 10000 + 0.5) / 10000 AS score FROM s LEFT JOIN (SELECT conv_id, sum(floor(score * 1000000)) / count(*) / 1000000 AS m FROM p GROUP BY conv_id) p ON p.conv_id = s.conv_id""")
def e23_artifact_score(spark, sf_dir):
    """Mean page score, less the share of pages without a partner."""
    pairs, counts = d5_page_pairs(spark, sf_dir), _sides(spark, sf_dir)[2]
    score = F.least("cand", "ref") / F.greatest(F.col("cand"), F.col("ref"), F.lit(1))
    mean = pairs.groupBy("conv_id").agg((F.sum(F.floor(score * 1000000)) / F.count("*") / 1000000).alias("m"))
    n = F.col("rn") - F.col("strip")
    value = F.coalesce("m", F.lit(0.0)) * F.least(n, F.col("cn")) / F.greatest(n, F.col("cn"), F.lit(1))
    return counts.join(mean, "conv_id", "left").select("conv_id", (F.floor(value * 10000 + 0.5) / 10000).alias("score"))


_INK = """ink AS (SELECT l_suppkey AS img, l_linenumber % 2 AS side, CAST(l_quantity AS INT) AS x, l_partkey % 32 AS y, max(l_linenumber % 3) AS c FROM lineitem GROUP BY ALL)"""
_NEAR = f"""{_INK}, a AS (SELECT * FROM ink WHERE side = 0), b AS (SELECT * FROM ink WHERE side = 1),
m AS (SELECT a.img, a.x, a.y, min(greatest(abs(a.x - b.x), abs(a.y - b.y))) AS any_r, min(CASE WHEN a.c = b.c THEN greatest(abs(a.x - b.x), abs(a.y - b.y)) END) AS r
FROM a LEFT JOIN b ON b.img = a.img AND b.x BETWEEN a.x - 2 AND a.x + 2 AND b.y BETWEEN a.y - 2 AND a.y + 2 GROUP BY a.img, a.x, a.y)"""


def ink_neighbours(a, b, radius: int = 2):
    """Each pixel of a(img, x, y, c) with the smallest Chebyshev radius to one of ``b`` (any_r) and to a like one (r).

    Pixels meet in square cells of 2 radius + 1: one of ``a`` is in its own cell, one of ``b`` is copied to the at most four it can
    be near to. A place has one cell, so what meets there is summed up there.
    """
    cell = 2 * radius + 1
    at = lambda c: F.floor(F.col(c) / cell)
    reach = lambda c: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - radius) / cell), F.floor((F.col(c) + radius) / cell))))
    asks = a.select("img", "x", "y", "c", at("x").alias("cx"), at("y").alias("cy"))
    there = b.select("img", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("c").alias("cb"))
    there = there.select("*", reach("tx").alias("cx")).select("*", reach("ty").alias("cy"))
    d = F.greatest(F.abs(F.col("x") - F.col("tx")), F.abs(F.col("y") - F.col("ty")))
    met = asks.join(there, ["img", "cx", "cy"], "left").withColumn("d", F.when(d <= radius, d).cast("int"))
    near = F.min("d").alias("any_r"), F.min(F.when(F.col("c") == F.col("cb"), F.col("d"))).alias("r")
    return met.groupBy("img", "cx", "cy", "x", "y").agg(*near).drop("cx", "cy")


def _ink(spark, sf_dir):
    cols = [F.col("l_suppkey").alias("img"), (F.col("l_linenumber") % 2).alias("side"), F.col("l_quantity").cast("int").alias("x"), (F.col("l_partkey") % 32).alias("y")]
    rows = table(spark, sf_dir, "lineitem").groupBy(*cols).agg(F.max(F.col("l_linenumber") % 3).alias("c"))
    return rows.filter("side = 0"), rows.filter("side = 1")


@query(f"WITH {_NEAR} SELECT img, x, y, coalesce(any_r, 9) AS any_r, coalesce(r, 9) AS r FROM m")
def d6_ink_neighbours(spark, sf_dir):
    """D6 on pixels made of lineitem; 9 where nothing is near."""
    return ink_neighbours(*_ink(spark, sf_dir)).fillna(9)


@query(f"""WITH {_NEAR} SELECT img, count(*) AS ink, count(*) FILTER (WHERE r <= 0) AS r0, count(*) FILTER (WHERE r <= 1) AS r1, count(*) FILTER (WHERE r <= 2) AS r2,
count(*) FILTER (WHERE any_r IS NULL) AS lost, count(*) FILTER (WHERE any_r IS NOT NULL AND r IS NULL) AS recoloured FROM m GROUP BY img""")
def e19_ink_agreement(spark, sf_dir):
    """Ink, matches up to each radius, lost and recoloured pixels of each image."""
    at = lambda k: F.count_if(F.col("r") <= k).alias(f"r{k}")
    return ink_neighbours(*_ink(spark, sf_dir)).groupBy("img").agg(
        F.count("*").alias("ink"), at(0), at(1), at(2), F.count_if(F.col("any_r").isNull()).alias("lost"),
        F.count_if(F.col("any_r").isNotNull() & F.col("r").isNull()).alias("recoloured"),
    )


@query(f"""WITH {_INK} SELECT coalesce(a.img, b.img) AS img, count(*) FILTER (WHERE b.img IS NULL) AS lost, count(*) FILTER (WHERE a.img IS NULL) AS added,
count(*) FILTER (WHERE a.c = b.c) AS agreed, count(*) FILTER (WHERE a.c <> b.c) AS differ, 51 * 32 - count(*) AS background
FROM (SELECT * FROM ink WHERE side = 0) a FULL JOIN (SELECT * FROM ink WHERE side = 1) b ON a.img = b.img AND a.x = b.x AND a.y = b.y GROUP BY 1""")
def e22_diff_class(spark, sf_dir):
    """Each pixel of the padded canvas is lost, added, agreed, different or background."""
    a, b = _ink(spark, sf_dir)
    both = a.select("img", "x", "y", F.col("c").alias("ca")).join(b.select("img", "x", "y", F.col("c").alias("cb")), ["img", "x", "y"], "full")
    return both.groupBy("img").agg(
        F.count_if(F.col("cb").isNull()).alias("lost"), F.count_if(F.col("ca").isNull()).alias("added"), F.count_if(F.col("ca") == F.col("cb")).alias("agreed"),
        F.count_if(F.col("ca") != F.col("cb")).alias("differ"), (F.lit(51 * 32) - F.count("*")).alias("background"),
    )


@query("""SELECT a.vec_id, b.vec_id AS next_id, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.97 * sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS alike
FROM embeddings a JOIN embeddings b ON b.label = a.label AND b.vec_id = a.vec_id + 10""")
def d7_colour_match(spark, sf_dir):
    """Is the direction of a vector that of another of its label (cosine of at least 0.97)?"""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    b = rows.select((F.col("vec_id") - 10).alias("vec_id"), "label", F.col("vec_id").alias("next_id"), F.col("v").alias("w"))
    alike = dot("v", "w") >= 0.97 * F.sqrt(dot("v", "v")) * F.sqrt(dot("w", "w"))
    return rows.join(b, ["vec_id", "label"]).select("vec_id", "next_id", alike.alias("alike"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 11 = 3 THEN 'missing' WHEN turn % 7 = 2 THEN 'role' WHEN conv_id % 5 = 1 AND turn % 2 = 0 THEN 'text' END AS what
FROM conversations WHERE turn % 11 = 3 OR turn % 7 = 2 OR conv_id % 5 = 1 AND turn % 2 = 0""")
def d8_event_parity(spark, sf_dir):
    """Two runs event by event; the second lacks some turns, has other roles and texts in others."""
    a = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    b = a.filter("turn % 11 <> 3").select(
        "conv_id", "turn", F.when(F.col("turn") % 7 == 2, "other").otherwise(F.col("role")).alias("r"),
        F.when((F.col("conv_id") % 5 == 1) & (F.col("turn") % 2 == 0), F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("t"),
    )
    # Digests cross the join, not texts.
    a, b = a.withColumn("text", F.sha2("text", 256)), b.withColumn("t", F.sha2("t", 256))
    rows = a.join(b, ["conv_id", "turn"], "full")
    what = F.when(F.col("r").isNull() | F.col("role").isNull(), "missing").when(F.col("r") != F.col("role"), "role").when(~F.col("t").eqNullSafe(F.col("text")), "text")
    return rows.select("conv_id", "turn", what.alias("what")).filter("what is not null")


@query(f"SELECT event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in PLAIN.items())} ELSE 'event ' || event_type END AS message FROM events")
def d10_messages(spark, sf_dir):
    """The sentence of a code, else its own message."""
    rows = table(spark, sf_dir, "events").select("event_id", "event_type").join(_pairs(spark, PLAIN, "event_type string, plain string"), "event_type", "left")
    return rows.select("event_id", F.coalesce("plain", F.concat(F.lit("event "), F.col("event_type"))).alias("message"))


_HINT = "CASE WHEN contains(lower(p_name), '9') THEN 'Liberation Mono' WHEN contains(lower(p_name), '8') THEN 'Liberation Sans' WHEN contains(lower(p_name), '7') THEN 'Liberation Serif' ELSE 'Liberation Sans' END"


@query(f"SELECT p_partkey, CASE lower(p_name) {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items())} ELSE {_HINT} END AS family, lower(p_name) NOT IN {tuple(FAMILIES)} AS substituted FROM part")
def d11_font_families(spark, sf_dir):
    """An exact name, else the first hint found in it, else the default."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.lower("p_name").alias("key")).join(_pairs(spark, FAMILIES, "key string, exact string"), "key", "left")
    return rows.select("p_partkey", F.coalesce("exact", F.expr(_HINT)).alias("family"), F.col("exact").isNull().alias("substituted"))


@query(f"""SELECT n_nationkey, coalesce(CASE lcid {' '.join(f"WHEN {k} THEN '{v}'" for k, v in LOCALE_EXCEPTIONS.items())} END, CASE lcid & 1023 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in LOCALES.items())} END, '') AS locale
FROM (SELECT n_nationkey, CAST(n_nationkey % 12 + 1024 * (1 + n_nationkey % 2) AS INT) AS lcid FROM nation)""")
def d12_locales(spark, sf_dir):
    """An exception, else the primary language in the low ten bits, else none."""
    lcid = (F.col("n_nationkey") % 12 + 1024 * (1 + F.col("n_nationkey") % 2)).cast("int")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", lcid.alias("lcid"), lcid.bitwiseAND(1023).alias("low"))
    rows = rows.join(_pairs(spark, LOCALE_EXCEPTIONS, "lcid int, exact string"), "lcid", "left").join(_pairs(spark, LOCALES, "low int, language string"), "low", "left")
    return rows.select("n_nationkey", F.coalesce("exact", "language", F.lit("")).alias("locale"))


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'new' WHEN b.doc_id IS NULL THEN 'missing' WHEN a.h = b.h THEN 'unchanged' ELSE 'CHANGED' END AS state
FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 8 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 9 <> 0) b ON a.doc_id = b.doc_id""")
def d13_baseline_compare(spark, sf_dir):
    """A run against its baseline: new, unchanged, CHANGED, missing."""
    docs = table(spark, sf_dir, "documents")
    a = docs.filter("doc_id % 10 <> 0").select("doc_id", F.sha2("text", 256).alias("a"))
    now = F.when(F.col("doc_id") % 8 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    b = docs.filter("doc_id % 9 <> 0").select("doc_id", F.sha2(now, 256).alias("b"))
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "missing").when(F.col("a") == F.col("b"), "unchanged").otherwise("CHANGED")
    return a.join(b, "doc_id", "full").select("doc_id", state.alias("state"))


_CELLS = """cell AS (SELECT l_suppkey AS tab, l_orderkey * 10 + l_linenumber AS id, min(l_partkey % 6) AS r, min(CAST(l_quantity AS INT) % 5) AS c, min(l_linenumber % 3 + 1) AS rs, min(l_orderkey % 2 + 1) AS cs FROM lineitem GROUP BY ALL),
anchor AS (SELECT * FROM cell WHERE c BETWEEN 0 AND 4 AND r BETWEEN 0 AND 5 QUALIFY row_number() OVER (PARTITION BY tab, r, c ORDER BY id) = 1),
spot AS (SELECT tab, id, r, c, r + dr AS row, c + dc AS col, CASE WHEN dr = 0 AND dc = 0 THEN 0 ELSE 1 END AS late FROM anchor, (SELECT unnest(range(3)) AS dr), (SELECT unnest(range(2)) AS dc) WHERE dr < rs AND dc < cs AND c + dc < 5 AND r + dr < 6),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tab, row, col ORDER BY late, id) AS k FROM spot) WHERE k = 1)"""


def span_cover(cells, rows: int, columns: int):
    """cells(tab, id, r, c, rs, cs) to the grid places each owns: anchors first, then spans in order.

    Of several cells at one place the first by id is there, the others are dropped with their spans, as are those off the
    grid; spans below one count as one.
    """
    cells = cells.filter(F.col("r").between(0, rows - 1) & F.col("c").between(0, columns - 1)).groupBy("tab", "r", "c").agg(F.min(F.struct("id", "rs", "cs")).alias("o"))
    cells = cells.select("tab", "r", "c", "o.id", F.greatest(F.lit(1), "o.rs").alias("rs"), F.greatest(F.lit(1), "o.cs").alias("cs"))
    dr, dc = F.explode(F.expr("sequence(0, rs - 1)")), F.explode(F.expr("sequence(0, cs - 1)"))
    spots = cells.select("*", dr.alias("dr")).select("*", dc.alias("dc"))
    spots = spots.select("tab", "id", "r", "c", (F.col("r") + F.col("dr")).alias("row"), (F.col("c") + F.col("dc")).alias("col"), ((F.col("dr") > 0) | (F.col("dc") > 0)).cast("int").alias("late"))
    spots = spots.filter((F.col("col") < columns) & (F.col("row") < rows))
    return spots.groupBy("tab", "row", "col").agg(F.min(F.struct("late", "id", "r", "c")).alias("o")).select("tab", "row", "col", "o.id", "o.r", "o.c")


def _cells(spark, sf_dir):
    low = lambda c, n: F.min(c).cast("int").alias(n)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("tab"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")).agg(
        low(F.col("l_partkey") % 6, "r"), low(F.col("l_quantity").cast("int") % 5, "c"), low(F.col("l_linenumber") % 3 + 1, "rs"), low(F.col("l_orderkey") % 2 + 1, "cs")
    )


@query(f"WITH {_CELLS} SELECT tab, row, col, id FROM own")
def d15_span_cover(spark, sf_dir):
    """D15 on tables made of lineitem."""
    return span_cover(_cells(spark, sf_dir), 6, 5).select("tab", "row", "col", "id")


@query(f"""WITH {_CELLS} SELECT t.tab, g.row, h.col, coalesce(own.col > own.c, false) AS h_merge, coalesce(own.row > own.r, false) AS v_merge, coalesce(own.id, -1) AS owner
FROM (SELECT DISTINCT tab FROM cell) t, (SELECT unnest(range(6)) AS row) g, (SELECT unnest(range(5)) AS col) h LEFT JOIN own ON own.tab = t.tab AND own.row = g.row AND own.col = h.col""")
def d16_merge_flags(spark, sf_dir):
    """Every place of the grid, its owner, and whether it continues one to the left or above."""
    cells = _cells(spark, sf_dir)
    grid = cells.select("tab").distinct().select("tab", F.explode(F.expr("sequence(0, 5)")).alias("row")).select("*", F.explode(F.expr("sequence(0, 4)")).alias("col"))
    rows = grid.join(span_cover(cells, 6, 5), ["tab", "row", "col"], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.select("tab", "row", "col", no(F.col("col") > F.col("c")).alias("h_merge"), no(F.col("row") > F.col("r")).alias("v_merge"), F.coalesce("id", F.lit(-1)).alias("owner"))
