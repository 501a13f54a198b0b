"""Projections of events to typed columns. Units and missing values are made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.scalars import ALIGN, REPEAT, enum_of, round_js, to_fraction, to_points
from folioscope.plans.catalog import query, table


def first_filled(*texts: Column) -> Column:
    """B1: the first text that is not empty."""
    return F.coalesce(*[F.nullif(F.trim(t), F.lit("")) for t in texts])


def box(x: Column, y: Column, w: Column, h: Column, unit: Column) -> list[Column]:
    """B2: four lengths in points to three places, missing ones 0."""
    return [round_js(F.coalesce(to_points(v, unit), F.lit(0.0)), 3) for v in (x, y, w, h)]


def dash(length: Column, gap: Column, times: Column) -> Column:
    """(length, gap) as often as asked."""
    return F.flatten(F.array_repeat(F.array(length, gap), times))


UNIT = "CASE p_partkey % 4 WHEN 0 THEN 'pt' WHEN 1 THEN 'twip' WHEN 2 THEN 'in' ELSE '%' END"
_POINTS = "CASE p_partkey % 4 WHEN 0 THEN {0} * 1.0 WHEN 1 THEN {0} / 20.0 WHEN 2 THEN {0} * 72.0 ELSE 0.0 END"
_R3 = "floor({0} * 1000 + 0.5) / 1000"


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_name END, c_mktsegment) AS title,
coalesce(CASE WHEN c_custkey % 2 = 0 THEN 'owner ' || c_nationkey END, c_name) AS creator,
coalesce(CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END, 'none') AS keywords FROM customer""")
def b1_metadata(spark, sf_dir):
    """B1: title, creator and keywords, each from the first source that has one."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", first_filled(F.when(k % 3 == 0, "  ").otherwise(F.col("c_name")), F.col("c_mktsegment")).alias("title"),
        first_filled(F.when(k % 2 == 0, F.concat(F.lit("owner "), F.col("c_nationkey"))), F.col("c_name")).alias("creator"),
        first_filled(F.when(k % 5 == 0, F.col("c_mktsegment")), F.lit(""), F.lit("none")).alias("keywords"),
    )


@query(f"""SELECT p_partkey, {_R3.format(_POINTS.format('p_size'))} AS x, {_R3.format(_POINTS.format('(p_size % 7)'))} AS y,
{_R3.format(_POINTS.format('p_retailprice'))} AS w, 0.0 AS h FROM part""")
def b2_box(spark, sf_dir):
    """B2 on parts: the unit comes from the key, the height is missing."""
    unit = F.expr(UNIT)
    cols = box(F.col("p_size"), F.col("p_size") % 7, F.col("p_retailprice"), F.lit(None).cast("double"), unit)
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for c, n in zip(cols, "xywh")])


_FULL = "l_linenumber % 3 <> 0"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN {_FULL} THEN l_quantity - l_tax * 100 ELSE l_quantity END AS x,
CASE WHEN {_FULL} THEN l_linenumber - l_discount * 100 ELSE l_linenumber * 1.0 END AS y,
CASE WHEN {_FULL} THEN l_tax * 200 ELSE 0.0 END AS w, CASE WHEN {_FULL} THEN l_discount * 200 ELSE 0.0 END AS h FROM lineitem""")
def b3_ellipse(spark, sf_dir):
    """Centre and radii where all four exist (not on every third line), else the plain box."""
    rx = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_tax") * 100)
    cx, cy, ry = F.col("l_quantity"), F.col("l_linenumber"), F.col("l_discount") * 100
    full = cx.isNotNull() & cy.isNotNull() & rx.isNotNull() & ry.isNotNull()
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(full, cx - rx).otherwise(cx).alias("x"), F.when(full, cy - ry).otherwise(cy * 1.0).alias("y"),
        F.when(full, F.col("l_tax") * 200).otherwise(0.0).alias("w"), F.when(full, F.col("l_discount") * 200).otherwise(0.0).alias("h"),
    )


@query("""SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 4 <> 3 THEN CASE l_linenumber % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'M' ELSE 'L' END || ' ' || CAST(l_partkey % 97 AS VARCHAR) || ' ' || CAST(l_suppkey % 89 AS VARCHAR) END, ';' ORDER BY l_linenumber, l_partkey % 97, l_suppkey % 89) AS path,
count(*) FILTER (WHERE l_linenumber % 4 <> 3) AS commands, count(*) FILTER (WHERE l_linenumber % 4 <> 3) < 2 AS unusable FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linenumber % 4 <> 3) > 0""")
def b4_path_commands(spark, sf_dir):
    """Commands of an order's path, those without a y left out; a path of fewer than two is unusable."""
    n = F.col("l_linenumber")
    cmd = F.when(n % 3 == 0, "A").when(n % 3 == 1, "M").otherwise("L")
    item = F.struct(n.alias("n"), cmd.alias("c"), (F.col("l_partkey") % 97).alias("x"), F.when(n % 4 != 3, F.col("l_suppkey") % 89).alias("y"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("all"))
    rows = rows.select("l_orderkey", F.filter("all", lambda i: i["y"].isNotNull()).alias("p")).filter(F.size("p") > 0)
    text = F.transform("p", lambda i: F.concat_ws(" ", i["c"], i["x"], i["y"]))
    return rows.select("l_orderkey", F.array_join(text, ";").alias("path"), F.size("p").cast("long").alias("commands"), (F.size("p") < 2).alias("unusable"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN 'none' ELSE '#' || lpad(hex(l_partkey % 4096), 3, '0') END AS fill, l_tax * 10 AS stroke,
CASE WHEN l_discount < 0.05 THEN l_discount * 20 END IS NOT NULL AS clear, repeat(CAST(l_linenumber AS VARCHAR) || ',2,', CAST(l_linenumber % 3 AS INT)) AS dash,
l_returnflag = 'R' AS shadow FROM lineitem""")
def b5_style(spark, sf_dir):
    """Fill, stroke, dash, shadow and opacity (1 counts as absent)."""
    n = F.col("l_linenumber")
    opacity = to_fraction(F.col("l_discount") * 20)
    d = dash(n.cast("string"), F.lit("2"), (n % 3).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_discount") == 0, "none").otherwise(F.concat(F.lit("#"), F.lpad(F.hex(F.col("l_partkey") % 4096), 3, "0"))).alias("fill"),
        (F.col("l_tax") * 10).alias("stroke"), F.nullif(opacity, F.lit(1.0)).isNotNull().alias("clear"),
        F.array_join(F.transform(d, lambda x: F.concat(x, F.lit(","))), "").alias("dash"), (F.col("l_returnflag") == "R").alias("shadow"),
    )


@query("""SELECT l_orderkey, count(*) FILTER (WHERE l_linenumber % 3 <> 0) AS stops, CASE WHEN count(*) FILTER (WHERE l_linenumber % 3 <> 0) < 2 THEN 'flat' ELSE
string_agg(CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_partkey % 100 AS VARCHAR) END, '>' ORDER BY l_linenumber, l_partkey % 100) END AS fill,
count(*) FILTER (WHERE l_linenumber % 3 <> 0) < 2 AS warned FROM lineitem GROUP BY l_orderkey""")
def b6_gradient(spark, sf_dir):
    """Stops with a colour (not every third); fewer than two are one flat colour and a warning."""
    item = F.struct(F.col("l_linenumber").alias("n"), F.when(F.col("l_linenumber") % 3 != 0, F.col("l_partkey") % 100).alias("c"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("s"))
    rows = rows.select("l_orderkey", F.filter("s", lambda i: i["c"].isNotNull()).alias("s"))
    few, text = F.size("s") < 2, F.array_join(F.transform("s", lambda i: i["c"].cast("string")), ">")
    return rows.select("l_orderkey", F.size("s").cast("long").alias("stops"), F.when(few, "flat").otherwise(text).alias("fill"), few.alias("warned"))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'left' WHEN 1 THEN 'left' WHEN 2 THEN 'right' WHEN 3 THEN 'right' WHEN 4 THEN 'center' ELSE 'left' END AS align,
coalesce(nullif(n_chars % 3, 0), -1) AS leading, coalesce(nullif(n_chars % 5, 0), -1) AS indent, CASE WHEN doc_id % 4 = 3 THEN 'none' ELSE ['tile', 'once', 'stretch'][doc_id % 4 + 1] END AS repeat FROM documents""")
def b7_paragraph(spark, sf_dir):
    """Alignment, and spacings where 0 counts as absent (shown as -1)."""
    k = F.col("doc_id")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    space = lambda n: F.coalesce(F.nullif(F.col("n_chars") % n, F.lit(0)), F.lit(-1))
    return table(spark, sf_dir, "documents").select(
        "doc_id", enum_of(pick(("left", "start", "right", "end", "center", "odd"), 6), ALIGN, "left").alias("align"),
        space(3).alias("leading"), space(5).alias("indent"), enum_of(pick(("repeat", "no-repeat", "stretch", "odd"), 4), REPEAT, "none").alias("repeat"),
    )


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'en' ELSE 'en-GB' END AS lang, role = 'user' AS bold, CASE WHEN turn % 3 = 0 THEN 12.0 ELSE turn * 1.0 END AS size,
replace(replace(text, chr(13), ''), ' ', CASE turn % 3 WHEN 0 THEN ' ' WHEN 1 THEN chr(9) ELSE chr(10) END) AS text FROM conversations""")
def b8_run_format(spark, sf_dir):
    """Language tag, weight and size of a run; space, tab and break events as text, no carriage returns."""
    n, white = F.col("turn") % 3, F.when(F.col("turn") % 3 == 0, " ").when(F.col("turn") % 3 == 1, "\t").otherwise("\n")
    lang = F.concat_ws("-", F.lit("en"), F.when(F.col("turn") % 2 != 0, "GB"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", lang.alias("lang"), (F.col("role") == "user").alias("bold"),
        F.coalesce(F.when(n != 0, F.col("turn") * 1.0), F.lit(12.0)).alias("size"), F.replace(F.replace("text", F.lit("\r"), F.lit("")), F.lit(" "), white).alias("text"),
    )


@query("SELECT doc_id, source, lang, n_chars FROM documents")
def b10_slim_results(spark, sf_dir):
    """Path, counts and codes, never the bytes: the scan leaves the text column unread."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 OR l_tax > 0.05 THEN (CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber ELSE 0 END) || '/' || (CASE WHEN l_tax > 0.05 THEN 4 ELSE 0 END) ELSE 'none' END AS padding,
CASE WHEN l_suppkey % 4 > 1 THEN l_suppkey % 4 ELSE 0 END AS columns FROM lineitem""")
def b11_text_box(spark, sf_dir):
    """Padding where any side is given (others 0), columns where there are several."""
    left, top = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber")), F.when(F.col("l_tax") > 0.05, 4)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    given = F.coalesce(left, top).isNotNull()
    n = F.col("l_suppkey") % 4
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(given, F.concat_ws("/", zero(left), zero(top))).otherwise("none").alias("padding"), F.when(n > 1, n).otherwise(0).alias("columns")
    )


@query("""SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 4 = 0 THEN '0' ELSE CAST(l_linenumber * 72 AS VARCHAR) END, ',' ORDER BY l_linenumber) AS widths,
max(CASE WHEN l_linenumber % 4 = 1 THEN l_linenumber ELSE -1 END) AS height FROM lineitem GROUP BY l_orderkey""")
def b12_table(spark, sf_dir):
    """Column widths with missing ones 0; a row height that is missing stays so (shown as -1)."""
    n = F.col("l_linenumber")
    item = F.struct(n.alias("n"), to_points(F.when(n % 4 != 0, n), F.lit("in")).alias("w"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(item)).alias("c"), F.coalesce(F.max(F.when(n % 4 == 1, n)), F.lit(-1)).alias("height")
    )
    width = F.transform("c", lambda i: F.coalesce(i["w"], F.lit(0.0)).cast("long").cast("string"))
    return rows.select("l_orderkey", F.array_join(width, ",").alias("widths"), "height")


@query("""SELECT p_partkey, 'image' AS via, p_brand AS asset, 'once' AS repeat FROM part WHERE p_partkey % 3 = 0 UNION ALL
SELECT p_partkey, 'fill', p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'tile' ELSE 'stretch' END FROM part WHERE p_partkey % 3 <> 0 AND p_size > 20""")
def b13_pictures(spark, sf_dir):
    """Pictures stand as elements or as fills."""
    part = table(spark, sf_dir, "part")
    cols = lambda via, repeat: ["p_partkey", F.lit(via).alias("via"), F.col("p_brand").alias("asset"), repeat.alias("repeat")]
    kind = enum_of(F.when(F.col("p_partkey") % 2 == 0, "repeat").otherwise("stretch"), REPEAT)
    return part.filter("p_partkey % 3 = 0").select(*cols("image", F.lit("once"))).unionByName(
        part.filter("p_partkey % 3 <> 0 AND p_size > 20").select(*cols("fill", kind))
    )
