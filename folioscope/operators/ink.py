"""Ink of two rendered pictures: marks by colour, likeness of neighbours both ways, raw agreement and classes of difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.plans.catalog import query, table, written

# How far from white ink is, the least cosine of like colours, the widest and the counted radius, channel slack.
INK, LIKE, WIDEST, RADIUS, SLACK = 32, 0.97, 2, 1, 16
CELL = 2 * WIDEST + 1


def is_ink(r: Column, g: Column, b: Column) -> Column:
    """Is a pixel a mark, or page?"""
    return 255 - F.least(r, g, b) > INK


def like(a: str, b: str) -> Column:
    """D7 on pixels: do the ways from white to both colours point the same way?"""
    d = lambda p, c: (255 - F.col(f"{p}.{c}")).cast("double")
    dot = lambda p, q: sum((d(p, c) * d(q, c) for c in "gb"), d(p, "r") * d(q, "r"))
    return (dot(a, b) > 0) & (dot(a, b) >= LIKE * F.sqrt(dot(a, a) * dot(b, b)))


def radii(ink: DataFrame) -> DataFrame:
    """For each mark of ink(img, side, x, y, r, g, b) the smallest Chebyshev distance, up to two, of a mark of the other side
    (near) and of one of like colour (radius); null where there is none.

    Marks meet in square cells of five: each is looked for from its own cell, and copied to the at most four cells it can be
    near to. Both ways are one join; a crowded picture is spread over its cells.
    """
    colour = F.struct("r", "g", "b")
    cell = lambda c: F.floor(F.col(c) / CELL)
    asks = ink.select("img", "side", "x", "y", colour.alias("a"), cell("x").alias("cx"), cell("y").alias("cy"))
    reach = lambda c: F.explode(F.array_distinct(F.array(F.floor((F.col(c) - WIDEST) / CELL), F.floor((F.col(c) + WIDEST) / CELL))))
    there = ink.select("img", (1 - F.col("side")).alias("side"), F.col("x").alias("tx"), F.col("y").alias("ty"), colour.alias("b"))
    there = there.select("*", reach("tx").alias("cx")).select("*", reach("ty").alias("cy"))
    met = asks.join(there, ["img", "side", "cx", "cy"], "left")
    d = F.greatest(F.abs(F.col("x") - F.col("tx")), F.abs(F.col("y") - F.col("ty")))
    met = met.withColumn("d", F.when(d <= WIDEST, d).cast("int"))
    return met.groupBy("img", "side", "x", "y").agg(F.min("d").alias("near"), F.min(F.when(like("a", "b"), F.col("d"))).alias("radius"))


def r4(x: Column) -> Column:
    return F.floor(x * 10000 + 0.5) / 10000


def agreement(pixels: DataFrame, sizes: DataFrame) -> DataFrame:
    """E18 to E22, F13 of pixels(img, side, x, y, r, g, b), side 0 the reference and 1 the candidate, against sizes(img, side, w, h).

    Pixels not listed are white; a place is listed once per side. Both sides are padded with white to the union canvas. Per
    picture: w, h, total, ink of each side and its coverage; score at each radius (1 if both are blank); lost and recoloured
    marks of the reference; the places that are exact and within the slack, and their shares; and the diff classes at the
    counted radius: diff_lost, diff_added, diff_agreed, diff_background. A picture needs a size on a side to be there.
    """
    canvas = sizes.groupBy("img").agg(F.max("w").alias("w"), F.max("h").alias("h"))
    pixels = written(pixels.select("img", "side", "x", "y", "r", "g", "b"))
    found = written(radii(pixels.filter(is_ink(F.col("r"), F.col("g"), F.col("b")))))
    of = lambda side: F.col("side") == side
    hit = [F.count_if(F.col("radius") <= k).alias(f"hit{k}") for k in range(WIDEST + 1)]
    ink = found.groupBy("img").agg(
        F.count_if(of(0)).alias("ink0"), F.count_if(of(1)).alias("ink1"), *hit,
        F.count_if(of(0) & F.col("near").isNull()).alias("lost"), F.count_if(of(0) & F.col("near").isNotNull() & F.col("radius").isNull()).alias("recoloured"),
    )
    channels = [F.max(F.when(of(s), F.col(c))).alias(f"{c}{s}") for s in (0, 1) for c in "rgb"]
    places = pixels.groupBy("img", "x", "y").agg(*channels)
    gap = reduce(F.greatest, [F.abs(F.coalesce(f"{c}0", F.lit(255)) - F.coalesce(f"{c}1", F.lit(255))) for c in "rgb"])
    raw = places.select("img", gap.alias("gap")).groupBy("img").agg(
        F.count("*").alias("listed"), F.count_if(F.col("gap") == 0).alias("same"), F.count_if(F.col("gap") <= SLACK).alias("close")
    )
    far = F.coalesce(F.col("radius") > RADIUS, F.lit(True))
    marks = found.groupBy("img", "x", "y").agg(F.coalesce(F.max(of(0) & far), F.lit(False)).alias("lost"), F.coalesce(F.max(of(1) & far), F.lit(False)).alias("added"))
    classes = marks.groupBy("img").agg(
        F.count_if("lost").alias("diff_lost"), F.count_if(F.col("added") & ~F.col("lost")).alias("diff_added"), F.count_if(~F.col("added") & ~F.col("lost")).alias("diff_agreed")
    )
    rows = canvas.join(ink, "img", "left").join(raw, "img", "left").join(classes, "img", "left").fillna(0)
    total, inks = F.col("w") * F.col("h"), F.col("ink0") + F.col("ink1")
    exact, close = F.col("same") + total - F.col("listed"), F.col("close") + total - F.col("listed")
    return rows.select(
        "img", "w", "h", total.alias("total"), "ink0", "ink1", r4(F.col("ink0") / total).alias("coverage0"), r4(F.col("ink1") / total).alias("coverage1"),
        *[F.when(inks == 0, 1.0).otherwise(r4(F.col(f"hit{k}") / inks)).alias(f"score{k}") for k in range(WIDEST + 1)], "lost", "recoloured",
        exact.alias("exact"), r4(exact / total).alias("exact_share"), close.alias("close"), r4(close / total).alias("close_share"),
        "diff_lost", "diff_added", "diff_agreed", (total - F.col("diff_lost") - F.col("diff_added") - F.col("diff_agreed")).alias("diff_background"),
    )


# Two pictures for each supplier, of its lines: places from quantity and part, colours from order and date; some lines are faint.
_PIXEL = """l_suppkey AS img, CAST(l_linenumber % 2 AS INT) AS side, CAST(l_quantity AS INT) AS x, CAST(l_partkey % 32 AS INT) AS y,
CAST(max(CASE WHEN l_orderkey % 4 = 0 THEN 16777215 - (l_partkey % 40) * 65793 WHEN l_orderkey % 4 = 1 THEN (l_partkey % 60) * 65793 ELSE (200 - l_orderkey % 3 * 100) * 65536 + (l_partkey % 3 * 100) * 256 + 30 END) AS BIGINT) AS c"""
_SIZE = "s_suppkey AS img, CAST(side AS INT) AS side, CAST(51 + side * (s_suppkey % 3) AS BIGINT) AS w, CAST(32 + (1 - side) * (s_suppkey % 2) AS BIGINT) AS h"


def _pictures(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "l_linenumber", "l_quantity", "l_partkey", "l_orderkey")
    keys = ["l_suppkey AS img", "CAST(l_linenumber % 2 AS INT) AS side", "CAST(l_quantity AS INT) AS x", "CAST(l_partkey % 32 AS INT) AS y"]
    code = F.expr(_PIXEL[_PIXEL.index("CAST(max(") :].removesuffix(" AS c"))
    rows = rows.groupBy(*[F.expr(k) for k in keys]).agg(code.alias("c"))
    rows = rows.selectExpr("img", "side", "x", "y", "CAST(c DIV 65536 AS INT) AS r", "CAST(c DIV 256 % 256 AS INT) AS g", "CAST(c % 256 AS INT) AS b")
    sizes = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    return rows, sizes.selectExpr(*_SIZE.split(", "))


_SQL = f"""code AS (SELECT {_PIXEL} FROM lineitem GROUP BY l_suppkey, 2, 3, 4),
pixel AS (SELECT img, side, x, y, CAST(c // 65536 AS INT) AS r, CAST(c // 256 % 256 AS INT) AS g, CAST(c % 256 AS INT) AS b FROM code),
size AS (SELECT {_SIZE} FROM supplier, (SELECT unnest([0, 1]) AS side)), canvas AS (SELECT img, max(w) AS w, max(h) AS h FROM size GROUP BY img),
ink AS (SELECT *, (255.0 - r)::DOUBLE AS dr, (255.0 - g)::DOUBLE AS dg, (255.0 - b)::DOUBLE AS db FROM pixel WHERE 255 - least(r, g, b) > {INK}),
pairs AS (SELECT p.img, p.side, p.x, p.y, greatest(abs(p.x - q.x), abs(p.y - q.y)) AS d, p.dr * q.dr + p.dg * q.dg + p.db * q.db AS dot, p.dr ** 2 + p.dg ** 2 + p.db ** 2 AS pp, q.dr ** 2 + q.dg ** 2 + q.db ** 2 AS qq
FROM ink p LEFT JOIN ink q ON q.img = p.img AND q.side <> p.side AND q.x BETWEEN p.x - 2 AND p.x + 2 AND q.y BETWEEN p.y - 2 AND p.y + 2),
near AS (SELECT img, side, x, y, min(d) AS near, min(d) FILTER (WHERE dot > 0 AND dot >= {LIKE} * sqrt(pp * qq)) AS radius FROM pairs GROUP BY ALL)"""


@query(f"WITH {_SQL} SELECT img, side, x, y, CAST(coalesce(near, 9) AS INT) AS near, CAST(coalesce(radius, 9) AS INT) AS radius FROM near")
def d6_ink_radii(spark, sf_dir):
    """D6 by D7: each mark's distance to the other picture's marks, and to those of like colour, both ways; 9 where there is none."""
    pixels, _ = _pictures(spark, sf_dir)
    return radii(pixels.filter(is_ink(F.col("r"), F.col("g"), F.col("b")))).fillna(9)


_SHARE = lambda v: f"floor(({v}) / (w * h) * 10000 + 0.5) / 10000"


@query(f"""WITH {_SQL}, i AS (SELECT img, count(*) FILTER (WHERE side = 0) AS ink0, count(*) FILTER (WHERE side = 1) AS ink1, {", ".join(f"count(*) FILTER (WHERE radius <= {k}) AS hit{k}" for k in range(3))},
count(*) FILTER (WHERE side = 0 AND near IS NULL) AS lost, count(*) FILTER (WHERE side = 0 AND near IS NOT NULL AND radius IS NULL) AS recoloured FROM near GROUP BY img),
gap AS (SELECT coalesce(p.img, q.img) AS img, greatest(abs(coalesce(p.r, 255) - coalesce(q.r, 255)), abs(coalesce(p.g, 255) - coalesce(q.g, 255)), abs(coalesce(p.b, 255) - coalesce(q.b, 255))) AS gap
FROM (SELECT * FROM pixel WHERE side = 0) p FULL JOIN (SELECT * FROM pixel WHERE side = 1) q ON p.img = q.img AND p.x = q.x AND p.y = q.y),
raw AS (SELECT img, count(*) AS listed, count(*) FILTER (WHERE gap = 0) AS same, count(*) FILTER (WHERE gap <= {SLACK}) AS close FROM gap GROUP BY img),
cls AS (SELECT img, count(*) FILTER (WHERE l) AS dl, count(*) FILTER (WHERE a AND NOT l) AS da, count(*) FILTER (WHERE NOT a AND NOT l) AS dg
FROM (SELECT img, x, y, bool_or(side = 0 AND coalesce(radius, 9) > {RADIUS}) AS l, bool_or(side = 1 AND coalesce(radius, 9) > {RADIUS}) AS a FROM near GROUP BY img, x, y) GROUP BY img)
SELECT img, w, h, w * h AS total, coalesce(ink0, 0) AS ink0, coalesce(ink1, 0) AS ink1, {_SHARE("coalesce(ink0, 0)")} AS coverage0, {_SHARE("coalesce(ink1, 0)")} AS coverage1,
{", ".join(f"CASE WHEN coalesce(ink0 + ink1, 0) = 0 THEN 1 ELSE floor(hit{k} / (ink0 + ink1) * 10000 + 0.5) / 10000 END AS score{k}" for k in range(3))}, coalesce(lost, 0) AS lost, coalesce(recoloured, 0) AS recoloured,
coalesce(same - listed, 0) + w * h AS exact, {_SHARE("coalesce(same - listed, 0) + w * h")} AS exact_share, coalesce(close - listed, 0) + w * h AS close, {_SHARE("coalesce(close - listed, 0) + w * h")} AS close_share,
coalesce(dl, 0) AS diff_lost, coalesce(da, 0) AS diff_added, coalesce(dg, 0) AS diff_agreed, w * h - coalesce(dl + da + dg, 0) AS diff_background
FROM canvas LEFT JOIN i USING (img) LEFT JOIN raw USING (img) LEFT JOIN cls USING (img)""")
def e19_picture_agreement(spark, sf_dir):
    """E18 to E22, F13 in full on each supplier's two pictures."""
    return agreement(*_pictures(spark, sf_dir))
