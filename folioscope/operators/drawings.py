"""Vector drawings: path texts, transforms down the nesting, structural signatures and their comparison."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from folioscope.functions.scalars import decode_entities
from folioscope.operators.reports import compose
from folioscope.operators.signing import ARITY, FIELDS, NUMBER, PIECE, SHAPES, signed
from folioscope.plans.catalog import query, spread, table
from folioscope.sources.markup import attribute, depths, innermost, markup

# Weights of a comparison, facets by their names in differences.
WEIGHTS = {"elements": 3, "paths": 2, "text": 3, "bbox": 3, "fills": 1, "strokes": 1, "fonts": 1}
FACETS = {"elements": "element", "paths": "pathCommand", "fills": "fill", "strokes": "stroke", "fonts": "font"}
_POINT = "array<struct<x:double,y:double>>"


def r3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def path_steps(paths: DataFrame, *keys: str) -> DataFrame:
    """R2: ``keys``, step (from 0), command (upper case) and points of each step of paths(keys, d).

    Further arguments repeat a command, a move as a line. Lower case is relative to the current point; Z goes back to the
    last move. Control points count as points. A step without all its arguments is counted, gives no points and ends its
    path. Nothing is folded: a coordinate is the last absolute one plus the relative steps since; Z and a relative move
    stand on the move before, and those chains are running sums between absolute moves. Null and empty paths: no rows.
    """
    rows = paths.select(*keys, F.posexplode(F.regexp_extract_all("d", F.lit(PIECE), F.lit(0))).alias("piece", "s"))
    letter = F.left("s", F.lit(1))
    arity = F.element_at(F.create_map(*[F.lit(x) for p in ARITY.items() for x in p]), F.upper(letter))
    numbers = F.transform(F.regexp_extract_all("s", F.lit(NUMBER), F.lit(0)), lambda v: v.cast("double"))
    rows = rows.select(*keys, "piece", F.upper(letter).alias("up"), (letter == F.lower(letter)).alias("rel"), arity.alias("arity"), numbers.alias("n"))
    times = F.when(F.col("arity") == 0, 1).otherwise(F.greatest(F.lit(1), F.ceil(F.size("n") / F.col("arity")).cast("int")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), times - 1)).alias("k"))
    args = F.slice("n", F.col("k") * F.col("arity") + 1, F.col("arity"))
    command = F.when((F.col("up") == "M") & (F.col("k") > 0), "L").otherwise(F.col("up"))
    rows = rows.select(*keys, "piece", "k", command.alias("command"), "rel", (F.size(args) < F.col("arity")).alias("short"), args.alias("a"))
    order = Window.partitionBy(*keys).orderBy("piece", "k")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("over", F.coalesce(F.max("short").over(before), F.lit(False))).filter("not over")
    arg = lambda i: F.get("a", F.lit(i))
    c = F.col("command")
    to = {
        "x": F.when(c.isin("M", "L", "T", "H"), arg(0)).when(c == "C", arg(4)).when(c.isin("S", "Q"), arg(2)).when(c == "A", arg(5)),
        "y": F.when(c.isin("M", "L", "T"), arg(1)).when(c == "V", arg(0)).when(c == "C", arg(5)).when(c.isin("S", "Q"), arg(3)).when(c == "A", arg(6)),
    }
    rows = rows.select(*keys, "command", "rel", "short", "a", (F.row_number().over(order) - 1).alias("step"), *[v.alias(f"to_{x}") for x, v in to.items()])
    order = Window.partitionBy(*keys).orderBy("step")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    for x in "xy":
        v, move = F.col(f"to_{x}"), F.col("command") == "M"
        rows = rows.withColumn("sum", F.sum(F.when(F.col("rel"), F.coalesce(v, F.lit(0.0))).otherwise(0.0)).over(upto))
        fixed = ~F.col("rel") & v.isNotNull()
        # The last anchor: a fixed coordinate, or the move that a relative move or a Z stands on; free means the latter.
        anchor = F.when(fixed, F.struct(F.lit(False).alias("free"), (v - F.col("sum")).alias("v"))).when(
            move | (F.col("command") == "Z"), F.struct(F.lit(True).alias("free"), (-F.col("sum")).alias("v"))
        )
        rows = rows.withColumn("anchor", F.last(anchor, ignorenulls=True).over(upto))
        rows = rows.withColumn("free", F.coalesce("anchor.free", F.lit(False))).withColumn("own", F.coalesce("anchor.v", F.lit(0.0)) + F.col("sum"))
        last_free, last_own = F.coalesce(F.lag("free").over(order), F.lit(False)), F.coalesce(F.lag("own").over(order), F.lit(0.0))
        rows = rows.withColumn("start", F.when(move, fixed | ~last_free)).withColumn("gain", F.when(move, F.when(fixed, v).otherwise(last_own + v)))
        rows = rows.withColumn("chain", F.sum(F.coalesce(F.col("start").cast("int"), F.lit(0))).over(upto))
        chain = Window.partitionBy(*keys, "chain").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("moved", F.coalesce(F.sum("gain").over(chain), F.lit(0.0)))
        rows = rows.withColumn(x, F.col("own") + F.when(F.col("free"), F.col("moved")).otherwise(0.0))
        rows = rows.withColumn(f"base_{x}", F.when(F.col("rel"), F.coalesce(F.lag(x).over(order), F.lit(0.0))).otherwise(0.0))
    control = lambda i: _point(F.col("base_x") + arg(i), F.col("base_y") + arg(i + 1))
    end = _point(F.col("x"), F.col("y"))
    points = (
        F.when(F.col("short") | (c == "Z"), F.array().cast(_POINT)).when(c == "C", F.array(control(0), control(2), end))
        .when(c.isin("S", "Q"), F.array(control(0), end)).otherwise(F.array(end))
    )
    return rows.select(*keys, "step", "command", points.alias("points"))


def calls(value: Column) -> Column:
    """Array of (name, numbers) of a transform text's functions."""
    found = F.regexp_extract_all(value, F.lit(r"[a-zA-Z]+\s*\([^)]*\)"), F.lit(0))

    def one(f: Column) -> Column:
        inner = F.regexp_extract(f, r"\(([^)]*)\)", 1)
        numbers = F.transform(F.filter(F.split(inner, r"[\s,]+"), lambda v: v != ""), lambda v: v.try_cast("double"))
        return F.struct(F.regexp_extract(f, "^[a-zA-Z]+", 0).alias("name"), numbers.alias("n"))

    return F.transform(found, one)


def matrices(called: Column) -> Column:
    """Array of affine matrices (a, b, c, d, e, f) of (name, numbers); unknown functions change nothing."""

    def one(f: Column) -> Column:
        at = lambda i, other=None: F.coalesce(F.get(f["n"], F.lit(i)), F.lit(other)) if other is not None else F.get(f["n"], F.lit(i))
        name, angle = f["name"], F.coalesce(F.get(f["n"], F.lit(0)), F.lit(0.0)) * (math.pi / 180)
        cos, sin, about = F.cos(angle), F.sin(angle), F.size(f["n"]) >= 3
        whole = (name == "matrix") & (F.size(f["n"]) == 6)
        case = lambda rest, **of: _case(name, whole, rest, of)
        return F.struct(
            case(1.0, matrix=at(0), scale=at(0, 1.0), rotate=cos).alias("a"), case(0.0, matrix=at(1), rotate=sin, skewY=F.tan(angle)).alias("b"),
            case(0.0, matrix=at(2), rotate=-sin, skewX=F.tan(angle)).alias("c"),
            case(1.0, matrix=at(3), scale=F.coalesce(at(1), at(0, 1.0)), rotate=cos).alias("d"),
            case(0.0, matrix=at(4), translate=at(0, 0.0), rotate=F.when(about, at(1) - cos * at(1) + sin * at(2)).otherwise(0.0)).alias("e"),
            case(0.0, matrix=at(5), translate=at(1, 0.0), rotate=F.when(about, at(2) - sin * at(1) - cos * at(2)).otherwise(0.0)).alias("f"),
        )

    return F.transform(called, one)


def _case(name: Column, whole: Column, rest: float, of: dict[str, Column]) -> Column:
    out = F.when(whole, of.pop("matrix"))
    for k, v in of.items():
        out = out.when(name == k, v)
    return out.otherwise(rest)


def placed(opens: DataFrame, key: str) -> DataFrame:
    """R1 over F3: (key, pos, ctm) of opens(key, pos, alone, depth, transform): the product of the transforms of an element's
    ancestors, outermost first, and its own. Elements without any get none."""
    opens = opens.select(key, "pos", "alone", "depth", calls(F.coalesce("transform", F.lit(""))).alias("called"))
    opens = opens.select(key, "pos", "alone", "depth", matrices(F.col("called")).alias("m"))
    above = innermost(opens, key, "m", F.sequence(F.lit(0), F.col("depth") - 1)).filter(F.size("m") > 0)
    own = opens.filter(F.size("m") > 0).select(key, "pos", F.col("depth").alias("k"), "m")
    every = above.select(key, "pos", "k", "m").unionByName(own).groupBy(key, "pos").agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("m"))
    return every.select(key, "pos", compose(F.flatten(F.transform("m", lambda x: x["m"]))).alias("ctm"))


def opened(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Opening tags with attrs, depth, and the text before each tag that a text element holds (closing tags have that only)."""
    rows = depths(markup(docs, key, text), key)
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when((F.col("name") == "text") & F.col("closing"), -1).when((F.col("name") == "text") & ~F.col("alone"), 1).otherwise(0)
    rows = rows.withColumn("within", F.sum(step).over(order))
    rows = rows.withColumn("within", F.col("within") - F.least(F.lit(0), F.min("within").over(order)))
    order = Window.partitionBy(key).orderBy("pos")
    chunk = F.when(F.coalesce(F.lag("within").over(order), F.lit(0)) > 0, decode_entities(F.col("before")))
    return rows.select(key, "pos", "name", "closing", "alone", "depth", "attrs", F.when(F.trim(chunk) != "", chunk).alias("chunk"))


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per document: view_box, width, height, total, drawn, points, elements, paths, fills, strokes, fonts (maps to
    counts), text, chars, hash, bbox. Null and empty documents have empty maps and no box. Lengths count code points. A text is
    read once, by ``signing``, in the task that holds it."""
    held = docs.select(key, text)
    rows = held.mapInArrow(signed, StructType([held.schema[0], *StructType.fromDDL(FIELDS)]))
    edges = {"x": F.col("min_x"), "y": F.col("min_y"), "width": F.col("max_x") - F.col("min_x"), "height": F.col("max_y") - F.col("min_y")}
    view = F.transform(F.filter(F.split("viewBox", r"[\s,]+"), lambda v: v != ""), lambda v: v.try_cast("double"))
    rows = rows.withColumn("said", F.trim(F.regexp_replace("said", r"\s+", " "))).withColumn("view", view)
    length = lambda k: F.regexp_extract(k, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double").alias(k)
    box = F.when(F.col("points") > 0, F.struct(*[r3(v).alias(k) for k, v in edges.items()])).alias("bbox")
    return rows.select(
        key, F.when(F.size("view") == 4, F.col("view")).alias("view_box"), length("width"), length("height"), "total", "drawn", "points", *FACETS,
        F.col("said").alias("text"), F.length("said").alias("chars"), F.sha2("said", 256).alias("hash"), box,
    )


def _keys(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b)))


def _of(m: Column, k: Column) -> Column:
    return F.coalesce(F.element_at(m, k), F.lit(0).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """E15 on maps: sum of the smaller counts over sum of the larger ones; 1 where both are empty."""
    sums = F.aggregate(
        _keys(a, b), F.struct(F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")),
        lambda s, k: F.struct((s["low"] + F.least(_of(a, k), _of(b, k))).alias("low"), (s["high"] + F.greatest(_of(a, k), _of(b, k))).alias("high")),
        lambda s: F.when(s["high"] == 0, 1.0).otherwise(s["low"] / s["high"]),
    )
    return sums


def _gaps(a: Column, b: Column, field: str, severity) -> Column:
    """Differences of two maps, the largest gap first, then by key."""
    rows = F.transform(_keys(a, b), lambda k: F.struct(-F.abs(_of(a, k) - _of(b, k)), k.alias("key"), _of(a, k).alias("a"), _of(b, k).alias("b")))
    rows = F.array_sort(F.filter(rows, lambda r: r["a"] != r["b"]))
    say = lambda r: F.struct(
        F.lit(severity).alias("severity") if isinstance(severity, str) else severity(r).alias("severity"), F.concat(F.lit(f"{field}:"), r["key"]).alias("field"),
        r["a"].cast("string").alias("a"), r["b"].cast("string").alias("b"),
    )
    return F.transform(rows, say)


def compared(pairs: DataFrame, a: str, b: str, tolerance: float = 0.5) -> DataFrame:
    """``pairs`` with ``likeness`` (seven similarities), ``score``, ``bbox_delta`` (null: one side has no box), ``differences``
    (severity, field, a, b) and ``match`` of two signature structs."""
    c = lambda side, k: F.col(f"{side}.{k}")
    one_empty = lambda r: F.when((r["a"] == 0) | (r["b"] == 0), "major").otherwise("minor")
    gaps = [_gaps(c(a, f), c(b, f), n, one_empty if f == "elements" else "major" if f == "fonts" else "minor") for f, n in FACETS.items()]
    same, la, lb = c(a, "hash") == c(b, "hash"), c(a, "chars"), c(b, "chars")
    row = lambda severity, field, x, y: F.struct(severity.alias("severity"), F.lit(field).alias("field"), x.cast("string").alias("a"), y.cast("string").alias("b"))
    none = F.array().cast("array<struct<severity:string,field:string,a:string,b:string>>")
    text = F.when(~same, F.array(row(F.when(la == lb, "minor").otherwise("major"), "text", la, lb))).otherwise(none)
    sides = ("x", "y", "width", "height")
    shift = {k: F.abs(c(a, f"bbox.{k}") - c(b, f"bbox.{k}")) for k in sides}
    boxes = [F.when(shift[k] > tolerance, F.array(row(F.lit("major"), f"bbox.{k}", c(a, f"bbox.{k}"), c(b, f"bbox.{k}")))).otherwise(none) for k in sides]
    lone = c(a, "bbox").isNull() != c(b, "bbox").isNull()
    box = lambda s: F.when(c(s, "bbox").isNotNull(), F.to_json(c(s, "bbox")))
    boxes.append(F.when(lone, F.array(row(F.lit("major"), "bbox", box(a), box(b)))).otherwise(none))
    delta = F.when(lone, None).otherwise(F.coalesce(r3(F.greatest(*shift.values())), F.lit(0.0)))
    pairs = pairs.withColumn("bbox_delta", delta).withColumn("differences", F.concat(*gaps, text, *boxes))
    diagonal = F.hypot(c(a, "bbox.width"), c(a, "bbox.height"))
    d = F.col("bbox_delta")
    alike = {
        **{f: likeness(c(a, f), c(b, f)) for f in FACETS},
        "text": F.when(same | ((la == 0) & (lb == 0)), 1.0).otherwise(F.least(la, lb) / F.greatest(la, lb, F.lit(1))),
        "bbox": F.when(d.isNull(), 0.0).when(diagonal > 0, F.greatest(F.lit(0.0), 1 - d / diagonal)).otherwise((d == 0).cast("double")),
    }
    pairs = pairs.withColumn("likeness", F.struct(*[v.alias(k) for k, v in alike.items()]))
    score = sum(F.col(f"likeness.{k}") * w for k, w in WEIGHTS.items()) / sum(WEIGHTS.values())
    calm = F.forall("differences", lambda x: x["severity"] != "major") & F.coalesce(d <= tolerance, F.lit(False))
    return pairs.withColumn("score", r3(score)).withColumn("match", calm)


def record_baseline(signed: DataFrame, folder: str, run_id: str) -> None:
    """Write signatures as a run of a baseline folder; a run of that name is replaced."""
    signed.write.mode("overwrite").parquet(f"{folder}/run_id={run_id}")


def read_baseline(spark, folder: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/run_id={run_id}")


def against_baseline(now: DataFrame, baseline: DataFrame, key: str, tolerance: float = 0.5) -> DataFrame:
    """Key, status (new, unchanged, CHANGED, missing), score, differences of signatures against those recorded."""
    side = lambda df, n: df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(n))
    rows = compared(side(baseline, "before").join(side(now, "after"), key, "full"), "before", "after", tolerance)
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "missing").when(F.col("match"), "unchanged").otherwise("CHANGED")
    held = F.col("before").isNotNull() & F.col("after").isNotNull()
    return rows.select(key, status.alias("status"), F.when(held, F.col("score")).alias("score"), F.when(held, F.col("differences")).alias("differences"))


def passes(status: DataFrame) -> DataFrame:
    """One row: the run passes if nothing is missing and everything else is unchanged."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s.lower())
    return status.agg(n("new"), n("unchanged"), n("CHANGED"), n("missing"), (F.count_if(F.col("status") != "unchanged") == 0).alias("pass"))


# Drawings of the given tables: a customer's orders, each a shape in one or two groups. The text is an SQL expression that both
# engines take; ``v`` 1 is a later version in which some sizes, colours and words differ.
def _drawn(v: int) -> str:
    k, a, b = "o_orderkey", "(o_orderkey % 97)", "(o_custkey % 89)"
    t = f"(o_orderkey % 40 + 1 + {v} * CAST(o_custkey % 7 = 0 AS INT) * 3)"
    red = f"CASE WHEN {v} = 1 AND o_custkey % 5 = 0 THEN 'Blue' ELSE 'RED' END"
    shapes = (
        f"""concat('<rect x="', {a}, '" y="-', {b}, '.5" width="', {t}, '" height="5e0" fill="#a', {a} % 5, '" note=", > <"/>')""",
        f"""concat('<circle cx=', chr(39), {a}, chr(39), ' cy="', {b}, '" r="', {t}, 'px" fill="lime" style="a:b; fill: ', {red}, ';stroke:#0', {b} % 3, '"/>')""",
        f"""concat('<ellipse cx="', {a}, '" cy="', {b}, '" rx="', {t}, '" ry=".5" fill="none" stroke="Inherit"></ellipse>')""",
        f"""concat('<line x1="', {a}, '" y1="1" x2="', {b}, '" y2="', {t}, '" stroke="k', {b} % 3, '"/><!-- <rect x="1" width="9999"/> -->')""",
        f"""concat('<polygon points="', {a}, ',', {b}, ' ', {t}, ', 3 7 -8  9"/><![CDATA[<line x2="9999">]]>')""",
        f"""concat('<path d="M', {a}, ' ', {b}, ' 10 10l-', {t}, '.5.5 1 1h3 4V', {b}, 'v-1c1 2 3 4 5 6 1 1 2 2 ', {t}, ' 3S', {a}, ' 1 2 3s1 1 1 1Q5 6 7 8q.1.2 3e0 4t1 2T', {b}, ' 9A5 5 0 0 1 ', {a}, ',', {t}, 'a1 1 0 1 0 2 2zm1 1.5zl2 2M1 1z" fill="url(#g)"/>')""",
        f"""concat('<path d="m', {a}, ' ', {b}, ' 1 1zm', {t}, ' 2zm1 1h2M5 5H', {b}, 'c1 2 3 4 5 L9 9"/>')""",
        f"""concat('<text x="', {a}, '" font-family="F', {a} % 3, '">A &amp;', {b}, ' <tspan y="', {b}, '">', CASE WHEN {v} = 1 AND o_custkey % 3 = 0 THEN 'B' ELSE 'b' END, '&#38;lt;&#', 65 + {a} % 26, ';</tspan></text>')""",
        f"""concat('<svg:image xlink:href="a>b" x="', {a}, '" y="0" width="', {t}, '" height="', {b}, '"/>')""",
    )
    turns = (f"concat('translate(', {a}, ',4)')", "'scale(2)'", f"concat('rotate(90 ', {a}, ' ', {b}, ')')", "'matrix(1 0.5 -0.5 1 2 3)'", "'skewX(45) translate(1)'", "'rotate(30) skewY(10) scale(1,2) other(3)'")
    case = lambda n, of: f"CASE {n} % {len(of)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(of)) + " END"
    outer = f"""CASE WHEN {k} % 3 = 0 THEN concat('<g transform="', {case(f"({k} + {b})", turns)}, '">') ELSE '<g>' END"""
    return f"""concat({outer}, '<g transform="', {case(k, turns)}, '">', {case(f"({k} + o_custkey)", shapes)}, '</g></g>')"""


_HEAD = """concat('<?xml version="1.0"?><!DOCTYPE svg><svg viewBox="0 0 ', o_custkey % 500 + 1, ' 100" width="', o_custkey % 7, 'px" height="80">')"""


def drawn_sql(v: int) -> str:
    return f"""SELECT o_custkey AS doc, concat({_HEAD}, string_agg({_drawn(v)}, '' ORDER BY o_orderkey), '</svg>') AS svg FROM orders GROUP BY o_custkey"""


def drawn(spark, sf_dir: str, v: int = 0) -> DataFrame:
    """doc, svg: one drawing of each customer's orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    # Only keys travel; texts, tags and steps are made where a customer's orders have met.
    rows = spread(orders, orders.count(), 10_000, "o_custkey").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("s"))
    shapes = F.array_join(F.expr(f"transform(s, o_orderkey -> {_drawn(v)})"), "")
    return rows.select(F.col("o_custkey").alias("doc"), F.concat(F.expr(_HEAD), shapes, F.lit("</svg>")).alias("svg"))


def _attr(name: str, raw: str = "raw") -> str:
    """SQL for an attribute's value, null where there is none; the drawings hold no spaces around its sign."""
    return f"""CASE WHEN regexp_matches({raw}, '\\s{name}=["'']') THEN regexp_extract({raw}, '\\s{name}=(?:"([^"]*)|''([^'']*))', 1) || regexp_extract({raw}, '\\s{name}=(?:"([^"]*)|''([^'']*))', 2) END"""


def _sql_tags(source: str) -> str:
    from folioscope.sources.markup import _TAG, NAME, noiseless

    return f"""src AS (SELECT doc, {noiseless("svg")} AS s FROM ({source})),
cut AS (SELECT doc, regexp_extract_all(s, '{_TAG}') AS m, string_split_regex(s, '{_TAG}') AS g FROM src),
tag AS (SELECT doc, unnest(range(len(m))) AS pos, unnest(m) AS raw, unnest(g[:len(m)]) AS before FROM cut),
t AS (SELECT doc, pos, raw, before, regexp_replace(regexp_extract(raw, '^</?({NAME})', 1), '^.*:', '') AS name, raw LIKE '</%' AS closing, raw LIKE '%/>' AS alone FROM tag)"""


_SQL_STEPS = f"""piece AS (SELECT doc, pos, regexp_extract_all(d, '{PIECE}') AS p FROM path),
part AS (SELECT doc, pos, unnest(range(len(p))) AS i, unnest(p) AS s FROM piece),
num AS (SELECT doc, pos, i, upper(s[1]) AS up, s[1] = lower(s[1]) AS rel, list_transform(regexp_extract_all(s, '{NUMBER}'), lambda v: CAST(v AS DOUBLE)) AS n FROM part),
arity AS (SELECT doc, pos, i, up, rel, n, CASE up {" ".join(f"WHEN '{c}' THEN {n}" for c, n in ARITY.items())} END AS k FROM num),
args AS (SELECT doc, pos, i, j, CASE WHEN up = 'M' AND j > 0 THEN 'L' ELSE up END AS c, rel, k, n[j * k + 1 : j * k + k] AS a
FROM (SELECT *, unnest(range(CASE WHEN k = 0 THEN 1 ELSE greatest(1, CAST(ceil(len(n) / k) AS INT)) END)) AS j FROM arity)),
line AS (SELECT *, row_number() OVER (PARTITION BY doc, pos ORDER BY i, j) AS o FROM args),
walk AS (SELECT doc, pos, CAST(0 AS BIGINT) AS o, '' AS c, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS sx, 0.0::DOUBLE AS sy, CAST([] AS DOUBLE[][]) AS pts, false AS over FROM path
UNION ALL SELECT doc, pos, o, c, ex, ey, CASE WHEN c = 'M' THEN ex ELSE sx END, CASE WHEN c = 'M' THEN ey ELSE sy END,
CASE WHEN short OR c = 'Z' THEN [] WHEN c = 'C' THEN [[px + a[1], py + a[2]], [px + a[3], py + a[4]], [ex, ey]] WHEN c IN ('S', 'Q') THEN [[px + a[1], py + a[2]], [ex, ey]] ELSE [[ex, ey]] END, short
FROM (SELECT *, CASE WHEN short THEN x WHEN c = 'Z' THEN sx WHEN c = 'V' THEN x WHEN c IN ('M', 'L', 'T', 'H') THEN px + a[1] WHEN c = 'C' THEN px + a[5] WHEN c = 'A' THEN px + a[6] ELSE px + a[3] END AS ex,
CASE WHEN short THEN y WHEN c = 'Z' THEN sy WHEN c = 'H' THEN y WHEN c = 'V' THEN py + a[1] WHEN c IN ('M', 'L', 'T') THEN py + a[2] WHEN c = 'C' THEN py + a[6] WHEN c = 'A' THEN py + a[7] ELSE py + a[4] END AS ey
FROM (SELECT l.doc, l.pos, l.o, l.c, l.a, len(l.a) < l.k AS short, w.x, w.y, w.sx, w.sy, CASE WHEN l.rel THEN w.x ELSE 0 END AS px, CASE WHEN l.rel THEN w.y ELSE 0 END AS py
FROM walk w JOIN line l ON l.doc = w.doc AND l.pos = w.pos AND l.o = w.o + 1 WHERE NOT w.over))),
step AS (SELECT doc, pos, o - 1 AS step, c, pts FROM walk WHERE o > 0)"""


_PATHS = f"""{_sql_tags(drawn_sql(0))}, path AS (SELECT doc, pos, {_attr("d")} AS d FROM t WHERE name = 'path' AND NOT closing), {_SQL_STEPS}"""


@query(f"""WITH RECURSIVE {_PATHS} SELECT doc, CAST(pos AS INT) AS pos, CAST(step AS INT) AS step, c AS command, CAST(len(pts) AS INT) AS points,
array_to_string(list_transform(pts, lambda p: CAST(CAST(floor(p[1] * 1000 + 0.5) AS BIGINT) AS VARCHAR) || ',' || CAST(CAST(floor(p[2] * 1000 + 0.5) AS BIGINT) AS VARCHAR)), ' ') AS at FROM step""")
def r2_path_steps(spark, sf_dir):
    """R2: every step of the paths drawn for the customers: command and points, in thousandths."""
    tags = markup(drawn(spark, sf_dir), "doc", "svg").filter("name = 'path' and not closing")
    steps = path_steps(tags.select("doc", "pos", attribute("attrs", "d").alias("d")), "doc", "pos")
    whole = lambda v: F.floor(v * 1000 + 0.5).cast("string")
    at = F.array_join(F.transform("points", lambda p: F.concat(whole(p["x"]), F.lit(","), whole(p["y"]))), " ")
    return steps.select("doc", "pos", "step", "command", F.size("points").alias("points"), at.alias("at"))


@query(f"""WITH RECURSIVE {_PATHS} SELECT doc, CAST(pos AS INT) AS pos, string_agg(c || n, ' ' ORDER BY c) AS commands, CAST(sum(n) AS BIGINT) AS steps
FROM (SELECT doc, pos, c, count(*) AS n FROM step GROUP BY ALL) GROUP BY doc, pos""")
def r2_command_histogram(spark, sf_dir):
    """R2: how often each command stands in a path."""
    tags = markup(drawn(spark, sf_dir), "doc", "svg").filter("name = 'path' and not closing")
    steps = path_steps(tags.select("doc", "pos", attribute("attrs", "d").alias("d")), "doc", "pos")
    rows = steps.groupBy("doc", "pos", "command").count().groupBy("doc", "pos")
    said = F.transform(F.array_sort(F.collect_list(F.struct("command", "count"))), lambda c: F.concat(c["command"], c["count"].cast("string")))
    return rows.agg(F.array_join(said, " ").alias("commands"), F.sum("count").alias("steps"))


_MUL = """[m[1] * n[1] + m[3] * n[2], m[2] * n[1] + m[4] * n[2], m[1] * n[3] + m[3] * n[4], m[2] * n[3] + m[4] * n[4], m[1] * n[5] + m[3] * n[6] + m[5], m[2] * n[5] + m[4] * n[6] + m[6]]"""
# All tags in order with the stack of matrices of the open elements; own is the matrix of a tag's transform text.
_SQL_CTM = rf"""call AS (SELECT doc, pos, list_transform(regexp_extract_all(coalesce({_attr("transform")}, ''), '[a-zA-Z]+\s*\([^)]*\)'), lambda f: {{'f': regexp_extract(f, '^[a-zA-Z]+'),
'n': list_transform(list_filter(regexp_split_to_array(regexp_extract(f, '\(([^)]*)\)', 1), '[\s,]+'), lambda v: v <> ''), lambda v: CAST(v AS DOUBLE))}}) AS f FROM t WHERE NOT closing),
mat AS (SELECT doc, pos, list_transform(f, lambda x: CASE x.f WHEN 'matrix' THEN x.n WHEN 'translate' THEN [1, 0, 0, 1, x.n[1], coalesce(x.n[2], 0)] WHEN 'scale' THEN [x.n[1], 0, 0, coalesce(x.n[2], x.n[1]), 0, 0]
WHEN 'rotate' THEN [cos(radians(x.n[1])), sin(radians(x.n[1])), -sin(radians(x.n[1])), cos(radians(x.n[1])),
CASE WHEN len(x.n) >= 3 THEN x.n[2] - cos(radians(x.n[1])) * x.n[2] + sin(radians(x.n[1])) * x.n[3] ELSE 0 END, CASE WHEN len(x.n) >= 3 THEN x.n[3] - sin(radians(x.n[1])) * x.n[2] - cos(radians(x.n[1])) * x.n[3] ELSE 0 END]
WHEN 'skewX' THEN [1, 0, tan(radians(x.n[1])), 1, 0, 0] WHEN 'skewY' THEN [1, tan(radians(x.n[1])), 0, 1, 0, 0] ELSE [1, 0, 0, 1, 0, 0] END) AS ms FROM call),
own AS (SELECT doc, pos, list_reduce([[1, 0, 0, 1, 0, 0]::DOUBLE[]] || ms, lambda m, n: {_MUL}) AS n FROM mat),
ord AS (SELECT t.doc, t.pos, t.closing, t.alone, own.n FROM t LEFT JOIN own ON own.doc = t.doc AND own.pos = t.pos),
nest AS (SELECT doc, CAST(-1 AS BIGINT) AS pos, CAST(NULL AS DOUBLE[]) AS ctm, [[1, 0, 0, 1, 0, 0]::DOUBLE[]] AS stack FROM (SELECT DISTINCT doc FROM t) UNION ALL
SELECT doc, pos, ctm, CASE WHEN closing THEN CASE WHEN len(stack) > 1 THEN stack[:-2] ELSE stack END WHEN alone THEN stack ELSE stack || [ctm] END
FROM (SELECT doc, pos, closing, alone, stack, CASE WHEN NOT closing THEN {_MUL} END AS ctm FROM (SELECT o.doc, o.pos, o.closing, o.alone, o.n, nest.stack, nest.stack[-1] AS m FROM nest JOIN ord o ON o.doc = nest.doc AND o.pos = nest.pos + 1)))"""


@query(f"""WITH RECURSIVE {_sql_tags(drawn_sql(0))}, {_SQL_CTM} SELECT doc, CAST(pos AS INT) AS pos, floor(ctm[1] * 1000 + 0.5) AS a, floor(ctm[2] * 1000 + 0.5) AS b, floor(ctm[3] * 1000 + 0.5) AS c,
floor(ctm[4] * 1000 + 0.5) AS d, floor(ctm[5] * 1000 + 0.5) AS e, floor(ctm[6] * 1000 + 0.5) AS f FROM nest WHERE ctm IS NOT NULL AND pos >= 0""")
def r1_nested_transforms(spark, sf_dir):
    """R1 over F3: the matrix that each element of the drawings is drawn with, in thousandths."""
    opens = opened(drawn(spark, sf_dir), "doc", "svg").filter("not closing").select("doc", "pos", "alone", "depth", attribute("attrs", "transform").alias("transform"))
    rows = opens.select("doc", "pos").join(placed(opens, "doc"), ["doc", "pos"], "left")
    still = dict(zip("abcdef", (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), strict=True))
    return rows.select("doc", "pos", *[F.floor(F.coalesce(f"ctm.{k}", F.lit(v)) * 1000 + 0.5).cast("double").alias(k) for k, v in still.items()])


def _sql_paint(name: str) -> str:
    style = f"regexp_extract(coalesce({_attr('style')}, ''), '(?:^|;)\\s*{name}\\s*:\\s*([^;]+)', 1)"
    return f"nullif(nullif(lower(trim(CASE WHEN {style} <> '' THEN {style} ELSE {_attr(name)} END)), 'inherit'), '')"


def _sql_num(name: str) -> str:
    return f"coalesce(TRY_CAST(regexp_extract({_attr(name)}, '^\\s*([-+]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][-+]?\\d+)?)', 1) AS DOUBLE), 0)"


def _sql_signatures(v: int) -> str:
    n = {k: _sql_num(k) for k in ("x", "y", "width", "height", "cx", "cy", "r", "rx", "ry", "x1", "y1", "x2", "y2")}
    around = lambda rx, ry: f"[[{n['cx']} - {rx}, {n['cy']} - {ry}], [{n['cx']} + {rx}, {n['cy']} + {ry}]]"
    held = f"list_transform(list_filter(regexp_split_to_array({_attr('points')}, '[\\s,]+'), lambda q: q <> ''), lambda q: CAST(q AS DOUBLE))"
    text = "replace(replace(replace(replace(before, '&lt;', '<'), '&#38;', '&'), '&gt;', '>'), '&amp;', '&')"
    for code in range(65, 91):
        text = f"replace({text}, '&#{code};', '{chr(code)}')"
    text = text.replace("'&amp;', '&')", "'&gt;', '>')", 1)  # & last, below
    return f"""{_sql_tags(drawn_sql(v))}, path AS (SELECT doc, pos, {_attr("d")} AS d FROM t WHERE name = 'path' AND NOT closing), {_SQL_STEPS}, {_SQL_CTM},
shape AS (SELECT doc, pos, CASE WHEN name IN ('rect', 'image', 'use') THEN [[{n["x"]}, {n["y"]}], [{n["x"]} + {n["width"]}, {n["y"]} + {n["height"]}]] WHEN name = 'circle' THEN {around(n["r"], n["r"])}
WHEN name = 'ellipse' THEN {around(n["rx"], n["ry"])} WHEN name = 'line' THEN [[{n["x1"]}, {n["y1"]}], [{n["x2"]}, {n["y2"]}]]
WHEN name IN ('polygon', 'polyline') THEN list_transform(range(len({held}) // 2), lambda i: [({held})[2 * i + 1], ({held})[2 * i + 2]])
WHEN name IN ('text', 'tspan') AND ({_attr("x")} IS NOT NULL OR {_attr("y")} IS NOT NULL) THEN [[{n["x"]}, {n["y"]}]] END AS pts FROM t WHERE NOT closing AND name <> 'svg'),
pt AS (SELECT doc, pos, unnest(pts) AS p FROM shape UNION ALL SELECT doc, pos, unnest(pts) FROM step),
box AS (SELECT doc, count(*) AS points, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM (SELECT pt.doc, m[1] * p[1] + m[3] * p[2] + m[5] AS x, m[2] * p[1] + m[4] * p[2] + m[6] AS y
FROM pt JOIN (SELECT doc, pos, ctm AS m FROM nest) c ON c.doc = pt.doc AND c.pos = pt.pos) GROUP BY doc),
facet AS (SELECT doc, 'elements' AS facet, name AS key FROM t WHERE NOT closing UNION ALL SELECT doc, 'paths', c FROM step
UNION ALL SELECT doc, 'fills', {_sql_paint("fill")} FROM t WHERE NOT closing UNION ALL SELECT doc, 'strokes', {_sql_paint("stroke")} FROM t WHERE NOT closing
UNION ALL SELECT doc, 'fonts', {_sql_paint("font-family")} FROM t WHERE NOT closing),
cnt AS (SELECT doc, facet, key, count(*) AS n FROM facet WHERE key IS NOT NULL AND NOT (facet IN ('fills', 'strokes') AND key = 'none') GROUP BY ALL),
inside AS (SELECT doc, pos, replace({text}, '&amp;', '&') AS chunk, sum(CASE WHEN name = 'text' THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS depth FROM t),
said AS (SELECT doc, trim(regexp_replace(string_agg(chunk, ' ' ORDER BY pos), '\\s+', ' ', 'g')) AS text FROM inside WHERE depth > 0 AND trim(chunk) <> '' GROUP BY doc),
sums AS (SELECT doc, count(*) AS total, count(*) FILTER (WHERE name IN {SHAPES}) AS drawn, any_value(list_transform(regexp_split_to_array({_attr("viewBox")}, '[\\s,]+'), lambda q: CAST(q AS DOUBLE))) FILTER (WHERE name = 'svg') AS view,
any_value({_sql_num("width")}) FILTER (WHERE name = 'svg') AS width, any_value({_sql_num("height")}) FILTER (WHERE name = 'svg') AS height FROM t WHERE NOT closing GROUP BY doc),
sig AS (SELECT s.doc, view, width, height, total, drawn, coalesce(points, 0) AS points, coalesce(text, '') AS text, floor(x0 * 1000 + 0.5) / 1000 AS box_x, floor(y0 * 1000 + 0.5) / 1000 AS box_y,
floor((x1 - x0) * 1000 + 0.5) / 1000 AS box_w, floor((y1 - y0) * 1000 + 0.5) / 1000 AS box_h FROM sums s LEFT JOIN said USING (doc) LEFT JOIN box USING (doc))"""


_FACET = "coalesce((SELECT string_agg(key || '=' || n, ';' ORDER BY key) FROM cnt c WHERE c.doc = sig.doc AND facet = '{0}'), '') AS {0}"


@query(f"""WITH RECURSIVE {_sql_signatures(0)} SELECT doc, array_to_string(view, ' ') AS view_box, width, height, total, drawn, points, {", ".join(_FACET.format(f) for f in FACETS)},
length(text) AS chars, sha256(text) AS hash, floor(box_x * 100 + 0.5) AS x, floor(box_y * 100 + 0.5) AS y, floor(box_w * 100 + 0.5) AS w, floor(box_h * 100 + 0.5) AS h FROM sig""")
def e17_drawing_signatures(spark, sf_dir):
    """E17 with all its facets, E14 and E16's inputs, on the customers' drawings; boxes in hundredths."""
    rows = signatures(drawn(spark, sf_dir), "doc", "svg")
    said = lambda f: F.array_join(F.transform(F.array_sort(F.map_entries(f)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias(f)
    near = {k: F.floor(F.col(f"bbox.{c}") * 100 + 0.5).cast("double").alias(k) for k, c in zip("xywh", ("x", "y", "width", "height"), strict=True)}
    return rows.select(
        "doc", F.array_join(F.transform("view_box", lambda v: v.cast("string")), " ").alias("view_box"), "width", "height", "total", "drawn", "points", *[said(f) for f in FACETS],
        "chars", "hash", *near.values(),
    )


def _version(spark, sf_dir: str, v: int, where: str = "true") -> DataFrame:
    """Signatures of a version's drawings, dealt out by document: those of about 100,000 orders meet in a task, whatever Spark
    takes a signature's size for."""
    signed_ = signatures(drawn(spark, sf_dir, v).filter(where), "doc", "svg")
    return spread(signed_, table(spark, sf_dir, "orders").count(), 100_000, "doc")


_PAIRS = f"""s0 AS (WITH RECURSIVE {_sql_signatures(0)} SELECT * FROM sig), s1 AS (WITH RECURSIVE {_sql_signatures(1)} SELECT * FROM sig),
c0 AS (WITH RECURSIVE {_sql_signatures(0)} SELECT * FROM cnt), c1 AS (WITH RECURSIVE {_sql_signatures(1)} SELECT * FROM cnt),
gap AS (SELECT doc, facet, key, coalesce(c0.n, 0) AS a, coalesce(c1.n, 0) AS b FROM c0 FULL JOIN c1 USING (doc, facet, key)),
alike AS (SELECT doc, facet, sum(least(a, b)) / sum(greatest(a, b)) AS s FROM gap GROUP BY doc, facet),
diff AS (SELECT doc, CASE WHEN facet = 'fonts' OR facet = 'elements' AND least(a, b) = 0 THEN 'major' ELSE 'minor' END AS severity,
CASE facet {" ".join(f"WHEN '{f}' THEN '{n}'" for f, n in FACETS.items())} END || ':' || key || ' ' || a || ' ' || b AS field, list_position({list(FACETS)}, facet) AS o, -abs(a - b) AS g, key FROM gap WHERE a <> b),
pair AS (SELECT doc, s0.text = s1.text AS same, length(s0.text) AS la, length(s1.text) AS lb, s0.box_x IS NULL AND s1.box_x IS NULL AS bare, (s0.box_x IS NULL) <> (s1.box_x IS NULL) AS lone,
abs(s0.box_x - s1.box_x) AS dx, abs(s0.box_y - s1.box_y) AS dy, abs(s0.box_w - s1.box_w) AS dw, abs(s0.box_h - s1.box_h) AS dh, sqrt(s0.box_w ** 2 + s0.box_h ** 2) AS diagonal FROM s0 JOIN s1 USING (doc)),
every AS (SELECT doc, severity, field, o, g, key FROM diff UNION ALL SELECT doc, CASE WHEN la = lb THEN 'minor' ELSE 'major' END, 'text ' || la || ' ' || lb, 6, 0, '' FROM pair WHERE NOT same
UNION ALL SELECT doc, 'major', 'bbox.x', 7, 0, '' FROM pair WHERE dx > 0.5 UNION ALL SELECT doc, 'major', 'bbox.y', 8, 0, '' FROM pair WHERE dy > 0.5 UNION ALL SELECT doc, 'major', 'bbox.width', 9, 0, '' FROM pair WHERE dw > 0.5
UNION ALL SELECT doc, 'major', 'bbox.height', 10, 0, '' FROM pair WHERE dh > 0.5 UNION ALL SELECT doc, 'major', 'bbox', 11, 0, '' FROM pair WHERE lone),
says AS (SELECT doc, string_agg(severity || ' ' || field, '|' ORDER BY o, g, key) AS differences, count(*) FILTER (WHERE severity = 'major') AS majors FROM every GROUP BY doc),
like_ AS (SELECT doc, {", ".join(f"coalesce(max(s) FILTER (WHERE facet = '{f}'), 1) AS {f}" for f in FACETS)} FROM pair LEFT JOIN alike USING (doc) GROUP BY doc),
scored AS (SELECT doc, elements, paths, fills, strokes, fonts, CASE WHEN same OR la + lb = 0 THEN 1 ELSE least(la, lb) / greatest(la, lb, 1) END AS text,
CASE WHEN lone THEN 0 WHEN diagonal > 0 THEN greatest(0, 1 - greatest(dx, dy, dw, dh) / diagonal) ELSE CAST(bare OR greatest(dx, dy, dw, dh) = 0 AS INT) END AS bbox,
coalesce(differences, '') AS differences, coalesce(majors, 0) = 0 AND NOT lone AND (bare OR greatest(dx, dy, dw, dh) <= 0.5) AS match FROM pair JOIN like_ USING (doc) LEFT JOIN says USING (doc))"""
_SCORE = f"floor(({' + '.join(f'{k} * {w}' for k, w in WEIGHTS.items())}) / {sum(WEIGHTS.values())} * 1000 + 0.5) / 1000"


def _named(diffs: Column) -> Column:
    """Differences as text; boxes by field alone."""
    say = lambda d: F.when(d["field"].startswith("bbox"), F.concat_ws(" ", d["severity"], d["field"])).otherwise(F.concat_ws(" ", d["severity"], d["field"], d["a"], d["b"]))
    return F.array_join(F.transform(diffs, say), "|")


@query(f"""WITH {_PAIRS} SELECT doc, {", ".join(f"floor({k} * 1000 + 0.5) / 1000 AS {k}" for k in WEIGHTS)}, {_SCORE} AS score, match, differences FROM scored""")
def d14_drawing_compare(spark, sf_dir):
    """D14, E15, E16 in full: the drawings of each customer in two versions, with graded differences in order."""
    side = lambda v, n: (lambda s: s.select("doc", F.struct(*[c for c in s.columns if c != "doc"]).alias(n)))(_version(spark, sf_dir, v))
    rows = compared(side(0, "a").hint("merge").join(side(1, "b"), "doc"), "a", "b")  # else one side would be broadcast
    return rows.select("doc", *[r3(F.col(f"likeness.{k}")).alias(k) for k in WEIGHTS], "score", "match", _named(F.col("differences")).alias("differences"))


_BASELINE = f"""WITH {_PAIRS}, st AS (SELECT doc, CASE WHEN doc % 10 = 0 THEN 'new' WHEN doc % 11 = 0 THEN 'missing' WHEN match THEN 'unchanged' ELSE 'CHANGED' END AS status, {_SCORE} AS score
FROM scored WHERE doc % 110 <> 0)"""


def _baseline(spark, sf_dir) -> DataFrame:
    return against_baseline(_version(spark, sf_dir, 1, "doc % 11 <> 0"), _version(spark, sf_dir, 0, "doc % 10 <> 0"), "doc")


@query(f"{_BASELINE} SELECT doc, status, CASE WHEN status IN ('unchanged', 'CHANGED') THEN score END AS score FROM st")
def d13_drawing_baseline(spark, sf_dir):
    """D13 by D14: the later version of the drawings against the earlier as baseline; some were added since, some are gone."""
    return _baseline(spark, sf_dir).select("doc", "status", "score")


@query(f"""{_BASELINE} SELECT count(*) FILTER (WHERE status = 'new') AS new, count(*) FILTER (WHERE status = 'unchanged') AS unchanged, count(*) FILTER (WHERE status = 'CHANGED') AS changed,
count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status <> 'unchanged') = 0 AS pass FROM st""")
def d13_baseline_pass(spark, sf_dir):
    """Whether the run passes against its baseline."""
    return passes(_baseline(spark, sf_dir))
