"""Order, limits and lists of the report; formats asked for; transforms of drawn paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.scalars import ALIASES
from folioscope.operators.reference import OUTCOME
from folioscope.plans.catalog import query, table


@query("SELECT event_type AS code, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY event_type")
def g2_loss_order(spark, sf_dir):
    """Codes by count, then by name; one row per code reaches the numbering."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "code")))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 3")
def g3_slowest(spark, sf_dir):
    """The three dearest; each task keeps three."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rows.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(3)


_CAPS = "CASE WHEN outcome IN ('failed', 'unreadable', 'caveats') THEN 'flagged' ELSE 'clean' END"


@query(f"""SELECT section, o_orderkey, k FROM (SELECT section, o_orderkey, row_number() OVER (PARTITION BY section ORDER BY o_orderkey) AS k FROM
(SELECT o_orderkey, {_CAPS} AS section FROM (SELECT o_orderkey, {OUTCOME} AS outcome FROM orders))) WHERE k <= CASE section WHEN 'flagged' THEN 40 ELSE 20 END""")
def g5_capped_lists(spark, sf_dir):
    """The first 40 flagged and 20 clean files; Spark keeps that many per section and task before the shuffle."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(OUTCOME).alias("outcome")).select("o_orderkey", F.expr(_CAPS).alias("section"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("section").orderBy("o_orderkey"))).filter("k <= 40")
    return rows.filter("section = 'flagged' OR k <= 20").select("section", "o_orderkey", "k")


@query("""WITH r AS (SELECT user_id AS run, max(ts) AS t FROM events GROUP BY user_id), k AS (SELECT *, row_number() OVER (ORDER BY t DESC, run) AS k, max(t) OVER () AS now FROM r)
SELECT run FROM k WHERE k > 3 AND t <= now - INTERVAL 30 MINUTE""")
def g6_old_runs(spark, sf_dir):
    """Runs beyond the newest three that nobody touched for half an hour, as a list to delete."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("run")).agg(F.max("ts").alias("t"))
    newest = runs.orderBy(F.desc("t"), "run").limit(3).select("run")
    now = runs.agg(F.max("t").alias("now"))  # one row
    rows = runs.join(newest, "run", "left_anti").join(F.broadcast(now), F.col("t") <= F.col("now") - F.expr("INTERVAL 30 MINUTES"))
    return rows.select("run")


def formats(text: Column) -> Column:
    """H2: distinct formats in the order asked, other names resolved."""

    def resolved(x: Column) -> Column:
        out = x
        for a, b in ALIASES.items():
            out = F.when(x == a, b).otherwise(out)
        return out

    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), "[ ,]+"), lambda x: x != ""), resolved))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'pptx,docx' WHEN 1 THEN 'docx,pdf' WHEN 2 THEN 'pdf' ELSE 'svg,pptx' END AS formats FROM part""")
def h2_formats(spark, sf_dir):
    """H2 on lists of names."""
    asked = F.element_at(F.array(*[F.lit(x) for x in ("PowerPoint, pptx word", "doc,docx, pdf", "pdf pdf", "svg powerpoint,")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(formats(asked), ",").alias("formats"))


@query(f"""SELECT o_orderkey AS source, outcome AS state, 1 AS result FROM (SELECT o_orderkey, {OUTCOME} AS outcome FROM orders) UNION ALL SELECT c_custkey, 'attention', 0 FROM customer WHERE c_acctbal < 0""")
def h3_report_rows(spark, sf_dir):
    """H3: results and problem rows in one report."""
    results = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.expr(OUTCOME).alias("state"), F.lit(1).alias("result"))
    problems = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("source"), F.lit("attention").alias("state"))
    return results.unionByName(problems, allowMissingColumns=True).fillna(0, ["result"])


def compose(matrices: Column) -> Column:
    """Product of an array of structs a..f, outermost first."""
    start = F.struct(*[F.lit(v).alias(k) for k, v in zip("abcdef", (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))])

    def times(m, n):
        return F.struct(
            (m["a"] * n["a"] + m["c"] * n["b"]).alias("a"), (m["b"] * n["a"] + m["d"] * n["b"]).alias("b"),
            (m["a"] * n["c"] + m["c"] * n["d"]).alias("c"), (m["b"] * n["c"] + m["d"] * n["d"]).alias("d"),
            (m["a"] * n["e"] + m["c"] * n["f"] + m["e"]).alias("e"), (m["b"] * n["e"] + m["d"] * n["f"] + m["f"]).alias("f"),
        )

    return F.aggregate(matrices, start, times)


@query("""WITH RECURSIVE m AS (SELECT l_orderkey, list(CAST(l_quantity % 3 + 1 AS DOUBLE) ORDER BY l_linenumber, l_partkey, l_quantity % 3) AS s, list(CAST(l_partkey % 7 AS DOUBLE) ORDER BY l_linenumber, l_partkey, l_quantity % 3) AS t FROM lineitem GROUP BY l_orderkey),
r AS (SELECT l_orderkey, s, t, 0 AS i, CAST(1 AS DOUBLE) AS k, CAST(0 AS DOUBLE) AS e FROM m UNION ALL SELECT l_orderkey, s, t, i + 1, k * s[i + 1], k * t[i + 1] + e FROM r WHERE i < len(s))
SELECT l_orderkey, k AS scale, e AS shift, k * 10 + e AS x FROM r WHERE i = len(s)""")
def r1_affine(spark, sf_dir):
    """Nested scales and shifts of an order's lines, applied to the point 10."""
    s, t, zero = (F.col("l_quantity") % 3 + 1).cast("double"), (F.col("l_partkey") % 7).cast("double"), F.lit(0.0)
    m = F.struct(s.alias("a"), zero.alias("b"), zero.alias("c"), s.alias("d"), t.alias("e"), zero.alias("f"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", m.alias("m")))).alias("l"))
    rows = rows.select("l_orderkey", compose(F.transform("l", lambda x: x["m"])).alias("m"))
    return rows.select("l_orderkey", F.col("m.a").alias("scale"), F.col("m.e").alias("shift"), (F.col("m.a") * 10 + F.col("m.e")).alias("x"))


def path_points(path: Column) -> Column:
    """R2: end points of a path's M, L, H, V and Z commands, upper case absolute and lower case relative."""
    parts = F.regexp_extract_all(path, F.lit("[MLHVZmlhvz][^A-Za-z]*"), F.lit(0))
    start = F.struct(F.expr("cast(array() as array<struct<c:string,x:double,y:double>>)").alias("p"), *[F.lit(0.0).alias(c) for c in ("x", "y", "sx", "sy")])

    def step(s, part):
        c = F.substring(part, 1, 1)
        n = F.transform(F.regexp_extract_all(part, F.lit("-?[0-9]+(?:\\.[0-9]+)?"), F.lit(0)), lambda v: v.cast("double"))
        up, low = F.upper(c), c == F.lower(c)
        first, second = F.get(n, F.lit(0)), F.get(n, F.lit(1))
        bx, by = F.when(low, s["x"]).otherwise(0.0), F.when(low, s["y"]).otherwise(0.0)
        x = F.when(up == "Z", s["sx"]).when(up == "V", s["x"]).otherwise(bx + first)
        y = F.when(up == "Z", s["sy"]).when(up == "H", s["y"]).when(up == "V", by + first).otherwise(by + second)
        return F.struct(
            F.array_append(s["p"], F.struct(up.alias("c"), x.alias("x"), y.alias("y"))).alias("p"), x.alias("x"), y.alias("y"),
            F.when(up == "M", x).otherwise(s["sx"]).alias("sx"), F.when(up == "M", y).otherwise(s["sy"]).alias("sy"),
        )

    return F.aggregate(parts, start, step, lambda s: s["p"])


@query("""SELECT p_partkey, 5 AS points, 1 AS moves, CAST(p_size AS DOUBLE) AS x0, CAST(p_size + p_partkey % 50 AS DOUBLE) AS x1, CAST(p_size + 3 AS DOUBLE) AS y2 FROM part""")
def r2_path_points(spark, sf_dir):
    """R2 on a box drawn as a path: five commands, the last back at the start."""
    path = F.format_string("M%d %d h%d v3 L%d %d Z", F.col("p_size"), F.col("p_size"), (F.col("p_partkey") % 50).cast("int"), F.col("p_size"), F.col("p_size") + 3)
    rows = table(spark, sf_dir, "part").select("p_partkey", path_points(path).alias("p"))
    return rows.select(
        "p_partkey", F.size("p").alias("points"), F.size(F.filter("p", lambda x: x["c"] == "M")).alias("moves"), F.get("p", F.lit(0))["x"].alias("x0"),
        F.get("p", F.lit(1))["x"].alias("x1"), F.get("p", F.lit(3))["y"].alias("y2"),
    )


@query("SELECT doc_id, regexp_replace(text, '[^\\x00-\\x{FF}]', '?', 'g') AS text FROM documents")
def r3_charset(spark, sf_dir):
    """A text through Latin-1 bytes and back; what it cannot hold is a question mark."""
    held = F.encode(F.regexp_replace("text", "[^\\x00-\\x{FF}]", "?"), "ISO-8859-1")
    return table(spark, sf_dir, "documents").select("doc_id", F.decode(held, "ISO-8859-1").alias("text"))
