"""Corpus profile, gates, loss accounting, report order and event delivery, each with the same query in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.scalars import round_js, to_fraction
from folioscope.plans.catalog import query, written
from folioscope.plans.catalog import table as _t


@query("""SELECT event_type AS key, count(*) AS n, count(DISTINCT user_id) AS files,
min(event_id) AS first_seen FROM events GROUP BY event_type""")
def e_coverage_profile(spark, sf_dir):
    """E-family corpus profile: occurrences, distinct owners and first sight of each key."""
    return _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(
        F.count("*").alias("n"), F.count_distinct("user_id").alias("files"), F.min("event_id").alias("first_seen")
    )


@query("""SELECT l_orderkey, l_linenumber,
CASE (l_linenumber % 4) WHEN 0 THEN l_quantity WHEN 1 THEN l_quantity / 20.0 WHEN 2 THEN l_quantity * 72.0 END AS points,
CASE WHEN isfinite(l_discount) THEN greatest(0.0, least(1.0, l_discount)) END AS fraction,
CASE WHEN l_quantity <= 0 THEN NULL WHEN l_quantity > 10 THEN l_quantity / 100.0 ELSE l_quantity END AS multiplier
FROM lineitem""")
def i_units(spark, sf_dir):
    """Units to points, fractions and multipliers; the unit comes from the line number."""
    u, q = F.col("l_linenumber") % 4, F.col("l_quantity")
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(u == 0, q).when(u == 1, q / 20.0).when(u == 2, q * 72.0).alias("points"),
        to_fraction(F.col("l_discount")).alias("fraction"),
        F.when(q > 10, q / 100.0).when(q > 0, q).alias("multiplier"),
    )


@query("""SELECT l_orderkey, l_returnflag || l_linestatus AS code, CAST(sum(l_suppkey % 3 + 1) AS BIGINT) AS n,
array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') AS pages FROM lineitem GROUP BY ALL""")
def e11_losses_by_file(spark, sf_dir):
    """Warnings of one code in one file become one line: counts summed, distinct pages sorted."""
    code = F.concat("l_returnflag", "l_linestatus")
    pages = F.array_join(F.sort_array(F.collect_set("l_linenumber")).cast("array<string>"), ",")
    return _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", code.alias("code")).agg(
        F.sum(F.col("l_suppkey") % 3 + 1).alias("n"), pages.alias("pages")
    )


@query("""SELECT conv_id, turn, role,
CAST(sum(CASE WHEN role IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn
ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM (SELECT conv_id, turn, role,
lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations)""")
def f6_run_merge(spark, sf_dir):
    """gaps and islands; neighbours of equal format share a run."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("prev"))
    new = (~F.col("role").eqNullSafe(F.col("prev"))).cast("int")
    run = F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("conv_id", "turn", "role", run.alias("run_id"))


@query("""SELECT doc_id, sha256(text) AS text_hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS kept,
count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents""")
def a8_exact_copies(spark, sf_dir):
    """A8 on files: byte-equal ones share a key, null texts one of their own. Copies are counted before the join back, so a hot text is pre-aggregated."""
    rows = _t(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"))
    sums = rows.groupBy("text_hash").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))
    sums = sums.withColumnRenamed("text_hash", "of")
    return rows.join(sums, F.col("text_hash").eqNullSafe(F.col("of"))).select("doc_id", "text_hash", "kept", "copies")


@query("""SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
'"', '&quot;'), '''', '&#39;') AS escaped, CASE WHEN octet_length(encode(text)) <= 262144 THEN 'accept' ELSE 'too_large'
END AS status, 60000 + 15000 * CAST(ceil(octet_length(encode(text)) / 1048576.0) AS BIGINT) AS budget_ms
FROM documents""")
def j5_body_cap(spark, sf_dir):
    """Escaped text, body cap and silence budget by size."""
    size = F.octet_length("text")
    esc = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    return _t(spark, sf_dir, "documents").select(
        "doc_id",
        esc.alias("escaped"),
        F.when(size <= 262144, "accept").otherwise("too_large").alias("status"),
        (60000 + 15000 * F.ceil(size / 1048576.0)).cast("long").alias("budget_ms"),
    )


_STEP = """SELECT e.user_id, min(ts) AS t FROM events e JOIN {0} ON e.user_id = {0}.user_id AND e.event_type = '{1}'
AND e.ts >= {0}.t GROUP BY e.user_id"""


@query(f"""WITH f AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY user_id),
c AS ({_STEP.format("f", "click")}), s AS ({_STEP.format("c", "signup")}), p AS ({_STEP.format("s", "purchase")}),
u AS (SELECT DISTINCT user_id FROM events)
SELECT count(f.t) AS visits, count(c.t) AS clicks, count(s.t) AS signups, count(p.t) AS paid, count(*) AS users FROM u
LEFT JOIN f USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN p USING (user_id)""")
def j9_funnel(spark, sf_dir):
    """Funnel with a fixed denominator; each step is the first at or after the step before, one shuffle by user."""
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    seen, before = _t(spark, sf_dir, "events").select("user_id", "ts", "event_type"), None
    for kind in ("view", "click", "signup", "purchase"):
        ok = (F.col("event_type") == kind) & (F.lit(True) if before is None else F.col(before) <= F.col("ts"))
        seen, before = seen.withColumn(kind, F.min(F.when(ok, F.col("ts"))).over(w)), kind
    users = seen.groupBy("user_id").agg(*[F.min(k).alias(k) for k in ("view", "click", "signup", "purchase")])
    return users.agg(
        F.count("view").alias("visits"), F.count("click").alias("clicks"), F.count("signup").alias("signups"),
        F.count("purchase").alias("paid"), F.count("*").alias("users"),
    )


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(DISTINCT user_id) AS users FROM events
WHERE event_type IN ('view', 'click', 'signup', 'purchase', 'error') GROUP BY ALL""")
def j9_funnel_daily(spark, sf_dir):
    """J9, the daily form: distinct users of each step and day."""
    kinds = F.col("event_type").isin("view", "click", "signup", "purchase", "error")
    return _t(spark, sf_dir, "events").filter(kinds).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(
        F.count_distinct("user_id").alias("users")
    )


@query("""SELECT CASE WHEN n_chars < 500 THEN 'a' WHEN n_chars < 1000 THEN 'b' WHEN n_chars < 5000 THEN 'c' ELSE 'd' END AS bucket,
source, count(*) AS n FROM documents GROUP BY ALL""")
def j10_intent(spark, sf_dir):
    """Size bucket counts by source."""
    n = F.col("n_chars")
    bucket = F.when(n < 500, "a").when(n < 1000, "b").when(n < 5000, "c").otherwise("d")
    return _t(spark, sf_dir, "documents").groupBy(bucket.alias("bucket"), "source").agg(F.count("*").alias("n"))


@query("""SELECT event_type AS key, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS a,
count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS b, abs(count(*) FILTER (ts < TIMESTAMP '2024-01-16') -
count(*) FILTER (ts >= TIMESTAMP '2024-01-16')) AS gap FROM events GROUP BY event_type ORDER BY gap DESC, key""")
def d9_histogram_diff(spark, sf_dir):
    """Counts of each key on two sides, here the halves of the month; both sides in one pass, no join."""
    later = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    return _t(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(
        F.count_if(~later).alias("a"), F.count_if(later).alias("b")
    ).withColumn("gap", F.abs(F.col("a") - F.col("b"))).orderBy(F.desc("gap"), "key")  # one row per key


@query("""SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL""")
def e5_event_counts(spark, sf_dir):
    """E5: histogram of event types per file."""
    return _t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


OUTCOME = """CASE WHEN o_orderkey % 23 = 0 THEN 'failed' WHEN o_orderkey % 19 = 0 THEN 'unreadable'
WHEN o_orderkey % 17 = 0 THEN 'skipped' WHEN o_orderstatus = 'P' OR o_orderkey % 5 = 0 THEN 'caveats' ELSE 'converted' END"""
RANK = "CASE outcome WHEN 'failed' THEN 0 WHEN 'unreadable' THEN 1 WHEN 'caveats' THEN 2 WHEN 'converted' THEN 3 ELSE 4 END"


@query(f"""SELECT o_orderkey, rank, weight, row_number() OVER (ORDER BY rank, weight DESC, o_orderkey) AS place FROM
(SELECT o_orderkey, {RANK} AS rank, weight FROM (SELECT o_orderkey, {OUTCOME} AS outcome, o_custkey % 50 + 100 * (o_orderkey % 2) AS weight FROM orders))""")
def g1_report_order(spark, sf_dir):
    """G1: files that need a person first, the heaviest losses first among them.

    Rows are dealt by range, numbered in each range and moved by the rows of the ranges before: no task sorts all.
    """
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", F.expr(OUTCOME).alias("outcome"), F.expr("o_custkey % 50 + 100 * (o_orderkey % 2)").alias("weight"))
    rows = rows.select("o_orderkey", F.expr(RANK).alias("rank"), "weight")
    keys = ("rank", F.desc("weight"), "o_orderkey")
    # The sample behind the ranges is drawn anew per plan, so the number of the range is fixed by writing it once.
    held = written(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()))
    sizes = held.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select("part", before.alias("before"))  # one row per range
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) + F.col("before")
    return held.join(F.broadcast(before), "part").select("o_orderkey", "rank", "weight", place.alias("place"))


@query(f"""SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'failed') AS failed,
count(*) FILTER (WHERE outcome = 'unreadable') AS unreadable, count(*) FILTER (WHERE outcome = 'caveats') AS caveats,
count(*) FILTER (WHERE outcome = 'converted') AS converted, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
count(*) FILTER (WHERE outcome IN ('failed', 'unreadable', 'caveats')) AS attention,
count(*) FILTER (WHERE outcome IN ('converted', 'caveats', 'skipped')) AS written,
CAST(coalesce(sum(CASE WHEN outcome IN ('converted', 'caveats') THEN o_custkey % 3 + 1 ELSE 0 END), 0) AS BIGINT) AS outputs
FROM (SELECT {OUTCOME} AS outcome, o_custkey FROM orders)""")
def e13_run_summary(spark, sf_dir):
    """One row of outcome counts; what was skipped counts as written, outputs are files of its own run."""
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    made = F.when(F.col("outcome").isin("converted", "caveats"), F.col("o_custkey") % 3 + 1).otherwise(0)
    names = ("failed", "unreadable", "caveats", "converted", "skipped")
    return _t(spark, sf_dir, "orders").select(F.expr(OUTCOME).alias("outcome"), "o_custkey").agg(
        F.count("*").alias("total"), *[of(n).alias(n) for n in names], of("failed", "unreadable", "caveats").alias("attention"),
        of("converted", "caveats", "skipped").alias("written"), F.coalesce(F.sum(made), F.lit(0)).alias("outputs"),
    )


_CHANGE = "CASE WHEN turn % 3 = 0 THEN 'start' WHEN turn % 7 = 5 THEN 'end' ELSE 'text' END"


@query(f"""WITH e AS (SELECT conv_id, turn, {_CHANGE} AS t FROM conversations),
n AS (SELECT *, count(*) FILTER (WHERE t = 'start') OVER w AS page, max(CASE WHEN t = 'start' THEN turn END) OVER w AS began,
max(CASE WHEN t = 'end' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended
FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT conv_id, turn, t, CASE WHEN began IS NOT NULL AND (ended IS NULL OR ended < began) THEN page END AS page FROM n""")
def f1_page_number(spark, sf_dir):
    """running count of page starts; what stands after a page's end and before the next start has no page."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_CHANGE).alias("t"))
    rows = rows.select(
        "conv_id", "turn", "t", F.count_if(F.col("t") == "start").over(w).alias("page"),
        F.max(F.when(F.col("t") == "start", F.col("turn"))).over(w).alias("began"),
        F.max(F.when(F.col("t") == "end", F.col("turn"))).over(past).alias("ended"),
    )
    inside = F.col("began").isNotNull() & (F.col("ended").isNull() | (F.col("ended") < F.col("began")))
    return rows.select("conv_id", "turn", "t", F.when(inside, F.col("page")).alias("page"))


@query("""SELECT p_partkey, CASE WHEN p_size - 5 > 0 THEN floor((p_size - 5) / 7.0 * 1000 + 0.5) / 1000 ELSE 612.0 END AS width,
CASE WHEN p_retailprice - 1000 > 0 THEN floor((p_retailprice - 1000) * 1000 + 0.5) / 1000 ELSE 792.0 END AS height FROM part""")
def f2_page_size(spark, sf_dir):
    """page width and height to three places, the default where one is missing or not positive."""
    width, height = (F.col("p_size") - 5).cast("double"), F.col("p_retailprice") - 1000
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(width > 0, round_js(width / 7.0, 3)).otherwise(612.0).alias("width"),
        F.when(height > 0, round_js(height, 3)).otherwise(792.0).alias("height"),
    )
