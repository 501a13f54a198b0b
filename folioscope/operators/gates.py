"""Filters and gates: what may be read, what came out, what a person must see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.reference import OUTCOME
from folioscope.plans.catalog import query, table

# Bytes a file may have; picture kinds no output can hold, and those a slide can.
LIMIT = 128 * 1024 * 1024
METAFILES = ("wmf", "emf")
READABLE = ("png", "jpeg", "gif", "bmp", "svg", "tiff")
_MIME = "CASE p_partkey % 8 WHEN 0 THEN 'wmf' WHEN 1 THEN 'emf' WHEN 2 THEN 'png' WHEN 3 THEN 'jpeg' WHEN 4 THEN 'gif' WHEN 5 THEN 'bmp' WHEN 6 THEN 'svg' ELSE 'webp' END"


@query(f"""SELECT doc_id, CASE WHEN n = 0 THEN 'empty' WHEN n > {LIMIT} THEN 'too large' WHEN magic <> 'D0CF11E0' THEN 'not a publication' ELSE 'ok' END AS gate
FROM (SELECT doc_id, n_chars * (doc_id % 5) * (1 + doc_id % 40000) AS n, CASE WHEN doc_id % 7 = 0 THEN '25504446' ELSE 'D0CF11E0' END AS magic FROM documents)""")
def c1_pre_parse(spark, sf_dir):
    """Size 0, size over the limit, wrong first bytes; the first that holds."""
    k = F.col("doc_id")
    n, magic = F.col("n_chars") * (k % 5) * (1 + k % 40000), F.when(k % 7 == 0, "25504446").otherwise("D0CF11E0")
    gate = F.when(n == 0, "empty").when(n > LIMIT, "too large").when(magic != "D0CF11E0", "not a publication").otherwise("ok")
    return table(spark, sf_dir, "documents").select("doc_id", gate.alias("gate"))


_PARTS = """SELECT d.doc_id, count(l.doc_id) AS elements, coalesce(max(length(trim(CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE d.text END))), 0) AS chars,
count(*) FILTER (WHERE l.quality = 1) AS images FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.doc_id"""
_VERDICT = "CASE WHEN elements = 0 THEN 'empty' WHEN chars = 0 AND images = 0 THEN 'partial' ELSE 'ok' END"


def _verdicts(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length(F.trim(F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("text")))).alias("chars"))
    found = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("elements"), F.count_if(F.col("quality") == 1).alias("images"))
    rows = docs.join(found, "doc_id", "left").fillna(0)
    return rows.select("doc_id", F.expr(_VERDICT).alias("verdict"))


@query(f"SELECT doc_id, {_VERDICT} AS verdict FROM ({_PARTS})")
def c2_verdict(spark, sf_dir):
    """Empty, partial or ok; documents without elements stay by the left join."""
    return _verdicts(spark, sf_dir)


@query(f"SELECT {_VERDICT} AS verdict, count(*) AS n FROM ({_PARTS}) GROUP BY ALL")
def e25_verdict_split(spark, sf_dir):
    """Documents of each verdict."""
    return _verdicts(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"))


@query(f"""SELECT p_partkey, mime, CASE WHEN mime IN ('wmf', 'emf') THEN 'dropped' WHEN mime NOT IN {READABLE} THEN 'unknown' ELSE 'kept' END AS fate,
CASE WHEN mime IN ('wmf', 'emf') THEN 'METAFILE' WHEN mime NOT IN {READABLE} THEN 'PICTURE' ELSE '' END AS warning FROM (SELECT p_partkey, {_MIME} AS mime FROM part)""")
def c3_pictures(spark, sf_dir):
    """Metafiles are dropped with a warning each; a list of kinds says what else can be read."""
    m = F.col("mime")
    bad, known = m.isin(*METAFILES), m.isin(*READABLE)
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_MIME).alias("mime")).select(
        "p_partkey", "mime", F.when(bad, "dropped").when(~known, "unknown").otherwise("kept").alias("fate"),
        F.when(bad, "METAFILE").when(~known, "PICTURE").otherwise("").alias("warning"),
    )


@query(f"""SELECT o_orderkey, outcome IN ('failed', 'unreadable', 'caveats') OR o_orderkey % 13 = 0 AS attention FROM (SELECT o_orderkey, {OUTCOME} AS outcome FROM orders)""")
def c7_attention(spark, sf_dir):
    """Failed, unreadable, with caveats, or with a problem of any kind (every thirteenth has one)."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(OUTCOME).alias("outcome"))
    return rows.select("o_orderkey", (F.col("outcome").isin("failed", "unreadable", "caveats") | (F.col("o_orderkey") % 13 == 0)).alias("attention"))


_READY = "CASE WHEN o_orderkey % 29 = 0 THEN 'unreadable' END"


@query(f"""SELECT o_orderkey, CASE WHEN {_READY} IS NOT NULL THEN {_READY} WHEN o_custkey % 4 = 0 AND o_orderkey % 3 > 0 THEN 'skipped' WHEN o_custkey % 4 = 0 THEN 'failed'
WHEN o_orderkey % 5 = 0 OR o_orderpriority LIKE '1%' THEN 'caveats' ELSE 'converted' END AS outcome FROM orders""")
def c8_outcome(spark, sf_dir):
    """From what was written (o_custkey % 4), skipped (o_orderkey % 3) and warned of."""
    written, skipped = F.col("o_custkey") % 4, F.col("o_orderkey") % 3
    warned = (F.col("o_orderkey") % 5 == 0) | F.col("o_orderpriority").startswith("1")
    ready = F.when(F.col("o_orderkey") % 29 == 0, "unreadable")
    outcome = F.when(ready.isNotNull(), ready).when((written == 0) & (skipped > 0), "skipped").when(written == 0, "failed").when(warned, "caveats")
    return table(spark, sf_dir, "orders").select("o_orderkey", outcome.otherwise("converted").alias("outcome"))


@query(f"""SELECT CASE WHEN count(*) = 0 OR count(*) FILTER (WHERE outcome IN ('converted', 'caveats', 'skipped')) = 0 THEN 2
WHEN count(*) FILTER (WHERE outcome IN ('failed', 'unreadable', 'caveats')) > 0 THEN 1 ELSE 0 END AS status FROM (SELECT {OUTCOME} AS outcome FROM orders)""")
def c10_exit_status(spark, sf_dir):
    """2 if nothing came out, 1 if something needs a person, else 0."""
    of = lambda *n: F.count_if(F.col("outcome").isin(*n))
    status = F.when((F.count("*") == 0) | (of("converted", "caveats", "skipped") == 0), 2).when(of("failed", "unreadable", "caveats") > 0, 1).otherwise(0)
    return table(spark, sf_dir, "orders").select(F.expr(OUTCOME).alias("outcome")).agg(status.alias("status"))


_WHY = "CASE WHEN page_id % 31 = 0 THEN 'failed' WHEN length(html) < 800 THEN 'empty' WHEN page_id % 17 = 0 THEN 'reference failed' WHEN page_id % 13 = 0 THEN 'reference blank' ELSE 'scored' END"


@query(f"SELECT page_id, {_WHY} AS state, CASE WHEN {_WHY} = 'scored' THEN 1.0 * (page_id % 10) / 10 ELSE -1.0 END AS score FROM pages")
def c11_skip_reasons(spark, sf_dir):
    """C11: why a page has no score; every page stays a row (no score: -1)."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(_WHY).alias("state"))
    return rows.withColumn("score", F.when(F.col("state") == "scored", 1.0 * (F.col("page_id") % 10) / 10).otherwise(-1.0))


@query("SELECT event_type, max(ts) FILTER (WHERE event_id % 2 = 0) > max(ts) FILTER (WHERE event_id % 2 = 1) AS stale FROM events GROUP BY event_type")
def c12_stale(spark, sf_dir):
    """Is the newest input (even ids) later than the newest measurement (odd ids)?"""
    side = lambda n: F.max(F.when(F.col("event_id") % 2 == n, F.col("ts")))
    return table(spark, sf_dir, "events").groupBy("event_type").agg((side(0) > side(1)).alias("stale"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, '7')")
def c13_name_filter(spark, sf_dir):
    """C13."""
    return table(spark, sf_dir, "part").filter(F.col("p_name").contains("7")).select("p_partkey", "p_name")


@query(r"""SELECT doc_id, count(*) FILTER (WHERE length(trim(w)) BETWEEN 6 AND 254 AND regexp_matches(trim(w), '^[^@]+@[^@]+\.[^@.]+$')) AS emails
FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM documents) GROUP BY doc_id""")
def c14_email_shape(spark, sf_dir):
    """C14: words of the shape of an address."""
    ok = lambda w: F.length(F.trim(w)).between(6, 254) & F.trim(w).rlike(r"^[^@]+@[^@]+\.[^@.]+$")
    words = F.split(F.coalesce("text", F.lit("")), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(words, ok)).cast("long").alias("emails"))


_RULES = (
    ("GRADIENT", "l_linenumber % 3 = 0 AND l_quantity < 10"), ("METAFILE", "l_shipdate < '1995-01-01'"), ("SHADOW", "l_returnflag = 'R' AND l_tax = 0"),
    ("ROTATED", "l_discount > 0.08"), ("TEXT_SCALE", "abs(l_quantity * 4 - 100) > 90"), ("OVERSET", "l_extendedprice < l_quantity * 900"),
)


@query(" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS code FROM lineitem WHERE {w}" for c, w in _RULES))
def c15_loss_rules(spark, sf_dir):
    """One warning row per rule that hits; one scan for all rules."""
    hits = F.array_compact(F.array(*[F.when(F.expr(w), c) for c, w in _RULES]))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(hits).alias("code"))
