"""Totals, folds of warnings, boxes and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.scalars import band
from folioscope.operators.reference import OUTCOME
from folioscope.plans.catalog import query, table


@query("""SELECT count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(floor(length(text) * 3 / 4)) AS BIGINT) AS asset_bytes FROM documents""")
def e3_totals(spark, sf_dir):
    """Text and estimated asset bytes of a corpus."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("files"), F.sum(n).alias("chars"), F.sum(F.floor(n * 3 / 4)).alias("asset_bytes"))


@query(f"""SELECT count(*) AS files, count(*) FILTER (WHERE outcome = 'failed') AS failed, coalesce(array_to_string(list_sort(list(o_orderkey) FILTER (WHERE outcome = 'failed'))[1:3], ','), '') AS first_failed FROM (SELECT o_orderkey, {OUTCOME} AS outcome FROM orders)""")
def e6_corpus_totals(spark, sf_dir):
    """Totals with the first three failures named; partial aggregates keep three keys each."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(OUTCOME).alias("outcome"))
    first = rows.filter("outcome = 'failed'").orderBy("o_orderkey").limit(3).agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("first_failed"))
    # One row each.
    return rows.agg(F.count("*").alias("files"), F.count_if(F.col("outcome") == "failed").alias("failed")).join(first, F.lit(True))


@query("SELECT user_id AS doc, event_type AS code, event_id % 4 AS page, count(*) AS n, arg_min(props, event_id) AS message, min(event_id) AS first FROM events GROUP BY ALL")
def e7_warning_fold(spark, sf_dir):
    """Warnings of one code and page fold to a count and the first message."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc"), F.col("event_type").alias("code"), (F.col("event_id") % 4).alias("page"))
    return rows.agg(F.count("*").alias("n"), F.min_by("props", "event_id").alias("message"), F.min("event_id").alias("first"))


@query("SELECT event_type AS code, event_id % 4 AS page, props AS message, count(*) AS n FROM events GROUP BY ALL")
def e8_emitter_fold(spark, sf_dir):
    """The message is part of the key."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("code"), (F.col("event_id") % 4).alias("page"), F.col("props").alias("message")).agg(F.count("*").alias("n"))


_A = "SELECT l_orderkey AS doc, l_returnflag AS code, l_linenumber % 3 AS page, count(*) AS n FROM lineitem WHERE l_tax < 0.05 GROUP BY ALL"
_B = "SELECT l_orderkey AS doc, l_returnflag AS code, l_linenumber % 3 AS page, count(*) AS n FROM lineitem WHERE l_discount < 0.05 GROUP BY ALL"


def _bags(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_orderkey").alias("doc"), F.col("l_returnflag").alias("code"), (F.col("l_linenumber") % 3).alias("page")]
    return [rows.filter(c).groupBy(*keys).agg(F.count("*").alias("n")) for c in ("l_tax < 0.05", "l_discount < 0.05")]


@query(f"SELECT doc, code, page, max(n) AS n FROM ({_A} UNION ALL {_B}) GROUP BY ALL")
def e9_bag_merge(spark, sf_dir):
    """One warning from several sources keeps the larger count, not the sum."""
    a, b = _bags(spark, sf_dir)
    return a.unionByName(b).groupBy("doc", "code", "page").agg(F.max("n").alias("n"))


@query(f"WITH a AS ({_A}), b AS ({_B}) SELECT * FROM a UNION ALL SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc = b.doc AND a.code = b.code AND a.page = b.page)")
def e10_merge_if_absent(spark, sf_dir):
    """What is there already stays as it is."""
    a, b = _bags(spark, sf_dir)
    return a.unionByName(b.join(a, ["doc", "code", "page"], "left_anti").select(*a.columns))


@query("SELECT l_orderkey, CAST(sum(l_suppkey % 3 + 1) + 100 * count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS weight FROM lineitem GROUP BY l_orderkey")
def e12_loss_weight(spark, sf_dir):
    """Losses, and a hundred for each problem."""
    weight = F.sum(F.col("l_suppkey") % 3 + 1) + 100 * F.count_if(F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(weight.alias("weight"))


@query("""SELECT l_orderkey, min(l_partkey % 97) AS x, min(l_suppkey % 89) AS y, max(l_partkey % 97) - min(l_partkey % 97) AS w, max(l_suppkey % 89) - min(l_suppkey % 89) AS h FROM lineitem GROUP BY l_orderkey""")
def e14_bounding_box(spark, sf_dir):
    """Box of an order's points."""
    x, y = F.col("l_partkey") % 97, F.col("l_suppkey") % 89
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.min(x).alias("x"), F.min(y).alias("y"), (F.max(x) - F.min(x)).alias("w"), (F.max(y) - F.min(y)).alias("h")
    )


@query("""SELECT user_id, CASE WHEN sum(greatest(a, b)) = 0 THEN 1.0 ELSE sum(least(a, b)) * 1.0 / sum(greatest(a, b)) END AS similarity FROM
(SELECT user_id, event_type, count(*) FILTER (WHERE event_id % 2 = 0) AS a, count(*) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY ALL) GROUP BY user_id""")
def e15_histogram_similarity(spark, sf_dir):
    """Common part of two histograms, by user, of even and odd events."""
    of = lambda n, c: F.count_if(F.col("event_id") % 2 == n).alias(c)
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(of(0, "a"), of(1, "b"))
    low, high = F.sum(F.least("a", "b")), F.sum(F.greatest("a", "b"))
    return rows.groupBy("user_id").agg(F.when(high == 0, 1.0).otherwise(low / high).alias("similarity"))


_SCORES = "SELECT l_returnflag AS format, l_orderkey AS file, l_linenumber AS page, (l_partkey % 11) / 10.0 AS score FROM lineitem"


@query(f"""WITH f AS (SELECT format, file, count(*) AS pages, CAST(sum(CAST(score * 10 AS INT)) AS BIGINT) AS s FROM ({_SCORES}) GROUP BY ALL),
r AS (SELECT format, count(*) AS files, CAST(sum(pages) AS BIGINT) AS pages, floor(avg(s * 1.0 / pages) * 10 + 0.5) / 100 AS by_file, floor(sum(s) * 1.0 / sum(pages) * 10 + 0.5) / 100 AS by_page,
count(*) FILTER (WHERE s >= 9 * pages) AS good, count(*) FILTER (WHERE s >= 6 * pages AND s < 9 * pages) AS fair, count(*) FILTER (WHERE s < 6 * pages) AS poor FROM f GROUP BY format)
SELECT * FROM r UNION ALL SELECT 'overall', CAST(sum(files) AS BIGINT), CAST(sum(pages) AS BIGINT), floor(sum(CAST(by_file * 100 AS INT)) * 1.0 / count(*) * 10 + 0.5) / 1000, -1, CAST(sum(good) AS BIGINT), CAST(sum(fair) AS BIGINT), CAST(sum(poor) AS BIGINT) FROM r""")
def e24_by_format(spark, sf_dir):
    """Files, pages, mean of file and of page scores and bands of each format; overall is the mean of the formats."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("format"), F.col("l_orderkey").alias("file"), (F.col("l_partkey") % 11).alias("tenths"))
    f = rows.groupBy("format", "file").agg(F.count("*").alias("pages"), F.sum("tenths").alias("s"))
    f = f.withColumn("band", F.when(F.col("s") >= 9 * F.col("pages"), "good").when(F.col("s") >= 6 * F.col("pages"), "fair").otherwise("poor"))
    r = f.groupBy("format").agg(
        F.count("*").alias("files"), F.sum("pages").alias("pages"), (F.floor(F.avg(F.col("s") / F.col("pages")) * 10 + 0.5) / 100).alias("by_file"),
        (F.floor(F.sum("s") / F.sum("pages") * 10 + 0.5) / 100).alias("by_page"), *[F.count_if(F.col("band") == b).alias(b) for b in ("good", "fair", "poor")],
    )
    mean = F.floor(F.sum(F.round(F.col("by_file") * 100)) / F.count("*") * 10 + 0.5) / 1000
    total = r.agg(F.lit("overall").alias("format"), F.sum("files").alias("files"), F.sum("pages").alias("pages"), mean.alias("by_file"), F.lit(-1.0).alias("by_page"), *[F.sum(b).alias(b) for b in ("good", "fair", "poor")])
    return r.unionByName(total)


@query("""SELECT p_brand, array_to_string(n[1:6], ', ') || CASE WHEN len(n) > 6 THEN ', ...' ELSE '' END AS fonts, len(n) AS substituted FROM (SELECT p_brand, list_sort(list(DISTINCT p_name)) AS n FROM part WHERE trim(p_name) <> '' GROUP BY p_brand)""")
def e26_substituted_fonts(spark, sf_dir):
    """Distinct names, the first six told. Distinct rows are numbered, so that no list of all names is built."""
    rows = table(spark, sf_dir, "part").filter("trim(p_name) <> ''").select("p_brand", "p_name").distinct()
    count = rows.groupBy("p_brand").agg(F.count("*").alias("substituted"))
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_name"))
    first = rows.withColumn("k", k).filter("k <= 6").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("p_name")), ", ").alias("f"))
    return first.join(count, "p_brand").select("p_brand", F.concat("f", F.when(F.col("substituted") > 6, ", ...").otherwise("")).alias("fonts"), "substituted")


@query("""SELECT p_partkey, p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_tax < 0.02 UNION SELECT l_suppkey FROM lineitem WHERE l_tax > 0.07) AS orphan FROM part""")
def e27_referenced_assets(spark, sf_dir):
    """Assets that elements or fills refer to; the rest are orphans."""
    line = table(spark, sf_dir, "lineitem")
    used = line.filter("l_tax < 0.02").select(F.col("l_partkey").alias("p_partkey")).union(line.filter("l_tax > 0.07").select("l_suppkey")).distinct()
    rows = table(spark, sf_dir, "part").select("p_partkey").join(used.withColumn("used", F.lit(True)), "p_partkey", "left")
    return rows.select("p_partkey", F.col("used").isNull().alias("orphan"))


@query("""SELECT l_orderkey, count(*) FILTER (WHERE size <> first) AS unlike FROM (SELECT l_orderkey, l_suppkey % 2 AS size, first_value(l_suppkey % 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS first FROM lineitem) GROUP BY l_orderkey""")
def e28_mixed_page_size(spark, sf_dir):
    """Pages unlike page 1: the first page by a partial aggregate, then an equi-join."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 2).alias("size"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("place"))
    first = rows.groupBy("l_orderkey").agg(F.min_by("size", "place").alias("first"))
    return rows.join(first, "l_orderkey").groupBy("l_orderkey").agg(F.count_if(F.col("size") != F.col("first")).alias("unlike"))


@query("""SELECT conv_id, bool_or(trim(CASE WHEN turn % 2 = 0 THEN '' ELSE text END) <> '') AS carries_text, max(CASE WHEN turn % 3 = 0 THEN 12 ELSE turn END) AS largest FROM conversations GROUP BY conv_id""")
def e29_carries_text(spark, sf_dir):
    """Does a page carry text, and the largest type on it (12 where none is given)?"""
    text, size = F.when(F.col("turn") % 2 == 0, "").otherwise(F.col("text")), F.when(F.col("turn") % 3 != 0, F.col("turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.trim(text) != "").alias("carries_text"), F.max(F.coalesce(size, F.lit(12))).alias("largest"))


@query("SELECT l_orderkey, CASE WHEN m >= 90 THEN 'good' WHEN m >= 60 THEN 'fair' ELSE 'poor' END AS band FROM (SELECT l_orderkey, max(l_partkey % 101) AS m FROM lineitem GROUP BY l_orderkey)")
def i24_bands(spark, sf_dir):
    """I24 on the best line of an order."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.col("l_partkey") % 101).alias("m")).select("l_orderkey", band(F.col("m") / 100.0).alias("band"))
