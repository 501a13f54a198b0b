"""Ordered operators: numbering, trimming, names that never collide, line breaking."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.plans.catalog import query, table


@query("""WITH p AS (SELECT conv_id, turn, CASE WHEN turn = 0 OR turn % 6 = 5 THEN 0 ELSE length(text) END AS n FROM conversations),
e AS (SELECT conv_id, min(turn) FILTER (WHERE n > 0) AS a, max(turn) FILTER (WHERE n > 0) AS b FROM p GROUP BY conv_id)
SELECT p.conv_id, turn, turn - a + 1 AS page, n = 0 AS blank FROM p JOIN e ON e.conv_id = p.conv_id WHERE turn BETWEEN a AND b""")
def f4_trim_edges(spark, sf_dir):
    """blank pages go at the edges only; the rest is numbered anew."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when((F.col("turn") == 0) | (F.col("turn") % 6 == 5), 0).otherwise(F.length("text")).alias("n"))
    full = F.when(F.col("n") > 0, F.col("turn"))
    edges = rows.groupBy("conv_id").agg(F.min(full).alias("a"), F.max(full).alias("b"))
    kept = rows.join(edges, "conv_id").filter(F.col("turn").between(F.col("a"), F.col("b")))
    return kept.select("conv_id", "turn", (F.col("turn") - F.col("a") + 1).alias("page"), (F.col("n") == 0).alias("blank"))


_KIND = "CASE WHEN turn % 5 = 0 THEN 'open' WHEN turn % 5 = 3 THEN 'close' ELSE 'text' END"


@query(f"""WITH e AS (SELECT conv_id, turn, {_KIND} AS t FROM conversations),
n AS (SELECT *, lag(t) OVER w AS before, count(*) FILTER (WHERE t = 'open') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS opened FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CAST(sum(CASE WHEN t = 'open' OR t = 'text' AND (before = 'close' OR before IS NULL) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS paragraph
FROM n QUALIFY t <> 'close'""")
def f5_paragraphs(spark, sf_dir):
    """an open starts a paragraph, and so does text that stands after a close."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_KIND).alias("t"))
    rows = rows.withColumn("before", F.lag("t").over(w))
    stray = (F.col("t") == "text") & (F.col("before").isNull() | (F.col("before") == "close"))
    start = F.when((F.col("t") == "open") | stray, 1).otherwise(0)
    rows = rows.withColumn("paragraph", F.sum(start).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("t <> 'close'").select("conv_id", "turn", "paragraph")


@query("""SELECT conv_id, run_id, min(turn) AS first, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT *, sum(CASE WHEN fmt IS DISTINCT FROM prev THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run_id
FROM (SELECT *, lag(fmt) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT conv_id, turn, text, CASE WHEN turn % 3 = 2 THEN NULL ELSE turn // 3 % 2 END AS fmt FROM conversations))) GROUP BY conv_id, run_id""")
def f6_run_text(spark, sf_dir):
    """neighbouring text of one format (null-safe) joined to runs, in order."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    fmt = F.when(F.col("turn") % 3 != 2, F.floor(F.col("turn") / 3) % 2)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", fmt.alias("fmt"))
    new = (~F.col("fmt").eqNullSafe(F.lag("fmt").over(w)) | F.lag("turn").over(w).isNull() & F.col("fmt").isNotNull()).cast("int")
    rows = rows.withColumn("new", new)
    rows = rows.withColumn("run_id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy("conv_id", "run_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return runs.select("conv_id", F.col("run_id").cast("double").alias("run_id"), F.get("t", F.lit(0))["turn"].alias("first"), F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber ELSE dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 END AS row,
row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) - 1 AS col, greatest(1, l_suppkey % 4 - 1) AS span FROM lineitem""")
def f8_cells(spark, sf_dir):
    """F8: a cell's row as given, else the rows so far; its column is the cells so far; spans are at least 1."""
    n = F.col("l_linenumber")
    row = F.coalesce(F.when(n % 3 == 0, n), F.dense_rank().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1)
    col = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_extendedprice")) - 1
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", row.alias("row"), col.alias("col"), F.greatest(F.lit(1), F.col("l_suppkey") % 4 - 1).alias("span")
    )


def folded(name: Column) -> Column:
    """A name as file systems compare it: composed, then in lower case. Spark has no normal forms, so Arrow batches do it."""

    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda n: None if n is None else unicodedata.normalize("NFC", n).lower())

    return F.pandas_udf(fold, "string")(name)


def claim_names(files: DataFrame) -> DataFrame:
    """files(source, folder, stem) to names that never collide: the n-th claim of a folded stem takes ` (n)`. Folded is composed
    (NFC) and in lower case, so that a letter and the same letter with its accent apart meet.

    A name that some stem has by itself is left to it: claims are numbered past the numbers taken so. Groups are the
    folded stems without a trailing ` (n)`, so only names that can meet share a task; each group is one folder's.
    """
    files = files.withColumn("key", folded(F.col("stem")))
    key = F.col("key")
    base, number = F.regexp_replace(key, " \\([0-9]+\\)$", ""), F.regexp_extract(key, " \\(([0-9]+)\\)$", 1)
    rows = files.select("*", base.alias("base"), F.when(number == "", 1).otherwise(number.cast("int")).alias("own")).drop("key")
    first = Window.partitionBy("folder", "base", "own").orderBy("source")
    rows = rows.withColumn("turn", F.row_number().over(first))
    kept = rows.filter("turn = 1").select("source", "folder", F.col("stem").alias("name"))
    late = rows.filter("turn > 1").withColumn("k", F.row_number().over(Window.partitionBy("folder", "base").orderBy("own", "turn", "source")))
    taken = rows.filter("turn = 1").groupBy("folder", "base").agg(F.sort_array(F.collect_set("own")).alias("taken"))
    late = late.join(taken, ["folder", "base"])
    # The k-th free number: move past every taken one at or below it.
    free = F.aggregate("taken", F.col("k") + 1, lambda n, t: F.when((t > 1) & (t <= n), n + 1).otherwise(n))
    name = F.concat(F.regexp_replace("stem", " \\([0-9]+\\)$", ""), F.lit(" ("), free.cast("string"), F.lit(")"))
    return kept.unionByName(late.select("source", "folder", name.alias("name")))


_NAMES = """SELECT c_custkey AS source, c_nationkey AS folder, CASE WHEN c_custkey % 4 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END
|| CASE c_custkey % 5 WHEN 0 THEN 'é' WHEN 1 THEN 'e' || chr(769) WHEN 2 THEN 'É' ELSE '' END AS stem FROM customer"""


@query(f"""WITH f AS ({_NAMES}), n AS (SELECT *, row_number() OVER (PARTITION BY folder, lower(nfc_normalize(stem)) ORDER BY source) AS k FROM f)
SELECT source, folder, CASE WHEN k = 1 THEN stem ELSE stem || ' (' || k || ')' END AS name FROM n""")
def f10_names(spark, sf_dir):
    """F10 on customers; stems that bring their own number are tested apart."""
    stem = F.when(F.col("c_custkey") % 4 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    mark = F.element_at(F.array(*map(F.lit, ("\u00e9", "e\u0301", "\u00c9", "", ""))), (F.col("c_custkey") % 5 + 1).cast("int"))
    stem = F.concat(stem, mark)
    return claim_names(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("folder"), stem.alias("stem")))


@query("""SELECT doc_id, CASE WHEN row_number() OVER w = 1 THEN 'kept' ELSE 'note' END AS fate, first_value(doc_id) OVER w AS kept_as FROM documents
WINDOW w AS (PARTITION BY sha256(text) ORDER BY doc_id % 3 = 0, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def f11_aliases(spark, sf_dir):
    """of the names of one content the real file stays before shortcuts (every third); the others become notes.

    The winner comes from a partial aggregate, so a content with very many names meets in no task.
    """
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.struct((F.col("doc_id") % 3 == 0).alias("via"), "doc_id").alias("o"))
    won = rows.groupBy("h").agg(F.min("o").alias("w")).select(F.col("h").alias("g"), F.col("w.doc_id").alias("kept_as"))
    rows = rows.join(won, F.col("h").eqNullSafe(F.col("g")))
    return rows.select("doc_id", F.when(F.col("doc_id") == F.col("kept_as"), "kept").otherwise("note").alias("fate"), "kept_as")


@query("""SELECT item_id, coalesce(p, 0) AS position, substr(a, greatest(1, coalesce(p, 1) - 20), 40) AS context FROM (SELECT item_id, text AS a,
list_min(list_filter(range(1, greatest(length(text), length(b)) + 1), lambda i: substr(text, i, 1) <> substr(b, i, 1))) AS p FROM
(SELECT item_id, text, CASE WHEN item_id % 3 = 0 THEN text ELSE left(text, CAST(item_id % 30 AS INT)) || '#' || substr(text, CAST(item_id % 30 + 2 AS INT)) END AS b FROM benchmark))""")
def f12_divergence(spark, sf_dir):
    """where two texts first differ (0: nowhere), and 40 characters around it."""
    n = (F.col("item_id") % 30).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n), F.lit("#"), F.substr("text", n + 2, F.length("text")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("a"), F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(edited).alias("b"))
    # Character by character in one pass; the shorter text ends in nulls, which differ.
    differ = F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: ~x.eqNullSafe(y))
    rows = rows.withColumn("p", F.nullif(F.array_position(differ, True), F.lit(0)).cast("int"))
    around = F.substr("a", F.greatest(F.lit(1), F.coalesce("p", F.lit(1)) - 20), F.lit(40))
    return rows.select("item_id", F.coalesce("p", F.lit(0)).alias("position"), around.alias("context"))


def break_lines(words, width: int):
    """greedy lines of words in a monospaced width, as an array of word counts; a longer word has its own line."""
    start = F.struct(F.expr("cast(array() as array<int>)").alias("lines"), F.lit(0).alias("n"), F.lit(0).alias("used"))

    def place(s, w):
        size = F.length(w)
        fits = (s["n"] > 0) & (s["used"] + 1 + size <= width) | (s["n"] == 0)
        joined = F.when(s["n"] == 0, size).otherwise(s["used"] + 1 + size)
        return F.struct(
            F.when(fits, s["lines"]).otherwise(F.array_append(s["lines"], s["n"])).alias("lines"),
            F.when(fits, s["n"] + 1).otherwise(1).alias("n"), F.when(fits, joined).otherwise(size).alias("used"),
        )

    return F.aggregate(words, start, place, lambda s: F.when(s["n"] > 0, F.array_append(s["lines"], s["n"])).otherwise(s["lines"]))


@query("""WITH RECURSIVE w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
r AS (SELECT item_id, w, 0 AS i, 0 AS used, 0 AS line FROM w UNION ALL
SELECT item_id, w, i + 1, CASE WHEN i > 0 AND used + 1 + length(w[i + 1]) <= 60 THEN used + 1 + length(w[i + 1]) ELSE length(w[i + 1]) END,
CASE WHEN i > 0 AND used + 1 + length(w[i + 1]) <= 60 THEN line ELSE line + 1 END FROM r WHERE i < len(w))
SELECT item_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY line) AS lines, count(*) AS height FROM (SELECT item_id, line, count(*) AS n FROM r WHERE i > 0 GROUP BY ALL) GROUP BY item_id""")
def f14_lines(spark, sf_dir):
    """F14 on benchmark paragraphs at 60 characters: words on each line."""
    rows = table(spark, sf_dir, "benchmark").select("item_id", break_lines(F.split("text", " "), 60).alias("l"))
    return rows.select("item_id", F.array_join(F.col("l").cast("array<string>"), ",").alias("lines"), F.size("l").cast("long").alias("height"))


def pack_columns(heights, limit: int, columns: int):
    """column of each paragraph; the next one where it would stand over the limit, but for the last column."""
    start = F.struct(F.expr("cast(array() as array<int>)").alias("at"), F.lit(1).alias("c"), F.lit(0).cast("long").alias("used"))

    def place(s, h):
        over = (s["used"] + h > limit) & (s["used"] > 0) & (s["c"] < columns)
        c = F.when(over, s["c"] + 1).otherwise(s["c"])
        return F.struct(F.array_append(s["at"], c).alias("at"), c.alias("c"), F.when(over, h).otherwise(s["used"] + h).alias("used"))

    return F.aggregate(heights, start, place, lambda s: s["at"])


@query("""WITH RECURSIVE h AS (SELECT conv_id, list(CAST(1 + length(text) % 40 AS BIGINT) ORDER BY turn) AS h FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, h, 0 AS i, 1 AS c, CAST(0 AS BIGINT) AS used FROM h UNION ALL
SELECT conv_id, h, i + 1, CASE WHEN used + h[i + 1] > 60 AND used > 0 AND c < 3 THEN c + 1 ELSE c END, CASE WHEN used + h[i + 1] > 60 AND used > 0 AND c < 3 THEN h[i + 1] ELSE used + h[i + 1] END FROM r WHERE i < len(h))
SELECT conv_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY i) AS columns FROM r WHERE i > 0 GROUP BY conv_id""")
def f15_columns(spark, sf_dir):
    """F15 on turns as paragraphs, three columns of 60."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (1 + F.length("text") % 40).cast("long").alias("h")))).alias("p"))
    return rows.select("conv_id", F.array_join(pack_columns(F.transform("p", lambda x: x["h"]), 60, 3).cast("array<string>"), ",").alias("columns"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber % 3 + 1) < 4 * (1 + l_suppkey % 4) AS overset, CASE WHEN l_quantity / (l_linenumber % 3 + 1) < 4 * (1 + l_suppkey % 4) THEN 1 ELSE l_linenumber % 3 + 1 END AS columns FROM lineitem""")
def f16_overset(spark, sf_dir):
    """F16: columns narrower than the largest type are laid across the page, with a warning."""
    columns, em = F.col("l_linenumber") % 3 + 1, 4 * (1 + F.col("l_suppkey") % 4)
    over = F.col("l_quantity") / columns < em
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", over.alias("overset"), F.when(over, 1).otherwise(columns).alias("columns"))
