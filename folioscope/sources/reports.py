"""Reports of a batch: every file's losses as sentences, twelve CSV columns, a JSON object with its summary, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import csv_cell, describe_loss, human_bytes
from folioscope.plans.catalog import query, table

# The columns, the outcomes in the order of a report with their words, the bad ones among them.
COLUMNS = ("Source file", "Size (bytes)", "Size", "Outcome", "Needs attention", "Pages", "Output files", "Format", "Format chosen automatically", "Why this format", "What was lost", "Note")
OUTCOMES = {
    "failed": "Could not be converted", "unreadable": "Nothing could be read from it", "converted-with-caveats": "Converted, but something was lost",
    "converted": "Converted", "skipped": "Skipped",
}
BAD = ("failed", "unreadable", "converted-with-caveats")
# Sentences for codes; a code without one speaks by its first message.
PLAIN = {"GRADIENT_FLATTENED": "A colour fade became one flat colour.", "SHADOW_DROPPED": "A shadow is missing."}
RESULT = """source string, absolute string, size_bytes bigint, outcome string, outputs array<struct<format:string,path:string>>, pages bigint,
warnings array<struct<code:string,message:string,page:int,count:bigint>>, problems array<string>, message string, format struct<format:string,automatic:boolean,because:string>, ms bigint"""


def _list(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(f"array<{kind}>"))


def losses(plain: dict[str, str] | None = None) -> Column:
    """A result's problems as they stand, then each code once: its sentence with how often and where, the most frequent
    first, then by code."""
    held = _list("warnings", "struct<code:string,message:string,page:int,count:bigint>")
    known = F.create_map(*[F.lit(x) for p in (PLAIN if plain is None else plain).items() for x in p]).cast("map<string,string>")

    def group(code: Column) -> Column:
        own = F.filter(held, lambda w: w["code"] == code)
        count = F.aggregate(own, F.lit(0).cast("bigint"), lambda s, w: s + F.coalesce(w["count"], F.lit(1).cast("bigint")))
        pages = F.array_sort(F.array_distinct(F.array_compact(F.transform(own, lambda w: w["page"]))))
        sentence = F.coalesce(F.element_at(known, code), F.get(own, F.lit(0))["message"], F.lit(""))
        return F.struct((-count).alias("order"), code.alias("code"), count.alias("count"), pages.alias("pages"), sentence.alias("sentence"))

    groups = F.array_sort(F.transform(F.array_distinct(F.array_compact(F.transform(held, lambda w: w["code"]))), group))
    return F.concat(_list("problems", "string"), F.transform(groups, lambda g: describe_loss(g["sentence"], g["count"], g["pages"])))


def ranked(results: DataFrame, plain: dict[str, str] | None = None) -> DataFrame:
    """Results with rank, weight, attention and lost (sentences); report order is rank, weight downwards, source."""
    warned = F.aggregate(_list("warnings", "struct<code:string,message:string,page:int,count:bigint>"), F.lit(0).cast("bigint"), lambda s, w: s + F.coalesce(w["count"], F.lit(1).cast("bigint")))
    troubles = F.size(_list("problems", "string"))
    rank = F.lit(len(OUTCOMES))
    for n, name in enumerate(OUTCOMES):
        rank = F.when(F.col("outcome") == name, n).otherwise(rank)
    attention = F.coalesce(F.col("outcome").isin(*BAD), F.lit(False)) | (troubles > 0)
    return results.withColumns({"rank": rank, "weight": warned + 100 * troubles, "attention": attention, "lost": losses(plain)})


def csv_line() -> Column:
    """The safe line of a ranked result."""
    words = F.create_map(*[F.lit(x) for p in OUTCOMES.items() for x in p])
    outputs = _list("outputs", "struct<format:string,path:string>")
    formats = F.when(F.size(outputs) > 0, F.array_join(F.array_distinct(F.transform(outputs, lambda o: o["format"])), "; ")).otherwise(F.col("format.format"))
    cells = (
        F.col("source"), F.col("size_bytes").cast("string"), human_bytes(F.col("size_bytes")), F.element_at(words, F.col("outcome")), F.when(F.col("attention"), "yes").otherwise("no"),
        F.col("pages").cast("string"), F.array_join(F.filter(F.transform(outputs, lambda o: o["path"]), lambda p: p != ""), "; "), formats,
        F.when(F.col("format").isNotNull(), F.when(F.col("format.automatic"), "yes").otherwise("no")), F.col("format.because"), F.array_join("lost", "; "), F.col("message"),
    )
    return F.concat_ws(",", *[csv_cell(F.coalesce(c, F.lit(""))) for c in cells])


def json_line() -> Column:
    """The object of a ranked result; what is absent is left out."""
    seconds = F.floor(F.col("ms") / 10 + 0.5) / 100
    return F.to_json(F.struct(
        F.col("source").alias("file"), F.col("absolute").alias("path"), F.col("size_bytes").alias("sizeBytes"), "outcome", F.col("attention").alias("needsAttention"), "pages",
        F.coalesce("outputs", F.array().cast("array<struct<format:string,path:string>>")).alias("outputs"), "format", F.col("message").alias("note"), "lost", "warnings", seconds.alias("seconds"),
    ))


def summary(results: DataFrame) -> DataFrame:
    """E13 of ranked results: total, each outcome, attention, written (skipped ones are written already) and outputs."""
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return results.agg(
        F.count("*").alias("total"), *[of(n).alias(n) for n in OUTCOMES], F.count_if("attention").alias("attention"),
        of("converted", "converted-with-caveats", "skipped").alias("written"), F.coalesce(F.sum(F.size(_list("outputs", "struct<format:string,path:string>"))), F.lit(0)).alias("outputs"),
    )


def _in_order(rows: DataFrame, head: str) -> DataFrame:
    """Lines of rows(rank, weight, source, value) in report order behind one head, dealt by range: no task holds the whole report."""
    first = rows.sparkSession.createDataFrame([(-1, 0, "", head)], "rank int, weight bigint, source string, value string")
    keys = ("rank", F.desc("weight"), "source")
    every = first.unionByName(rows.select("rank", "weight", "source", "value"))
    return every.repartitionByRange(*keys).sortWithinPartitions(*keys).select("value")


def write_csv(results: DataFrame, path: str, plain: dict[str, str] | None = None) -> None:
    """The report as CRLF lines in parts, in the parts' order: a byte order mark and the header stand in the first alone."""
    rows = ranked(results, plain).select("rank", "weight", "source", csv_line().alias("value"))
    _in_order(rows, "﻿" + ",".join(COLUMNS)).write.option("lineSep", "\r\n").text(path)


def write_json(results: DataFrame, path: str, plain: dict[str, str] | None = None, **context: object) -> None:
    """One JSON object a line in parts, in the parts' order: first the run (``context`` and the summary), then the files."""
    rows = ranked(results, plain)
    run = F.struct(*[F.lit(v).alias(k) for k, v in context.items() if v is not None], F.struct("*").alias("summary"))
    head = summary(rows).select(F.to_json(run).alias("v")).first()["v"]  # one row of counts
    _in_order(rows.select("rank", "weight", "source", json_line().alias("value")), head).write.text(path)


# A result for each order: its lines are the warnings, some of one code and page; other parts from its own numbers.
_K = "o_orderkey"
_FIELDS = {
    "source": f"concat(CASE {_K} % 5 WHEN 0 THEN '=' WHEN 1 THEN 'a,' WHEN 2 THEN ' ' ELSE '' END, 'f', {_K}, '.doc')", "absolute": f"concat('/in/', {_K})", "size_bytes": f"CAST({_K} * {_K} AS BIGINT)",
    "outcome": f"CASE WHEN {_K} % 23 = 0 THEN 'failed' WHEN {_K} % 19 = 0 THEN 'unreadable' WHEN {_K} % 17 = 0 THEN 'skipped' WHEN {_K} % 5 < 2 THEN 'converted-with-caveats' ELSE 'converted' END",
    "pages": f"CAST({_K} % 9 AS BIGINT)", "message": f"CASE WHEN {_K} % 7 = 0 THEN concat('say \"', {_K}, '\"') END", "ms": f"CAST({_K} % 10007 AS BIGINT)",
}


def _results(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    warnings = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_suppkey") % 3 == 0, "SHADOW_DROPPED").when(F.col("l_suppkey") % 3 == 1, "GRADIENT_FLATTENED").otherwise("OTHER").alias("code"),
        F.concat(F.lit("m"), F.col("l_partkey").cast("string")).alias("message"), F.nullif(F.col("l_linenumber") % 4, F.lit(0)).cast("int").alias("page"), F.nullif(F.col("l_partkey") % 3, F.lit(0)).cast("bigint").alias("count"),
    ))).alias("w"))
    rows = table(spark, sf_dir, "orders").join(warnings, "o_orderkey", "left")
    output = lambda f: F.struct(F.lit(f).alias("format"), F.concat(F.lit("o"), k.cast("string"), F.lit(f".{f}")).alias("path"))
    outputs = F.when(k % 4 == 0, F.array(output("pptx"), output("pdf"))).when(k % 4 == 1, F.array(output("pdf"))).otherwise(F.array().cast("array<struct<format:string,path:string>>"))
    chosen = F.when(k % 3 > 0, F.struct(F.lit("docx").alias("format"), (k % 3 == 1).alias("automatic"), F.lit("one box").alias("because")))
    problems = F.when(k % 11 == 0, F.array(F.lit("the disk is full")))
    given = F.transform("w", lambda w: F.struct(w["code"].alias("code"), w["message"].alias("message"), w["page"].alias("page"), w["count"].alias("count")))
    return rows.select("o_orderkey", *[F.expr(v).alias(n) for n, v in _FIELDS.items()], outputs.alias("outputs"), chosen.alias("format"), problems.alias("problems"), given.alias("warnings"))


_CELL = lambda c: f"""CASE WHEN regexp_matches({c}, '^[=+\\-@\\t\\r]') THEN '''' || {c} ELSE {c} END"""
_QUOTE = lambda c: f"""CASE WHEN regexp_matches({c}, '["\\r\\n,\\t]|^ | $') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""
_SQL = f"""w AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, CASE l_suppkey % 3 WHEN 0 THEN 'SHADOW_DROPPED' WHEN 1 THEN 'GRADIENT_FLATTENED' ELSE 'OTHER' END AS code,
'm' || l_partkey AS message, nullif(l_linenumber % 4, 0) AS page, nullif(l_partkey % 3, 0) AS n FROM lineitem),
g AS (SELECT k, code, sum(coalesce(n, 1)) AS n, list_sort(list(DISTINCT page) FILTER (page IS NOT NULL)) AS pages, CASE code {" ".join(f"WHEN '{c}' THEN '{s}'" for c, s in PLAIN.items())} ELSE arg_min(message, i) END AS said FROM w GROUP BY k, code),
d AS (SELECT k, code, n, said || coalesce(' (' || nullif(concat_ws(', ', CASE WHEN n > 1 THEN n || ' times' END, CASE len(pages) WHEN 0 THEN NULL WHEN 1 THEN 'page ' || pages[1] ELSE 'pages ' || array_to_string(pages[:-2], ', ') || ' and ' || pages[-1] END), '') || ')', '') AS said FROM g),
l AS (SELECT k, string_agg(said, '; ' ORDER BY n DESC, code) AS lost, sum(n) AS weight FROM d GROUP BY k),
r AS (SELECT o_orderkey, {", ".join(f"{v} AS {n}" for n, v in _FIELDS.items())}, o_orderkey AS k, l.* EXCLUDE (k), o_orderkey % 11 = 0 AS trouble FROM orders LEFT JOIN l ON l.k = o_orderkey),
s AS (SELECT *, concat_ws('; ', CASE WHEN trouble THEN 'the disk is full' END, lost) AS lost_, CASE outcome {" ".join(f"WHEN '{o}' THEN {n}" for n, o in enumerate(OUTCOMES))} END AS rank, coalesce(weight, 0) + CASE WHEN trouble THEN 100 ELSE 0 END AS weight_,
outcome IN {BAD} OR trouble AS attention, CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS made, size_bytes / 1024 AS kb FROM r)"""
_CELLS = (
    "source", "CAST(size_bytes AS VARCHAR)", "CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' ELSE (SELECT CASE WHEN v < 10 THEN printf('%.1f', floor(v * 10 + 0.5) / 10) ELSE CAST(CAST(floor(v + 0.5) AS BIGINT) AS VARCHAR) END || ' ' || u FROM (SELECT CASE WHEN kb < 1024 THEN kb WHEN kb < 1048576 THEN kb / 1024 ELSE kb / 1048576 END AS v, CASE WHEN kb < 1024 THEN 'KB' WHEN kb < 1048576 THEN 'MB' ELSE 'GB' END AS u)) END",
    f"CASE outcome {' '.join(f'''WHEN '{o}' THEN '{t}' ''' for o, t in OUTCOMES.items())} END", "CASE WHEN attention THEN 'yes' ELSE 'no' END", "CAST(pages AS VARCHAR)",
    "CASE made WHEN 2 THEN 'o' || k || '.pptx; o' || k || '.pdf' WHEN 1 THEN 'o' || k || '.pdf' ELSE '' END", "CASE made WHEN 2 THEN 'pptx; pdf' WHEN 1 THEN 'pdf' ELSE CASE WHEN k % 3 > 0 THEN 'docx' ELSE '' END END",
    "CASE k % 3 WHEN 1 THEN 'yes' WHEN 2 THEN 'no' ELSE '' END", "CASE WHEN k % 3 > 0 THEN 'one box' ELSE '' END", "lost_", "coalesce(message, '')",
)


@query(f"""WITH {_SQL}, c AS (SELECT o_orderkey, rank, weight_ AS weight, [{", ".join(_CELLS)}] AS c FROM s)
SELECT o_orderkey, rank, CAST(weight AS BIGINT) AS weight, array_to_string(list_transform(c, lambda x: {_QUOTE("(" + _CELL("x") + ")")}), ',') AS line FROM c""")
def a12_report_lines(spark, sf_dir):
    """A12 with its twelve columns, E11, E12, I9 to I12 and the order's keys."""
    return ranked(_results(spark, sf_dir)).select("o_orderkey", "rank", "weight", csv_line().alias("line"))


@query(f"""WITH {_SQL} SELECT count(*) AS total, {", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o.replace('-', '_')}" for o in OUTCOMES)}, count(*) FILTER (WHERE attention) AS attention,
count(*) FILTER (WHERE outcome IN ('converted', 'converted-with-caveats', 'skipped')) AS written, CAST(sum(made) AS BIGINT) AS outputs FROM s""")
def a13_report_summary(spark, sf_dir):
    """A13's summary object, E13."""
    rows = summary(ranked(_results(spark, sf_dir)))
    return rows.select(*[F.col(f"`{c}`").alias(c.replace("-", "_")) for c in rows.columns])


@query(f"""WITH {_SQL} SELECT o_orderkey, source AS file, absolute AS path, size_bytes AS size, outcome, attention, pages, message AS note, lost_ AS lost, floor(ms / 10 + 0.5) / 100 AS seconds, made AS outputs FROM s""")
def a13_report_objects(spark, sf_dir):
    """Each file's object, read back from its JSON."""
    rows = ranked(_results(spark, sf_dir)).select("o_orderkey", F.try_parse_json(json_line()).alias("v"))
    get = lambda p, kind: F.try_variant_get("v", f"$.{p}", kind)
    return rows.select(
        "o_orderkey", get("file", "string").alias("file"), get("path", "string").alias("path"), get("sizeBytes", "bigint").alias("size"), get("outcome", "string").alias("outcome"),
        get("needsAttention", "boolean").alias("attention"), get("pages", "bigint").alias("pages"), get("note", "string").alias("note"), F.array_join(get("lost", "array<string>"), "; ").alias("lost"),
        get("seconds", "double").alias("seconds"), F.size(get("outputs", "array<variant>")).alias("outputs"),
    )
