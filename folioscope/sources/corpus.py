"""Scans of a corpus: files, envelopes, assets and manifests; and the report sinks."""

from __future__ import annotations

import uuid

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.scalars import csv_cell
from folioscope.operators.ordered import claim_names, folded
from folioscope.operators.reference import OUTCOME
from folioscope.plans.catalog import query, table, written


def files(spark: SparkSession, path: str, pattern: str = "*.[pP][uU][bB]") -> DataFrame:
    """A1: path, length and time of every file below ``path`` whose name fits, sidecars (A2) left out; contents unread."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return found.select("path", "length", "modificationTime").filter(~name.rlike(SIDECAR)).orderBy("path")


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Safe lines of ``columns``, in the rows' order, CRLF, one header line after a byte order mark per file."""
    line = F.concat_ws(",", *[F.coalesce(csv_cell(F.col(c).cast("string")), F.lit("")) for c in columns])
    head = rows.sparkSession.createDataFrame([("﻿" + ",".join(columns),)], "value string")
    head.union(rows.select(line.alias("value"))).coalesce(1).write.option("lineSep", "\r\n").text(path)


def planned(files: DataFrame, existing: DataFrame, policy: Column) -> DataFrame:
    """files(source, folder, stem, ext) against existing(folder, stem, ext) to source, folder, name, action, renamed.

    A free name is taken as it is. Where the file exists, `rename` counts on, `skip` writes nothing and `overwrite`
    takes the name; a name already claimed in the run always counts on. Sources are ids
    that occur once, never null; the policy is one per folder.
    """
    at = F.struct("folder", "ext").alias("folder")
    key = folded(F.col("stem")).alias("key")
    files = files.withColumn("policy", policy)
    held = existing.select(at, key).distinct().withColumn("held", F.lit(True))
    asked = files.select("source", at, "stem", key, "policy").join(held, ["folder", "key"], "left")
    free = files.filter("policy <> 'rename'").select(at, key).distinct()
    taken = existing.select(at, "stem", key).dropDuplicates(["folder", "key"]).join(free, ["folder", "key"], "left_anti")
    kind = files.schema["source"].dataType
    claims = claim_names(asked.select("source", "folder", "stem").unionByName(taken.select(F.lit(None).cast(kind).alias("source"), "folder", "stem")))
    rows = asked.join(claims.filter("source is not null").select("source", "name"), "source")
    renamed = F.col("name") != F.col("stem")
    skip = F.coalesce("held", F.lit(False)) & (F.col("policy") == "skip") & ~renamed
    name = F.concat("name", F.lit("."), "folder.ext").alias("name")
    return rows.select("source", "folder.folder", name, F.when(skip, "skip").otherwise("write").alias("action"), renamed.alias("renamed"))


def write_outputs(files: DataFrame, existing: DataFrame, policy: Column, root: str) -> DataFrame:
    """Write files(source, folder, stem, ext, content) below the address ``root`` by their plan; gives the plan.

    The plan is written first, so a task that runs again writes the same names. A file appears whole, by a rename.
    """
    plan = written(planned(files.drop("content"), existing, policy))

    def put(rows) -> None:
        store, base = pyarrow.fs.FileSystem.from_uri(root)
        for r in rows:
            folder = f"{base}/{r['folder']}"
            store.create_dir(folder, recursive=True)
            part = f"{folder}/.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(bytes(r["content"] or b""))
            store.move(part, f"{folder}/{r['name']}")

    todo = plan.filter("action = 'write'").select("source", "folder", "name")
    todo.join(files.select("source", "content"), "source").foreachPartition(put)
    return plan


_STEMS = "SELECT c_custkey AS source, c_nationkey AS folder, CASE WHEN c_custkey % 4 = 0 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS stem FROM customer"


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY folder, lower(nfc_normalize(stem)) ORDER BY source) AS k, folder % 2 = 0 AS held FROM ({_STEMS})),
n AS (SELECT *, k + CASE WHEN held AND folder % 3 = 0 THEN 1 ELSE 0 END AS n FROM f)
SELECT source, folder, CASE WHEN n = 1 THEN stem ELSE stem || ' (' || n || ')' END || '.docx' AS name, CASE WHEN held AND folder % 3 = 1 AND k = 1 THEN 'skip' ELSE 'write' END AS action, n > 1 AS renamed FROM n""")
def a11_output_plan(spark, sf_dir):
    """A11 on customers, with a policy per nation and files already there in every second one."""
    stem = F.when(F.col("c_custkey") % 4 == 0, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.col("c_nationkey").alias("folder"), stem.alias("stem"), F.lit("docx").alias("ext"))
    there = rows.filter("folder % 2 = 0").select("folder", F.lower("stem").alias("stem"), "ext").distinct()
    policy = F.when(F.col("folder") % 3 == 0, "rename").when(F.col("folder") % 3 == 1, "skip").otherwise("overwrite")
    return planned(rows, there, policy)


def snapshot(signatures: DataFrame, path: str, run_id: str) -> None:
    """A run's signatures beside those of other runs."""
    signatures.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


SIDECAR = r"^(~\$|\._)"  # fixed value
_NAMES = "SELECT page_id, CASE page_id % 5 WHEN 0 THEN '~$' WHEN 1 THEN '._' WHEN 2 THEN '~' WHEN 3 THEN '.' ELSE '' END || regexp_extract(url, '([^/]*)$', 1) AS name FROM pages"


@query(f"SELECT * FROM ({_NAMES}) WHERE NOT regexp_matches(name, '{SIDECAR}')")
def a2_sidecars(spark, sf_dir):
    """A2 on page names, some of which get the marks of sidecars and some nearly so."""
    mark = F.element_at(F.array(*map(F.lit, ("~$", "._", "~", ".", ""))), (F.col("page_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(mark, F.regexp_extract("url", "([^/]*)$", 1)).alias("name"))
    return rows.filter(~F.col("name").rlike(SIDECAR))


@query("SELECT doc_id, 'attention' AS kind, 'not in the labels' AS reason FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def a3_problem_rows(spark, sf_dir):
    """A3: what the manifest has and the scan has not becomes a row."""
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")
    return rows.select("doc_id", F.lit("attention").alias("kind"), F.lit("not in the labels").alias("reason"))


_RAW = """CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN left(props, length(props) - 1) WHEN 2 THEN '{"ok":false,"error":{"code":"LOCKED","message":"asks for a password"}}' WHEN 3 THEN '{"other":1}' ELSE props END"""


@query(f"""SELECT event_id, CASE WHEN raw = '' OR NOT json_valid(raw) THEN 'BAD_IR' WHEN json_extract_string(raw, '$.ok') = 'false' THEN json_extract_string(raw, '$.error.code')
WHEN json_extract_string(raw, '$.k') IS NULL THEN 'BAD_IR' ELSE 'ok' END AS code, CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.error.message') END AS message
FROM (SELECT event_id, {_RAW} AS raw FROM events)""")
def a4_envelopes(spark, sf_dir):
    """A4: an envelope is its events, its own error, or BAD_IR; failures stay as rows."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_RAW).alias("raw")).withColumn("v", F.try_parse_json("raw"))
    get = lambda path: F.try_variant_get("v", path, "string")
    code = F.when(F.col("v").isNull(), "BAD_IR").when(get("$.ok") == "false", get("$.error.code")).when(get("$.k").isNull(), "BAD_IR").otherwise("ok")
    return rows.select("event_id", code.alias("code"), get("$.error.message").alias("message"))


@query("""SELECT event_id, 'k' AS key, 'number' AS kind, '' AS unit, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def a6_property_flatten(spark, sf_dir):
    """Properties of an event, one row each, with kind, unit and value."""
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "text"))
    number = F.col("text").try_cast("double")
    return rows.select("event_id", "key", F.when(number.isNotNull(), "number").otherwise("string").alias("kind"), F.lit("").alias("unit"), number.alias("value"))


@query("SELECT sha256(text) AS asset_key, min(doc_id) AS first_doc, count(*) AS uses, CAST(floor(any_value(length(text)) * 3 / 4) AS BIGINT) AS size FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def a8_assets(spark, sf_dir):
    """Each content once, with its uses and estimated size."""
    rows = table(spark, sf_dir, "documents").filter("text is not null")
    rows = rows.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("asset_key"), F.length("text").alias("n"))
    return rows.groupBy("asset_key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("uses"), F.floor(F.first("n") * 3 / 4).alias("size"))


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'MISSING' WHEN doc_id % 7 = 0 THEN 'DRIFT' ELSE 'ok' END AS status FROM documents""")
def a10_manifest_audit(spark, sf_dir):
    """A10: pinned digests against a copy that lacks some texts and holds others altered."""
    docs = table(spark, sf_dir, "documents")
    digest = lambda t: F.sha2(t.cast("binary"), 256)
    pinned = docs.select("doc_id", digest(F.coalesce("text", F.lit(""))).alias("pinned"))
    copy = docs.filter("doc_id % 11 <> 0")
    copy = copy.select("doc_id", digest(F.concat(F.coalesce("text", F.lit("")), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))).alias("now"))
    status = F.when(F.col("now").isNull(), "MISSING").when(F.col("now") != F.col("pinned"), "DRIFT").otherwise("ok")
    return pinned.join(copy, "doc_id", "left").select("doc_id", status.alias("status"))


@query(f"""SELECT o_orderkey, o_orderkey || ',' || outcome || ',' || CASE WHEN o_orderkey % 3 = 0 THEN '''=' || o_orderpriority WHEN o_orderkey % 3 = 1 THEN '"' || o_orderpriority || ',x"' ELSE o_orderpriority END AS line
FROM (SELECT *, {OUTCOME} AS outcome FROM orders)""")
def a12_csv_lines(spark, sf_dir):
    """The report line of each result."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    note = F.when(k % 3 == 0, F.concat(F.lit("="), p)).when(k % 3 == 1, F.concat(p, F.lit(",x"))).otherwise(p)
    cells = [k.cast("string"), F.expr(OUTCOME), note]
    return table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", *[csv_cell(c) for c in cells]).alias("line"))


@query(f"""SELECT o_orderkey, '{{"source":' || o_orderkey || ',"outcome":"' || outcome || '","problems":["' || o_orderpriority || '"]}}' AS line FROM (SELECT *, {OUTCOME} AS outcome FROM orders)""")
def a13_json_lines(spark, sf_dir):
    """The report object of each result."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(OUTCOME).alias("outcome"), "o_orderpriority")
    line = F.to_json(F.struct(F.col("o_orderkey").alias("source"), "outcome", F.array("o_orderpriority").alias("problems")))
    return rows.select("o_orderkey", line.alias("line"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def a15_flow_text(spark, sf_dir):
    """A document as its paragraphs in order."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    return rows.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
