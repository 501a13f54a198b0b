"""Events with an open property map: ordered explode, recursive properties, and the profiles counted over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.plans.catalog import query, table, written

# Samples kept for each key, and the characters kept of each.
SAMPLES, SAMPLE = 8, 120


def exploded(envelopes: DataFrame, key: str, envelope: str) -> DataFrame:
    """A5: key, pos, t, s, p (VARIANT) of each event of a JSON envelope, in order. Bad JSON and envelopes without events: no rows."""
    events = F.try_variant_get(F.try_parse_json(envelope), "$.events", "array<variant>")
    rows = envelopes.select(key, F.posexplode(events).alias("pos", "e"))
    get = lambda path, kind: F.try_variant_get("e", path, kind)
    return rows.select(key, "pos", get("$.t", "string").alias("t"), get("$.s", "string").alias("s"), get("$.p", "variant").alias("p"))


def _kind(v: Column, inner: Column) -> Column:
    shape = F.schema_of_variant(v)
    return (
        F.when(shape.startswith("ARRAY"), "vector")
        .when(F.array_contains(F.map_keys(inner), "v") & F.array_contains(F.map_keys(inner), "u"), "measure")
        .when(shape.startswith("OBJECT") | (shape == "VOID"), "object").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").otherwise("number")
    )


def properties(events: DataFrame, *keys: str) -> DataFrame:
    """``keys``, t, key, kind, unit, value, text, items of every property of events(keys, t, p VARIANT).

    kind is string, number, boolean, object (null too), measure (an object with v and u) or vector. The objects of a vector
    are taken apart as `key[].sub`, to any depth: one union per depth the data has. unit is the measure's, '(generic)' for
    none; value the number or the measure's; text the JSON of what is no vector (an object's keys in alphabetic order); items the length of a vector. Null and
    non-object properties give no rows.
    """
    level = events.select(*keys, "t", F.lit("").alias("prefix"), F.col("p").alias("object"))
    out = None
    while True:
        rows = level.select(*keys, "t", "prefix", F.explode(F.try_variant_get("object", "$", "map<string,variant>")).alias("name", "v"))
        rows = rows.select(*keys, "t", F.concat("prefix", "name").alias("key"), "v", F.try_variant_get("v", "$", "map<string,variant>").alias("inner"))
        rows = rows.withColumn("kind", _kind(F.col("v"), F.col("inner")))
        unit = F.try_variant_get("v", "$.u", "string")
        number = F.when(F.col("kind") == "measure", F.try_variant_get("v", "$.v", "double")).when(F.col("kind") == "number", F.try_variant_get("v", "$", "double"))
        flat = F.col("kind") != "vector"
        items = F.when(~flat, F.try_variant_get("v", "$", "array<variant>"))
        rows = rows.select(
            *keys, "t", "key", "kind", F.when(F.col("kind") == "measure", F.coalesce(F.nullif(unit, F.lit("")), F.lit("(generic)"))).alias("unit"),
            number.alias("value"), F.when(flat, F.to_json("v")).alias("text"), items.alias("items"),
        )
        rows = written(rows)
        part = rows.withColumn("items", F.size("items"))
        part = part.withColumn("items", F.when(F.col("kind") == "vector", F.col("items")))
        out = part if out is None else out.unionByName(part)
        level = rows.filter("kind = 'vector'").select(*keys, "t", F.concat("key", F.lit("[].")).alias("prefix"), F.explode("items").alias("object"))
        level = level.filter(F.schema_of_variant("object").startswith("OBJECT"))
        if level.isEmpty():
            return out


def _counted(rows: DataFrame, by: str, what: str) -> DataFrame:
    """by, and a map of the counts of ``what``."""
    sums = rows.filter(F.col(what).isNotNull()).groupBy(by, what).count().groupBy(by)
    return sums.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(what, "count")))).alias(f"{what}s"))


def property_profile(rows: DataFrame, file: str, *order: str) -> DataFrame:
    """E2 over properties(file, order, ...): key, n, files, kinds, units, ts (maps to counts) and the first eight different
    samples by (file, order), cut at 120 characters; the sample of a vector is its length."""
    cut = F.when(F.length("text") > SAMPLE, F.concat(F.left("text", F.lit(SAMPLE)), F.lit("…"))).otherwise(F.col("text"))
    sample = F.when(F.col("kind") == "vector", F.format_string('{"length":%d}', F.col("items"))).otherwise(cut)
    at = F.struct(file, *order, sample)
    firsts = rows.groupBy("key", sample.alias("sample")).agg(F.min(at).alias("at"))
    firsts = firsts.withColumn("k", F.row_number().over(Window.partitionBy("key").orderBy("at"))).filter(F.col("k") <= SAMPLES)
    firsts = firsts.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "sample"))), lambda s: s["sample"]).alias("samples"))
    # One row per key and file first: a hot key is not counted in one task.
    sums = rows.groupBy("key", file).agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("files"))
    out = sums.join(firsts, "key")
    for what in ("kind", "unit", "t"):
        out = out.join(_counted(rows, "key", what), "key", "left")
    return out


def event_profile(events: DataFrame, file: str) -> DataFrame:
    """E1 over events(file, t, p): t, n, files, and how often each property stands in such an event."""
    sums = events.groupBy("t", file).agg(F.count("*").alias("n")).groupBy("t").agg(F.sum("n").alias("n"), F.count("*").alias("files"))
    keys = events.select("t", F.explode(F.map_keys(F.try_variant_get("p", "$", "map<string,variant>"))).alias("key"))
    return sums.join(_counted(keys, "t", "key"), "t", "left")


# A file per user: the user's events in order, each with nested properties from its own columns.
_PROPS = """concat('{"k":', get_k, CASE WHEN event_id % 2 = 0 THEN concat(',"svg:x":{"u":"', CASE event_id % 3 WHEN 0 THEN 'in' WHEN 1 THEN 'pt' ELSE '' END, '","v":', event_id % 100, '.5}') ELSE '' END,
CASE WHEN event_id % 5 = 0 THEN concat(',"stops":[{"offset":{"u":"%","v":', event_id % 7, '},"color":"#f0', event_id % 4, '"},', event_id, ',{"color":null,"sub":[{"z":"', event_type, '"},{"z":[{"deep":true}]}]}]') ELSE '' END,
',"name":"', event_type, '","long":"', repeat('ab', CAST(event_id % 70 AS INT)), '","flag":', CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END, ',"o":{"a":1},"none":[]}')"""
_EVENT = """concat('{"t":"', event_type, '"', CASE WHEN event_id % 6 = 0 THEN '' ELSE concat(',"p":', p) END, CASE WHEN event_id % 4 = 0 THEN concat(',"s":"', event_id, '"') ELSE '' END, '}')"""


def _files(spark, sf_dir) -> DataFrame:
    """file, envelope."""
    rows = table(spark, sf_dir, "events").withColumn("get_k", F.get_json_object("props", "$.k")).withColumn("p", F.expr(_PROPS))
    rows = rows.groupBy(F.col("user_id").alias("file")).agg(F.array_sort(F.collect_list(F.struct("event_id", F.expr(_EVENT).alias("e")))).alias("e"))
    joined = F.array_join(F.transform("e", lambda x: x["e"]), ",")
    return rows.select("file", F.concat(F.lit('{"ok":true,"events":['), joined, F.lit("]}")).alias("envelope"))


_SQL = f"""files AS (SELECT user_id AS file, CAST('{{"ok":true,"events":[' || string_agg({_EVENT}, ',' ORDER BY event_id) || ']}}' AS JSON) AS envelope
FROM (SELECT *, {_PROPS} AS p FROM (SELECT *, json_extract_string(props, '$.k') AS get_k FROM events)) GROUP BY user_id),
raw AS (SELECT file, unnest(json_extract(envelope, '$.events[*]')) AS e, unnest(range(CAST(json_array_length(envelope, '$.events') AS BIGINT))) AS pos FROM files),
ev AS (SELECT file, pos, json_extract_string(e, '$.t') AS t, json_extract_string(e, '$.s') AS s, json_extract(e, '$.p') AS p FROM raw)"""
_SQL_FLAT = f"""{_SQL}, lvl AS (SELECT file, pos, t, k AS key, json_extract(p, '$."' || k || '"') AS v FROM (SELECT file, pos, t, p, unnest(json_keys(p)) AS k FROM ev WHERE p IS NOT NULL)
UNION ALL SELECT file, pos, t, key || '[].' || k, json_extract(o, '$."' || k || '"') FROM (SELECT file, pos, t, key, o, unnest(json_keys(o)) AS k
FROM (SELECT file, pos, t, key, unnest(json_extract(v, '$[*]')) AS o FROM lvl WHERE json_type(v) = 'ARRAY') WHERE json_type(o) = 'OBJECT')),
flat AS (SELECT file, pos, t, key, v, CASE json_type(v) WHEN 'ARRAY' THEN 'vector' WHEN 'OBJECT' THEN CASE WHEN list_contains(json_keys(v), 'v') AND list_contains(json_keys(v), 'u') THEN 'measure' ELSE 'object' END
WHEN 'NULL' THEN 'object' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS kind FROM lvl),
props AS (SELECT *, CASE WHEN kind = 'measure' THEN coalesce(nullif(json_extract_string(v, '$.u'), ''), '(generic)') END AS unit,
CASE kind WHEN 'measure' THEN CAST(json_extract_string(v, '$.v') AS DOUBLE) WHEN 'number' THEN CAST(CAST(v AS VARCHAR) AS DOUBLE) END AS value, CASE WHEN kind <> 'vector' THEN CAST(v AS VARCHAR) END AS text,
CASE WHEN kind = 'vector' THEN CAST(json_array_length(v) AS INT) END AS items FROM flat)"""


@query(f"WITH {_SQL} SELECT file, CAST(pos AS INT) AS pos, t, s, coalesce(CAST(len(json_keys(p)) AS INT), -1) AS properties FROM ev")
def a5_ordered_events(spark, sf_dir):
    """A5: the events of every user's envelope, in order; -1 properties where there is no map of them."""
    n = F.size(F.map_keys(F.try_variant_get("p", "$", "map<string,variant>")))
    return exploded(_files(spark, sf_dir), "file", "envelope").select("file", "pos", "t", "s", F.coalesce(F.when(F.col("p").isNotNull(), n), F.lit(-1)).alias("properties"))


@query(f"WITH RECURSIVE {_SQL_FLAT} SELECT file, CAST(pos AS INT) AS pos, t, key, kind, unit, value, text, coalesce(items, -1) AS items FROM props")
def a6_properties(spark, sf_dir):
    """Every property of every event, the vectors' objects taken apart to any depth; -1 items where there is no vector."""
    return properties(exploded(_files(spark, sf_dir), "file", "envelope"), "file", "pos").fillna(-1, ["items"])


def _said(m: str) -> Column:
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(m)), entry), ";"), F.lit(""))


def _sql_said(what: str) -> str:
    return f"coalesce((SELECT string_agg({what} || '=' || n, ';' ORDER BY {what}) FROM (SELECT {what}, count(*) AS n FROM props q WHERE q.key = p.key AND {what} IS NOT NULL GROUP BY {what})), '')"


@query(f"""WITH RECURSIVE {_SQL_FLAT}, s AS (SELECT file, pos, key, CASE WHEN kind = 'vector' THEN '{{"length":' || items || '}}' WHEN length(text) > {SAMPLE} THEN left(text, {SAMPLE}) || '…' ELSE text END AS sample FROM props),
f AS (SELECT key, sample, min(struct_pack(a := file, b := pos, c := sample)) AS first_at FROM s GROUP BY key, sample), k AS (SELECT key, sample, row_number() OVER (PARTITION BY key ORDER BY first_at) AS k FROM f)
SELECT key, count(*) AS n, count(DISTINCT file) AS files, {_sql_said("kind")} AS kinds, {_sql_said("unit")} AS units, {_sql_said("t")} AS events,
(SELECT string_agg(sample, '|' ORDER BY k) FROM k WHERE k.key = p.key AND k <= {SAMPLES}) AS samples FROM props p GROUP BY key""")
def e2_properties(spark, sf_dir):
    """The profile of every qualified property key."""
    rows = property_profile(properties(exploded(_files(spark, sf_dir), "file", "envelope"), "file", "pos"), "file", "pos")
    return rows.select("key", "n", "files", _said("kinds").alias("kinds"), _said("units").alias("units"), _said("ts").alias("events"), F.array_join("samples", "|").alias("samples"))


@query(f"""WITH {_SQL}, k AS (SELECT t, key, count(*) AS n FROM (SELECT t, unnest(json_keys(p)) AS key FROM ev WHERE p IS NOT NULL) GROUP BY ALL)
SELECT t, count(*) AS n, count(DISTINCT file) AS files, coalesce((SELECT string_agg(key || '=' || n, ';' ORDER BY key) FROM k WHERE k.t = ev.t), '') AS properties FROM ev GROUP BY t""")
def e1_events(spark, sf_dir):
    """Count, files and property counts of each event type."""
    return event_profile(exploded(_files(spark, sf_dir), "file", "envelope"), "file").select("t", "n", "files", _said("keys").alias("properties"))
