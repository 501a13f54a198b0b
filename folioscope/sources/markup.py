"""Markup as an ordered event stream: one row per tag, and what is counted over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioscope.functions.scalars import decode_entities
from folioscope.plans.catalog import query, table

# What is no tag (taken away in this order), a tag, an attribute; the classified names.
NOISE = ("(?s)<!--.*?-->", r"(?s)<!\[CDATA\[.*?\]\]>", r"(?s)<\?.*?\?>", "(?i)<!DOCTYPE[^>]*>")
NAME = r"[A-Za-z_][\w:.-]*"
TAG = rf"""</?{NAME}+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE = rf"""{NAME}\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""
HANDLED = ("html", "head", "body", "p", "h1", "ul", "li", "a", "nav", "footer", "b", "article")
IGNORED = ("meta", "title", "script", "style", "article", "table")
DROPPED = ("html", "head", "meta", "title", "script", "style")

# The same in SQL, for its regular expressions: no possessive loops there, quotes doubled.
_TAG = rf"""</?{NAME}(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
_ATTRIBUTE = ATTRIBUTE.replace("'", "''")


def noiseless(text: str) -> str:
    """SQL for a text without comments, CDATA, instructions and doctype."""
    for n in NOISE:
        text = f"regexp_replace({text}, '{n}', '', 'g')"
    return text


def attributes_sql(raw: str) -> str:
    """SQL for the list of a tag's attributes, as they stand."""
    return f"""regexp_extract_all(regexp_replace(regexp_replace({raw}, '^</?{NAME}', ''), '/?>$', ''), '{_ATTRIBUTE}')"""


def value_sql(a: str) -> str:
    """SQL for an attribute's value without its quotes (references as they stand)."""
    return f"""regexp_replace(regexp_replace({a}, '(?s)^[^=]*=\\s*', ''), '(?s)^["''](.*)["'']$', '\\1')"""


TAGS = f"""tags AS (SELECT page_id, CAST(pos AS INT) AS pos, raw, lower(regexp_replace(regexp_extract(raw, '^</?({NAME})', 1), '^.*:', '')) AS name,
raw LIKE '</%' AS closing, raw LIKE '%/>' AND raw NOT LIKE '</%' AS alone FROM (SELECT page_id, unnest(m) AS raw, unnest(range(len(m))) AS pos
FROM (SELECT page_id, regexp_extract_all({noiseless("html")}, '{_TAG}') AS m FROM pages)))"""


def markup(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Key, pos, raw, name (prefix dropped), closing, alone (self-closing), attrs (name and decoded value, in order) of each
    tag, and the text before it since the last tag. Comments, CDATA, instructions and doctype are taken away first; `>` inside
    quotes ends no tag. Null and empty texts have no tags."""
    source = F.col(text)
    for n in NOISE:
        source = F.regexp_replace(source, n, "")
    rows = docs.select(key, source.alias("source"))
    both = F.arrays_zip(F.regexp_extract_all("source", F.lit(TAG), F.lit(0)).alias("raw"), F.split("source", TAG, -1).alias("before"))
    rows = rows.select(key, F.posexplode(both).alias("pos", "t")).select(key, "pos", "t.raw", "t.before").filter("raw is not null")
    rows = rows.withColumn("held", F.regexp_extract_all(F.regexp_replace("raw", rf"^</?{NAME}|/?>$", ""), F.lit(ATTRIBUTE), F.lit(0)))

    def parted(a: Column) -> Column:
        value = F.regexp_replace(a, r"^[^=]*=\s*", "")
        value = F.when(value.rlike("^[\"']"), F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        value = F.when(value.contains("&"), decode_entities(value)).otherwise(value)
        return F.struct(F.regexp_extract(a, rf"^{NAME}", 0).alias("name"), value.alias("value"))

    closing = F.col("raw").startswith("</")
    return rows.select(
        key, "pos", "raw", F.regexp_replace(F.regexp_extract("raw", rf"^</?({NAME})", 1), "^.*:", "").alias("name"), closing.alias("closing"),
        (F.col("raw").endswith("/>") & ~closing).alias("alone"), F.transform("held", parted).alias("attrs"), "before",
    )


def attribute(attrs: str, name: str) -> Column:
    """The value of an attribute; of several, the last."""
    return F.try_element_at(F.filter(attrs, lambda a: a["name"] == name), F.lit(-1))["value"]


def depths(rows: DataFrame, key: str) -> DataFrame:
    """rows(key, pos, closing, alone) with depth: how many elements are open around a tag. Closing what is not open leaves
    the depth at zero; self-closing elements open nothing."""
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("depth", F.sum(F.when(F.col("closing"), -1).when(F.col("alone"), 0).otherwise(1)).over(order))
    after = F.col("depth") - F.least(F.lit(0), F.min("depth").over(order))
    return rows.withColumn("depth", (after - F.when(F.col("closing") | F.col("alone"), 0).otherwise(1)).cast("int"))


def innermost(opens: DataFrame, key: str, value: str, levels: Column) -> DataFrame:
    """for each opening tag and each depth of ``levels`` below its own, the element open there: key, pos, k, value, at.

    An element is open at depth k where it is the last opened one of that depth. Askers and elements meet in one window per
    document and depth, in order.
    """
    some = F.filter(levels, lambda k: (k >= 0) & (k < F.col("depth")))
    asks = opens.filter("depth > 0").select(key, "pos", F.explode(some).alias("k"), F.lit(None).cast(opens.schema[value].dataType).alias(value), F.lit(True).alias("asks"))
    held = opens.filter("not alone").select(key, "pos", F.col("depth").alias("k"), value, F.lit(False).alias("asks"))
    before = Window.partitionBy(key, "k").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(~F.col("asks"), F.struct(F.col(value), F.col("pos").alias("at"))), ignorenulls=True).over(before)
    return asks.unionByName(held).select(key, "pos", "k", "asks", last.alias("e")).filter("asks").select(key, "pos", "k", f"e.{value}", "e.at")


def tags(pages: DataFrame) -> DataFrame:
    """A7 on pages, names in lower case."""
    return markup(pages, "page_id", "html").withColumn("name", F.lower("name"))


def _tags(spark, sf_dir) -> DataFrame:
    return tags(table(spark, sf_dir, "pages"))


@query(f"""WITH {TAGS}, a AS (SELECT *, {attributes_sql("raw")} AS held FROM tags) SELECT page_id, pos, name, closing, alone, len(held) AS attributes,
coalesce({value_sql("list_filter(held, lambda x: starts_with(x, 'class'))[-1]")}, '') AS class FROM a""")
def a7_markup_scan(spark, sf_dir):
    """A7, with the class and the number of attributes."""
    return _tags(spark, sf_dir).select(
        "page_id", "pos", "name", "closing", "alone", F.coalesce(attribute("attrs", "class"), F.lit("")).alias("class"), F.size("attrs").alias("attributes")
    )


_ATTRS = f"""{TAGS}, a AS (SELECT page_id, pos, name, regexp_extract(a, '^{NAME}') AS key, {value_sql("a")} AS value
FROM (SELECT page_id, pos, name, unnest({attributes_sql("raw")}) AS a FROM tags))"""


def _attributes(spark, sf_dir) -> DataFrame:
    rows = _tags(spark, sf_dir).select("page_id", "pos", "name", F.explode("attrs").alias("a"))
    return rows.select("page_id", "pos", "name", F.col("a.name").alias("key"), "a.value")


@query(f"WITH {_ATTRS} SELECT page_id, pos, lower(key) AS key, value FROM a")
def a6_attributes(spark, sf_dir):
    """A6 on markup: one row per attribute of an element."""
    return _attributes(spark, sf_dir).select("page_id", "pos", F.lower("key").alias("key"), "value")


@query(f"""WITH {TAGS} SELECT name AS key, count(*) AS n, count(DISTINCT page_id) AS files,
count(*) FILTER (WHERE raw LIKE '%class=%') AS with_class, count(*) FILTER (WHERE raw LIKE '%href=%') AS with_href
FROM tags WHERE NOT closing GROUP BY name""")
def e1_event_profile(spark, sf_dir):
    """Count, distinct files and property counts of each element."""
    has = lambda k: F.count_if(F.col("raw").contains(f"{k}="))
    return _tags(spark, sf_dir).filter(~F.col("closing")).groupBy(F.col("name").alias("key")).agg(
        F.count("*").alias("n"), F.count_distinct("page_id").alias("files"), has("class").alias("with_class"), has("href").alias("with_href")
    )


@query(f"""WITH {_ATTRS}, c AS (SELECT page_id, pos, name, key, left(value, 120) AS v FROM a),
f AS (SELECT key, v, min(struct_pack(p := page_id, q := pos)) AS first FROM c GROUP BY key, v), s AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY first) AS k FROM f)
SELECT key, count(*) AS n, count(DISTINCT page_id) AS files, array_to_string(list_sort(list(DISTINCT name)), ',') AS events,
count(*) FILTER (WHERE regexp_matches(v, '^[0-9]+$')) AS numbers, (SELECT string_agg(v, '|' ORDER BY first) FROM s WHERE s.key = c.key AND k <= 8) AS samples FROM c GROUP BY key""")
def e2_property_profile(spark, sf_dir):
    """Count, files, elements, numbers and the first eight distinct samples of each attribute, cut at 120 characters."""
    rows = _attributes(spark, sf_dir).select(F.struct("page_id", "pos").alias("at"), "page_id", "name", "key", F.substring("value", 1, 120).alias("v"))
    firsts = rows.groupBy("key", "v").agg(F.min("at").alias("at"))
    w = Window.partitionBy("key").orderBy("at")  # Spark keeps eight rows per key and task before the shuffle
    firsts = firsts.withColumn("k", F.row_number().over(w)).filter("k <= 8").groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), "|").alias("samples")
    )
    sums = rows.groupBy("key").agg(
        F.count("*").alias("n"), F.count_distinct("page_id").alias("files"),
        F.array_join(F.sort_array(F.collect_set("name")), ",").alias("events"), F.count_if(F.col("v").rlike("^[0-9]+$")).alias("numbers"),
    )
    return sums.join(firsts, "key")


@query(f"""WITH {TAGS} SELECT p.page_id, count(t.pos) AS events, count(*) FILTER (WHERE t.name = 'p' AND NOT closing) AS pages,
length(any_value(regexp_replace(html, '<[^>]*>', '', 'g'))) AS chars, count(*) FILTER (WHERE t.name = 'a' AND NOT closing) AS assets
FROM pages p LEFT JOIN tags t ON p.page_id = t.page_id GROUP BY p.page_id""")
def e4_file_stats(spark, sf_dir):
    """Events, pages, characters and references of each file; files without tags stay."""
    pages = table(spark, sf_dir, "pages")
    of = lambda n: F.count_if((F.col("name") == n) & ~F.col("closing"))
    sums = tags(pages).groupBy("page_id").agg(F.count("*").alias("events"), of("p").alias("pages"), of("a").alias("assets"))
    chars = F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("chars")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return pages.select("page_id", chars).join(sums, "page_id", "left").select("page_id", zero("events"), zero("pages"), "chars", zero("assets"))


_LISTS = "handled AS (SELECT unnest({0}) AS key), ignored AS (SELECT unnest({1}) AS key)".format(list(HANDLED), list(IGNORED))
_DIFF = f"""{TAGS}, {_LISTS}, seen AS (SELECT name AS key, count(*) AS n FROM tags WHERE NOT closing GROUP BY name),
keys AS (SELECT key FROM seen UNION SELECT key FROM handled UNION SELECT key FROM ignored),
diff AS (SELECT key, n, key IN (FROM handled) AS h, key IN (FROM ignored) AS i FROM keys LEFT JOIN seen USING (key))"""
_STATE = """CASE WHEN h AND i THEN 'contradiction' WHEN n IS NULL THEN 'stale' WHEN h THEN 'handled' WHEN i THEN 'known loss' ELSE 'unknown' END"""


def coverage(seen: DataFrame, handled: tuple[str, ...], ignored: tuple[str, ...]) -> DataFrame:
    """D3: seen(key, n) against two lists of names: key, n, state."""
    spark = seen.sparkSession
    lists = spark.createDataFrame([(k, k in handled, k in ignored) for k in sorted({*handled, *ignored})], "key string, h boolean, i boolean")
    rows = seen.join(lists, "key", "full")
    none = F.lit(False)
    return rows.select("key", "n", F.coalesce("h", none).alias("h"), F.coalesce("i", none).alias("i")).select("key", "n", F.expr(_STATE).alias("state"))


def _seen(spark, sf_dir):
    return _tags(spark, sf_dir).filter(~F.col("closing")).groupBy(F.col("name").alias("key")).agg(F.count("*").alias("n"))


@query(f"WITH {_DIFF} SELECT key, coalesce(n, 0) AS n, {_STATE} AS state FROM diff")
def d3_coverage_diff(spark, sf_dir):
    """D3: unknown, stale, contradicting, handled and lost elements."""
    return coverage(_seen(spark, sf_dir), HANDLED, IGNORED).select("key", F.coalesce("n", F.lit(0)).alias("n"), "state")


@query(f"""WITH {_DIFF} SELECT count(*) FILTER (WHERE s = 'unknown') AS unknown, count(*) FILTER (WHERE s = 'contradiction') AS contradictions,
count(*) FILTER (WHERE s IN ('unknown', 'contradiction')) = 0 AS pass FROM (SELECT {_STATE} AS s FROM diff)""")
def c9_corpus_gate(spark, sf_dir):
    """The corpus passes if every element is classified, and once."""
    of = lambda *s: F.count_if(F.col("state").isin(*s))
    return coverage(_seen(spark, sf_dir), HANDLED, IGNORED).agg(
        of("unknown").alias("unknown"), of("contradiction").alias("contradictions"), (of("unknown", "contradiction") == 0).alias("pass")
    )


@query(f"WITH {_DIFF} SELECT key, n FROM diff WHERE {_STATE} = 'known loss' ORDER BY n DESC, key LIMIT 8")
def g4_known_losses(spark, sf_dir):
    """The eight most frequent known losses."""
    rows = coverage(_seen(spark, sf_dir), HANDLED, IGNORED).filter("state = 'known loss'")
    return rows.select("key", "n").orderBy(F.desc("n"), "key").limit(8)


@query(f"""WITH {TAGS}, s AS (SELECT DISTINCT name FROM tags), t AS (SELECT DISTINCT event_type AS name FROM events)
SELECT name, 'union' AS op FROM (SELECT name FROM s UNION SELECT name FROM t) UNION ALL
SELECT name, 'difference' FROM (SELECT name FROM s EXCEPT SELECT unnest({list(DROPPED)})) UNION ALL
SELECT name, 'intersection' FROM (SELECT name FROM s INTERSECT SELECT unnest({list(DROPPED)}))""")
def h1_key_sets(spark, sf_dir):
    """H1: union, difference and intersection of key sets."""
    s = _tags(spark, sf_dir).select("name").distinct()
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    d = spark.createDataFrame([(x,) for x in DROPPED], "name string")
    parts = (("union", s.union(t).distinct()), ("difference", s.subtract(d)), ("intersection", s.intersect(d)))
    out = None
    for op, rows in parts:
        rows = rows.withColumn("op", F.lit(op))
        out = rows if out is None else out.unionByName(rows)
    return out


_SHAPE = f"""{TAGS}, shape AS (SELECT page_id, count(*) FILTER (WHERE name = 'ul') AS tables, count(*) FILTER (WHERE name = 'p') AS boxes,
count(*) FILTER (WHERE name = 'img') AS images, any_value(chars) AS chars FROM tags JOIN (SELECT page_id AS id, length(regexp_replace(html, '<[^>]*>', '', 'g')) AS chars FROM pages)
ON id = page_id WHERE NOT closing GROUP BY page_id)"""
_ADVICE = """CASE WHEN tables > 0 AND boxes <= 2 THEN 'pptx!' WHEN boxes = 1 AND images = 0 AND chars > 0 AND chars < 400 THEN 'docx!' ELSE 'pptx' END"""


@query(f"WITH {_SHAPE} SELECT page_id, left({_ADVICE}, 4) AS format, right({_ADVICE}, 1) = '!' AS confident, {_ADVICE} = 'docx!' AS suggested FROM shape")
def c5_recommendation(spark, sf_dir):
    """Which format suits a file, if that is sure, and if it speaks against the usual pptx."""
    pages = table(spark, sf_dir, "pages")
    of = lambda n: F.count_if(F.col("name") == n)
    shape = tags(pages).filter(~F.col("closing")).groupBy("page_id").agg(of("ul").alias("tables"), of("p").alias("boxes"), of("img").alias("images"))
    chars = pages.select("page_id", F.length(F.regexp_replace("html", "<[^>]*>", "")).alias("chars"))
    rows = shape.join(chars, "page_id").select("page_id", F.expr(_ADVICE).alias("a"))
    return rows.select("page_id", F.left("a", F.lit(4)).alias("format"), F.col("a").endswith("!").alias("confident"), (F.col("a") == "docx!").alias("suggested"))


CONTAINERS = ("nav", "ul", "ol", "li", "article", "footer")
LISTS = ("ul", "ol")
_NEST = f"""{TAGS}, c AS (SELECT page_id, pos, name, closing, alone, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS i FROM tags WHERE name IN {CONTAINERS}),
r AS (SELECT page_id, i, pos, name, closing, CAST([] AS INT[]) AS above, CASE WHEN closing OR alone THEN CAST([] AS INT[]) ELSE [pos] END AS stack,
CAST([] AS VARCHAR[]) AS lists, CASE WHEN name IN {LISTS} AND NOT closing AND NOT alone THEN [name] ELSE CAST([] AS VARCHAR[]) END AS held FROM c WHERE i = 1 UNION ALL
SELECT c.page_id, c.i, c.pos, c.name, c.closing, r.stack, CASE WHEN c.closing THEN r.stack[:-2] WHEN c.alone THEN r.stack ELSE r.stack || [c.pos] END, r.held,
CASE WHEN c.name NOT IN {LISTS} OR c.alone THEN r.held WHEN c.closing THEN r.held[:-2] ELSE r.held || [c.name] END FROM r JOIN c ON c.page_id = r.page_id AND c.i = r.i + 1)"""


@query(f"""WITH RECURSIVE {_NEST} SELECT page_id, pos, name, CAST(len(above) AS INT) AS depth, coalesce(above[-1], -1) AS parent, CAST(len(lists) AS INT) AS level,
coalesce(lists[-1], '') AS list_type FROM r WHERE NOT closing""")
def f3_nesting(spark, sf_dir):
    """of each container how many are open around it, the innermost of them, and the level and kind of list it is in."""
    return nested(_tags(spark, sf_dir).filter(F.col("name").isin(*CONTAINERS)), "page_id")


def nested(rows: DataFrame, key: str) -> DataFrame:
    """F3, F7 over tags(key, pos, name, closing, alone): depth, parent (its pos or -1), level and list_type ('' outside lists)."""
    rows = depths(rows.select(key, "pos", "name", "closing", "alone"), key)
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    listed, closing = F.col("name").isin(*LISTS) & ~F.col("alone"), F.col("closing")
    rows = rows.withColumn("level", F.sum(F.when(listed & closing, -1).when(listed, 1).otherwise(0)).over(order))
    rows = rows.withColumn("level", F.col("level") - F.least(F.lit(0), F.min("level").over(order)) - F.when(listed & ~closing, 1).otherwise(0))
    opens = rows.filter("not closing")
    parents = innermost(opens, key, "name", F.array(F.col("depth") - 1)).select(key, "pos", F.col("at").alias("parent"))
    # For the kind of list, lists are the only elements and the level is their depth.
    kinds = opens.select(key, "pos", "name", F.col("level").cast("int").alias("depth"), (~listed).alias("alone"))
    kinds = innermost(kinds, key, "name", F.array(F.col("depth") - 1)).select(key, "pos", F.col("name").alias("list_type"))
    out = opens.join(parents, [key, "pos"], "left").join(kinds, [key, "pos"], "left")
    return out.select(
        key, "pos", "name", "depth", F.coalesce("parent", F.lit(-1)).alias("parent"), F.col("level").cast("int").alias("level"),
        F.coalesce("list_type", F.lit("")).alias("list_type"),
    )


_SIGN = f"""{TAGS}, sig AS (SELECT p.page_id, count(*) FILTER (WHERE name = 'p' AND NOT closing) AS p, count(*) FILTER (WHERE name = 'li' AND NOT closing) AS li,
count(*) FILTER (WHERE name = 'br') AS br, any_value(regexp_replace(html, '<[^>]*>', '', 'g')) AS text FROM pages p LEFT JOIN tags t ON p.page_id = t.page_id GROUP BY p.page_id)"""


def signatures(pages: DataFrame) -> DataFrame:
    """Element counts, text and its hash of each page."""
    of = lambda n: F.count_if((F.col("name") == n) & ~F.col("closing"))
    sums = tags(pages).groupBy("page_id").agg(of("p").alias("p"), of("li").alias("li"), F.count_if(F.col("name") == "br").alias("br"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    text = pages.select("page_id", F.regexp_replace("html", "<[^>]*>", "").alias("text"))
    return text.join(sums, "page_id", "left").select("page_id", zero("p"), zero("li"), zero("br"), "text")


@query(f"WITH {_SIGN} SELECT page_id, p, li, br, length(text) AS chars, sha256(text) AS hash FROM sig")
def e17_signatures(spark, sf_dir):
    """E17 on pages."""
    rows = signatures(table(spark, sf_dir, "pages"))
    return rows.select("page_id", "p", "li", "br", F.length("text").alias("chars"), F.sha2("text", 256).alias("hash"))


@query(f"""WITH {_SIGN}, pair AS (SELECT a.page_id, a.p AS ap, b.p AS bp, a.li AS al, b.li AS bl, a.br AS ab, b.br AS bb, length(a.text) AS la, length(b.text) AS lb, a.text = b.text AS same
FROM sig a JOIN sig b ON b.page_id = a.page_id + 1),
s AS (SELECT *, CASE WHEN same THEN 1.0 ELSE least(la, lb) * 1.0 / greatest(la, lb, 1) END AS text_sim,
CASE WHEN ap + bp + al + bl + ab + bb = 0 THEN 1.0 ELSE (least(ap, bp) + least(al, bl) + least(ab, bb)) * 1.0 / (greatest(ap, bp) + greatest(al, bl) + greatest(ab, bb)) END AS element_sim FROM pair)
SELECT page_id, floor((text_sim * 3 + element_sim * 3) / 6 * 10000 + 0.5) / 10000 AS score,
CASE WHEN (ap = 0) <> (bp = 0) OR (al = 0) <> (bl = 0) OR la <> lb THEN 'major' WHEN ap <> bp OR al <> bl OR ab <> bb OR NOT same THEN 'minor' ELSE 'match' END AS verdict FROM s""")
def d14_signature_compare(spark, sf_dir):
    """Each page's signature against the next one's, by text and elements."""
    # Lengths and digests cross the join, not texts.
    sig = signatures(table(spark, sf_dir, "pages")).withColumns({"chars": F.length("text"), "text": F.sha2("text", 256)})
    a = sig.select("page_id", F.col("p").alias("ap"), F.col("li").alias("al"), F.col("br").alias("ab"), F.col("chars").alias("la"), F.col("text").alias("ta"))
    b = sig.select((F.col("page_id") - 1).alias("page_id"), F.col("p").alias("bp"), F.col("li").alias("bl"), F.col("br").alias("bb"), F.col("chars").alias("lb"), F.col("text").alias("tb"))
    rows = a.join(b, "page_id").withColumn("same", F.col("ta") == F.col("tb"))
    return rows.selectExpr(
        "page_id",
        """floor((CASE WHEN same THEN 1.0D ELSE least(la, lb) * 1.0D / greatest(la, lb, 1) END * 3 +
        CASE WHEN ap + bp + al + bl + ab + bb = 0 THEN 1.0D ELSE (least(ap, bp) + least(al, bl) + least(ab, bb)) * 1.0D / (greatest(ap, bp) + greatest(al, bl) + greatest(ab, bb)) END * 3) / 6 * 10000 + 0.5D) / 10000 AS score""",
        """CASE WHEN (ap = 0) <> (bp = 0) OR (al = 0) <> (bl = 0) OR la <> lb THEN 'major' WHEN ap <> bp OR al <> bl OR ab <> bb OR NOT same THEN 'minor' ELSE 'match' END AS verdict""",
    )
