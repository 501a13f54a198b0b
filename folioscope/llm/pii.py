"""PII by patterns and information-theoretic sanitisation, in DataFrame functions only.

Base spans come from four patterns. Positions follow from the text between matches: `split` and `regexp_extract_all`
walk the same matches, and running sums of their lengths give starts. The patterns are the contract's, written with
possessive loops and run starts so that no long text makes them walk a run twice.

Terms that give an entity away are found by co-occurrence in whole documents. Protected are each kind and each exact
string of a kind; with p(e) the share of documents that hold entity e, a document tells log2(1 / p(e)) bits by holding
it, and a term t tells log2(p(e | t) / p(e)) of them. A term discloses e if it tells at least ``share`` of e's own
information and stands with e in at least ``contexts`` different texts. The measure is relative, so an entity of a hot
source can reach it as well as a rare one. All occurrences of the term in documents with e become `term` spans. Words
inside an email are no terms.

Null or empty text: no spans. Repeated rows are found apart and alike, and copies of one text count once towards
``contexts``. No documents: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, spare, table, unsent, written

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = (
    rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
TERM = r"\p{L}{4,}"
WORDS = rf"(?:{PATTERNS[0]})|{TERM}"  # an email is taken whole, so that its parts are no terms


def _valid(kind: Column, found: Column) -> Column:
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    parts = F.transform(F.split(found, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    ip = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    luhn = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0
    card = F.when(n.between(12, 19), luhn).otherwise(False)
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, card).otherwise(n.between(9, 15))


def numbered(docs: DataFrame, name: str = "_rid") -> DataFrame:
    """The columns of ``docs`` and a row number, fixed by the scan: write it before a second job reads it."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def matches(rows: DataFrame, reach: int) -> DataFrame:
    """_rid, kind, start, end, found, before, after of each base span of rows(_rid, text)."""
    text = F.coalesce("text", F.lit(""))
    kinds = []
    for k, p in enumerate(PATTERNS):
        gaps = F.transform(
            F.split(text, p, -1),
            lambda g: F.struct(F.length(g).alias("n"), F.substring(g, -reach, reach).alias("tail"), F.substring(g, 1, reach).alias("head")),
        )
        kinds.append(F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("found"), gaps.alias("gaps")))
    held = rows.select("_rid", F.explode(F.array(*kinds)).alias("k")).filter(F.size("k.found") > 0)
    # Match and both gaps in one row: an array beside the exploded matches would be copied for each of them.
    both = F.arrays_zip(F.col("k.found").alias("found"), F.col("k.gaps").alias("g"), F.slice("k.gaps", F.lit(2), F.size("k.gaps")).alias("h"))
    held = held.select("_rid", "k.kind", F.posexplode(both).alias("i", "m")).select("_rid", "kind", "i", "m.*").filter("found is not null")
    upto = Window.partitionBy("_rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.length("found")
    end = F.sum(F.col("g.n") + size).over(upto)
    held = held.select("_rid", "kind", "found", F.col("g.tail").alias("before"), F.col("h.head").alias("after"), (end - size).alias("start"), end.alias("end"))
    return held.filter(_valid(F.col("kind"), F.col("found")))


def _terms(text: Column) -> Column:
    """Array of the distinct terms of a text."""
    found = F.filter(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)), lambda w: ~w.contains("@"))
    return F.array_distinct(F.transform(found, lambda w: F.lower(w)))


def disclosing(rows: DataFrame, base: DataFrame, contexts: int, share: float) -> DataFrame:
    """_rid, kind, start, end of the terms that give an entity away, from rows(_rid, text)."""
    name = F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    entity = F.explode(F.array(name, F.concat_ws(":", name, F.lower("found")))).alias("entity")
    entities = base.select("_rid", entity).distinct()
    # Only texts with a base span are read for pairs; entities and terms in too few texts can pass no threshold.
    own = rows.join(base.select("_rid").distinct(), "_rid", "left_semi")
    own = written(own.select("_rid", F.xxhash64("text").alias("c"), F.explode(_terms(F.col("text"))).alias("term")))
    texts = own.select("_rid", "c").distinct()
    sizes = entities.join(texts, "_rid").groupBy("entity").agg(F.count("*").alias("of"), F.count_distinct("c").alias("texts"))
    sizes = sizes.filter(F.col("texts") >= contexts).select("entity", "of")
    total = max(rows.count(), 1)
    # told >= share * information is p(e | t) >= p(e) ** (1 - share): n of all.
    sizes = sizes.withColumn("least", F.pow(F.col("of") / F.lit(total), F.lit(1 - share)))
    counts = rows.select(F.explode(_terms(F.coalesce("text", F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("all"))
    counts = counts.filter(F.col("all") >= contexts)
    held = written(entities.join(sizes, "entity"))
    near = unsent(unsent(own).join(counts, "term")).join(held, "_rid").filter(F.col("least") * F.col("all") <= F.col("of"))
    pairs = near.groupBy("term", "entity", "c", "least", "all").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("term", "entity", "least", "all").agg(F.count("*").alias("contexts"), F.sum("n").alias("n"))
    strong = pairs.filter((F.col("contexts") >= contexts) & (F.col("n") >= F.col("least") * F.col("all")))
    strong = strong.select("term", "entity")
    cut = unsent(unsent(own.select("_rid", "term")).join(strong, "term")).join(held.select("_rid", "entity"), ["_rid", "entity"])
    cut = written(cut.select("_rid", "term").distinct())
    # Places of every word of the texts that lose one, by running sums as for base spans.
    texts = rows.join(cut.select("_rid").distinct(), "_rid", "left_semi")
    gaps = F.transform(F.split("text", WORDS, -1), lambda g: F.length(g))
    # Word and gap in one row: an array beside the exploded words would be copied for each of them.
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0)).alias("word"), gaps.alias("g"))
    found = texts.select("_rid", F.posexplode(both).alias("i", "w")).select("_rid", "i", "w.word", "w.g")
    found = found.filter("word is not null")
    upto = Window.partitionBy("_rid").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("g") + F.length("word")).over(upto)
    found = found.select("_rid", F.lower("word").alias("term"), (end - F.length("word")).alias("start"), end.alias("end"))
    return unsent(found).join(cut, ["_rid", "term"]).select("_rid", F.lit(4).alias("kind"), "start", "end")


def spans(rows: DataFrame, contexts: int = 3, share: float = 0.75) -> DataFrame:
    """_rid, kind, start, end of every span of rows(_rid, text)."""
    base = written(matches(rows, 0).select("_rid", "kind", "start", "end", "found"))
    more = disclosing(rows, base, contexts, share)
    return base.select("_rid", "kind", "start", "end").unionByName(more)


def _joined(found: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"], s["end"])), ",")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(numbered(only(table(spark, sf_dir, "documents"), "doc_id", "text")))
    found = spans(rows.select("_rid", "text"))
    found = found.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    rows = rows.select("_rid", "doc_id").join(found, "_rid", "left")
    every = F.coalesce("all", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))
    rows = rows.select("doc_id", every.alias("all")).withColumn("base", F.filter("all", lambda s: s["kind"] < 4))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select(
        "doc_id", *[count(k) for k in range(4)], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
    )


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of its text generalised to its kind, as [EMAIL]; overlapping spans become one."""
    rid, own = spare(docs, "rid", "cut")
    rows = written(numbered(docs, rid))
    found = spans(rows.select(F.col(rid).alias("_rid"), "text"))
    order = Window.partitionBy("_rid").orderBy("start", "kind", "end")
    past = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("new", (past.isNull() | (F.col("start") >= past)).cast("int"))
    found = found.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.groupBy("_rid", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min("kind").alias("k"))
    found = found.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("s", "e", "k"))).alias(own))
    cut, found = F.col(own), found.withColumnRenamed("_rid", rid)
    name = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(c: Column, i: Column) -> Column:
        start = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get(cut, i - 1)["e"])
        return F.concat(F.substr("text", (start + 1).cast("int"), (c["s"] - start).cast("int")), F.get(name, c["k"]))

    last = F.element_at(cut, -1)["e"]
    text = F.concat(F.array_join(F.transform(cut, piece), ""), F.substr("text", (last + 1).cast("int"), F.length("text")))
    text = F.when(cut.isNotNull(), text).otherwise(F.col("text"))
    kept = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return rows.join(found, rid, "left").select(*kept)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitised(docs)
