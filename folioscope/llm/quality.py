"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule rejects texts whose measure, in thousandths, is at a cutoff or above. The cutoffs come from a labelled holdout:
the different texts with a quality label that pass the base rule (no measure, rule or order is fitted to labels, so all of
them are holdout). In a stratum with n good holdout texts a cutoff that rejects k of them passes its test if
P(Binomial(n, p) <= k) <= level, so that a false rejection rate above p would have shown more than k with confidence
1 - level. p is ``alpha`` over the number of rules, so that all rules of a stratum together reject at most ``alpha`` of its
good texts. Every rule of a stratum is tested from its strictest value downwards until the first value fails, a fixed
sequence that needs no correction; level is ``delta`` over the number of rules times strata, which corrects for those.
Among the values that passed, a rule takes the one with most bad texts caught less ``worth`` times good ones lost, and
none if that is never above zero. A stratum with too few good texts to prove anything has no cutoffs: its texts stay.

The binomial sum is exact: ln n! from factorials up to 20 and five terms of its series above (error below 1e-14), terms
from k downwards as products, until they are below 1e-17 of the sum. k is found per stratum by bisection.

Null text: no words, which fails the base rule. Null lang and '' are one stratum. Repeated rows are judged alike; equal
texts of a stratum are one holdout text, good if any label of one says so (1), bad if none does and one says 0; null or
other labels say nothing. Ties between cutoffs go to the stricter. No documents: no rows; no labels: the base rule alone.
Extra columns are ignored. Repeated five-word windows are found inside each row's arrays, exactly and in n log n.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only, table, written

SYMBOLS = "#*$%&|<>"  # fixed value: the contract's symbols
WINDOW = 5
FEWEST = 10
MOST_REPEATED = 20  # of 100 words
ALPHA, DELTA, WORTH = 0.05, 0.05, 4
# What each rule measures, in thousandths; higher is worse.
RULES = ("symbols", "long_words", "short_words", "dup_lines", "repeats")


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and text's n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, text_key of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    rows = only(docs, *keep, "text").select(*[F.col(f"`{c}`") for c in keep], text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split(flat, " "), lambda w: w != ""))
    rows = rows.withColumn("n", F.size("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")
    rows = rows.withColumn("lines", lines)
    parts = [F.slice("words", F.lit(k + 1), F.col("n")).alias(f"w{k}") for k in range(WINDOW)]
    windows = F.arrays_zip(*parts, F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array()).alias("at"))
    rows = rows.withColumn("windows", F.sort_array(F.slice(windows, F.lit(1), F.greatest(F.col("n") - (WINDOW - 1), F.lit(0)))))

    def twin(a: Column, b: Column) -> Column:
        same = a["w0"] == b["w0"]
        for k in range(1, WINDOW):
            same = same & (a[f"w{k}"] == b[f"w{k}"])
        return F.when(same, F.array(a["at"], b["at"])).otherwise(F.array().cast("array<int>"))

    # In sorted order equal windows stand together; places found twice or more, in order, cover what lies between them.
    twins = F.zip_with("windows", F.slice("windows", F.lit(2), F.col("n")), twin)
    rows = rows.withColumn("at", F.sort_array(F.array_distinct(F.flatten(twins))))
    steps = F.zip_with("at", F.slice("at", F.lit(2), F.col("n")), lambda a, b: F.least(b - a, F.lit(WINDOW)))
    return rows.select(
        *[F.col(f"`{c}`") for c in keep], F.xxhash64("text").alias("text_key"), F.col("n").cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(steps, F.lit(0).cast("long"), lambda s, x: s + x).alias("n_repeat_words"), F.size("lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def values() -> Column:
    """Array of the rules' measures, in the order of RULES; null where a text has no words."""
    of = lambda part, whole: F.expr(f"{part} * 1000 div nullif({whole}, 0)")
    return F.array(
        of("n_symbols", "n_words"), of("word_chars", "n_words"), -of("word_chars", "n_words"), of("n_dup_lines", "n_lines"), of("n_repeat_words", "n_words")
    )


def _ln_factorial(n: Column) -> Column:
    n = n.cast("double")
    series = (n + 0.5) * F.log(n) - n + 0.5 * math.log(2 * math.pi) + 1 / (12 * n) - 1 / (360 * n**3) + 1 / (1260 * n**5) - 1 / (1680 * n**7)
    return F.when(n <= 20, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k) for 0 <= k <= n * p."""
    first = _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k) + k * math.log(p) + (n - k) * math.log1p(-p)
    terms = F.least(k, F.ceil(12 * F.sqrt(n * (p * (1 - p)))) + 60)

    def add(s: Column, j: Column) -> Column:
        term = s["term"] * (k - j + 1) / (n - k + j) * ((1 - p) / p)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(terms > 0, F.sequence(F.lit(1).cast("long"), terms)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(first + F.log(F.aggregate(steps, start, add, lambda s: s["sum"])))


def allowed(n: Column, p: float, level: float) -> Column:
    """The largest k with P(Binomial(n, p) <= k) <= level, or -1."""
    n = n.cast("long")
    bounds = F.struct(F.lit(-1).cast("long").alias("low"), (F.floor(n * p) + 1).cast("long").alias("high"))  # low passes, high does not

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["low"] + s["high"]) / 2).cast("long")
        passes = F.when(mid <= s["low"], True).otherwise(binomial_tail(mid, n, p) <= level)
        return F.struct(F.when(passes, mid).otherwise(s["low"]).alias("low"), F.when(passes, s["high"]).otherwise(mid).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(63)), bounds, halve, lambda s: s["low"])


def cutoffs(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, worth: int = WORTH) -> DataFrame:
    """stratum, rule, cut, good_texts, allowed, good_lost, bad_caught from rows(doc_id, stratum, text_key, measures) and
    labels(doc_id, quality)."""
    say = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality").isin(0, 1), F.col("quality"))).alias("good")).filter("good is not null")
    held = rows.filter(~base_failed()).select("doc_id", "stratum", "text_key", values().alias("v")).join(say, "doc_id")
    held = held.groupBy("stratum", "text_key").agg(F.max("good").alias("good"), F.first("v").alias("v"))
    held = written(held.select("stratum", "good", "v"))
    sizes = held.groupBy("stratum").agg(F.sum("good").cast("long").alias("good_texts"))
    p, tests = alpha / len(RULES), len(RULES) * max(sizes.count(), 1)
    sizes = written(sizes.withColumn("allowed", allowed(F.col("good_texts"), p, delta / tests)))
    counts = held.select("stratum", "good", F.posexplode("v").alias("rule", "cut")).filter("cut is not null")
    counts = counts.groupBy("stratum", "rule", "cut").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
    down = Window.partitionBy("stratum", "rule").orderBy(F.desc("cut")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("stratum", "rule", "cut", F.sum("good").over(down).alias("good_lost"), F.sum("bad").over(down).alias("bad_caught"))
    tried = counts.join(sizes, "stratum").filter(F.col("good_lost") <= F.col("allowed"))
    tried = tried.withColumn("gain", F.col("bad_caught") - worth * F.col("good_lost")).filter("gain > 0")
    best = F.max_by(F.struct("cut", "good_texts", "allowed", "good_lost", "bad_caught"), F.struct("gain", "cut"))
    return tried.groupBy("stratum", "rule").agg(best.alias("best")).select("stratum", "rule", "best.*")


def judged(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """``rows`` with base_failed and kept."""
    cuts = cuts.groupBy("stratum").agg(F.collect_list(F.struct("rule", "cut")).alias("cuts"))
    rows = rows.join(written(cuts), "stratum", "left")
    rejected = F.coalesce(F.exists("cuts", lambda c: F.get(values(), c["rule"]) >= c["cut"]), F.lit(False))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejected)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumnRenamed("lang", "stratum")
    rows = written(measured(docs.withColumn("stratum", F.coalesce("stratum", F.lit(""))), "doc_id", "stratum"))
    labels = only(table(spark, sf_dir, "labels"), "doc_id", "quality")
    return judged(rows, cutoffs(rows, labels)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = rf"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
), grams AS (
    SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram
    FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)
), twice AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM grams) WHERE n > 1
), repeats AS (
    SELECT rid, sum(least(coalesce(next - i, {WINDOW}), {WINDOW})) AS n
    FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS next FROM twice) GROUP BY rid
), m AS (
    SELECT w.rid, doc_id, stratum, text, len(words)::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM w LEFT JOIN repeats r USING (rid)
), b AS (
    SELECT rid, doc_id, stratum, text, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        n_repeat_words, n_words < {FEWEST} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
        [n_symbols * 1000 // nullif(n_words, 0), word_chars * 1000 // nullif(n_words, 0), -(word_chars * 1000 // nullif(n_words, 0)),
         (len(lines) - len(list_distinct(lines))) * 1000 // nullif(len(lines), 0), n_repeat_words * 1000 // nullif(n_words, 0)] AS v
    FROM m
), say AS (
    SELECT doc_id, max(quality) FILTER (quality IN (0, 1)) AS good FROM labels GROUP BY doc_id
), held AS (
    SELECT stratum, text, max(good)::BIGINT AS good, any_value(v) AS v
    FROM b JOIN say USING (doc_id) WHERE good IS NOT NULL AND NOT base_failed GROUP BY stratum, text
), sizes AS (
    SELECT stratum, sum(good)::BIGINT AS n FROM held GROUP BY stratum
), level AS (
    SELECT {DELTA} / ({len(RULES)} * count(*)) AS level FROM sizes
), tails AS (
    SELECT stratum, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({ALPHA / len(RULES)!r}) + (n - k) * ln(1 - {ALPHA / len(RULES)!r})))
        OVER (PARTITION BY stratum ORDER BY k) AS tail
    FROM (SELECT stratum, n, unnest(range(0, n + 1)) AS k FROM sizes)
), allowed AS (
    SELECT s.stratum, coalesce(max(k) FILTER (tail <= level), -1) AS allowed
    FROM sizes s CROSS JOIN level LEFT JOIN tails t ON s.stratum = t.stratum GROUP BY s.stratum
), long AS (
    SELECT stratum, good, rule, v[rule] AS cut FROM held CROSS JOIN (SELECT unnest(range(1, {len(RULES)} + 1)) AS rule) WHERE v[rule] IS NOT NULL
), counts AS (
    SELECT stratum, rule, cut, sum(sum(good)) OVER down AS lost, sum(sum(1 - good)) OVER down AS caught
    FROM long GROUP BY stratum, rule, cut WINDOW down AS (PARTITION BY stratum, rule ORDER BY cut DESC)
), cuts AS (
    SELECT stratum, rule, first(cut ORDER BY caught - {WORTH} * lost DESC, cut DESC) AS cut
    FROM counts JOIN allowed USING (stratum) WHERE lost <= allowed AND caught - {WORTH} * lost > 0 GROUP BY stratum, rule
), rejected AS (
    SELECT DISTINCT rid FROM b JOIN cuts c ON b.stratum = c.stratum WHERE b.v[c.rule] >= c.cut
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND rid NOT IN (SELECT rid FROM rejected) AS kept
FROM b
"""
