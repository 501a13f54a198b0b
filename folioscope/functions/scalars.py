"""Scalar functions as Column expressions, and queries that apply them to the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.plans.catalog import query, table

# C0 controls but tab, LF and CR; those with C1; the word-processing formats and their other names.
CONTROLS = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]"
CONTROLS_C1 = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]"
ALIASES = {"powerpoint": "pptx", "word": "docx", "doc": "docx"}


def finite(x: Column) -> Column:
    """Null for null, NaN and the infinities."""
    return F.when(F.abs(x) < float("inf"), x)


def round_js(x: Column, places: int = 0) -> Column:
    """Half up towards plus infinity, never -0."""
    return F.floor(x * 10**places + 0.5) / 10**places


def to_points(v: Column, unit: Column) -> Column:
    """Points; twips and inches become points, a bare number is inches, other units give nothing."""
    v = finite(v)
    return F.when(unit == "pt", v * 1.0).when(unit == "twip", v / 20.0).when(unit.isin("in", ""), v * 72.0)


def to_degrees(v: Column) -> Column:
    """The number, whatever its unit."""
    return finite(v)


def to_fraction(v: Column) -> Column:
    """Within 0 and 1; nothing for null and non-finite values (`least` and `greatest` would skip them)."""
    return F.when(finite(v).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))


def to_multiplier(v: Column) -> Column:
    """I4: nothing up to 0, over 10 it is a percentage."""
    v = finite(v)
    return F.when(v > 10, v / 100.0).when(v > 0, v)


def to_int(v: Column) -> Column:
    """Rounded half up."""
    return F.floor(finite(v) + 0.5)


def stem_of(name: Column, ending: str) -> Column:
    """I8: the last part of a path without its ending; `publication` if nothing is left."""
    stem = F.trim(F.regexp_replace(F.regexp_extract(name, "([^/]*)$", 1), f"(?i)\\.{ending}$", ""))
    return F.when(stem == "", "publication").otherwise(stem)


def human_bytes(n: Column) -> Column:
    """Bytes below 1024, else KB, MB or GB, one decimal below ten."""
    out = F.when(n.isNull() | F.isnan(n.cast("double")) | (n < 0), "").when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B")))
    for k, unit in ((1, " KB"), (2, " MB"), (3, " GB")):
        x = n / float(1024**k)
        tenths = F.floor(x * 10 + 0.5)
        small = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(unit))
        whole = F.concat(F.floor(x + 0.5).cast("string"), F.lit(unit))
        value = F.when(x < 10, small).otherwise(whole)
        out = out.when(n < 1024 ** (k + 1), value) if k < 3 else out.otherwise(value)
    return out


def page_list(pages: Column) -> Column:
    """I10: "page 3", "pages 3 and 9", "pages 3, 4 and 9" of a sorted array."""
    text = F.transform(pages, lambda p: p.cast("string"))
    n = F.size(pages)
    head = F.array_join(F.slice(text, F.lit(1), F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 0, "").when(n == 1, F.concat(F.lit("page "), F.get(text, F.lit(0)))).otherwise(
        F.concat(F.lit("pages "), head, F.lit(" and "), F.element_at(text, -1))
    )


def describe_loss(message: Column, count: Column, pages: Column) -> Column:
    """The message, with how often and where: "Shadow (3 times, pages 1 and 3)"."""
    parts = F.array_compact(F.array(F.when(count > 1, F.concat(count.cast("string"), F.lit(" times"))), F.nullif(page_list(pages), F.lit(""))))
    return F.when(F.size(parts) == 0, message).otherwise(F.concat(message, F.lit(" ("), F.array_join(parts, ", "), F.lit(")")))


def csv_cell(text: Column) -> Column:
    """A cell that no spreadsheet takes for a formula, quoted where RFC 4180 or an edge space asks for it."""
    safe = F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(safe.rlike("[\",\\n\\r\\t]|^ | $"), quoted).otherwise(safe)


def escape_html(text: Column) -> Column:
    """Five characters, & first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def xml_clean(text: Column) -> Column:
    """Without the controls XML has no name for, escaped."""
    text = F.regexp_replace(text, CONTROLS, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def sanitize(text: Column) -> Column:
    """Tabs to spaces, no C0 and C1 controls."""
    return F.regexp_replace(F.replace(text, F.lit("\t"), F.lit(" ")), CONTROLS_C1, "")


def decode_entities(text: Column) -> Column:
    """I16: four named references, then numeric ones, & last. A number is decoded from its four UTF-32 bytes."""
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = F.replace(text, F.lit(a), F.lit(b))
    parts = F.regexp_extract_all(text, F.lit("&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});|&[^&]*|[^&]+"), F.lit(0))

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, "^&#([0-9]{1,7});$", 1)
        hexes = F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]{1,6});$", 1)
        code = F.when(digits != "", digits.cast("int")).when(hexes != "", F.conv(hexes, 16, 10).cast("int"))
        known = (code < 0x110000) & ~code.between(0xD800, 0xDFFF) & (code > 0)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(p)

    return F.replace(F.array_join(F.transform(parts, one), ""), F.lit("&amp;"), F.lit("&"))


def norm(text: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r\\x0B\\f]+", " "))


def tokens(text: Column) -> Column:
    """Words, runs of spaces (no-break ones too) and breaks, in order."""
    return F.regexp_extract_all(text, F.lit("\\r\\n|[\\r\\n]|[ \\u00a0]+|[^ \\u00a0\\r\\n]+"), F.lit(0))


# Fixed value: the characters of WinAnsi, as a class.
WIN_ANSI = "\\t\\n\\r\\x20-\\x7E\\x{A0}-\\x{FF}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def unencodable(text: Column) -> Column:
    """Characters that WinAnsi has none of, each of which such an output shows as '?'; tabs and breaks are no characters."""
    return F.length(text) - F.length(F.regexp_replace(text, f"[^{WIN_ANSI}]", ""))


def parse_color(text: Column) -> Column:
    """#rgb or #rrggbb to a number, else nothing."""
    three = F.regexp_replace(text, "^#([0-9a-fA-F])([0-9a-fA-F])([0-9a-fA-F])$", "#$1$1$2$2$3$3")
    return F.when(three.rlike("^#[0-9a-fA-F]{6}$"), F.conv(F.substring(three, 2, 6), 16, 10).cast("long"))


def flatten_on_white(channel: Column, alpha: Column) -> Column:
    """A channel over white."""
    return F.floor(channel * alpha / 255.0 + (255 - alpha) + 0.5)


def sniff_format(head: Column) -> Column:
    """Picture format by the first bytes, as hex."""
    return (
        F.when(head.startswith("89504E47"), "png").when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("47494638"), "gif").when(head.startswith("424D"), "bmp")
    )


def text_hash(text: Column) -> Column:
    """I23."""
    return F.sha2(text.cast("binary"), 256)


def band(score: Column) -> Column:
    """I24."""
    return F.when(score >= 0.9, "good").when(score >= 0.6, "fair").when(score < 0.6, "poor")


def keywords_split(text: Column) -> Column:
    """Parts between commas and semicolons, trimmed, none empty."""
    return F.filter(F.transform(F.split(text, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def w3cdtf(text: Column) -> Column:
    """A date text as UTC seconds with Z, nothing where it is no date."""
    return F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def charset_label(text: Column) -> Column:
    """Lower case without hyphens, underscores and spaces."""
    return F.lower(F.translate(text, "-_ ", ""))


def enum_of(text: Column, names: dict[str, str], default: str | None = None) -> Column:
    """A closed list of names, else the default."""
    out = F.lit(default).cast("string")
    for a, b in names.items():
        out = F.when(text == a, b).otherwise(out)
    return out


ALIGN = {"left": "left", "start": "left", "right": "right", "end": "right", "center": "center", "justify": "justify"}
REPEAT = {"repeat": "tile", "no-repeat": "once", "stretch": "stretch"}


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice AS degrees, CAST(floor(l_extendedprice + 0.5) AS BIGINT) AS whole,
CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS percent, floor(l_extendedprice / 7.0 * 1000 + 0.5) / 1000 AS r3,
floor(l_extendedprice / 7.0 * 100 + 0.5) / 100 AS r2, CASE WHEN l_discount < 0.03 THEN NULL ELSE 1.0 / l_discount END AS finite,
CASE WHEN l_discount * 10 >= 0.9 THEN 'good' WHEN l_discount * 10 >= 0.6 THEN 'fair' ELSE 'poor' END AS band,
CAST(floor((l_partkey % 256) * (l_suppkey % 256) / 255.0 + (255 - l_suppkey % 256) + 0.5) AS BIGINT) AS on_white FROM lineitem""")
def i2_numbers(spark, sf_dir):
    """I2, I5, I6, I7, I21, I24 on lineitem."""
    p, d = F.col("l_extendedprice"), F.col("l_discount")
    bad = F.when(d < 0.03, F.lit(float("nan"))).otherwise(1.0 / d)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", to_degrees(p).alias("degrees"), to_int(p).alias("whole"), to_int(d * 100).alias("percent"),
        round_js(p / 7.0, 3).alias("r3"), round_js(p / 7.0, 2).alias("r2"), finite(bad).alias("finite"), band(d * 10).alias("band"),
        flatten_on_white(F.col("l_partkey") % 256, F.col("l_suppkey") % 256).alias("on_white"),
    )


@query("""SELECT page_id, CASE WHEN s = '' THEN 'publication' ELSE s END AS stem FROM (SELECT page_id,
trim(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(?i)\\.html$', '')) AS s FROM pages)""")
def i8_stem(spark, sf_dir):
    """I8 on urls."""
    return table(spark, sf_dir, "pages").select("page_id", stem_of(F.col("url"), "html").alias("stem"))


@query("""SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN
CASE WHEN n / 1024.0 < 10 THEN CAST(floor(floor(n / 1024.0 * 10 + 0.5) / 10) AS BIGINT) || '.' || CAST(floor(n / 1024.0 * 10 + 0.5) AS BIGINT) % 10
ELSE '' || CAST(floor(n / 1024.0 + 0.5) AS BIGINT) END || ' KB' ELSE
CASE WHEN n / 1048576.0 < 10 THEN CAST(floor(floor(n / 1048576.0 * 10 + 0.5) / 10) AS BIGINT) || '.' || CAST(floor(n / 1048576.0 * 10 + 0.5) AS BIGINT) % 10
ELSE '' || CAST(floor(n / 1048576.0 + 0.5) AS BIGINT) END || ' MB' END AS size FROM (SELECT doc_id, n_chars * (1 + doc_id % 700) AS n FROM documents)""")
def i9_human_bytes(spark, sf_dir):
    """I9 on text sizes."""
    n = F.col("n_chars") * (1 + F.col("doc_id") % 700)
    return table(spark, sf_dir, "documents").select("doc_id", human_bytes(n).alias("size"))


@query("""SELECT l_orderkey, 'Shadow' || CASE WHEN n > 1 THEN ' (' || n || ' times, ' ELSE ' (' END || CASE WHEN len(p) = 1
THEN 'page ' || p[1] ELSE 'pages ' || array_to_string(p[1 : len(p) - 1], ', ') || ' and ' || p[len(p)] END || ')' AS loss
FROM (SELECT l_orderkey, count(*) AS n, list_sort(list(DISTINCT l_linenumber)) AS p FROM lineitem GROUP BY l_orderkey)""")
def i11_describe_loss(spark, sf_dir):
    """Losses of an order told with their pages."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sort_array(F.collect_set("l_linenumber")).alias("p")
    )
    return rows.select("l_orderkey", describe_loss(F.lit("Shadow"), F.col("n"), F.col("p")).alias("loss"))


_TEXTS = """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '=' || text WHEN 1 THEN ' ' || text WHEN 2 THEN replace(text, ' ', '"')
WHEN 3 THEN replace(text, ' ', chr(9)) WHEN 4 THEN replace(text, 'e', chr(7)) || chr(160) || '<' ELSE replace(text, ' ', '') END AS t FROM documents"""


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(s, '[",\\n\\r\\t]|^ | $') THEN '"' || replace(s, '"', '""') || '"' ELSE s END AS cell
FROM (SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN '''' || t ELSE t END AS s FROM ({_TEXTS}))""")
def i12_csv_cell(spark, sf_dir):
    """I12 on texts that a spreadsheet would take for formulas."""
    return _texts(spark, sf_dir).select("doc_id", csv_cell(F.col("t")).alias("cell"))


def _texts(spark, sf_dir):
    t, k = F.col("text"), F.col("doc_id") % 6
    swap = lambda a, b: F.replace(t, F.lit(a), F.lit(b))
    t = (
        F.when(k == 0, F.concat(F.lit("="), t)).when(k == 1, F.concat(F.lit(" "), t)).when(k == 2, swap(" ", '"'))
        .when(k == 3, swap(" ", "\t")).when(k == 4, F.concat(swap("e", "\7"), F.lit(" <"))).otherwise(swap(" ", ""))
    )
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))


@query(f"""SELECT doc_id, replace(replace(replace(replace(regexp_replace(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml,
regexp_replace(replace(t, chr(9), ' '), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]', '', 'g') AS plain,
trim(regexp_replace(t, '[ \\t\\n\\r\\x0B\\f]+', ' ', 'g')) AS norm, sha256(t) AS hash,
CAST(length(t) - length(regexp_replace(t, '[^{WIN_ANSI}]', '', 'g')) AS BIGINT) AS unencodable FROM ({_TEXTS})""")
def i14_cleaned(spark, sf_dir):
    """I14, I15, I17, I19, I23 on texts with controls."""
    t = F.col("t")
    return _texts(spark, sf_dir).select(
        "doc_id", xml_clean(t).alias("xml"), sanitize(t).alias("plain"), norm(t).alias("norm"), text_hash(t).alias("hash"),
        unencodable(t).cast("long").alias("unencodable"),
    )


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS text
FROM pages""")
def i16_entities(spark, sf_dir):
    """I16 on pages; their references are named ones, numeric ones are tested apart."""
    return table(spark, sf_dir, "pages").select("page_id", decode_entities(F.col("html")).alias("text"))


@query("""SELECT doc_id, CAST(i AS INT) AS pos, token, CASE WHEN regexp_matches(token, '^[\\r\\n]') THEN 'break' WHEN regexp_matches(token, '^[ \\x{A0}]') THEN 'space' ELSE 'word' END AS kind
FROM (SELECT doc_id, unnest(m) AS token, unnest(range(len(m))) AS i FROM (SELECT doc_id,
regexp_extract_all(text, '\\r\\n|[\\r\\n]|[ \\x{A0}]+|[^ \\x{A0}\\r\\n]+') AS m FROM documents))""")
def i18_tokens(spark, sf_dir):
    """I18 on documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    t = F.col("token")
    return rows.withColumn("kind", F.when(t.rlike("^[\r\n]"), "break").when(t.rlike("^[  ]"), "space").otherwise("word"))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN 'none' ELSE '' || CAST(n_nationkey % 16 * 17 * 65536 + (n_nationkey * 3) % 16 * 17 * 256 + (n_nationkey * 5) % 16 * 17 AS BIGINT) END AS color,
CASE n_nationkey % 5 WHEN 0 THEN 'png' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'gif' WHEN 3 THEN 'bmp' END AS format,
replace(lower(n_name), '_', '') || 'latin1' AS label, CASE n_nationkey % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'right' WHEN 2 THEN 'center' ELSE 'left' END AS align,
'en' AS lang, CASE WHEN n_nationkey % 2 = 0 THEN 'Latn' ELSE '' END AS script, 'GB' AS country, lower(n_name) || '|x y' AS keywords FROM nation""")
def i20_codes(spark, sf_dir):
    """Codes made from a nation's key and name."""
    k, hexes = F.col("n_nationkey"), lambda x: F.lower(F.hex(x))
    three = [hexes(k % 16), hexes((k * 3) % 16), hexes((k * 5) % 16)]
    color = F.when(k % 3 == 0, F.concat(F.lit("#"), *three)).when(k % 3 == 1, F.concat(F.lit("#"), *[F.repeat(h, 2) for h in three])).otherwise("#12")
    head = F.element_at(F.array(*[F.lit(x) for x in ("89504E470D0A", "FFD8FFE0", "474946383961", "424D3C00", "00000000")]), (k % 5 + 1).cast("int"))
    align = F.element_at(F.array(*[F.lit(x) for x in ("start", "end", "center", "odd")]), (k % 4 + 1).cast("int"))
    locale = split_locale(F.when(k % 2 == 0, "en_Latn_GB@x=1").otherwise("en_GB"))
    return table(spark, sf_dir, "nation").select(
        "n_nationkey", F.coalesce(parse_color(color).cast("string"), F.lit("none")).alias("color"), sniff_format(head).alias("format"),
        charset_label(F.concat("n_name", F.lit(" Latin-_1"))).alias("label"), enum_of(align, ALIGN, "left").alias("align"),
        locale["lang"].alias("lang"), locale["script"].alias("script"), locale["country"].alias("country"),
        F.array_join(keywords_split(F.concat(F.lower("n_name"), F.lit(" ,; x y;"))), "|").alias("keywords"),
    )


def split_locale(text: Column) -> Column:
    """Struct lang, script, country; keywords after '@' are off, `root` is empty."""
    parts = F.split(F.regexp_replace(F.split_part(text, F.lit("@"), F.lit(1)), "^root$", ""), "_")
    pick = lambda pattern: F.coalesce(F.get(F.filter(F.slice(parts, 2, 9), lambda p: p.rlike(pattern)), F.lit(0)), F.lit(""))
    return F.struct(F.get(parts, F.lit(0)).alias("lang"), pick("^[A-Za-z]{4}$").alias("script"), pick("^([A-Za-z]{2}|[0-9]{3})$").alias("country"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0""")
def i26_dates(spark, sf_dir):
    """Order dates as text, every seventh not a date."""
    text = F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", w3cdtf(text).alias("stamp"))
