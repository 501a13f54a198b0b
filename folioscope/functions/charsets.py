"""Bytes of old documents to text, by the charset label each one brings."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.scalars import charset_label
from folioscope.plans.catalog import query, table

# The labels documents bring, without case and separators, and the codec of each; what any other label counts as.
CODECS = {
    "windows1250": "cp1250", "windows1251": "cp1251", "windows1252": "cp1252", "windows1256": "cp1256", "iso88591": "latin-1", "latin1": "latin-1", "iso88592": "iso8859-2",
    "utf16le": "utf-16-le", "windows932": "cp932", "shiftjis": "cp932", "sjis": "cp932", "windows936": "gbk", "gbk": "gbk", "windows950": "cp950", "big5": "cp950", "gb18030": "gb18030",
}
FALLBACK = "windows1252"
# The characters of single-byte pages; bytes a page has no character for are controls of the same number.
PAGES = {c: "".join(bytes([x]).decode(c, "ignore") or chr(x) for x in range(256)) for c in set(CODECS.values()) if c.startswith("cp125")}


def _decoded(data: pd.Series, labels: pd.Series) -> pd.Series:
    def one(b, label):
        if b is None:
            return None
        codec = CODECS.get(label, CODECS[FALLBACK])
        if codec in PAGES:
            return codecs.charmap_decode(bytes(b), "strict", PAGES[codec])[0]
        return bytes(b).decode(codec, "replace")

    return pd.Series([one(*x) for x in zip(data, labels, strict=True)], dtype=object)


def decoded(data: Column, label: Column) -> Column:
    """Text of bytes under a label of any case with any of `-`, `_` and space between; unknown and null labels are windows-1252.

    What is no character of a multi-byte charset becomes U+FFFD. Null bytes: null. Spark itself decodes none of these pages, so
    Arrow batches do it; the codecs are a closed list.
    """
    return F.pandas_udf(_decoded, "string")(data, F.coalesce(charset_label(label), F.lit(FALLBACK)))


_LABEL = "CASE doc_id % 5 WHEN 0 THEN 'Windows-1252' WHEN 1 THEN 'LATIN_1' WHEN 2 THEN 'utf 16LE' WHEN 3 THEN 'klingon' END"


@query(f"""SELECT doc_id, CASE label WHEN 'utf 16LE' THEN text || chr(34176) || chr(65409) WHEN 'LATIN_1' THEN plain || chr(128) || chr(133) || chr(129) || 'ÿ' ELSE plain || '€…' || chr(129) || 'ÿ' END AS text
FROM (SELECT doc_id, text, {_LABEL} AS label, regexp_replace(text, '[^\\x09-\\x7E\\x{{A0}}-\\x{{FF}}]', '?', 'g') AS plain FROM documents)""")
def r3_charset_labels(spark, sf_dir):
    """Every text as bytes of a charset, four more bytes behind it, read by its label, a wrong one or none."""
    plain = F.encode(F.regexp_replace("text", "[^\\x09-\\x7E\\x{A0}-\\x{FF}]", "?"), "ISO-8859-1")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_LABEL).alias("label"), F.encode("text", "UTF-16LE").alias("wide"), plain.alias("plain"))
    data = F.concat(F.when(F.col("label") == "utf 16LE", F.col("wide")).otherwise(F.col("plain")), F.unhex(F.lit("808581FF")))
    return rows.select("doc_id", decoded(data, F.col("label")).alias("text"))
