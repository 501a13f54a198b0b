"""HTML main text by equivalence-class template deduction.

The tokens of a page are its elements, each named by the path of block elements down to it (with class, id and role),
and its text blocks, each named by its element's path and its words. For each host, every token has an occurrence
vector over the host's distinct pages; tokens with one vector are an equivalence class. Vectors are compared by a sum
of hashes of (page, count), a partial aggregate per (host, token), so a host with a third of all pages never meets in
one task. A class is valid if it stands in at least ``support`` of the host's pages and in ``least`` of them, and if it
has an element beside another token: paragraphs that copies of one page share have a vector of their own, but no
element shares it. Valid classes nest by path into the host's template. Its text tokens are template text and are
dropped; so are slots (element paths) whose text stands on several pages in ``stale`` of all cases, with all that is
nested in them: menus and adverts drawn from a pool. What remains are the slots that vary. Where `article` or `main`
is a slot, only what it holds counts, else the body. Elements that name their part themselves (`nav`, class `ad`, ...)
are no slots of text anywhere: reader comments vary like an article, and a host of few pages proves no template. Class,
id and role name a part only if all their words speak of page parts (`ad`, `share-buttons`, `related posts list`); with
any other word (`share price`, `related work`) they name a subject, and the template alone decides.

The html is read in one linear pass: blocks are cut at block elements, references are decoded, white space becomes one
space. A tag or comment left open at the end is dropped, an element left open ends with its parent. Null, empty or
text-free html: empty text. A url without host shares the host ''. Copies of one page count once in a template.
Repeated page_ids are separate rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import only, table, written

# Roles of elements.
SKIP_RAW = frozenset("script style noscript template textarea title iframe svg select option".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button".split())
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_P = BLOCKS - {"body", "html"}
PARTS = re.compile(
    r"ads?|advert\w*|banners?|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|menu|nav|navbar"
    r"|navigation|newsletter|notice|popup|promo|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget",
    re.I,
)
NEUTRAL = frozenset(
    "area aside bar block body bottom box button buttons center col column container content div element entry extra fixed"
    " float form global group head holder icon icons inline inner item items js left lg line link links list main md media"
    " middle mobile module new outer page panel post posts primary region reply right row secondary section sm site slot"
    " small sticky text thread title top unit ul user users wrap wrapper xl xs".split()
)
WORDS = re.compile(r"[^\W_]+")
OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
ATTR = re.compile(r"(class|id|role|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SPACES = re.compile(r"\s+")


def _name(tag: str, attrs: str) -> str:
    got = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in ATTR.finditer(attrs)} if attrs.strip() else {}
    return f"{tag}|{got.get('class', '')} {got.get('id', '')} {got.get('role', '')}"


def _part(token: str) -> bool:
    tag, names = token.split("|", 1)
    if tag in FURNITURE:
        return True
    words = () if tag in ("body", "html", "main", "article") else WORDS.findall(names)
    named = [bool(PARTS.fullmatch(w)) for w in words]
    return any(named) and all(n or w.isdigit() or w.lower() in NEUTRAL for n, w in zip(named, words))


def _hash(*parts) -> int:
    """A token as a signed long."""
    got = xxhash.xxh64_intdigest("\0".join(map(str, parts)))
    return got - (1 << 64) if got >> 63 else got


def _end_of_tag(page: str, at: int) -> int:
    """Where the tag that begins before ``at`` ends: past its '>', quotes heeded, or -1."""
    first = page.find(">", at)
    while True:
        close = page.find(">", at)
        quotes = [q for q in (page.find('"', at, close), page.find("'", at, close)) if q >= 0] if close >= 0 else []
        if close < 0 or not quotes:
            return (close if close >= 0 else first) + 1 or -1
        quote = min(quotes)
        shut = page.find(page[quote], quote + 1)
        if shut < 0:
            return first + 1
        at = shut + 1


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', words, ''), ('open', tag, attributes), ('void', tag, '') and ('close', tag, ''), in order."""
    at, size = 0, len(page)
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", page[at:], ""
            return
        if page.startswith("<!--", lt):
            shut, skip = page.find("-->", lt + 4), 3
        elif page.startswith("<![CDATA[", lt):
            shut, skip = page.find("]]>", lt), 3
        elif page.startswith(("<!", "<?"), lt) or page.startswith("</", lt) and not page[lt + 2 : lt + 3].isalpha():
            shut, skip = page.find(">", lt), 1
        else:
            m = OPEN.match(page, lt)
            if m is None:  # a bare '<'
                yield "text", page[at : lt + 1], ""
                at = lt + 1
                continue
            if lt > at:
                yield "text", page[at:lt], ""
            at = _end_of_tag(page, m.end())
            if at < 0:
                return
            tag, attrs = m[2].lower(), page[m.end() : at - 1]
            if m[1]:
                yield "close", tag, ""
            elif tag in SKIP_RAW:
                yield "void", tag, ""
                end = re.compile(rf"</\s*{re.escape(tag)}\b", re.I).search(page, at)
                at = _end_of_tag(page, end.end()) if end else -1
                if at < 0:
                    return
            elif tag in VOID or attrs.endswith("/"):
                yield "void", tag, ""
            else:
                yield "open", tag, attrs
            continue
        if lt > at:
            yield "text", page[at:lt], ""
        if shut < 0:
            return
        at = shut + skip


def blocks(page: str | None, dropped: Callable[[int], bool] = lambda token: False, named: bool = True) -> tuple[list[tuple[int, str, bool]], Counter, bool]:
    """((path token, text, within article or main) of each block outside furniture and dropped slots, element counts, had main)."""
    out, found, elements, had_main = [], [], Counter(), False
    stack: list[tuple[str, int, bool, bool]] = []  # tag, path, skipped, main
    open_, skips, mains = Counter(), 0, 0

    def flush():
        if out:
            text = SPACES.sub(" ", entities.unescape("".join(out))).strip()
            out.clear()
            if text:
                found.append((stack[-1][1] if stack else 0, text, mains > 0))

    def pop():
        nonlocal skips, mains
        tag, _, skip, main = stack.pop()
        open_[tag] -= 1
        skips -= skip
        mains -= main
        return tag

    for kind, tag, attrs in _tokens(page or ""):
        if kind == "text":
            if not skips:
                out.append(tag)
            continue
        if tag in BLOCKS:
            flush()
        if kind == "close":
            if open_[tag]:
                while pop() != tag:
                    pass
            continue
        if tag in ENDS_P and open_["p"]:
            while pop() != "p":
                pass
        if kind == "void":
            if tag == "br" and not skips:
                out.append(" ")
            continue
        path = stack[-1][1] if stack else 0
        skip, main = False, tag in ("article", "main")
        if tag in BLOCKS or main:
            token = _name(tag, attrs)
            path = _hash(path, token)
            elements[path] += 1
            skip = named and _part(token) or dropped(path)
        elif not named:
            pass
        elif attrs:
            skip = _part(_name(tag, attrs))
        elif tag in FURNITURE:
            skip = True
        had_main |= main and not skips and not skip
        stack.append((tag, path, skip, main))
        open_[tag] += 1
        skips += skip
        mains += main
    flush()
    return found, elements, had_main


def extract(page: str | None, template: frozenset[int] = frozenset(), named: bool = True) -> str:
    """The blocks of the slots that remain once ``template`` (tokens of slots and of text) is taken out."""
    found, _, had_main = blocks(page, template.__contains__, named)
    return "\n".join(t for path, t, main in found if main >= had_main and not (template and _hash(path, "text", t) in template))


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for host, page in zip(batch["host"], batch["html"]):
            found, elements, _ = blocks(page, named=False)
            of = _hash(page or "")
            seen = Counter((path, _hash(path, "text", t)) for path, t, _ in found)
            out += [(host, path, 0, of, n) for path, n in elements.items()]
            out += [(host, path, text, of, n) for (path, text), n in seen.items()]
        yield pd.DataFrame(out, columns=["host", "slot", "text", "page", "n"])


def templates(pages: DataFrame, support: float = 0.5, least: int = 8, stale: float = 0.8, several: int = 3) -> DataFrame:
    """(host, template): the template text and stale slots of each host, as tokens, from pages(host, html)."""
    seen = pages.mapInPandas(_counts, "host string, slot long, text long, page long, n int").distinct()
    sign = F.xxhash64("page", "n").cast("decimal(38,0)")
    tokens = written(seen.groupBy("host", "slot", "text").agg(F.sum(sign).alias("vector"), F.count("*").alias("pages")))
    size = pages.select("host", F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count("*").alias("all"))
    size = size.filter(F.col("all") >= least)
    often = tokens.join(size, "host").filter((F.col("pages") >= least) & (F.col("pages") >= support * F.col("all")))
    classes = often.groupBy("host", "vector").agg(F.count_if(F.col("text") == 0).alias("elements"), F.count("*").alias("k"))
    classes = classes.filter("elements > 0 and k > 1").select("host", "vector")
    text = often.filter("text <> 0").join(classes, ["host", "vector"]).select("host", F.col("text").alias("token"))
    slots = tokens.filter("text <> 0").join(size, "host").groupBy("host", "slot").agg(
        F.sum("pages").alias("cases"), F.sum(F.when(F.col("pages") >= several, F.col("pages")).otherwise(0)).alias("again")
    )
    slots = slots.filter((F.col("cases") >= least) & (F.col("again") >= stale * F.col("cases")))
    found = text.union(slots.select("host", F.col("slot").alias("token")))
    return found.groupBy("host").agg(F.collect_set("token").alias("template"))


def main_text(pages: DataFrame, support: float = 0.5) -> DataFrame:
    """page_id, url, text per row."""
    rows = only(pages, "page_id", "url", "html")
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[a-zA-Z]+://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = rows.withColumn("host", host)
    # Written first, so that its size is known: Spark broadcasts it only under its own threshold.
    found = written(templates(rows.select("host", "html"), support))

    @F.pandas_udf(StringType())
    def of(htmls: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([extract(h, frozenset(p) if p is not None else frozenset()) for h, p in zip(htmls, parts)])

    return rows.join(found, "host", "left").select("page_id", "url", of("html", "template").alias("text"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    text: Column = F.col("text")
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length(text).cast("long"))
