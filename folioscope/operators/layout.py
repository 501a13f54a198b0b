"""Text layout: paragraphs broken into lines by the widths of their characters, lines packed into the columns of a box."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from folioscope.functions.scalars import sanitize, tokens
from folioscope.plans.catalog import query, table

# Points of type without a size, line height in sizes, least column width in sizes, margin kept on the page.
SIZE, LEADING, EM, MARGIN = 12, 1.2, 1.0, 18
WORD, SPACE, BREAK = range(3)
LINES = "array<struct<tokens:array<int>,width:double,size:double,hard:boolean>>"


def measured(runs: DataFrame, widths: DataFrame, *keys: str, unknown: float = 0.5) -> DataFrame:
    """keys, run, token, text, kind, size, width of runs(keys, run, text, size, font): words, spaces and breaks in order.

    A token's width is the sum of its characters' in widths(font, ch, width), ``unknown`` for others, times its size. Each
    different token of a font is measured once; characters never leave their token otherwise.
    """
    rows = runs.select(*keys, "run", F.coalesce(F.col("size").cast("double"), F.lit(float(SIZE))).alias("size"), "font", F.posexplode(tokens(sanitize(F.col("text")))).alias("token", "text"))
    kind = F.when(F.col("text").rlike("^[\\r\\n]"), BREAK).when(F.col("text").rlike("^[ \\u00a0]"), SPACE).otherwise(WORD)
    rows = rows.withColumn("kind", kind)
    once = rows.filter(F.col("kind") != BREAK).select("font", "text").distinct()
    chars = once.select("font", "text", F.explode(F.split("text", "")).alias("ch")).groupBy("font", "text", "ch").count()
    chars = chars.join(widths, ["font", "ch"], "left")
    ems = chars.groupBy("font", "text").agg(F.sum(F.coalesce("width", F.lit(unknown)) * F.col("count")).alias("ems"))
    rows = rows.join(ems, ["font", "text"], "left")
    return rows.select(*keys, "run", "token", "text", "kind", "size", (F.coalesce("ems", F.lit(0.0)) * F.col("size")).alias("width"))


def _broken(kinds: pd.Series, widths: pd.Series, sizes: pd.Series, first: pd.Series, rest: pd.Series) -> pd.Series:
    """Greedy lines of each paragraph's tokens; linear in them."""

    def one(kinds, widths, sizes, first, rest):
        lines, held, width, size, space, room = [], [], 0.0, 0.0, None, max(1.0, first)

        def end(hard):
            nonlocal held, width, size, space, room
            lines.append({"tokens": held, "width": width, "size": size or float(SIZE), "hard": hard})
            held, width, size, space, room = [], 0.0, 0.0, None, max(1.0, rest)

        for i, (kind, w, s) in enumerate(zip(kinds, widths, sizes, strict=True)):
            if kind == BREAK:
                end(True)
            elif kind == SPACE:
                space = i if held else None  # spaces never open a line; the last of several counts
            else:
                gap = widths[space] if space is not None else 0.0
                if held and width + gap + w > room:
                    end(False)  # and the space before goes with the break
                elif space is not None:
                    held.append(space)
                    width, size = width + gap, max(size, sizes[space])
                space = None
                held.append(i)
                width, size = width + w, max(size, s)
        if held or not lines:
            end(True)
        return lines

    return pd.Series([one(*x) for x in zip(kinds, widths, sizes, first, rest, strict=True)])


def lines(paragraphs: DataFrame, runs: DataFrame, widths: DataFrame, *keys: str, unknown: float = 0.5) -> DataFrame:
    """keys, line (from 0), text, width, size, height, left, before, after, hard of paragraphs(keys, width, indent,
    margin_left, margin_right, margin_top, margin_bottom, line_height) and their runs(keys, run, text, size, font).

    A word goes on the line while it fits with the space before it; else that space is dropped and the word opens a line. Hard
    breaks end a line, empty ones too. A line has at least one point; the indent is the first line's. Null measures are 0, a
    null line height 1.2; a paragraph without words has one empty line.
    """
    tok = measured(runs, widths, *keys, unknown=unknown)
    tok = tok.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("run", "token", "text", "kind", "width", "size"))).alias("t"))
    rows = paragraphs.join(tok, list(keys), "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    body = F.col("width").cast("double") - zero("margin_left") - zero("margin_right")
    none = F.array().cast("array<double>")
    part = lambda c, kind: F.coalesce(F.transform("t", lambda x: x[c]), none.cast(f"array<{kind}>"))
    rows = rows.withColumn("lines", F.pandas_udf(_broken, LINES)(part("kind", "int"), part("width", "double"), part("size", "double"), body - zero("indent"), body))
    rows = rows.withColumn("texts", F.transform("t", lambda x: x["text"])).withColumn("n", F.size("lines"))
    rows = rows.select("*", F.posexplode("lines").alias("line", "l"))
    text = F.array_join(F.transform("l.tokens", lambda i: F.get("texts", i)), "")
    first, last = F.col("line") == 0, F.col("line") == F.col("n") - 1
    return rows.select(
        *keys, "line", text.alias("text"), F.col("l.width").alias("width"), F.col("l.size").alias("size"), (F.col("l.size") * F.coalesce("line_height", F.lit(LEADING))).alias("height"),
        (zero("margin_left") + F.when(first, zero("indent")).otherwise(0.0)).alias("left"), F.when(first, zero("margin_top")).otherwise(0.0).alias("before"),
        F.when(last, zero("margin_bottom")).otherwise(0.0).alias("after"), F.col("l.hard").alias("hard"),
    )


def column_width(width: Column, count: Column, gap: Column, biggest: Column, page_width: Column, x: Column) -> tuple[Column, Column]:
    """F16: the width of a box's columns, and whether it had to be laid across the page for its largest type."""
    count = F.greatest(F.lit(1), F.floor(F.coalesce(count, F.lit(1))))
    own = (width - F.when(count > 1, F.coalesce(gap, F.lit(0.0))).otherwise(0.0) * (count - 1)) / count
    over = F.coalesce(own < biggest * EM, F.lit(False))
    return F.when(over, F.greatest(biggest, page_width - x - MARGIN)).otherwise(own), over


def _packed(needs: pd.Series, height: pd.Series, count: pd.Series) -> pd.Series:
    def one(needs, height, count):
        at, used, held, out = 0, 0.0, 0, []
        for need in needs:
            if held and used + need > height and at < count - 1:
                at, used, held = at + 1, 0.0, 0
            used, held = used + need, held + 1
            out.append(at)
        return out

    return pd.Series([one(*x) for x in zip(needs, height, count, strict=True)])


def columns(boxes: DataFrame, placed: DataFrame, box: str, *order: str) -> DataFrame:
    """placed lines (box, order, line, height, before, after) with the column (from 0) each stands in, in boxes(box, height,
    columns): the next one where a line would pass the height, but for the last column, which overflows."""
    need = (F.col("before") + F.col("height") + F.col("after")).alias("need")
    rows = placed.select(box, F.struct(*order, "line").alias("at"), need).groupBy(box).agg(F.array_sort(F.collect_list(F.struct("at", "need"))).alias("l"))
    rows = rows.join(boxes.select(box, F.col("height").cast("double"), F.greatest(F.lit(1), F.coalesce("columns", F.lit(1))).cast("int").alias("columns")), box)
    rows = rows.withColumn("c", F.pandas_udf(_packed, "array<int>")(F.transform("l", lambda x: x["need"]), F.col("height"), F.col("columns")))
    rows = rows.select(box, F.explode(F.arrays_zip(F.col("l").alias("l"), F.col("c").alias("c"))).alias("z"))
    return rows.select(box, "z.l.at.*", F.col("z.c").cast(IntegerType()).alias("column"))


# Turns as paragraphs of a conversation's box, each of two runs cut in the middle of its text; widths in thousandths, by rule.
def _widths(spark) -> DataFrame:
    rows = spark.range(32, 127).select(F.chr("id").alias("ch"), (200 + F.col("id") % 10 * 50).cast("double").alias("width"))
    return rows.crossJoin(spark.createDataFrame([("user", 0.0), ("other", 100.0)], "font string, more double")).select("font", "ch", (F.col("width") + F.col("more")).alias("width"))


def _turns(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations").withColumn("half", F.floor(F.length("text") / 2).cast("int"))
    font = F.when(F.col("role") == "user", "user").otherwise("other")
    parts = F.array(*[F.struct(F.lit(n).alias("run"), t.alias("text"), s.alias("size")) for n, t, s in (
        (0, F.left("text", F.col("half")), F.lit(10)), (1, F.expr("substr(text, half + 1)"), 8 + F.col("turn") % 5)
    )])
    runs = rows.select("conv_id", "turn", font.alias("font"), F.explode(parts).alias("r")).select("conv_id", "turn", "font", "r.*")
    paragraphs = rows.select(
        "conv_id", "turn", F.lit(240_000).alias("width"), (F.col("turn") % 3 * 12_000).alias("indent"), (F.col("turn") % 2 * 9_000).alias("margin_left"), F.lit(None).cast("double").alias("margin_right"),
        (F.col("turn") % 4 * 3.0).alias("margin_top"), F.lit(2.0).alias("margin_bottom"), F.lit(1.5).alias("line_height"),
    )
    return paragraphs, runs


_SQL = r"""w AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 100 END AS more, text, length(text) // 2 AS half FROM conversations),
run AS (SELECT conv_id, turn, more, 0 AS run, left(text, half) AS text, 10 AS size FROM w UNION ALL SELECT conv_id, turn, more, 1, substr(text, half + 1), 8 + turn % 5 FROM w),
cut AS (SELECT *, regexp_extract_all(regexp_replace(replace(text, chr(9), ' '), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '\r\n|[\r\n]|[ \x{A0}]+|[^ \x{A0}\r\n]+') AS t FROM run),
tok AS (SELECT conv_id, turn, more, run, size, unnest(t) AS s, unnest(range(len(t))) AS k FROM cut),
num AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY run, k) AS i, s, size, CASE WHEN regexp_matches(s, '^[\r\n]') THEN 2 WHEN regexp_matches(s, '^[ \x{A0}]') THEN 1 ELSE 0 END AS kind,
CAST(list_sum(list_transform(string_split(s, ''), lambda c: CASE WHEN unicode(c) BETWEEN 32 AND 126 THEN 200 + unicode(c) % 10 * 50 + more ELSE 500 END)) * size AS DOUBLE) AS width FROM tok),
walk AS (SELECT conv_id, turn, CAST(0 AS BIGINT) AS i, 0 AS line, false AS held, 0.0::DOUBLE AS used, CAST(NULL AS DOUBLE) AS gap, CAST(NULL AS VARCHAR) AS sp, 0::BIGINT AS spsize, CAST(NULL AS VARCHAR) AS put, 0 AS onto, 0::BIGINT AS size, false AS ended FROM conversations
UNION ALL SELECT conv_id, turn, i, CASE WHEN kind = 2 OR kind = 0 AND over THEN line + 1 ELSE line END, CASE kind WHEN 2 THEN false WHEN 1 THEN held ELSE true END,
CASE kind WHEN 2 THEN 0 WHEN 1 THEN used ELSE CASE WHEN over THEN width ELSE used + coalesce(gap, 0) + width END END, CASE WHEN kind = 1 AND held THEN width END, CASE WHEN kind = 1 AND held THEN s END, CASE WHEN kind = 1 THEN tsize ELSE 0 END,
CASE kind WHEN 0 THEN CASE WHEN over THEN s ELSE coalesce(sp, '') || s END WHEN 2 THEN '' END, CASE WHEN kind = 0 AND over THEN line + 1 ELSE line END, CASE WHEN kind = 0 THEN CASE WHEN over OR sp IS NULL THEN tsize ELSE greatest(tsize, spsize) END ELSE 0 END, kind = 2
FROM (SELECT w.conv_id, w.turn, n.i, w.line, w.held, w.used, w.gap, w.sp, w.spsize, n.s, n.kind, n.width, n.size AS tsize,
w.held AND w.used + coalesce(w.gap, 0) + n.width > greatest(1, 240000 - w.turn % 2 * 9000 - CASE WHEN w.line = 0 THEN w.turn % 3 * 12000 ELSE 0 END) AS over FROM walk w JOIN num n ON n.conv_id = w.conv_id AND n.turn = w.turn AND n.i = w.i + 1)),
put AS (SELECT conv_id, turn, onto AS line, string_agg(put, '' ORDER BY i) AS text, max(size) AS size FROM walk WHERE put IS NOT NULL GROUP BY ALL),
every AS (SELECT conv_id, turn, line, text, size FROM put UNION ALL SELECT conv_id, turn, 0, '', 0 FROM conversations c WHERE NOT EXISTS (FROM put p WHERE p.conv_id = c.conv_id AND p.turn = c.turn)),
lines AS (SELECT *, CASE WHEN size = 0 THEN 12 ELSE size END * 1.5 AS height, CASE WHEN line = 0 THEN turn % 4 * 3.0 ELSE 0 END AS before, CASE WHEN line = max(line) OVER (PARTITION BY conv_id, turn) THEN 2.0 ELSE 0 END AS after FROM every)"""


@query(f"WITH RECURSIVE {_SQL} SELECT conv_id, turn, line, text, CAST(height AS DOUBLE) AS height, CAST(before AS DOUBLE) AS before, CAST(after AS DOUBLE) AS after FROM lines")
def f14_measured_lines(spark, sf_dir):
    """F14 with character widths, two runs, hard breaks and indents: the lines of every turn."""
    out = lines(*_turns(spark, sf_dir), _widths(spark), "conv_id", "turn", unknown=500.0)
    return out.select("conv_id", "turn", "line", "text", "height", "before", "after")


@query(f"""WITH RECURSIVE {_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) AS k, CAST(before + height + after AS DOUBLE) AS need FROM lines),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS c, 0.0::DOUBLE AS used, CAST(NULL AS BIGINT) AS turn, 0 AS line FROM o GROUP BY conv_id UNION ALL
SELECT o.conv_id, o.k, CASE WHEN p.used > 0 AND p.used + o.need > 150 AND p.c < 2 THEN p.c + 1 ELSE p.c END, CASE WHEN p.used > 0 AND p.used + o.need > 150 AND p.c < 2 THEN o.need ELSE p.used + o.need END, o.turn, o.line
FROM p JOIN o ON o.conv_id = p.conv_id AND o.k = p.k + 1)
SELECT conv_id, turn, line, c AS column FROM p WHERE k > 0""".replace("AS column", 'AS "column"'))
def f15_line_columns(spark, sf_dir):
    """F15 on those lines: three columns of 150 points for each conversation."""
    out = lines(*_turns(spark, sf_dir), _widths(spark), "conv_id", "turn", unknown=500.0)
    boxes = out.select("conv_id").distinct().select("conv_id", F.lit(150).alias("height"), F.lit(3).alias("columns"))
    return columns(boxes, out, "conv_id", "turn")
