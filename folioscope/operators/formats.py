"""Formats from an event's open properties: runs, paragraphs, drawing styles with their warnings, path commands.

Every function takes the name of a column that holds properties as map<string, variant>, as `opened_map` makes it of a VARIANT.
A property is a text, a measure {v, u} or a list of property maps; what has another shape counts as absent, and absent is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.scalars import to_degrees, to_fraction, to_int, to_multiplier, to_points
from folioscope.plans.catalog import query, spread, table

# Enumerations, colours of what brings none, picture types that no target shows.
ALIGN = {"left": "left", "start": "left", "right": "right", "end": "right", "center": "center", "justify": "justify"}
REPEAT = {"repeat": "repeat", "no-repeat": "none", "none": "none"}
BLACK, GREY, WHITE = "#000000", "#808080", "#ffffff"
METAFILES = ("image/wmf", "image/x-wmf", "image/emf", "image/x-emf")


def opened_map(p: str) -> Column:
    return F.try_variant_get(p, "$", "map<string,variant>")


def text(m: Column, key: str) -> Column:
    """A text property; an empty one is absent."""
    v = F.try_element_at(m, F.lit(key))
    return F.nullif(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")), F.lit(""))


def number(m: Column, key: str) -> Column:
    return F.try_variant_get(F.try_element_at(m, F.lit(key)), "$.v", "double")


def points(m: Column, key: str) -> Column:
    """A length in points, rounded to thousandths."""
    return r3(to_points(number(m, key), F.try_variant_get(F.try_element_at(m, F.lit(key)), "$.u", "string")))


def vector(m: Column, key: str) -> Column:
    """A list property as maps; none is an empty list."""
    maps = F.try_variant_get(F.try_element_at(m, F.lit(key)), "$", "array<map<string,variant>>")
    return F.coalesce(maps, F.array().cast("array<map<string,variant>>"))


def r3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000 + 0.0


def r2(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100 + 0.0


def chosen(value: Column, of: dict[str, str], other: str | None = None) -> Column:
    out = F.lit(other)
    for k, v in of.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def run_format(p: str) -> Column:
    """The sixteen keys of a run; flags are true or absent."""
    m = F.col(p)
    flag = lambda c: F.when(c, True)
    lined = lambda k: flag((text(m, k) != "none"))
    size, scale = r2(points_raw(m, "fo:font-size")), r2(number(m, "fo:text-scale"))
    shift = F.regexp_extract(text(m, "style:text-position"), r"^\s*([-+]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double")
    relief, lang = text(m, "style:font-relief"), text(m, "fo:language")
    parts = {
        "font": text(m, "style:font-name"), "size": F.when(size > 0, size), "bold": flag(text(m, "fo:font-weight") == "bold"), "italic": flag(text(m, "fo:font-style") == "italic"),
        "underline": lined("style:text-underline-style"), "strike": lined("style:text-line-through-style"), "small_caps": flag(text(m, "fo:font-variant") == "small-caps"),
        "all_caps": flag(text(m, "fo:text-transform") == "uppercase"), "color": text(m, "fo:color"), "baseline_shift": F.when(shift != 0, shift),
        "link": text(m, "xlink:href"), "lang": F.when(lang.isNotNull(), F.concat_ws("-", lang, text(m, "fo:country"))), "outline": flag(text(m, "style:text-outline") == "true"),
        "relief": F.when(relief.isin("embossed", "engraved"), relief), "text_shadow": flag(text(m, "fo:text-shadow").isNotNull()), "text_scale": F.when((scale > 0) & (scale != 100), scale),
    }
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def points_raw(m: Column, key: str) -> Column:
    return to_points(number(m, key), F.try_variant_get(F.try_element_at(m, F.lit(key)), "$.u", "string"))


def paragraph(p: str, list_type: Column, list_level: Column) -> Column:
    """Alignment, leading, five spacings (0 is absent) and the list a paragraph is in."""
    m = F.col(p)
    spacing = {k: F.nullif(points(m, f"fo:{v}"), F.lit(0.0)) for k, v in (
        ("margin_top", "margin-top"), ("margin_bottom", "margin-bottom"), ("margin_left", "margin-left"), ("margin_right", "margin-right"), ("text_indent", "text-indent"),
    )}
    listed = F.when(list_type.isNotNull(), F.struct(list_type.alias("type"), list_level.alias("level")))
    parts = {"align": chosen(text(m, "fo:text-align"), ALIGN), "line_height": r3(to_multiplier(number(m, "fo:line-height"))), **spacing, "list": listed}
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def stops(p: str) -> Column:
    """A gradient's stops with a colour; the first without an offset is at 0, later ones at 1; opacity 1 is absent."""
    held = F.filter(vector(F.col(p), "svg:linearGradient"), lambda s: text(s, "svg:stop-color").isNotNull())

    def stop(s: Column, i: Column) -> Column:
        opacity = to_fraction(number(s, "svg:stop-opacity"))
        offset = F.coalesce(to_fraction(number(s, "svg:offset")), F.when(i == 0, 0.0).otherwise(1.0))
        return F.struct(r3(offset).alias("offset"), text(s, "svg:stop-color").alias("color"), F.when(opacity < 1, opacity).alias("opacity"))

    return F.transform(held, stop)


def style(rows: DataFrame, p: str) -> DataFrame:
    """``rows`` with ``style`` (fill, stroke, shadow, opacity; null if it has none of them) and ``warnings``, codes of what
    was lost: GRADIENT_FLATTENED (fewer than two stops: a flat colour), WMF_IMAGE_NOT_CONVERTED, SHADOW_DROPPED."""
    m, here = F.col(p), F.col
    texts = ("draw:fill", "draw:fill-color", "draw:fill-image", "librevenge:mime-type", "draw:stroke", "svg:stroke-color", "style:repeat", "draw:shadow", "draw:shadow-color")
    lengths = ("draw:distance", "draw:dots1-length", "draw:dots2-length", "svg:stroke-width", "draw:shadow-offset-x", "draw:shadow-offset-y")
    numbers = ("draw:angle", "draw:dots1", "draw:dots2", "draw:shadow-opacity", "draw:opacity")
    # Each property is read once, into a column of its own; all rules go by these.
    raw = {k: text(m, k) for k in texts} | {k: points(m, k) for k in lengths} | {k: number(m, k) for k in numbers}
    kept = [here(f"`{c}`") for c in rows.columns]
    rows = rows.select(*kept, F.struct(*[v.alias(k) for k, v in raw.items()]).alias("_p"), stops(p).alias("_stops"))
    get = lambda k: here(f"_p.`{k}`")
    kind, held, image, color = get("draw:fill"), here("_stops"), get("draw:fill-image"), get("draw:fill-color")
    flat = (kind == "gradient") & (F.size(held) < 2)
    wmf = (kind == "bitmap") & image.isNotNull() & F.coalesce(get("librevenge:mime-type").isin(*METAFILES), F.lit(False))
    line, seen, shade = get("draw:stroke"), get("draw:shadow") == "visible", get("draw:shadow-color")
    dx, dy = get("draw:shadow-offset-x"), get("draw:shadow-offset-y")
    bare = seen & shade.isNull() & dx.isNull() & dy.isNull()
    warned = F.array_compact(F.array(F.when(flat, "GRADIENT_FLATTENED"), F.when(wmf, "WMF_IMAGE_NOT_CONVERTED"), F.when(bare, "SHADOW_DROPPED")))
    shape = F.when(flat, "solid").when(kind == "bitmap", F.when(image.isNotNull() & ~wmf, "image")).when(kind.isin("none", "solid", "gradient"), kind)
    rows = rows.select(*kept, "_p", "_stops", warned.alias("warnings"), shape.alias("_shape"), bare.alias("_bare"))
    shape, bare = here("_shape"), F.coalesce(here("_bare"), F.lit(False))
    plain = F.when(kind == "gradient", F.coalesce(color, F.get(held, F.lit(0))["color"], F.lit(WHITE))).otherwise(F.coalesce(color, F.lit(BLACK)))
    fill = F.when(shape.isNotNull(), F.struct(
        shape.alias("type"), F.when(shape == "solid", plain).alias("color"), F.when(shape == "gradient", r3(F.coalesce(get("draw:angle"), F.lit(0.0)))).alias("angle"),
        F.when(shape == "gradient", held).alias("stops"), F.when(shape == "image", F.sha2(image, 256)).alias("asset"),
        F.when(shape == "image", chosen(get("style:repeat"), REPEAT, "stretch")).alias("repeat"),
    ))

    def dots(n: int) -> Column:
        count, length = F.coalesce(to_int(get(f"draw:dots{n}")), F.lit(0)).cast("int"), get(f"draw:dots{n}-length")
        each = F.array(length, F.coalesce(get("draw:distance"), F.lit(0.0)))
        return F.when((count > 0) & length.isNotNull(), F.flatten(F.array_repeat(each, count))).otherwise(F.array().cast("array<double>"))

    dash = F.concat(dots(1), dots(2))
    stroke = F.when(line != "none", F.struct(
        F.coalesce(get("svg:stroke-color"), F.lit(BLACK)).alias("color"), F.coalesce(get("svg:stroke-width"), F.lit(1.0)).alias("width"),
        F.when(line == "dash", F.nullif(dash, F.array().cast("array<double>"))).alias("dash"),
    ))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    shadow = F.when(seen & ~bare, F.struct(
        F.coalesce(shade, F.lit(GREY)).alias("color"), zero(dx).alias("dx"), zero(dy).alias("dy"), F.coalesce(to_fraction(get("draw:shadow-opacity")), F.lit(1.0)).alias("opacity")
    ))
    opacity = to_fraction(get("draw:opacity"))
    rows = rows.select(*kept, "warnings", F.struct(fill.alias("fill"), stroke.alias("stroke"), shadow.alias("shadow"), F.when(opacity < 1, opacity).alias("opacity")).alias("style"))
    some = here("style.fill").isNotNull() | here("style.stroke").isNotNull() | here("style.shadow").isNotNull() | here("style.opacity").isNotNull()
    return rows.withColumn("style", F.when(some, here("style")))


def path_commands(p: str) -> Column:
    """The complete commands of a path property; C wants both control points, Q one, A its radii, whose flags are 1 by default."""

    def one(c: Column) -> Column:
        op = text(c, "librevenge:path-action")
        at = {k: points(c, f"svg:{k}") for k in ("x", "y", "x1", "y1", "x2", "y2", "rx", "ry")}
        wants = {"M": "x y", "L": "x y", "C": "x y x1 y1 x2 y2", "Q": "x y x1 y1", "A": "x y rx ry"}
        whole = op == "Z"
        for name, keys in wants.items():
            held = op == name
            for k in keys.split():
                held = held & at[k].isNotNull()
            whole = whole | held
        arc = op == "A"
        uses = lambda k: op.isin(*[n for n, keys in wants.items() if k in keys.split()])
        flag = lambda k: F.when(arc, F.coalesce(to_int(number(c, f"librevenge:{k}")), F.lit(1)) != 0)
        turn = F.when(arc, r3(F.coalesce(to_degrees(number(c, "librevenge:rotate")), F.lit(0.0))))
        return F.when(F.coalesce(whole, F.lit(False)), F.struct(
            op.alias("op"), *[F.when(uses(k), v).alias(k) for k, v in at.items()], turn.alias("rotation"), flag("large-arc").alias("large_arc"), flag("sweep").alias("sweep")
        ))

    return F.array_compact(F.transform(vector(F.col(p), "svg:d"), one))


# Properties of every part, from its own numbers: some keys missing, some of the wrong shape, some without effect.
_K, _Z = "p_partkey", "p_size"
_PARTS = (
    (f"{_K} % 2 = 0", f"""concat('"style:font-name":"', p_brand, '"')"""), (f"{_K} % 3 <> 0", f"""concat('"fo:font-size":{{"u":"', CASE {_K} % 4 WHEN 0 THEN 'pt' WHEN 1 THEN '' WHEN 2 THEN '%' ELSE 'twip' END, '","v":', {_Z} % 10, '.5}}')"""),
    (f"{_K} % 5 < 3", f"""concat('"fo:font-weight":"', CASE WHEN {_K} % 5 = 0 THEN 'bold' ELSE 'normal' END, '"')"""), (f"{_K} % 7 = 1", """'"fo:font-style":"italic"'"""),
    (f"{_K} % 6 < 2", f"""concat('"style:text-underline-style":"', CASE WHEN {_K} % 6 = 0 THEN 'none' ELSE 'solid' END, '"')"""), (f"{_K} % 11 = 0", """'"style:text-line-through-style":"double"'"""),
    (f"{_K} % 13 = 0", """'"fo:font-variant":"small-caps"'"""), (f"{_K} % 13 = 1", """'"fo:text-transform":"uppercase"'"""), (f"{_K} % 4 = 1", f"""concat('"fo:color":"#', lpad(CAST({_Z} AS VARCHAR(9)), 6, '0'), '"')"""),
    (f"{_K} % 5 = 1", f"""concat('"style:text-position":"', CASE {_K} % 3 WHEN 0 THEN '-33.5% 58%' WHEN 1 THEN '0% 100%' ELSE 'super' END, '"')"""), (f"{_K} % 9 = 0", """'"style:text-outline":"true"'"""),
    (f"{_K} % 9 = 1", """'"fo:text-shadow":"1pt"'"""), (f"{_K} % 9 < 4", f"""concat('"style:font-relief":"', CASE {_K} % 9 WHEN 0 THEN 'embossed' WHEN 1 THEN 'engraved' ELSE 'none' END, '"')"""),
    (f"{_K} % 8 < 3", f"""concat('"fo:text-scale":{{"u":"%","v":', CASE {_K} % 8 WHEN 0 THEN 100 WHEN 1 THEN 80 ELSE -5 END, '}}')"""), (f"{_K} % 10 = 0", f"""concat('"xlink:href":"p', {_K}, '"')"""),
    (f"{_K} % 3 = 0", """'"fo:language":"en"'"""), (f"{_K} % 6 = 3", """'"fo:country":"GB"'"""),
    (f"{_K} % 7 < 6", f"""concat('"fo:text-align":"', CASE {_K} % 7 WHEN 0 THEN 'start' WHEN 1 THEN 'end' WHEN 2 THEN 'center' WHEN 3 THEN 'justify' WHEN 4 THEN 'right' ELSE 'odd' END, '"')"""),
    (f"{_K} % 4 < 3", f"""concat('"fo:line-height":{{"u":"%","v":', CASE {_K} % 4 WHEN 0 THEN '1.15' WHEN 1 THEN '120' ELSE '0' END, '}}')"""),
    (f"{_K} % 5 <> 4", f"""concat('"fo:margin-top":{{"u":"in","v":', {_Z} % 3, '}},"fo:margin-left":{{"u":"twip","v":-', {_Z}, '}},"fo:text-indent":{{"u":"pt","v":', {_Z} % 4, '.25}},"fo:margin-right":"5","fo:margin-bottom":{{"u":"%","v":3}}')"""),
    (f"{_K} % 6 < 5", f"""concat('"draw:fill":"', CASE {_K} % 6 WHEN 0 THEN 'none' WHEN 1 THEN 'solid' WHEN 2 THEN 'bitmap' WHEN 3 THEN 'gradient' ELSE 'gradient' END, '"')"""), (f"{_K} % 12 < 5", f"""concat('"draw:fill-color":"#c', {_K} % 12, '"')"""),
    (f"{_K} % 7 <> 0", f"""concat('"svg:linearGradient":[{{"svg:offset":{{"u":"%","v":', CASE {_K} % 3 WHEN 0 THEN '-1' ELSE '0.25' END, '}},"svg:stop-color":"#a', {_K} % 5, '"}},{{"svg:offset":{{"u":"%","v":0.5}}}}', CASE WHEN {_K} % 3 > 0 THEN ',{{"svg:stop-color":"#b","svg:stop-opacity":{{"u":"%","v":0.5}}}}' ELSE '' END, ']')"""),
    (f"{_K} % 2 = 1", f"""concat('"draw:angle":{{"u":"in","v":-', {_Z}, '}}')"""), (f"{_K} % 4 <> 0", f"""concat('"draw:fill-image":"d', {_Z}, '","librevenge:mime-type":"', CASE {_K} % 5 WHEN 0 THEN 'image/wmf' ELSE 'image/png' END, '"')"""), (f"{_K} % 3 = 1", f"""concat('"style:repeat":"', CASE {_K} % 2 WHEN 0 THEN 'no-repeat' ELSE 'repeat' END, '"')"""),
    (f"{_K} % 5 > 0", f"""concat('"draw:stroke":"', CASE {_K} % 5 WHEN 1 THEN 'none' WHEN 2 THEN 'solid' ELSE 'dash' END, '"')"""), (f"{_K} % 3 = 2", f"""concat('"svg:stroke-color":"#d', {_Z}, '","svg:stroke-width":{{"u":"in","v":0.0', {_Z} % 9, '}}')"""),
    (f"{_K} % 4 = 3", f"""concat('"draw:dots1":{{"u":"","v":', {_K} % 3, '}},"draw:dots1-length":{{"u":"pt","v":2}},"draw:distance":{{"u":"pt","v":1.5}},"draw:dots2":{{"u":"","v":1}}', CASE WHEN {_K} % 8 = 3 THEN ',"draw:dots2-length":{{"u":"twip","v":7}}' ELSE '' END)"""),
    (f"{_K} % 3 = 0", f"""concat('"draw:shadow":"', CASE {_K} % 9 WHEN 0 THEN 'hidden' ELSE 'visible' END, '"', CASE {_K} % 4 WHEN 0 THEN '' WHEN 1 THEN ',"draw:shadow-color":"#e"' ELSE ',"draw:shadow-offset-x":{{"u":"pt","v":3}},"draw:shadow-opacity":{{"u":"%","v":0.25}}' END)"""),
    (f"{_K} % 5 < 2", f"""concat('"draw:opacity":{{"u":"%","v":', {_K} % 5, '}}')"""),
    (f"{_K} % 2 = 0", f"""concat('"svg:d":[{{"librevenge:path-action":"M","svg:x":{{"u":"in","v":', {_Z}, '}},"svg:y":{{"u":"pt","v":1}}}},{{"librevenge:path-action":"L","svg:x":{{"u":"%","v":1}},"svg:y":{{"u":"pt","v":1}}}},{{"librevenge:path-action":"C","svg:x":{{"u":"pt","v":1}},"svg:y":{{"u":"pt","v":2}},"svg:x1":{{"u":"pt","v":3}},"svg:y1":{{"u":"pt","v":4}}', CASE WHEN {_K} % 4 = 0 THEN ',"svg:x2":{{"u":"pt","v":5}},"svg:y2":{{"u":"pt","v":6}}' ELSE '' END, '}},{{"librevenge:path-action":"A","svg:x":{{"u":"pt","v":1}},"svg:y":{{"u":"pt","v":2}},"svg:rx":{{"u":"pt","v":3}}', CASE WHEN {_K} % 6 = 0 THEN ',"svg:ry":{{"u":"pt","v":4}},"librevenge:sweep":{{"u":"","v":0}}' ELSE '' END, '}},{{"librevenge:path-action":"Q","svg:x":{{"u":"pt","v":1}},"svg:y":{{"u":"pt","v":2}},"svg:x1":{{"u":"pt","v":3}},"svg:y1":{{"u":"pt","v":', {_Z}, '.1234}}}},{{"librevenge:path-action":"B","svg:x":{{"u":"pt","v":1}},"svg:y":{{"u":"pt","v":2}}}},{{"librevenge:path-action":"Z"}}]')"""),
)
_JSON = "concat('{', concat_ws(',', " + ", ".join(f"CASE WHEN {when} THEN {part} END" for when, part in _PARTS) + "), '}')"


def _formats(spark, sf_dir) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand")
    rows = spread(parts, parts.count(), 5_000, "p_partkey").select("p_partkey", F.try_parse_json(F.expr(_JSON)).alias("p"))
    return rows.select("p_partkey", opened_map("p").alias("m"))


_J = f"j AS (SELECT p_partkey, CAST({_JSON} AS JSON) AS p FROM part)"


def _t(key: str, of: str = "p") -> str:
    """SQL for a text property."""
    return f"""CASE WHEN json_type({of}, '$."{key}"') = 'VARCHAR' THEN nullif(json_extract_string({of}, '$."{key}"'), '') END"""


def _v(key: str, of: str = "p") -> str:
    return f"""TRY_CAST(json_extract_string({of}, '$."{key}".v') AS DOUBLE)"""


def _pt(key: str, of: str = "p") -> str:
    return f"""CASE json_extract_string({of}, '$."{key}".u') WHEN 'pt' THEN {_v(key, of)} WHEN 'twip' THEN {_v(key, of)} / 20 WHEN 'in' THEN {_v(key, of)} * 72 WHEN '' THEN {_v(key, of)} * 72 END"""


def _r(x: str, k: int = 1000) -> str:
    return f"floor(({x}) * {k} + 0.5) / {k}"


_ONE = lambda c: f"CASE WHEN {c} THEN true END"


@query(f"""WITH {_J} SELECT p_partkey, {_t("style:font-name")} AS font, CASE WHEN {_r(_pt("fo:font-size"), 100)} > 0 THEN {_r(_pt("fo:font-size"), 100)} END AS size, {_ONE(_t("fo:font-weight") + " = 'bold'")} AS bold, {_ONE(_t("fo:font-style") + " = 'italic'")} AS italic,
{_ONE(_t("style:text-underline-style") + " <> 'none'")} AS underline, {_ONE(_t("style:text-line-through-style") + " <> 'none'")} AS strike, {_ONE(_t("fo:font-variant") + " = 'small-caps'")} AS small_caps, {_ONE(_t("fo:text-transform") + " = 'uppercase'")} AS all_caps,
{_t("fo:color")} AS color, nullif(TRY_CAST(regexp_extract({_t("style:text-position")}, '^[-+]?[0-9.]+') AS DOUBLE), 0) AS baseline_shift, {_t("xlink:href")} AS link, {_t("fo:language")} || coalesce('-' || {_t("fo:country")}, '') AS lang,
{_ONE(_t("style:text-outline") + " = 'true'")} AS outline, CASE WHEN {_t("style:font-relief")} IN ('embossed', 'engraved') THEN {_t("style:font-relief")} END AS relief, {_ONE(_t("fo:text-shadow") + " IS NOT NULL")} AS text_shadow,
CASE WHEN {_v("fo:text-scale")} > 0 AND {_v("fo:text-scale")} <> 100 THEN {_v("fo:text-scale")} END AS text_scale FROM j""")
def b8_run_formats(spark, sf_dir):
    """B8 with all sixteen keys."""
    return _formats(spark, sf_dir).select("p_partkey", run_format("m").alias("f")).select("p_partkey", "f.*")


_SPACE = lambda k: f"nullif({_r(_pt('fo:' + k))}, 0)"


@query(f"""WITH {_J} SELECT p_partkey, CASE {_t("fo:text-align")} {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ALIGN.items())} END AS align,
CASE WHEN {_v("fo:line-height")} > 10 THEN {_r(_v("fo:line-height") + " / 100")} WHEN {_v("fo:line-height")} > 0 THEN {_r(_v("fo:line-height"))} END AS line_height, {_SPACE("margin-top")} AS margin_top, {_SPACE("margin-bottom")} AS margin_bottom,
{_SPACE("margin-left")} AS margin_left, {_SPACE("margin-right")} AS margin_right, {_SPACE("text-indent")} AS text_indent, CASE WHEN p_partkey % 3 = 0 THEN 'ordered' || p_partkey % 5 END AS list FROM j""")
def b7_paragraph_formats(spark, sf_dir):
    """B7 with all five spacings and the list."""
    k = F.col("p_partkey")
    rows = _formats(spark, sf_dir).select("p_partkey", paragraph("m", F.when(k % 3 == 0, "ordered"), (k % 5).cast("int")).alias("f"))
    return rows.select("p_partkey", *[f"f.{c}" for c in ("align", "line_height", "margin_top", "margin_bottom", "margin_left", "margin_right", "text_indent")], F.concat("f.list.type", F.col("f.list.level").cast("string")).alias("list"))


_FRAC = lambda x: f"CASE WHEN {x} < 0 THEN 0 WHEN {x} > 1 THEN 1 ELSE {x} END"
_DOTS = lambda n: f"""CASE WHEN coalesce({_v(f"draw:dots{n}")}, 0) > 0 AND ({_pt(f"draw:dots{n}-length")}) IS NOT NULL THEN repeat({_r(_pt(f"draw:dots{n}-length"))} || ',' || {_r("coalesce(" + _pt("draw:distance") + ", 0)")} || ',', CAST({_v(f"draw:dots{n}")} AS INT)) ELSE '' END"""


@query(f"""WITH {_J}, s AS (SELECT p_partkey, unnest(json_extract(p, '$."svg:linearGradient"[*]')) AS s, unnest(range(CAST(json_array_length(p, '$."svg:linearGradient"') AS BIGINT))) AS i FROM j),
n AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS i, {_t("svg:stop-color", "s")} AS color, {_FRAC(_v("svg:offset", "s"))} AS off_, {_FRAC(_v("svg:stop-opacity", "s"))} AS o FROM s WHERE {_t("svg:stop-color", "s")} IS NOT NULL),
g AS (SELECT p_partkey, count(*) AS n, arg_min(color, i) AS lead_, string_agg({_r("coalesce(off_, CASE WHEN i = 1 THEN 0 ELSE 1 END)")} || color || coalesce('@' || CASE WHEN o < 1 THEN o END, ''), '>' ORDER BY i) AS stops FROM n GROUP BY p_partkey),
x AS (SELECT j.*, coalesce(n, 0) AS n, lead_, stops, {_t("draw:fill")} AS fill, {_t("draw:stroke")} AS line, {_t("draw:fill-image")} AS image, coalesce({_t("librevenge:mime-type")}, '') AS mime, {_t("draw:shadow")} = 'visible' AS seen,
{_r(_pt("draw:shadow-offset-x"))} AS dx, {_r(_pt("draw:shadow-offset-y"))} AS dy, {_t("draw:shadow-color")} AS shade FROM j LEFT JOIN g USING (p_partkey)),
r AS (SELECT p_partkey, CASE fill WHEN 'none' THEN 'none' WHEN 'solid' THEN 'solid ' || coalesce({_t("draw:fill-color")}, '{BLACK}') WHEN 'gradient' THEN CASE WHEN n < 2 THEN 'solid ' || coalesce({_t("draw:fill-color")}, lead_, '{WHITE}') ELSE 'gradient ' || {_r("coalesce(" + _v("draw:angle") + ", 0)")} || ' ' || stops END
WHEN 'bitmap' THEN CASE WHEN image IS NOT NULL AND mime NOT IN {METAFILES} THEN 'image ' || sha256(image) || ' ' || CASE {_t("style:repeat")} WHEN 'repeat' THEN 'repeat' WHEN 'no-repeat' THEN 'none' WHEN 'none' THEN 'none' ELSE 'stretch' END END END AS fill,
CASE WHEN line <> 'none' THEN coalesce({_t("svg:stroke-color")}, '{BLACK}') || ' ' || {_r("coalesce(" + _pt("svg:stroke-width") + ", 1)")} || CASE WHEN line = 'dash' THEN ' ' || {_DOTS(1)} || {_DOTS(2)} ELSE ' ' END END AS stroke,
CASE WHEN seen AND coalesce(shade, CAST(dx AS VARCHAR), CAST(dy AS VARCHAR)) IS NOT NULL THEN coalesce(shade, '{GREY}') || ' ' || coalesce(dx, 0) || ' ' || coalesce(dy, 0) || ' ' || coalesce({_FRAC(_v("draw:shadow-opacity"))}, 1) END AS shadow,
CASE WHEN {_FRAC(_v("draw:opacity"))} < 1 THEN {_FRAC(_v("draw:opacity"))} END AS opacity,
concat_ws(',', CASE WHEN fill = 'gradient' AND n < 2 THEN 'GRADIENT_FLATTENED' END, CASE WHEN fill = 'bitmap' AND image IS NOT NULL AND mime IN {METAFILES} THEN 'WMF_IMAGE_NOT_CONVERTED' END,
CASE WHEN seen AND shade IS NULL AND dx IS NULL AND dy IS NULL THEN 'SHADOW_DROPPED' END) AS warnings FROM x)
SELECT p_partkey, fill, stroke, shadow, CAST(opacity AS DOUBLE) AS opacity, coalesce(fill, stroke, shadow, CAST(opacity AS VARCHAR)) IS NOT NULL AS styled, warnings FROM r""")
def b5_styles(spark, sf_dir):
    """B5, B6, C15's model rules: fills of all four kinds, strokes with dashes, shadows, opacity, and what was lost."""
    rows = style(_formats(spark, sf_dir), "m")
    s = lambda k: F.col(f"style.{k}")
    say = lambda *parts: F.when(parts[0].isNotNull(), F.concat_ws(" ", *[x.cast("string") for x in parts]))
    stop = lambda x: F.concat(x["offset"].cast("string"), x["color"], F.coalesce(F.concat(F.lit("@"), x["opacity"].cast("string")), F.lit("")))
    dashes = F.coalesce(F.array_join(F.transform(s("stroke.dash"), lambda x: F.concat(x.cast("string"), F.lit(","))), ""), F.lit(""))
    return rows.select(
        "p_partkey", say(s("fill.type"), s("fill.color"), s("fill.angle"), F.array_join(F.transform(s("fill.stops"), stop), ">"), s("fill.asset"), s("fill.repeat")).alias("fill"),
        say(s("stroke.color"), s("stroke.width"), dashes).alias("stroke"), say(s("shadow.color"), s("shadow.dx"), s("shadow.dy"), s("shadow.opacity")).alias("shadow"),
        s("opacity").alias("opacity"), F.col("style").isNotNull().alias("styled"), F.array_join("warnings", ",").alias("warnings"),
    )


_AT = {k: _r(_pt(f"svg:{k}", "c")) for k in ("x", "y", "x1", "y1", "x2", "y2", "rx", "ry")}
_WANT = lambda keys: " AND ".join(f"{_AT[k]} IS NOT NULL" for k in keys.split())


@query(f"""WITH {_J}, c AS (SELECT p_partkey, unnest(json_extract(p, '$."svg:d"[*]')) AS c, unnest(range(CAST(json_array_length(p, '$."svg:d"') AS BIGINT))) AS i FROM j),
o AS (SELECT p_partkey, i, {_t("librevenge:path-action", "c")} AS op, c FROM c),
k AS (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS pos, op, c FROM o WHERE op = 'Z' OR op IN ('M', 'L') AND {_WANT("x y")} OR op = 'C' AND {_WANT("x y x1 y1 x2 y2")} OR op = 'Q' AND {_WANT("x y x1 y1")} OR op = 'A' AND {_WANT("x y rx ry")})
SELECT p_partkey, CAST(pos AS INT) AS pos, op, CASE WHEN op <> 'Z' THEN {_AT["x"]} END AS x, CASE WHEN op <> 'Z' THEN {_AT["y"]} END AS y, CASE WHEN op IN ('C', 'Q') THEN {_AT["x1"]} END AS x1, CASE WHEN op IN ('C', 'Q') THEN {_AT["y1"]} END AS y1,
CASE WHEN op = 'C' THEN {_AT["x2"]} END AS x2, CASE WHEN op = 'C' THEN {_AT["y2"]} END AS y2, CASE WHEN op = 'A' THEN {_AT["rx"]} END AS rx, CASE WHEN op = 'A' THEN {_AT["ry"]} END AS ry, CASE WHEN op = 'A' THEN coalesce({_v("librevenge:rotate", "c")}, 0) END AS rotation,
CASE WHEN op = 'A' THEN coalesce({_v("librevenge:large-arc", "c")}, 1) <> 0 END AS large_arc, CASE WHEN op = 'A' THEN coalesce({_v("librevenge:sweep", "c")}, 1) <> 0 END AS sweep FROM k""")
def b4_path_commands(spark, sf_dir):
    """B4 with all six commands."""
    return _formats(spark, sf_dir).select("p_partkey", F.posexplode(path_commands("m")).alias("pos", "c")).select("p_partkey", "pos", "c.*")
