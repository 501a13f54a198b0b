"""Markup, path texts, transforms, signatures and their comparison on hand-worked drawings."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from folioscope.operators import drawings
from folioscope.sources import markup


@pytest.fixture(scope="module")
def spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()


def steps(spark, *paths):
    rows = drawings.path_steps(spark.createDataFrame(list(enumerate(paths)), "id int, d string"), "id").orderBy("id", "step").collect()
    return [[(r["command"], [(round(p["x"], 9), round(p["y"], 9)) for p in r["points"]]) for r in rows if r["id"] == i] for i in range(len(paths))]


def test_all_commands_in_both_cases(spark):
    up, low = steps(
        spark, "M1 2L3 4H5V6C1 2 3 4 5 6S1 2 3 4Q1 2 3 4T7 8A1 1 0 0 1 9 9Z", "m1 2l3 4h5v6c1 2 3 4 5 6s1 2 3 4q1 2 3 4t7 8a1 1 0 0 1 9 9z"
    )
    assert up == [
        ("M", [(1, 2)]), ("L", [(3, 4)]), ("H", [(5, 4)]), ("V", [(5, 6)]), ("C", [(1, 2), (3, 4), (5, 6)]), ("S", [(1, 2), (3, 4)]), ("Q", [(1, 2), (3, 4)]),
        ("T", [(7, 8)]), ("A", [(9, 9)]), ("Z", []),
    ]
    assert low == [
        ("M", [(1, 2)]), ("L", [(4, 6)]), ("H", [(9, 6)]), ("V", [(9, 12)]), ("C", [(10, 14), (12, 16), (14, 18)]), ("S", [(15, 20), (17, 22)]),
        ("Q", [(18, 24), (20, 26)]), ("T", [(27, 34)]), ("A", [(36, 43)]), ("Z", []),
    ]


def test_repeats_subpaths_and_odd_numbers(spark):
    got = steps(
        spark, "M0 0 10 10-5.5.5", "M1 1l2 0zm1 1h1zl3 3", "m5 5zm1 0 1 0zm.5-1e1z", "M1 2 3", "L9 9", "", None, "12 34 M1 1", "M0 0C1 2 3 4 5 L9 9", "M1,1,Z5 6L2 2"
    )
    assert got[0] == [("M", [(0, 0)]), ("L", [(10, 10)]), ("L", [(-5.5, 0.5)])]
    assert got[1] == [("M", [(1, 1)]), ("L", [(3, 1)]), ("Z", []), ("M", [(2, 2)]), ("H", [(3, 2)]), ("Z", []), ("L", [(5, 5)])]
    assert got[2] == [("M", [(5, 5)]), ("Z", []), ("M", [(6, 5)]), ("L", [(7, 5)]), ("Z", []), ("M", [(6.5, -5)]), ("Z", [])]
    assert got[3] == [("M", [(1, 2)]), ("L", [])]
    assert got[4:8] == [[("L", [(9, 9)])], [], [], [("M", [(1, 1)])]]
    assert got[8] == [("M", [(0, 0)]), ("C", [])]  # short: counted, and the path ends there
    assert got[9] == [("M", [(1, 1)]), ("Z", []), ("L", [(2, 2)])]


def test_long_path_is_linear(spark):
    (got,) = steps(spark, "m1 1" + "l1 0 0 1" * 20_000 + "z" + "h1" * 3)
    assert len(got) == 40_005 and got[40_000] == ("L", [(20_001, 20_001)]) and got[-1] == ("H", [(4, 1)])


def ctm(spark, text):
    """The matrices of the elements of a drawing, by position."""
    opens = drawings.opened(spark.createDataFrame([(1, text)], "id int, svg string"), "id", "svg").filter("not closing")
    opens = opens.select("id", "pos", "alone", "depth", markup.attribute("attrs", "transform").alias("transform"))
    return {r["pos"]: tuple(r["ctm"]) for r in drawings.placed(opens, "id").collect()}


def test_transforms_down_the_nesting(spark):
    got = ctm(spark, """<svg><g transform="rotate(30)"><g transform='translate(10, 5) scale(2)'><rect transform="skewX(45)"/><g><use/></g></g></g>
        <g transform="rotate(90 3 4)"/><path transform="matrix(1 2 3 4 5)"/></g></g></svg><line transform="scale(3,4)"/>""")
    c, s = math.cos(math.pi / 6), math.sin(math.pi / 6)
    shift = (10 * c - 5 * s, 10 * s + 5 * c)
    inner = (2 * c, 2 * s, -2 * s, 2 * c, *shift)
    skewed = (2 * c, 2 * s, 2 * c - 2 * s, 2 * s + 2 * c, *shift)
    want = {1: (c, s, -s, c, 0, 0), 2: inner, 3: skewed, 4: inner, 5: inner, 9: (0, 1, -1, 0, 7, 1), 10: (1, 0, 0, 1, 0, 0), 14: (3, 0, 0, 4, 0, 0)}
    assert got.keys() == want.keys()
    for k, m in want.items():
        assert got[k] == pytest.approx(m, abs=1e-9), k


def test_markup_scan(spark):
    text = """<?pi <b> ?><!DOCTYPE html><p title='a>b' x:Y = "1 &lt; 2" z=un/quoted a=1 a=2><!-- <i> > <u> --><![CDATA[<s>]]>t<br/></p><x:img src=a/>< p><1>"""
    rows = markup.markup(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "id", "t").orderBy("pos").collect()
    assert [(r["name"], r["closing"], r["alone"], r["before"]) for r in rows] == [("p", False, False, ""), ("br", False, True, "t"), ("p", True, False, ""), ("img", False, True, "")]
    assert [tuple(a) for a in rows[0]["attrs"]] == [("title", "a>b"), ("x:Y", "1 < 2"), ("z", "un/quoted"), ("a", "1"), ("a", "2")]
    assert [tuple(a) for a in rows[3]["attrs"]] == [("src", "a")]
    long = "<p d='" + "x" * 200_000 + "' " + "k=v " * 20_000 + ">" + "<b>" * 3
    got = markup.markup(spark.createDataFrame([(1, long)], "id int, t string"), "id", "t").select(F.size("attrs").alias("n")).collect()
    assert sorted(r["n"] for r in got) == [0, 0, 0, 20_001]


def test_nesting_after_closed_lists(spark):
    text = "<ul></ul></ul><nav><ol><li>a</li><li/><ul><li>b</li></ul></ol><li>c</nav><footer>"
    rows = markup.markup(spark.createDataFrame([(1, text)], "id int, t string"), "id", "t")
    got = [tuple(r)[2:] for r in markup.nested(rows, "id").orderBy("pos").collect()]
    assert got == [
        ("ul", 0, -1, 0, ""), ("nav", 0, -1, 0, ""), ("ol", 1, 3, 0, ""), ("li", 2, 4, 1, "ol"), ("li", 2, 4, 1, "ol"), ("ul", 2, 4, 1, "ol"), ("li", 3, 8, 2, "ul"),
        ("li", 1, 3, 0, ""), ("footer", 1, 3, 0, ""),
    ]


DRAWING = """<svg viewBox="0,0 100 50" width="10.5mm" height="h"><g transform="translate(10 20)" font-family="Serif"><rect width="4" height="2" fill="RED" stroke="none"/>
<circle cx="1" r="3px" style="stroke: Blue ; fill:inherit"/><path d="M0 0l5 5z"/></g><text x="1" y="2"> A &amp;lt; <tspan font-family="serif">b</tspan>
 c</text>outside<text/><polyline points="1 2, 3 x 4 5"/></svg>"""


def signed(spark, *texts):
    return drawings.signatures(spark.createDataFrame(list(enumerate(texts)), "id int, svg string"), "id", "svg")


def test_signature(spark):
    a, none, empty = signed(spark, DRAWING, None, "no tags").orderBy("id").collect()
    assert (a["view_box"], a["width"], a["height"], a["total"], a["drawn"], a["points"]) == ([0, 0, 100, 50], 10.5, None, 9, 6, 9)
    assert a["elements"] == {"svg": 1, "g": 1, "rect": 1, "circle": 1, "path": 1, "text": 2, "tspan": 1, "polyline": 1}
    assert (a["paths"], a["fills"], a["strokes"], a["fonts"]) == ({"M": 1, "L": 1, "Z": 1}, {"red": 1}, {"blue": 1}, {"serif": 2})
    assert (a["text"], a["chars"]) == ("A &lt; b c", 10)
    assert tuple(a["bbox"]) == (1, 2, 14, 23)
    for r in (none, empty):
        assert (r["total"], r["points"], r["elements"], r["text"], r["bbox"], r["view_box"]) == (0, 0, {}, "", None, None)


def test_comparison_and_baseline(spark, tmp_path):
    moved = DRAWING.replace("translate(10 20)", "translate(10.4 20)")
    far = DRAWING.replace("translate(10 20)", "translate(11 20)")
    said = DRAWING.replace("c</text>", "d</text>").replace("RED", "green").replace("<text/>", "")
    sig = signed(spark, DRAWING, moved, far, said, None)
    one = sig.filter("id = 0").select(F.struct(*[c for c in sig.columns if c != "id"]).alias("a"))
    rows = drawings.compared(one.crossJoin(sig.select("id", F.struct(*[c for c in sig.columns if c != "id"]).alias("b"))), "a", "b").orderBy("id").collect()
    said_ = [[tuple(d)[:2] for d in r["differences"]] for r in rows]
    assert (rows[0]["score"], rows[0]["match"], said_[0]) == (1.0, True, [])
    assert rows[1]["match"] and said_[1] == [] and rows[1]["bbox_delta"] == 0.4 and 0.99 < rows[1]["score"] < 1
    assert not rows[2]["match"] and said_[2] == [("major", "bbox.width")]
    assert rows[3]["match"] and said_[3] == [("minor", "element:text"), ("minor", "fill:green"), ("minor", "fill:red"), ("minor", "text")]
    like = rows[3]["likeness"]
    assert (like["elements"], like["fills"], like["text"], like["bbox"]) == (8 / 9, 0.0, 1.0, 1.0)
    assert rows[3]["score"] == round((8 / 9 * 3 + 2 + 3 + 3 + 0 + 1 + 1) / 14, 3)
    assert said_[4][-2:] == [("major", "text"), ("major", "bbox")] and rows[4]["bbox_delta"] is None and rows[4]["score"] == 0.0
    drawings.record_baseline(sig.filter("id < 3"), str(tmp_path), "r1")
    held = drawings.read_baseline(spark, str(tmp_path), "r1")
    now = signed(spark, DRAWING, far, far, said).filter("id <> 2")
    status = drawings.against_baseline(now, held, "id")
    assert {r["id"]: r["status"] for r in status.collect()} == {0: "unchanged", 1: "CHANGED", 2: "missing", 3: "new"}
    assert tuple(drawings.passes(status).first()) == (1, 1, 1, 1, False)
    assert drawings.passes(drawings.against_baseline(held, held, "id")).first()["pass"]


def test_a_taken_place_drops_the_cell_and_its_span(spark):
    from folioscope.operators import joins

    cells = [(1, 1, 0, 0, 1, 1), (1, 2, 0, 0, 1, 3), (1, 3, 1, 1, 2, 2), (1, 4, 1, 2, 1, 1), (1, 5, 0, 9, 1, 1), (1, 6, 2, 0, 0, 5)]
    df = spark.createDataFrame(cells, "tab int, id int, r int, c int, rs int, cs int")
    got = {(r["row"], r["col"]): r["id"] for r in joins.span_cover(df, 3, 4).collect()}
    assert got == {(0, 0): 1, (1, 1): 3, (1, 2): 4, (2, 1): 3, (2, 2): 3, (2, 0): 6, (2, 3): 6}


def test_references_and_encoding(spark):
    from folioscope.functions import scalars

    rows = [("&#38;lt;", "&lt;", 0), ("&amp;#65;&lt;", "&#65;<", 0), ("€\x85•\t\n", "€\x85•\t\n", 1), ("Ā\U0001f600é\x01", "Ā\U0001f600é\x01", 3)]
    df = spark.createDataFrame(rows, "t string, want string, lost int")
    assert df.filter(scalars.decode_entities(F.col("t")) != F.col("want")).count() == 0
    assert df.filter(scalars.unencodable(F.col("t")) != F.col("lost")).count() == 0


def test_charsets_by_label(spark):
    from folioscope.functions import charsets

    rows = [
        (b"\x80\x81a\xe9", "WINDOWS 1252", "€\x81aé"), (b"\x80\xe9", None, "€é"), (b"\x80\xe9", "nonsense", "€é"), (b"\xe9\x80", "windows_1251", "йЂ"),
        (b"\xb9\x9c", "windows-1250", "ąś"), (b"\xb1", "ISO-8859-2", "ą"), (b"\x80\xff", "Latin1", "\x80ÿ"), (b"a\x00\xac\x20\x00", "UTF-16LE", "a€�"),
        (b"\x82\xa0\x82", "Shift_JIS", "あ�"), (b"\xc4\xe3\x81", "GBK", "你�"), (b"\xa7A", "big5", "你"), (b"\x94\x39\xda\x33", "gb18030", "💩"), (None, "gbk", None), (b"", "gbk", ""),
    ]
    df = spark.createDataFrame([(bytearray(b) if b is not None else None, n, w) for b, n, w in rows], "b binary, label string, want string")
    assert [r["got"] for r in df.select(charsets.decoded(F.col("b"), F.col("label")).alias("got")).collect()] == [w for _, _, w in rows]


def test_composed_and_decomposed_names_collide(spark):
    from folioscope.operators import ordered

    rows = [(1, "d", "Café"), (2, "d", "café"), (3, "d", "CAFÉ (2)"), (4, "e", "café"), (5, "d", "cafe")]
    got = {r["source"]: r["name"] for r in ordered.claim_names(spark.createDataFrame(rows, "source int, folder string, stem string")).collect()}
    assert got == {1: "Café", 2: "café (3)", 3: "CAFÉ (2)", 4: "café", 5: "cafe"}


def test_formats(spark):
    import json

    from folioscope.operators import formats

    pt = lambda v, u="pt": {"v": v, "u": u}
    rows = [
        {"style:font-name": "", "fo:font-size": pt(0.138889, "in"), "fo:font-weight": "bold", "style:text-position": "-33% 58%", "fo:text-scale": pt(80, "%"), "fo:language": "en", "style:font-relief": "none"},
        {"fo:font-size": "12pt", "fo:font-weight": pt(1), "fo:country": "GB", "style:text-underline-style": "none", "fo:text-shadow": "none", "fo:text-scale": pt(100, "%")},
        {"fo:text-align": "end", "fo:line-height": pt(115, "%"), "fo:margin-top": pt(0), "fo:margin-left": pt(-30, "twip"), "fo:text-indent": pt(1, "%")},
        {"draw:fill": "gradient", "svg:linearGradient": [{"svg:stop-color": "#1"}, {"svg:offset": pt(0.2, "%")}, {"svg:stop-color": "#2", "svg:stop-opacity": pt(0.5, "%")}], "draw:opacity": pt(1, "%")},
        {"draw:fill": "gradient", "svg:linearGradient": [{"svg:stop-color": "#1"}], "draw:shadow": "visible", "draw:stroke": "dash", "draw:dots1": pt(2, ""), "draw:dots1-length": pt(3), "draw:distance": pt(1)},
        {"draw:fill": "bitmap", "draw:fill-image": "x", "librevenge:mime-type": "image/emf", "draw:opacity": pt(0.5, "%")},
        {}, None, [],
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "id int, j string").select("id", F.parse_json("j").alias("p"))
    df = df.select("id", formats.opened_map("p").alias("m"))
    run = {r["id"]: {k: v for k, v in r["f"].asDict().items() if v is not None} for r in df.select("id", formats.run_format("m").alias("f")).collect()}
    assert run[0] == {"size": 10.0, "bold": True, "baseline_shift": -33.0, "text_scale": 80.0, "lang": "en"}
    assert run[1] == {"text_shadow": True} and run[6] == run[7] == run[8] == {}
    para = df.select("id", formats.paragraph("m", F.when(F.col("id") == 2, "ordered"), F.lit(3)).alias("f")).filter("id = 2").first()["f"].asDict(True)
    assert {k: v for k, v in para.items() if v is not None} == {"align": "right", "line_height": 1.15, "margin_left": -1.5, "list": {"type": "ordered", "level": 3}}
    style = {r["id"]: (r["style"].asDict(True) if r["style"] else None, r["warnings"]) for r in formats.style(df, "m").collect()}
    stops = style[3][0]["fill"]["stops"]
    assert [tuple(x.values()) for x in stops] == [(0.0, "#1", None), (1.0, "#2", 0.5)] and style[3][0]["opacity"] is None and style[3][1] == []
    four = style[4][0]
    assert (four["fill"]["type"], four["fill"]["color"], four["stroke"], four["shadow"]) == ("solid", "#1", {"color": "#000000", "width": 1.0, "dash": [3.0, 1.0, 3.0, 1.0]}, None)
    assert style[4][1] == ["GRADIENT_FLATTENED", "SHADOW_DROPPED"]
    assert style[5][0]["fill"] is None and style[5][0]["opacity"] == 0.5 and style[5][1] == ["WMF_IMAGE_NOT_CONVERTED"]
    assert style[6] == style[7] == style[8] == (None, [])
    bad = [{"librevenge:path-action": "A", "svg:x": pt(1), "svg:y": pt(2), "svg:rx": pt(3), "svg:ry": pt(4), "librevenge:large-arc": pt(0)}, {"librevenge:path-action": "C", "svg:x": pt(1), "svg:y": pt(1)}, {"librevenge:path-action": "Z"}]
    got = spark.createDataFrame([(json.dumps({"svg:d": bad}),)], "j string").select(F.parse_json("j").alias("p")).select(formats.opened_map("p").alias("m")).select(formats.path_commands("m").alias("c")).first()["c"]
    assert [(c["op"], c["large_arc"], c["sweep"], c["rotation"]) for c in got] == [("A", False, True, 0.0), ("Z", None, None, None)]
