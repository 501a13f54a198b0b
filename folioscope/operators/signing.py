"""E17 in one pass: what a drawing's signature counts, told from its text alone, with no table of tags and no shuffle.

The rules are those of ``markup``, ``depths``, ``path_steps`` and ``placed`` as DataFrames, read tag by tag: the matrices of
the open elements are a stack, a path is walked from point to point.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa

from folioscope.sources.markup import ATTRIBUTE, NAME, NOISE, TAG

# Path commands with their number of arguments, and elements that draw.
ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
SHAPES = ("rect", "circle", "ellipse", "line", "polyline", "polygon", "path", "image", "use", "text")
NUMBER = r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
LETTERS = "MmLlHhVvCcSsQqTtAaZz"
PIECE = f"[{LETTERS}][^{LETTERS}]*"
PAINTS = (("fills", "fill"), ("strokes", "stroke"), ("fonts", "font-family"))
KEPT = ("elements", "paths", "fills", "strokes", "fonts")

# Java's classes are those of ASCII.
_own = lambda p: re.compile(p, re.ASCII)
_NOISE, _TAG = [_own(n) for n in NOISE], _own(TAG.replace(f"</?{NAME}+", f"<(/?)({NAME}+)(", 1).removesuffix(">") + ")>")
_ATTRIBUTE = _own(ATTRIBUTE.replace(NAME, f"({NAME})", 1).replace("(?:", "(", 1))
_PIECE, _NUMBER, _SPACE = _own(PIECE), _own(NUMBER), _own(r"[\s,]+")
_FIRST = _own(r"\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")
_CALL = _own(r"([a-zA-Z]+)\s*\(([^)]*)\)")
_STYLE = {n: _own(rf"(?:^|;)\s*{n}\s*:\s*([^;]+)") for n in ("fill", "stroke", "font-family")}
_REFERENCE = _own("&#(?:([0-9]{1,7})|[xX]([0-9a-fA-F]{1,6}));")
_DOUBLE = _own(r"[\0-\x20]*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)[fFdD]?[\0-\x20]*")
_HEX = _own(r"[\0-\x20]*([-+]?0[xX](?:[0-9a-fA-F]+\.?|[0-9a-fA-F]*\.[0-9a-fA-F]+)[pP][-+]?\d+)[fFdD]?[\0-\x20]*")
_STILL = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def double(text: str) -> float | None:
    """Spark's cast of a text to a double, None where it has none."""
    m = _DOUBLE.fullmatch(text)
    if m:
        return float(m[1])
    m = _HEX.fullmatch(text)
    if m:
        try:
            return float.fromhex(m[1])
        except OverflowError:
            return -math.inf if m[1][0] == "-" else math.inf
    word = text.strip("".join(map(chr, range(33))))
    if word.lower() in ("nan", "inf", "+inf", "-inf", "infinity", "+infinity", "-infinity") or word in ("+NaN", "-NaN"):
        return float(word)
    return None


def _decoded(m: re.Match) -> str:
    code = int(m[1]) if m[1] else int(m[2], 16)
    known = 0 < code < 0x110000 and not 0xD800 <= code <= 0xDFFF
    return m[0] if not known else "" if code == 0xFEFF else chr(code)  # the mark of UTF-32 is no text


def decoded(text: str) -> str:
    """I16: four named references, then numeric ones, & last."""
    if "&" not in text:
        return text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'")):
        text = text.replace(a, b)
    return _REFERENCE.sub(_decoded, text).replace("&amp;", "&")


def _attributes(body: str) -> dict[str, str]:
    """The decoded values by name; of several, the last."""
    return {name: decoded(v[1:-1] if v[0] in "\"'" else v) for name, v in _ATTRIBUTE.findall(body)}


def _number(attrs: dict[str, str], name: str) -> float:
    m = _FIRST.match(attrs.get(name, ""))
    return float(m[1]) if m else 0.0


def _paint(attrs: dict[str, str], name: str) -> str | None:
    value, style = attrs.get(name), attrs.get("style")
    m = _STYLE[name].search(style) if style and name in style else None
    value = m[1] if m else value
    value = value.strip(" ").lower() if value else None
    return value if value and value != "inherit" else None


def _numbers(text: str) -> list[float | None]:
    return [double(v) for v in _SPACE.split(text) if v]


def _turns(angle: float, f) -> float:
    return f(angle) if math.isfinite(angle) else math.nan


def _matrix(name: str, n: list[float | None]) -> tuple:
    """What is no number is what a missing one would be; 0 in a whole matrix."""
    at = lambda i, other=None: n[i] if i < len(n) and n[i] is not None else other
    if name == "matrix" and len(n) == 6:
        return tuple(v or 0.0 for v in n)
    if name == "translate":
        return (1.0, 0.0, 0.0, 1.0, at(0, 0.0), at(1, 0.0))
    if name == "scale":
        return (at(0, 1.0), 0.0, 0.0, at(1, at(0, 1.0)), 0.0, 0.0)
    angle = at(0, 0.0) * (math.pi / 180)
    if name == "rotate":
        cos, sin, x, y = _turns(angle, math.cos), _turns(angle, math.sin), at(1), at(2)
        if len(n) < 3 or x is None or y is None:
            return (cos, sin, -sin, cos, 0.0, 0.0)
        return (cos, sin, -sin, cos, x - cos * x + sin * y, y - sin * x - cos * y)
    if name == "skewX":
        return (1.0, 0.0, _turns(angle, math.tan), 1.0, 0.0, 0.0)
    if name == "skewY":
        return (1.0, _turns(angle, math.tan), 0.0, 1.0, 0.0, 0.0)
    return _STILL


def _times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    u, v, w, x, y, z = n
    return (a * u + c * v, b * u + d * v, a * w + c * x, b * w + d * x, a * y + c * z + e, b * y + d * z + f)


@lru_cache(4096)
def _matrices(text: str) -> list[tuple]:
    return [_matrix(name, _numbers(n)) for name, n in _CALL.findall(text)]


def walked(d: str, commands: dict[str, int]) -> list[tuple[float, float]]:
    """R2: all points of a path in order; ``commands`` counts its steps."""
    out, x, y, sx, sy = [], 0.0, 0.0, 0.0, 0.0
    for piece in _PIECE.findall(d):
        letter = piece[0]
        up, rel = letter.upper(), letter > "Z"
        arity, n = ARITY[up], list(map(float, _NUMBER.findall(piece)))
        if not arity:
            commands[up] = commands.get(up, 0) + 1
            x, y = sx, sy
            continue
        for i in range(0, len(n) or 1, arity):
            c = "L" if up == "M" and i else up
            commands[c] = commands.get(c, 0) + 1
            if i + arity > len(n):
                return out  # counted, without points, and the path ends there
            bx, by = (x, y) if rel else (0.0, 0.0)
            if c == "H":
                x = bx + n[i]
            elif c == "V":
                y = by + n[i]
            else:
                if c == "C":
                    out += (bx + n[i], by + n[i + 1]), (bx + n[i + 2], by + n[i + 3])
                elif c in "SQ":
                    out.append((bx + n[i], by + n[i + 1]))
                x, y = bx + n[i + arity - 2], by + n[i + arity - 1]
                if c == "M":
                    sx, sy = x, y
            out.append((x, y))
    return out


def _shape(name: str, attrs: dict[str, str]) -> list[tuple[float, float]]:
    n = lambda k: _number(attrs, k)
    if name in ("rect", "image", "use"):
        x, y, w, h = n("x"), n("y"), n("width"), n("height")
        return [(x, y), (x + w, y + h)] if w or h else []
    if name in ("circle", "ellipse"):
        x, y, rx, ry = n("cx"), n("cy"), *((n("r"),) * 2 if name == "circle" else (n("rx"), n("ry")))
        return [(x - rx, y - ry), (x + rx, y + ry)]
    if name == "line":
        return [(n("x1"), n("y1")), (n("x2"), n("y2"))]
    if name in ("polygon", "polyline"):
        held = [v for v in _numbers(attrs.get("points", "")) if v is not None]
        return list(zip(held[::2], held[1::2]))
    if name in ("text", "tspan") and ("x" in attrs or "y" in attrs):
        return [(n("x"), n("y"))]
    return []


class _Range:
    """The least and the greatest value; NaN is the greatest of all."""

    def __init__(self):
        self.low = self.high = None

    def add(self, values: list[float]) -> None:
        some, total = values, sum(values)
        if total - total != 0:  # there may be NaN
            some = [v for v in values if v == v]
        if some:
            low, high = min(some), max(some)
            self.low = low if self.low is None or self.low != self.low or low < self.low else self.low
            self.high = high if self.high is None or high > self.high else self.high
        if len(some) < len(values):
            self.high = math.nan
            self.low = math.nan if self.low is None else self.low


def signature(text: str | None) -> tuple:
    """total, drawn, points, the counts of ``KEPT``, text, the first svg's viewBox, width and height, least and greatest x and y."""
    source = text or ""
    for n in _NOISE:
        source = n.sub("", source)
    counts = {k: {} for k in KEPT}
    elements = counts["elements"]
    total = drawn = points = 0
    sum_ = least = inside = lowest = end = within = 0
    stack, chunks, root, xs, ys = [], [], None, _Range(), _Range()
    for found in _TAG.finditer(source):
        if within > 0:
            chunk = decoded(source[end : found.start()])
            if chunk.strip(" "):
                chunks.append(chunk)
        end = found.end()
        closing, name, body = found.groups()
        alone = not closing and body[-1:] == "/"
        name = name.rpartition(":")[2] if ":" in name else name
        sum_ += -1 if closing else 0 if alone else 1
        least = sum_ if sum_ < least else least
        if name == "text":
            inside += -1 if closing else 0 if alone else 1
            lowest = min(lowest, inside)
            within = inside - lowest
        if closing:
            continue
        attrs = _attributes(body[:-1] if alone else body) if body else {}
        total += 1
        drawn += name in SHAPES
        elements[name] = elements.get(name, 0) + 1
        depth = sum_ - least - (not alone)
        ctm = stack[depth - 1] if depth else None
        if attrs:
            styled = "style" in attrs
            for facet, attribute in PAINTS:
                value = _paint(attrs, attribute) if styled or attribute in attrs else None
                if value and (value != "none" or facet == "fonts"):
                    held = counts[facet]
                    held[value] = held.get(value, 0) + 1
            for m in _matrices(attrs["transform"]) if "transform" in attrs else ():
                ctm = _times(ctm or _STILL, m)
        if not alone:
            del stack[depth:]
            stack.append(ctm)
        if name == "svg":
            root = root or (attrs.get("viewBox"), attrs.get("width"), attrs.get("height"))
            continue
        at = walked(attrs["d"], counts["paths"]) if name == "path" and "d" in attrs else _shape(name, attrs)
        if not at:
            continue
        points += len(at)
        if ctm is None:
            x, y = zip(*at)
        else:
            a, b, c, d, e, f = ctm
            x, y = [a * p + c * q + e for p, q in at], [b * p + d * q + f for p, q in at]
        xs.add(x)
        ys.add(y)
    maps = [sorted(counts[k].items()) for k in KEPT]
    return total, drawn, points, *maps, " ".join(chunks), *(root or (None,) * 3), xs.low, xs.high, ys.low, ys.high


_MAP = pa.map_(pa.string(), pa.int64())
_TYPES = {
    "total": pa.int64(), "drawn": pa.int64(), "points": pa.int64(), **{k: _MAP for k in KEPT}, "said": pa.string(), "viewBox": pa.string(),
    "width": pa.string(), "height": pa.string(), "min_x": pa.float64(), "max_x": pa.float64(), "min_y": pa.float64(), "max_y": pa.float64(),
}
FIELDS = ", ".join(f"{k} {'map<string,bigint>' if t == _MAP else {'int64': 'bigint', 'double': 'double', 'string': 'string'}[str(t)]}" for k, t in _TYPES.items())
SLICE = 1_000  # documents whose signatures a worker holds at once


def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) to key and ``FIELDS``."""
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            rows = [signature(t) for t in batch.column(1).to_pylist()]
            columns = [pa.array(v, t) for v, t in zip(zip(*rows), _TYPES.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [batch.schema.names[0], *_TYPES])
