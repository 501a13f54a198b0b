"""Rendered pages as PNG files to tables of their ink pixels."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.catalog import query, table

# Samples of a pixel by colour type, the largest picture, and how far from white ink is.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
MOST_PIXELS, INK = 100_000_000, 32
BAND = 1 << 16


def _parts(data: bytes) -> dict[bytes, list[bytes]]:
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("bad signature")
    parts, at = {}, 8
    while at + 8 <= len(data) and b"IEND" not in parts:
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data):
            raise ValueError("truncated chunk")
        parts.setdefault(kind, []).append(data[at + 8 : at + 8 + size])
        at += 12 + size
    return parts


def _paeth(a: int, b: int, c: int) -> int:
    near = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
    return (a, b, c)[near.index(min(near))]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:  # a running sum per byte of the pixel; bytes wrap
        wide = np.pad(line, (0, -len(line) % step)).reshape(-1, step)
        return np.cumsum(wide, axis=0, dtype=np.uint8).ravel()[: len(line)]
    if kind == 2:
        return line + above
    if kind > 4:
        raise ValueError("unknown filter")
    out, up = bytearray(step) + line.tobytes(), bytes(step) + above.tobytes()
    for i in range(step, len(out)):
        a, b = out[i - step], up[i]
        out[i] = out[i] + ((a + b) // 2 if kind == 3 else _paeth(a, b, up[i - step])) & 255
    return np.frombuffer(bytes(out[step:]), np.uint8)


class Picture:
    """Reads a PNG line by line: two lines are held, never the picture."""

    def __init__(self, data: bytes):
        self.parts = _parts(data)
        if len(self.parts.get(b"IHDR", [b""])[0]) < 13:
            raise ValueError("no header")
        self.width, self.height, self.depth, self.kind, _, _, interlaced = struct.unpack_from(">IIBBBBB", self.parts[b"IHDR"][0])
        if interlaced or self.kind not in SAMPLES or self.depth not in (1, 2, 4, 8, 16):
            raise ValueError("unsupported form")
        if not 0 < self.width * self.height <= MOST_PIXELS:
            raise ValueError("too large" if self.width * self.height else "no pixels")
        if b"IDAT" not in self.parts:
            raise ValueError("no data")
        self.bits = SAMPLES[self.kind] * self.depth

    def lines(self) -> Iterator[np.ndarray]:
        """Filtered lines undone, as bytes."""
        size, step = -(-self.width * self.bits // 8), max(1, self.bits // 8)
        inflate, held, above = zlib.decompressobj(), b"", np.zeros(size, np.uint8)
        source = b"".join(self.parts[b"IDAT"])
        for _ in range(self.height):
            while len(held) <= size:
                more = inflate.decompress(source, max(BAND, size + 1))
                source = inflate.unconsumed_tail
                if not more:
                    raise ValueError("data end before the picture does")
                held += more
            above = _unfiltered(held[0], np.frombuffer(held, np.uint8, size, 1), above, step)
            held = held[size + 1 :]
            yield above

    def rgb(self, line: np.ndarray) -> np.ndarray:
        """A line's colours over white, width x 3."""
        if self.depth == 16:
            values = line[::2]
        elif self.depth == 8:
            values = line
        else:
            ones = np.unpackbits(line).reshape(-1, self.depth)
            values = ones @ (1 << np.arange(self.depth)[::-1])
        values = values[: self.width * SAMPLES[self.kind]].astype(np.int64).reshape(self.width, -1)
        clear = np.frombuffer(self.parts.get(b"tRNS", [b""])[0], np.uint8)
        alpha = np.full(self.width, 255)
        if self.kind == 3:
            colours = np.frombuffer(self.parts.get(b"PLTE", [b""])[0], np.uint8)
            colours = colours[: len(colours) // 3 * 3].reshape(-1, 3)
            at = values[:, 0]
            if at.max() >= len(colours):
                raise ValueError("colour outside the palette")
            rgb, alpha = colours[at].astype(np.int64), np.pad(clear, (0, max(0, 256 - len(clear))), constant_values=255)[at]
        else:
            if self.depth < 8:
                values = np.floor(values * 255 / ((1 << self.depth) - 1) + 0.5).astype(np.int64)
            rgb = values[:, :3] if self.kind in (2, 6) else values[:, :1].repeat(3, axis=1)
            if self.kind in (4, 6):
                alpha = values[:, -1]
            elif self.kind == 0 and len(clear) >= 2:  # the clear grey is held against the widened sample
                alpha = np.where(values[:, 0] == int(clear[0]) * 256 + int(clear[1]), 0, 255)
        if alpha.min() == 255:
            return rgb
        alpha = alpha.astype(np.int64)[:, None]
        return np.floor(rgb * alpha / 255 + (255 - alpha) + 0.5).astype(np.int64)

    def ink(self) -> Iterator[np.ndarray]:
        """Per line with ink: x, y, r, g, b of its ink pixels."""
        for y, line in enumerate(self.lines()):
            rgb = self.rgb(line)
            x = np.flatnonzero(rgb.min(axis=1) < 255 - INK)
            if len(x):
                yield np.column_stack([x, np.full(len(x), y), rgb[x]])


def ink_pixels(pictures: DataFrame) -> DataFrame:
    """pictures(img, content) to img, x, y, r, g, b of each ink pixel, and `problem`.

    A picture that cannot be read whole gives one row with its problem and no pixels; a null content is a problem too.
    So a picture with more ink than a band is read to its end before its pixels leave, and then again. A picture
    without ink gives no row.
    """
    kind = pictures.schema["img"].dataType.simpleString()
    names = ["x", "y", "r", "g", "b"]

    def frame(imgs: list, times: list[int], marks: list[np.ndarray], problem: str | None = None) -> pd.DataFrame:
        all_marks = np.concatenate(marks) if marks else np.full((sum(times), 5), np.nan)
        held = pd.Series(imgs).repeat(times).reset_index(drop=True)
        columns = {n: pd.array(c, dtype="Int32") for n, c in zip(names, all_marks.T)}
        return pd.DataFrame({"img": held, **columns, "problem": pd.Series([problem] * len(held), dtype=object)})

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        imgs, times, marks, size = [], [], [], 0
        for rows in frames:
            for img, content in zip(rows["img"], rows["content"]):
                try:
                    picture, first, n = Picture(bytes(content if content is not None else b"")), [], 0
                    for mark in picture.ink():
                        n += len(mark)
                        if n <= BAND:
                            first.append(mark)
                except (ValueError, zlib.error) as e:
                    yield frame([img], [1], [], str(e))
                    continue
                for mark in [np.concatenate(first)] if 0 < n <= BAND else picture.ink() if n else ():
                    imgs.append(img)
                    times.append(len(mark))
                    marks.append(mark)
                    size += len(mark)
                    if size >= BAND:
                        yield frame(imgs, times, marks)
                        imgs, times, marks, size = [], [], [], 0
        if size:
            yield frame(imgs, times, marks)

    return pictures.select("img", "content").mapInPandas(of, f"img {kind}, x int, y int, r int, g int, b int, problem string")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def packed(width: int, height: int, depth: int, kind: int, raw: bytes, *extra: tuple[bytes, bytes]) -> bytes:
    """A PNG of filtered lines."""
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(_chunk(*e) for e in extra) + _chunk(b"IDAT", zlib.compress(raw, 1)) + _chunk(b"IEND", b"")


_GREY = "[c_custkey % 256, c_nationkey * 9 % 256, c_custkey * 7 % 256, c_custkey * 5 % 256]"


@query(f"""SELECT c_custkey, CAST(i % 2 AS INT) AS x, CAST(i // 2 AS INT) AS y, CAST(v AS INT) AS grey FROM
(SELECT c_custkey, unnest(range(4)) AS i, unnest({_GREY}) AS v FROM customer) WHERE 255 - v > 32""")
def r4_ink_pixels(spark, sf_dir):
    """R4 on a grey picture of two by two pixels for each customer, packed and read again."""

    @F.pandas_udf("binary")
    def picture(grey: pd.Series) -> pd.Series:
        return pd.Series([packed(2, 2, 8, 0, bytes([0, a, b, 2, (c - a) % 256, (d - b) % 256])) for a, b, c, d in grey])

    grey = F.expr(_GREY.replace("[", "array(").replace("]", ")"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("img"), picture(grey).alias("content"))
    return ink_pixels(rows).select(F.col("img").alias("c_custkey"), "x", "y", F.col("r").alias("grey"))
