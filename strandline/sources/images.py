"""Images: header probe, PNG read and write, row ranges, resampling."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import ship


def bounds(raw: bytes | None) -> tuple[int, int]:
    """(width, height) from the header of a PNG, GIF, BMP, JPEG or WEBP; (0, 0) of anything else."""
    b = raw or b""
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack(">II", b[16:24])
        if b[:4] == b"GIF8":
            return struct.unpack("<HH", b[6:10])
        if b[:2] == b"BM":
            w, h = struct.unpack("<ii", b[18:26])
            return w, abs(h)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            if b[12:16] == b"VP8X":
                return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little")
            if b[12:16] == b"VP8L":
                v = int.from_bytes(b[21:25], "little")
                return (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1
            w, h = struct.unpack("<HH", b[26:30])
            return w & 0x3FFF, h & 0x3FFF
        if b[:2] == b"\xff\xd8":
            i = 2
            while True:
                marker, size = b[i + 1], struct.unpack(">H", b[i + 2 : i + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", b[i + 5 : i + 9])
                    return w, h
                i += 2 + size
    except (struct.error, IndexError):
        pass
    return 0, 0


def write_png(px: np.ndarray) -> bytes:
    """Packed ARGB pixels, opaque, as an RGB PNG."""
    h, w = px.shape
    rgb = np.stack([px >> 16 & 255, px >> 8 & 255, px & 255], axis=2).astype(np.uint8).reshape(h, -1)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgb], axis=1).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def read_png(raw: bytes) -> np.ndarray:
    """Packed ARGB pixels of a PNG of 8-bit grey, RGB or RGBA samples, not interlaced."""
    if raw[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, b"", None
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    w, h, depth, colour, _, _, interlace = head
    per = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or per is None or interlace:
        raise ValueError("unsupported PNG")
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(h, 1 + w * per)
    out = np.zeros((h, w * per), np.uint8)
    above = np.zeros(w * per, np.int64)
    for y in range(h):
        f, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if f == 2:
            line = line + above
        elif f in (1, 3, 4):
            for x in range(w * per):
                a = line[x - per] if x >= per else 0
                b, c = above[x], above[x - per] if x >= per else 0
                if f == 1:
                    line[x] += a
                elif f == 3:
                    line[x] += (a + b) // 2
                else:
                    p = a + b - c
                    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    line[x] += a if pa <= pb and pa <= pc else b if pb <= pc else c
                line[x] &= 255
        above = line & 255
        out[y] = above
    s = out.reshape(h, w, per).astype(np.int64)
    r, g, b = (s[..., 0],) * 3 if per < 3 else (s[..., 0], s[..., 1], s[..., 2])
    return 0xFF << 24 | r << 16 | g << 8 | b


def resampled(px: np.ndarray, width: int) -> np.ndarray:
    """Nearest pixels at the given width, height in proportion."""
    h, w = px.shape
    hh = max(1, h * width // w)
    return px[np.arange(hh) * h // hh][:, np.arange(width) * w // width]


def grid(px: np.ndarray, columns: int = 96, rows: int = 16) -> np.ndarray:
    """Bilinear luminance grid of an image, in 32-bit floats, rounded down."""
    h, w = px.shape
    lum = ((px >> 16 & 255) * 77 + (px >> 8 & 255) * 150 + (px & 255) * 29).astype(np.float32) / np.float32(256)

    def axis(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = (np.arange(n, dtype=np.float32) + np.float32(0.5)) * np.float32(size) / np.float32(n) - np.float32(0.5)
        low = np.clip(np.trunc(s).astype(np.int64), 0, size - 1)
        return low, np.minimum(low + 1, size - 1), np.clip(s - low.astype(np.float32), 0, 1).astype(np.float32)

    y0, y1, fy = axis(rows, h)
    x0, x1, fx = axis(columns, w)
    one = np.float32(1)
    upper = lum[y0][:, x0] * (one - fx) + lum[y0][:, x1] * fx
    lower = lum[y1][:, x0] * (one - fx) + lum[y1][:, x1] * fx
    return (upper * (one - fy)[:, None] + lower * fy[:, None]).astype(np.int64)


def sample_size(pixels: int, most: int = 16_000_000) -> int:
    """The power of two by which both sides are divided so that at most most pixels are left."""
    n = 1
    while pixels // (n * n) > most:
        n *= 2
    return n


def preview_scale(width: int, height: int, longest: int = 1280) -> float:
    return min(1.0, longest / max(width, height, 1))


def probe(df: DataFrame, content: str) -> DataFrame:
    """Adds width and height, 0 of what is no image. Only headers are parsed; a JPEG whose frame header is not in the first 65536 bytes is read whole."""
    ship(df.sparkSession)

    @F.pandas_udf("width int, height int")
    def run(raw: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([bounds(x) for x in raw], columns=["width", "height"])

    late = (F.col("_b.width") == 0) & (F.length(content) > 65536) & (F.hex(F.substring(content, 1, 2)) == "FFD8")
    found = df.withColumn("_b", run(F.substring(content, 1, 65536))).withColumn("_w", run(F.when(late, F.col(content))))
    return found.withColumn("_b", F.when(late, F.col("_w")).otherwise(F.col("_b"))).select("*", "_b.*").drop("_b", "_w")


def row_range(px: Column, width: Column, height: Column, top: Column, bottom: Column) -> Column:
    """Pixels of rows top to bottom (exclusive), within the image; null if none is left."""
    a, b = F.greatest(top, F.lit(0)), F.least(bottom, height)
    return F.when(b > a, F.slice(px, a * width + 1, (b - a) * width))


def read_folder(spark, path: str) -> DataFrame:
    """path, length, content of every file below path; the path is one that Spark's readers open."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
