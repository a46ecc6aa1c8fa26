"""TIFF as a media column: write samples losslessly, walk directories, and emit one row per page.

Reads little- and big-endian files with any number of directories; strips and tiles; no compression, PackBits,
LZW, deflate (both codes); horizontal predictor for 8, 16 and 32 bits; chunky and planar samples.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandline.runtime import own, ship

#: Fixed values of the format: tags, field sizes, compression codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
FIELD = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
CLEAR, END = 256, 257


class BadTiff(ValueError):
    pass


def packbits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 2:
            out += bytes([257 - (j - i), data[i]])
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def unpackbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        c = data[i]
        if c < 128:
            out += data[i + 1 : i + 2 + c]
            i += c + 2
        elif c > 128:
            out += data[i + 1 : i + 2] * (257 - c)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early as the format asks."""
    acc = bits = 0
    out, table, width, prefix = bytearray(), {}, 9, b""

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    code_of = lambda s: s[0] if len(s) == 1 else table[s]
    put(CLEAR)
    for i in range(len(data)):
        grown = prefix + data[i : i + 1]
        if len(grown) == 1 or grown in table:
            prefix = grown
            continue
        put(code_of(prefix))
        table[grown] = 258 + len(table)
        prefix = grown[-1:]
        if (n := 258 + len(table)) == 4094:
            put(CLEAR)
            table, width = {}, 9
        elif n >= 1 << width and width < 12:
            width += 1
    if prefix:
        put(code_of(prefix))
        if 258 + len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    put(END)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def unlzw(data: bytes) -> bytes:
    out, acc, bits, width = bytearray(), 0, 0, 9
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, before = list(base), b""
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == CLEAR:
            table, width, before = list(base), 9, b""
            continue
        if code == END:
            break
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise BadTiff("LZW code outside the table")
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return bytes(out)


PACK = {NONE: bytes, LZW: lzw, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits}


def _inflate(data: bytes) -> bytes:
    return zlib.decompress(data)


UNPACK = {NONE: bytes, LZW: unlzw, DEFLATE: _inflate, OLD_DEFLATE: _inflate, PACKBITS: unpackbits}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 1024, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Pages of unsigned samples, (rows, columns) or (rows, columns, samples), in strips or tiles of (rows, columns)."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        px = page if page.ndim == 3 else page[:, :, None]
        h, w, s = px.shape
        kind = px.dtype.newbyteorder(order)
        step_h, step_w = tile or (rows_per_strip, w)
        offsets, counts = [], []
        for y in range(0, h, step_h):
            for x in range(0, w, step_w):
                part = px[y : y + step_h, x : x + step_w]
                if tile:
                    part = np.pad(part, ((0, step_h - part.shape[0]), (0, step_w - part.shape[1]), (0, 0)))
                if predictor == 2:
                    diff = part.copy()
                    diff[:, 1:] -= part[:, :-1]
                    part = diff
                raw = PACK[compression](np.ascontiguousarray(part).astype(kind).tobytes())
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        fields = {WIDTH: [w], HEIGHT: [h], COMPRESSION: [compression], PHOTOMETRIC: [1 if s < 3 else 2], SAMPLES: [s], PLANAR: [1], PREDICTOR: [predictor], BITS: [8 * px.dtype.itemsize] * s}
        fields |= {TILE_WIDTH: [step_w], TILE_HEIGHT: [step_h], TILE_OFFSETS: offsets, TILE_BYTES: counts} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [step_h], STRIP_BYTES: counts}
        entries = []
        for tag in sorted(fields):
            v = fields[tag]
            code = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else 4
            raw = struct.pack(f"{order}{len(v)}{FIELD[code][0]}", *v)
            if len(raw) > 4:
                at = struct.pack(order + "I", len(out))
                out += raw + b"\0" * (len(raw) % 2)
            else:
                at = raw.ljust(4, b"\0")
            entries.append(struct.pack(order + "HHI", tag, code, len(v)) + at)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple[int, ...]]]]:
    """Byte order and fields of each image directory, in file order; a loop of links ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise BadTiff("not a TIFF header")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        try:
            n = struct.unpack_from(order + "H", data, at)[0]
            fields = {}
            for i in range(n):
                tag, code, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                if code in FIELD:
                    letter, width = FIELD[code]
                    where = at + 10 + 12 * i
                    if count * width > 4:
                        where = struct.unpack_from(order + "I", data, where)[0]
                    fields[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
            yield order, fields
            at = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
        except struct.error as e:
            raise BadTiff(f"directory cut short: {e}") from e


def read_page(data: bytes, order: str, f: dict[int, tuple[int, ...]]) -> np.ndarray:
    """(rows, columns, samples) of unsigned integers."""
    try:
        w, h = f[WIDTH][0], f[HEIGHT][0]
    except KeyError as e:
        raise BadTiff("no width or height") from e
    s, bits = f.get(SAMPLES, (1,))[0], f.get(BITS, (1,))[0]
    coding, predictor, planar = f.get(COMPRESSION, (1,))[0], f.get(PREDICTOR, (1,))[0], f.get(PLANAR, (1,))[0]
    if coding not in UNPACK or predictor not in (1, 2) or bits not in (1, 2, 4, 8, 16, 32) or len(set(f.get(BITS, (1,)))) > 1 or f.get(FILL_ORDER, (1,))[0] != 1 or (predictor == 2 and bits < 8):
        raise BadTiff(f"unsupported: compression {coding}, predictor {predictor}, bits {bits}")
    tiled = TILE_OFFSETS in f
    step_w, step_h = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (w, min(h, f.get(ROWS_PER_STRIP, (h,))[0]) or h)
    offsets, counts = (f[TILE_OFFSETS], f.get(TILE_BYTES)) if tiled else (f.get(STRIP_OFFSETS, ()), f.get(STRIP_BYTES))
    if counts is None or len(counts) != len(offsets):
        raise BadTiff("no byte counts")
    kind = np.dtype(f"{order}u{max(1, bits // 8)}")
    planes, per = (s, 1) if planar == 2 else (1, s)
    across, down = -(-w // step_w), -(-h // step_h)
    if len(offsets) < planes * across * down:
        raise BadTiff("too few strips or tiles")
    out = np.zeros((h, w, s), dtype=kind.newbyteorder("="))
    for i in range(planes * across * down):
        plane, rest = divmod(i, across * down)
        y, x = rest // across * step_h, rest % across * step_w
        rows = step_h if tiled else min(step_h, h - y)
        if offsets[i] + counts[i] > len(data):
            raise BadTiff("strip or tile beyond the end")
        try:
            raw = UNPACK[coding](data[offsets[i] : offsets[i] + counts[i]])
        except zlib.error as e:
            raise BadTiff(f"deflate: {e}") from e
        line = -(-step_w * per * bits // 8)
        if len(raw) < rows * line:
            raise BadTiff("strip or tile too short")
        flat = np.frombuffer(raw, dtype=np.uint8, count=rows * line).reshape(rows, line)
        if bits < 8:
            on = np.unpackbits(flat, axis=1).reshape(rows, -1, bits)
            px = np.packbits(np.pad(on, ((0, 0), (0, 0), (8 - bits, 0))), axis=2)[:, : step_w * per, 0]
        else:
            px = flat.view(kind).astype(kind.newbyteorder("="), copy=False)
        px = px.reshape(rows, step_w, per)
        if predictor == 2:
            px = np.cumsum(px, axis=1, dtype=px.dtype)
        ph, pw = min(rows, h - y), min(step_w, w - x)
        if planar == 2:
            out[y : y + ph, x : x + pw, plane] = px[:ph, :pw, 0]
        else:
            out[y : y + ph, x : x + pw] = px[:ph, :pw]
    return out


PAGE_FIELDS = [("page", T.IntegerType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("samples", T.IntegerType()), ("bits", T.IntegerType()), ("compression", T.IntegerType()), ("pixels", T.BinaryType()), ("feature", T.StringType()), ("error", T.StringType())]
PAGE_ARROW = [pa.int32()] * 6 + [pa.binary(), pa.string(), pa.string()]


def feature(px: np.ndarray) -> str:
    """Size, sum of samples, and one bit per 1/64 of the columns: whether it is lighter than the mean, so near images differ in few bits."""
    if not px.size:
        return f"{px.shape[1]}x{px.shape[0]}-0-{0:016x}"
    columns = px.sum(axis=(0, 2), dtype=np.uint64)
    bands = np.array([p.sum() * 64 // max(1, len(p)) for p in np.array_split(columns, 64)], dtype=np.uint64)
    total = int(columns.sum())
    bits = sum(1 << i for i, b in enumerate(bands.tolist()) if b * len(bands) > sum(bands.tolist()))
    return f"{px.shape[1]}x{px.shape[0]}-{total}-{bits:016x}"


def tiff_pages(df: DataFrame, content_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep..., page, width, height, samples, bits, compression, pixels, feature, error: one row per page of each file.

    pixels: samples row by row, chunky, wider ones little-endian. A file that is null, empty or not a TIFF, and a page
    that can't be read, give one row with error set and no pixels; pages before it are still given.
    """
    ship(df.sparkSession)
    d = own(df, content_col, *keep)
    schema = T.StructType([*d.schema[1:], *(T.StructField(n, t) for n, t in PAGE_FIELDS)])

    def rows_of(data: bytes | None) -> Iterator[tuple]:
        page = 0
        try:
            for order, f in directories(data or b""):
                px = read_page(data, order, f)
                h, w, s = px.shape
                yield page, w, h, s, f.get(BITS, (1,))[0], f.get(COMPRESSION, (1,))[0], px.astype(px.dtype.newbyteorder("<"), copy=False).tobytes(), feature(px), None
                page += 1
        except BadTiff as e:
            yield page, None, None, None, None, None, None, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(source: pa.RecordBatch, at: list[int], found: list[tuple]) -> pa.RecordBatch:
            kept = source.select(range(1, source.num_columns)).take(pa.array(at, pa.int32()))
            cols = [pa.array(c, t) for c, t in zip(zip(*found), PAGE_ARROW)]
            return pa.RecordBatch.from_arrays([*kept.columns, *cols], names=schema.names)

        for batch in batches:
            at, found, size = [], [], 0
            for i, x in enumerate(batch.column(0)):
                for row in rows_of(x.as_py()):
                    at.append(i)
                    found.append(row)
                    size += len(row[6] or b"")
                    if size > 8 << 20:
                        yield batch_of(batch, at, found)
                        at, found, size = [], [], 0
            if at:
                yield batch_of(batch, at, found)

    return d.mapInArrow(run, schema)


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64) -> DataFrame:
    """(id, n_bytes, media): each whole text (null: empty) as one grey page of 8-bit samples, deflated with predictor.

    Its UTF-8 bytes fill rows of width samples; bytes 0 fill the last row, and an empty text has one row of them.
    """
    ship(df.sparkSession)
    d = own(df, id_col, text_col)
    schema = T.StructType([d.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, media, total, start = [], [], 0, 0

            def part(stop: int) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=schema.names)

            for i, x in enumerate(batch.column(1).cast(pa.binary())):
                raw = x.as_py() or b""
                payload = raw + b"\0" * (-len(raw) % width or width * (not raw))
                sizes.append(len(raw))
                media.append(write_tiff([np.frombuffer(payload, dtype=np.uint8).reshape(-1, width)]))
                total += len(media[-1])
                if total > 8 << 20:
                    yield part(i + 1)
                    sizes, media, total, start = [], [], 0, i + 1
            if sizes:
                yield part(batch.num_rows)

    return d.mapInArrow(run, schema)
