"""Archives as rows: unpack ZIP files held in a binary column, pack rows into ZIP files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.names import PICTURES, ZIP, sanitise
from strandline.functions.natural import natural_key
from strandline.operators.folds import fold_sorted
from strandline.runtime import own, ship


def _ending(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name else ""


def unpack(df: DataFrame, name: str, content: str, keep: tuple[str, ...] = (), pictures_only: bool = True) -> DataFrame:
    """keep..., archive, entry (its base name), position (in the archive), content, error: one row per entry that is a picture.

    Folders are passed over. RAR and 7z files, which nothing here can read, and broken ones give one row with error set, so they
    are never lost in silence.
    """
    ship(df.sparkSession)
    d = own(df, name, content, *keep)
    schema = T.StructType([*d.schema[2:], T.StructField("archive", T.StringType()), T.StructField("entry", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("content", T.BinaryType()), T.StructField("error", T.StringType())])

    def entries(n: str, raw: bytes | None) -> Iterator[tuple]:
        if _ending(n) not in ZIP:
            yield n, None, None, None, f"unsupported archive: {n}"
            return
        try:
            with zipfile.ZipFile(io.BytesIO(raw or b"")) as z:
                for i, info in enumerate(z.infolist()):
                    if not info.is_dir() and (not pictures_only or _ending(info.filename) in PICTURES):
                        yield n, info.filename.rpartition("/")[2].rpartition("\\")[2], i, z.read(info), None
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as e:
            yield n, None, None, None, f"{n}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                rows = list(entries(b.column(0)[i].as_py() or "", b.column(1)[i].as_py()))
                if rows:
                    kept = b.select(range(2, b.num_columns)).take(pa.array([i] * len(rows), pa.int32()))
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*kept.columns, *cols], names=schema.names)

    return d.mapInArrow(run, schema)


def numbered_entries(unpacked: DataFrame, keys: list[str]) -> DataFrame:
    """Adds n and file: entries in natural order, named 001_<sanitised name>, 002_..."""
    w = Window.partitionBy(*keys).orderBy(natural_key(F.col("entry")), "position")
    return unpacked.withColumn("n", F.row_number().over(w)).withColumn("file", F.format_string("%03d_%s", "n", sanitise(F.col("entry"))))


def pack(df: DataFrame, keys: list[str], order: list[str], name: str, content: str) -> DataFrame:
    """keys, archive (a ZIP file), entries, bytes (before compression): the rows of each group as one file, in order."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        out, n, total = io.BytesIO(), 0, 0
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, raw in rows:
                z.writestr(zipfile.ZipInfo(entry, (1980, 1, 1, 0, 0, 0)), bytes(raw or b""), zipfile.ZIP_DEFLATED)
                n, total = n + 1, total + len(raw or b"")
        yield out.getvalue(), n, total

    return fold_sorted(df, keys, order, [name, content], fold, "archive binary, entries long, bytes long", batch=16)
