"""Vector codes by product quantisation: Lloyd's rounds over each part with Yinyang bounds, in whole numbers.

The entries of a part's codebook are clustered into groups once. Each row keeps, for each part, its entry and one lower bound a group: no entry of the
group but its own is nearer. After a round a bound falls by the furthest drift of its group, and only groups whose bound reaches the distance to the
row's own entry are scanned again. Bounds are floating and held low; what they let through is compared in exact whole numbers, so equal distances
always go to the lower index and the result is that of full scans.

Rows stay in Spark; a codebook is entries x parts, so only codebooks and their sums come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.runtime import own, release, shared_table, ship

#: Below this size products and sums of whole numbers are exact in doubles; above it Python's whole numbers take over.
EXACT = 2**18
#: Bounds are held lower by this share, far more than doubles and floats round by, and distances beyond MOST count as MOST, so that they are compared.
SLACK, MOST = 1e-6, 1e37


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles without fractions as exact numbers: doubles where they are small, else Python's."""
    if not values.size or np.abs(values).max() < EXACT:
        return values
    return np.array([int(x) for x in values.ravel()], dtype=object).reshape(values.shape)


def alike(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if (a.dtype == object) == (b.dtype == object):
        return a, b
    big = lambda m: m if m.dtype == object else np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape)
    return big(a), big(b)


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(rows, entries) exact squared distances."""
    x, c = alike(x, entries)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def root(d: np.ndarray) -> np.ndarray:
    if d.dtype != object:
        return np.minimum(np.sqrt(d), MOST)
    return np.array([float(min(isqrt(int(x)) + 1, int(MOST))) if x else 0.0 for x in d.ravel()]).reshape(d.shape)


@dataclass
class Book:
    """A part's codebook: its entries, and the group of each."""

    entries: np.ndarray
    group: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray, groups: int, rounds: int = 5) -> Book:
        """Groups by a few of Lloyd's rounds over the entries alone, from evenly spaced ones."""
        e = entries.astype(np.float64)
        centre = e[np.linspace(0, len(e) - 1, groups).astype(int)]
        group = np.zeros(len(e), dtype=np.int64)
        for _ in range(rounds):
            group = ((e[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
            for g in np.unique(group):
                centre[g] = e[group == g].mean(axis=0)
        return cls(entries, np.unique(group, return_inverse=True)[1])

    @property
    def groups(self) -> int:
        return int(self.group.max(initial=-1)) + 1

    def moved(self, entries: np.ndarray) -> tuple[Book, np.ndarray]:
        """The book with new entries, and how far each group's entries went at most."""
        a, b = alike(entries, self.entries)
        far = root(((a - b) ** 2).sum(axis=1)) * (1 + SLACK)
        drift = np.zeros(self.groups)
        np.maximum.at(drift, self.group, far)
        return Book(entries, self.group), drift


def assign(x: np.ndarray, book: Book, entry: np.ndarray | None, bounds: np.ndarray | None, drift: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(entry, bounds, squared distance, distances computed) of rows x, whose entry and bounds are those of the round before (None: the first).

    bounds[r, g]: no entry of group g but the row's own is nearer to row r than this.
    """
    n, k, first = len(x), len(book.entries), entry is None
    if first:
        entry, low = np.zeros(n, dtype=np.int64), np.zeros((n, book.groups))
    else:
        low = np.maximum(bounds * (1 - SLACK) - drift[None, :], 0.0)
    a, c = alike(x, book.entries)
    mine = ((a - c[entry]) ** 2).sum(axis=1)
    old, start = root(mine), entry
    limit = old * (1 + SLACK) + SLACK
    best, at = mine.copy(), entry.copy()
    scanned = np.full((n, k), np.inf)
    count = n
    for g in range(book.groups):
        names = np.flatnonzero(book.group == g)
        due = np.arange(n) if first else np.flatnonzero(low[:, g] <= limit)
        if not len(due):
            continue
        d = squared(x[due], book.entries[names])
        count += d.size
        near = d.argmin(axis=1)  # the first, so the lowest index of the group
        dist, name = d[np.arange(len(due)), near], names[near]
        better = (dist < best[due]) | ((dist == best[due]) & (name < at[due]))
        best[due] = np.where(better, dist, best[due])
        at[due] = np.where(better, name, at[due])
        scanned[np.ix_(due, names)] = root(d)
    scanned[np.arange(n), at] = np.inf
    for g in range(book.groups):
        names = np.flatnonzero(book.group == g)
        near = scanned[:, names].min(axis=1)
        seen = np.full(n, True) if first else low[:, g] <= limit
        low[:, g] = np.where(seen, near, low[:, g])
        # an entry given up counts again in its group; whether that was scanned or not
        left = (start != at) & (book.group[start] == g) & ~seen
        low[left, g] = np.minimum(low[left, g], old[left])
    return at, np.minimum(low, MOST), best, count


# ---- over tables


def integers(df: DataFrame, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """vec_id, label, v: whole numbers floor(scale * x), as doubles; rows with a null vector or a null or non-finite part are left out."""
    d = own(df, id_col, vec_col, label_col).toDF("vec_id", "v", "label").withColumn("v", F.transform(F.col("v").cast("array<double>"), lambda x: x * scale))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    down = lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)  # larger ones have no fraction
    return d.where(F.col("v").isNotNull() & finite).select("vec_id", "label", F.transform("v", down).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors are padded by 0."""
    values, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    if len(values) == width * len(column):
        return values.reshape(len(column), width)
    out, ends = np.zeros((len(column), width)), ends - ends[0]
    for r in range(len(column)):
        out[r, : ends[r + 1] - ends[r]] = values[ends[r] : ends[r + 1]]
    return out


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(m.ravel(), kind))


def _assigned(table: DataFrame, books: list[Book], drifts: list[np.ndarray] | None, width: int) -> DataFrame:
    """table with each row's entries, bounds and error."""
    parts, step = len(books), width // len(books)
    edge = np.concatenate([[0], np.cumsum([b.groups for b in books])])
    fields = [f for f in ("vec_id", "label", "v")]
    schema = ", ".join(f"{f} {table.schema[f].dataType.simpleString()}" for f in fields) + ", entry array<int>, bounds array<float>, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["v"], width)
            before = None if drifts is None else (_matrix(b["entry"], parts).astype(np.int64), _matrix(b["bounds"], int(edge[-1])).astype(np.float64))
            entries, bounds, error = np.zeros((len(x), parts), dtype=np.int32), np.zeros((len(x), int(edge[-1])), dtype=np.float32), [0] * len(x)
            for p in range(parts):
                state = (None, None, None) if before is None else (before[0][:, p], before[1][:, edge[p] : edge[p + 1]], drifts[p])
                at, low, d, _ = assign(whole(x[:, p * step : (p + 1) * step]), books[p], *state)
                entries[:, p], bounds[:, edge[p] : edge[p + 1]] = at, low * (1 - SLACK)
                error = [e + int(y) for e, y in zip(error, d)]
            out = [b["vec_id"], b["label"], b["v"], _lists(entries, pa.int32()), _lists(bounds, pa.float32()), pa.array([min(e, 2**63 - 1) for e in error], pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*fields, "entry", "bounds", "error"])

    return table.mapInArrow(run, schema)


def _count(total: dict[tuple[int, int], list], key: tuple[int, int], n: int, s) -> None:
    held = total.setdefault(key, [0, [0] * len(s)])
    held[0] += n
    held[1] = [a + int(x) for a, x in zip(held[1], s)]


def _as_rows(total: dict[tuple[int, int], list]) -> Iterator[pa.RecordBatch]:
    if total:
        kind = pa.schema([("p", pa.int32()), ("e", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.string()))])
        yield pa.RecordBatch.from_pylist([{"p": p, "e": e, "n": n, "s": [str(x) for x in s]} for (p, e), (n, s) in total.items()], schema=kind)


def _centres(table: DataFrame, books: list[Book], width: int) -> list[np.ndarray]:
    """Each entry's rows' componentwise floor(sum / count); unused entries as they were. Summed in tasks first: a task hands on a row an entry at most."""
    parts, step = len(books), width // len(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            x, e = _matrix(b["v"], width), _matrix(b["entry"], parts)
            for p in range(parts):
                part = whole(x[:, p * step : (p + 1) * step])
                for name in np.unique(e[:, p]):
                    rows = part[e[:, p] == name]
                    _count(total, (p, int(name)), len(rows), rows.sum(axis=0))
        yield from _as_rows(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for b in batches:
            for p, e, n, s in zip(*(c.to_pylist() for c in b.columns)):
                _count(total, (p, e), n, s)
        yield from _as_rows({k: [n, [x // n for x in s]] for k, (n, s) in total.items()})

    fields = "p int, e int, n long, s array<string>"
    # all rows of an entry meet in one task, which holds a sum an entry; entries x parts rows at most come back
    found = table.select("v", "entry").mapInArrow(sums, fields).repartition("p", "e").mapInArrow(add, fields).collect()
    out = [[[int(x) for x in row] for row in b.entries] for b in books]
    for r in found:
        out[r["p"]][r["e"]] = [int(x) for x in r["s"]]
    return [whole(np.array(o, dtype=np.float64)) if all(abs(x) < EXACT for row in o for x in row) else np.array(o, dtype=object) for o in out]


def compress(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = 4, entries: int = 256, rounds: int = 4, groups: int = 16, scale: int = 1024) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: one row per row that is kept.

    Rows with a null vector, or with a null or non-finite part (also after scaling), are dropped. The codebooks start from the rows of the smallest ids (null ids last,
    equal ids by their vectors), so fewer rows than entries give smaller codebooks. Shorter vectors count as padded by 0, to a length that parts divides.
    A code has two hex digits a part, so entries is at most 256. An error beyond a long is the largest long; a label's sum beyond it is null. Null labels
    count as one. An empty table gives an empty result. groups: entries' groups a part, each with one bound a row.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be between 1 and 256")
    spark = df.sparkSession
    ship(spark)
    rows = shared_table(integers(df, id_col, vec_col, label_col, scale))
    width = -(-(rows.agg(F.max(F.size("v"))).first()[0] or 0) // parts) * parts
    step = width // parts
    seed = [r["v"] for r in rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()]
    start = np.zeros((len(seed), width))
    for i, v in enumerate(seed):
        start[i, : len(v)] = v
    books = [Book.of(whole(start[:, p * step : (p + 1) * step]), min(groups, len(seed))) for p in range(parts)] if seed else []
    table, drifts = rows, None
    for _ in range(rounds if seed else 0):
        following = shared_table(_assigned(table, books, drifts, width))
        release(table)
        table = following
        both = [b.moved(c) for b, c in zip(books, _centres(table, books, width))]
        books, drifts = [b for b, _ in both], [d for _, d in both]
    digits = ",".join(str(int(x)) for b in books for row in b.entries for x in row)
    if seed:
        following = shared_table(_assigned(table, books, drifts, width).drop("v", "bounds"))
        release(table)
        table = following
    else:
        table = rows.select("vec_id", "label", F.array().cast("array<int>").alias("entry"), F.lit(0).cast("long").alias("error"))
    code = F.array_join(F.transform("entry", lambda e: F.lower(F.lpad(F.hex(e), 2, "0"))), "")
    totals = table.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    joined = table.join(totals, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "label", code.alias("code"), "error", "label_error", F.lit(sha256(digits.encode()).hexdigest()).alias("codebooks_sha256"))
