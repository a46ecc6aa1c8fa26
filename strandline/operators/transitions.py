"""Cut plans over long groups in parts: each part's transition map, their composition, and the parts run from known entries.

A plan depends on its last cut, so a group is one sequence. But the next cut depends on nothing else than the last cut and the rows around it. So a part of
a group can say, for every row that the last cut before it may stand on, what the last cut in it will be. These maps are short, as plans from different
rows soon meet; composed in order they give the entry of each part, and the cuts of all parts are read off at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.operators import ordered
from strandline.operators.folds import fold_sorted
from strandline.operators.planner import Tiers
from strandline.runtime import shared_table, ship

#: For a cut that none follows; for entries that a part has no cut for.
ENDED, PASS = -1, -2


def edges_of(tiers: Tiers, first: int, last: int, entries: range) -> dict[int, tuple[int, bool]]:
    """{cut: (next cut, forced)} of the entries and of every cut in [first, last) that a plan from one of them makes; ENDED where none follows."""
    out: dict[int, tuple[int, bool]] = {}
    for at in entries:
        while at not in out and at < last:
            found = tiers.next(at) or (ENDED, False)
            out[at] = found
            at = found[0]
            if at == ENDED or at >= last:
                break
    return out


def walk(edges: dict[int, tuple[int, bool]], entry: int, first: int, last: int) -> Iterator[tuple[int, bool]]:
    """The cuts in [first, last) of the plan whose last cut before is entry."""
    at = entry
    while at in edges:
        at, forced = edges[at]
        if not first <= at < last:
            return
        yield at, forced


def exit_runs(edges: dict[int, tuple[int, bool]], first: int, last: int, entries: range) -> list[tuple[int, int, int]]:
    """(first entry, exit, cuts) of runs of entries that leave the part alike: by a cut, ENDED, or PASS as they came."""
    known: dict[int, tuple[int, int]] = {}
    for at in sorted(edges, reverse=True):  # a cut's end is that of the cut after it
        to = edges[at][0]
        known[at] = (known[to][0], known[to][1] + (to >= first)) if ENDED != to < last else (ENDED if to == ENDED else at, 0)
    out: list[tuple[int, int, int]] = []
    for e in entries:
        leaves, cuts = known[e]
        alike = (PASS if leaves == e else leaves, cuts)
        if not out or out[-1][1:] != alike:
            out.append((e, *alike))
    return out


def plan_long(df: DataFrame, keys: list[str], order: str, busy: str, ink: str, most: int | Column, least: int | Column | None = None, beyond: int | None = None, margin: int = 8, band: int | None = None, part_rows: int = 1 << 16) -> DataFrame:
    """keys, n (from 1), y, forced: what planner.plan_cuts() gives, a long group being worked on by as many tasks as it has parts.

    order counts a group's rows from 0 without gaps. most and least may be columns that hold one value in each group. Rows at part edges are copied into
    the parts beside them, as far as a cut may look; parts are at least that long.
    """
    spark = df.sparkSession
    ship(spark)
    value = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    d = df.select(*keys, F.col(order).cast("long").alias("_y"), F.col(busy).alias("_b"), F.coalesce(F.col(ink), F.lit(0)).alias("_i"), value(most).alias("_m"), (value(least) if least is not None else F.floor(value(most) / 3)).alias("_l"))
    groups = shared_table(d.groupBy(*keys).agg((F.max("_y") + 1).alias("_h"), F.max("_m").alias("_m"), F.max("_l").alias("_l")))
    longest = groups.agg(F.max("_m")).first()[0] or 1
    reach = Tiers.reach(longest, beyond, margin, band)
    size = max(part_rows, reach)
    rows = ordered.halo(d.select(*keys, "_y", "_b", "_i"), keys, "_y", reach, size)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    named = groups.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_h", "_m", "_l")
    # a part travels as one row of arrays: it is short, and Python is spared its rows
    cells = F.array_sort(F.collect_list(F.struct("_y", F.coalesce("_b", F.lit(False)).alias("_b"), F.col("_i").cast("long").alias("_i"))))
    packed = rows.where(F.col(ordered.PART) >= 0).groupBy(*keys, ordered.PART).agg(cells.alias("_c")).join(named, on).where(F.col(ordered.PART) * size < F.col("_h"))
    packed = packed.select(*keys, ordered.PART, F.get("_c._y", F.lit(0)).alias("_y"), F.col("_c._b").alias("_b"), F.col("_c._i").alias("_i"), "_h", "_m", "_l")

    def part(base: int, taken: np.ndarray, inked: np.ndarray, p: int, h: int, m: int, low: int) -> tuple:
        tiers = Tiers(taken, inked, m, low, beyond, margin, band, base, h)
        first, last = p * size, min((p + 1) * size, h)
        entries = range(0, 1) if p == 0 else range(max(0, first - m - tiers.beyond - 1), first)
        edges = edges_of(tiers, first, last, entries)
        runs = exit_runs(edges, first, last, entries)
        at = sorted(edges)
        return first, last, [list(r) for r in runs], at, [edges[a][0] for a in at], [edges[a][1] for a in at]

    nk = len(keys)
    schema = T.StructType([*(packed.schema[i] for i in range(nk + 1)), *T.StructType.fromDDL("first long, last long, runs array<array<long>>, at array<long>, to array<long>, forced array<boolean>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        for b in batches:
            for i in range(b.num_rows):
                p, y, taken, inked, h, m, low = (b.column(nk + j)[i] for j in range(7))
                busy, ink = (x.values.to_numpy(zero_copy_only=False) for x in (taken, inked))
                found = part(y.as_py(), busy, ink, p.as_py(), h.as_py(), m.as_py(), low.as_py())
                yield pa.RecordBatch.from_arrays([*(b.column(j).slice(i, 1).cast(types.field(j).type) for j in range(nk + 1)), *(pa.array([x], f.type) for x, f in zip(found, list(types)[nk + 1 :]))], schema=types)

    parts = shared_table(packed.mapInArrow(run, schema))

    def compose(rs: Iterator[tuple]) -> Iterator[tuple]:
        entry, before = 0, 0
        for p, runs in rs:
            yield p, entry, before
            run = None if entry == ENDED else max((r for r in runs if r[0] <= entry), default=None)
            if run is None:
                entry = ENDED
                continue
            entry, before = (entry if run[1] == PASS else run[1]), before + run[2]

    entries = fold_sorted(parts.select(*keys, ordered.PART, "runs"), keys, [ordered.PART], [ordered.PART, "runs"], compose, f"{ordered.PART} long, entry long, before long")
    known = ordered.with_parts(parts.drop("runs"), entries, keys)
    cut_schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", n long, y long, forced boolean"

    def read_off(rows: pa.Table) -> pa.Table:
        out: list[dict] = []
        for r in rows.to_pylist():  # one
            edges = dict(zip(r["at"], zip(r["to"], r["forced"])))
            cuts = walk(edges, r["entry"], r["first"], r["last"])
            out += [{**{k: r[k] for k in keys}, "n": n, "y": y, "forced": f} for n, (y, f) in enumerate(cuts, r["before"] + 1)]
        return pa.Table.from_pylist(out, schema=pa.schema([*(rows.schema.field(k) for k in keys), ("n", pa.int64()), ("y", pa.int64()), ("forced", pa.bool_())]))

    return known.groupBy(*keys, ordered.PART).applyInArrow(read_off, cut_schema)
