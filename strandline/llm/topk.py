"""Exact top-k inner-product search over bit-sliced attributes.

Vectors become integers floor(scale * x). A block of rows holds, for each attribute, one bitmap per bit of
the attribute (a slice). A query's score is the weighted sum of attributes, so it is the sum of those slices
that its own bits select, each shifted by both bit positions; negative weights take the complemented slice.
Carry-save adders on whole bitmaps make the slices of all scores of a block at once. The best rows are then
picked from the most significant score slice downward; rows still equal at the boundary are resolved
exactly by smaller id.

Work is dealt as (query block, row block) pairs. Both block sizes are fixed, so a task's memory does not
grow with the table, and no vector is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.runtime import own, ship


def quantise(df: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, ints): vectors as floor(scale * x). Rows without id or with a null or non-finite part are left out."""
    d = own(df, id_col, vec_col).toDF("id", "v").withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return d.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(finite).select("id", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


class Slices:
    """Bit slices of a block of integer rows. Vectors of other lengths count as padded by 0."""

    def __init__(self, rows: np.ndarray):
        self.n, self.dims = rows.shape
        self.low = int(rows.min(initial=0))
        shifted = (rows - self.low).astype(np.uint64)
        self.bits = max(1, int(shifted.max(initial=0)).bit_length())
        self.words = (self.n + 63) // 64
        padded = np.zeros((self.dims, self.words * 64), dtype=np.uint64)
        padded[:, : self.n] = shifted.T
        self.at = np.empty((self.bits, self.dims, self.words), dtype=np.uint64)
        for b in range(self.bits):
            on = ((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
            self.at[b] = np.packbits(on, axis=1, bitorder="little").view(np.uint64)
        self.full = np.zeros(self.words * 64, dtype=np.uint8)
        self.full[: self.n] = 1
        self.full = np.packbits(self.full, bitorder="little").view(np.uint64)

    def scores(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, lowest first, of a sum that orders rows as their inner products with query do."""
        weight = np.abs(query)
        negative = query < 0
        top = int(weight.max(initial=0)).bit_length()
        due: list[list[np.ndarray]] = [[] for _ in range(self.bits + top)]
        for j in range(top):
            on = (weight >> j) & 1 == 1
            plus, minus = np.flatnonzero(on & ~negative), np.flatnonzero(on & negative)
            for b in range(self.bits):
                if len(plus):
                    due[b + j].append(self.at[b, plus])
                if len(minus):
                    due[b + j].append(~self.at[b, minus])
        out, carried, w = [], [], 0
        while w < len(due) or carried:
            parts = (due[w] if w < len(due) else []) + carried
            carried = []
            x = np.concatenate(parts) if parts else np.zeros((1, self.words), dtype=np.uint64)
            while len(x) > 1:
                if len(x) == 2:
                    carried.append((x[0] & x[1])[None])
                    x = (x[0] ^ x[1])[None]
                    break
                t = len(x) // 3
                a, b, c = x[:t], x[t : 2 * t], x[2 * t : 3 * t]
                ab = a ^ b
                carried.append((a & b) | (c & ab))
                x = np.concatenate([ab ^ c, x[3 * t :]])
            out.append(x[0])
            w += 1
        return out

    def best(self, slices: list[np.ndarray], k: int, without: np.ndarray | None = None) -> np.ndarray:
        """Positions of the k best rows; of equal rows those that stand first."""
        sure = np.zeros(self.words, dtype=np.uint64)
        equal = self.full.copy()
        if without is not None:
            for i in without:
                equal[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
        for s in reversed(slices):
            more = equal & s
            both = sure | more
            n = int(np.bitwise_count(both).sum())
            if n > k:
                equal = more
            else:
                sure = both
                if n == k:
                    return self._rows(sure)
                equal = equal & ~s
        got = self._rows(sure)
        return np.concatenate([got, self._rows(equal)[: k - len(got)]])

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        w = np.flatnonzero(bitmap)
        if not len(w):
            return np.empty(0, dtype=np.int64)
        on = np.unpackbits(bitmap[w].view(np.uint8).reshape(len(w), 8), axis=1, bitorder="little")
        r, c = np.nonzero(on)
        return w[r] * 64 + c


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(queries) or not len(rows):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
    rows = rows.sort_values("id", kind="stable")
    width = max(max(map(len, rows["v"])), max(map(len, queries["v"])))
    ids, m = rows["id"].to_numpy(), _matrix(rows["v"], width)
    index = Slices(m)
    qs, rs, ss = [], [], []
    for qid, q in zip(queries["id"], _matrix(queries["v"], width)):
        lo, hi = np.searchsorted(ids, [qid, qid + 1])
        at = index.best(index.scores(q), k, np.arange(lo, hi))
        qs.append(np.full(len(at), qid, dtype=np.int64))
        rs.append(ids[at])
        ss.append(m[at] @ q)
    return pd.DataFrame({"query_id": np.concatenate(qs), "vec_id": np.concatenate(rs), "score": np.concatenate(ss)})


def top_k(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 5, scale: int = 256, query_block: int = 4096, row_block: int = 16384) -> DataFrame:
    """The k rows with the highest integer inner product for each query row: query_id, rank, vec_id, score.

    is_query: a condition on the column ``id``. Candidates are all rows whose id is not the query's own; equal
    scores rank by smaller vec_id. A query with fewer candidates returns them all. Rows whose vector is null or
    holds null or non-finite parts take no part, nor do rows without id. An id that occurs in several rows is
    several candidates, and one query (the smallest vector) if it is one. Shorter vectors count as padded by 0.
    An empty table gives an empty result.
    """
    ship(df.sparkSession)
    ints = quantise(df, id_col, vec_col, scale).withColumn("id", F.col("id").cast("long"))
    queries = ints.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    n, nq = ints.agg(F.count("*"), F.count_if(is_query)).first()
    row_blocks, query_blocks = max(1, math.ceil(n / row_block)), max(1, math.ceil(nq / query_block))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    spread = lambda m, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    left = queries.withColumn("qb", spread(query_blocks, 1)).withColumn("rb", every(row_blocks))
    # Equal ids stay together, so a block sees all of them; the vector breaks up repeats of one id.
    right = ints.withColumn("rb", F.pmod(F.xxhash64("id", "v"), F.lit(row_blocks)).cast("int")).withColumn("qb", every(query_blocks))

    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return search_block(q, r, k)

    found = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
