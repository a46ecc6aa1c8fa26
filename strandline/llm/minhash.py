"""Near-duplicates by HyperMinHash sketches, banding, and exact verification.

A sketch has one register per bucket, each with a permutation of its own, so short texts fill all. A register
keeps the leading-zero count of the bucket's least hash and the mantissa bits after its leading one: 16 bits
instead of 64. Bands of compressed registers propose pairs. The share of equal registers, corrected for registers
that are equal by compression alone, estimates the Jaccard similarity and drops most accidental pairs; all
others are decided on the full shingle sets.

Texts with equal shingle sets form one class first. Within a bucket of a band every class is compared to the
bucket's least one (and in a second round to another one), which joins large groups without
listing their pairs. Only buckets that still hold several components are then compared pair by pair, in tiles of bounded
size, which return no more links than join their components. No bucket is cut or sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from strandline.llm.components import components
from strandline.llm.shingles import shingle_set, slices
from strandline.runtime import own, shared_table, ship

REGISTERS = 128
ROWS = 4  # registers in a band; 32 bands of 4 miss a pair of similarity 0.8 with probability 4.7e-8
MANTISSA = 10
TILE = 256
BANDS = REGISTERS // ROWS
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers (uint16): leading zeros of the bucket's least hash, then the mantissa bits after its leading one."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(least, (shingles[i : i + 2048, None] * _A + _B).min(axis=0), out=least)
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63)
    mantissa = np.clip(np.floor((2 * fraction - 1) * (1 << MANTISSA)), 0, (1 << MANTISSA) - 1)
    return (zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)


def estimate(equal: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard from the share of equal registers. Two different minima x share a register if they lie within one cell of width about
    0.7213 x / 2**MANTISSA; for sets of na and nb elements that has the probability below, which is taken out."""
    p = 0.7213 / (1 << MANTISSA) * (na * nb) / np.maximum(1, na + nb) ** 2
    return (equal - p) / (1 - p)


def passes(threshold: float) -> float:
    """The least estimate that is verified: five standard deviations below the threshold."""
    return threshold - 5 * math.sqrt(threshold * (1 - threshold) / REGISTERS)


def _sketches(docs: DataFrame, width: int) -> DataFrame:
    schema = T.StructType([docs.schema[0], T.StructField("n", T.LongType()), T.StructField("set", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 1):
                sets = [shingle_set(t.as_py(), width) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                    names=schema.names,
                )

    return docs.mapInArrow(run, schema)


def _packed(docs: DataFrame) -> DataFrame:
    """Texts compressed for the shuffles of verification."""
    schema = T.StructType([docs.schema[0], T.StructField("z", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for b in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.compress((t.as_py() or "").encode()) for t in b.column(1)], pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose estimate is at least least."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS) for i in (4, 5))
            ok = estimate((x == y).mean(axis=1), b.column(2).to_numpy(), b.column(3).to_numpy()) >= least
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return joined.mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs whose full shingle sets have a Jaccard similarity of at least threshold."""
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("z").alias(f"z{x}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "za", "zb")
    percent = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        seen: dict[bytes, np.ndarray] = {}

        def set_of(z: bytes) -> np.ndarray:
            got = seen.get(z)
            if got is None:
                if len(seen) >= 256:
                    seen.clear()
                got = seen[z] = shingle_set(d.decompress(z).decode(), width)
            return got

        for batch in batches:
            for b in slices(batch, 2):
                ok = []
                for za, zb in zip(b.column(2), b.column(3)):
                    x, y = set_of(za.as_py()), set_of(zb.as_py())
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def _units(rows: DataFrame, judge: Callable[[pa.Table], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """What judge returns for each unit (key, i, j) of rows, one unit in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            f = pa.Table.from_batches([batch])
            f = f if kept is None else pa.concat_tables([kept, f])
            of = np.stack([f.column(c).to_numpy().astype(np.int64) for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((of[:, 1:] != of[:, :-1]).any(axis=0)) + 1).tolist()]
            for s, e in zip(cuts, cuts[1:]):
                if (x := judge(f.slice(s, e - s))) is not None:
                    yield x
            kept = f.slice(cuts[-1])
        if kept is not None and kept.num_rows and (x := judge(kept)) is not None:
            yield x

    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _candidates(unit: pa.Table, percent: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a unit whose pairs must be compared in full: of different components, first in this band, sizes and estimate allow it."""
    tile_i, tile_j, t, rep, comp, n, band = (unit.column(c).to_numpy() for c in ("i", "j", "t", "rep", "component", "n", "band"))
    if len(np.unique(comp)) < 2:
        return
    sig = np.frombuffer(b"".join(unit.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, REGISTERS)
    own_tile = tile_i[0] == tile_j[0]
    left = np.arange(len(rep)) if own_tile else np.flatnonzero(t == tile_i[0])
    right = left if own_tile else np.flatnonzero(t == tile_j[0])
    for p in left:
        q = right[(comp[right] != comp[p]) & ((rep[right] > rep[p]) if own_tile else True)]
        q = q[np.minimum(n[q], n[p]) * 100 >= percent * np.maximum(n[q], n[p])]
        equal = sig[q] == sig[p]
        first = equal.reshape(len(q), BANDS, ROWS).all(axis=2).argmax(axis=1)
        q = q[(first == band[p]) & (estimate(equal.mean(axis=1), n[q], n[p]) >= least)]
        if len(q):
            yield p, q


def _across(members: DataFrame, classes: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """Links (a, b) that join the components of a bucket, decided on full sets, tile by tile.

    members: (key, band, rep, component) of buckets that hold several components. The rows of a bucket's largest component and its others are cut
    into tiles of about TILE rows each. A pair of tiles is one unit of work, but for pairs inside the largest component, so memory is bounded and
    units spread over tasks however large the bucket is. Every pair of different components
    is looked at in the first band in which its registers agree. A first pass ships registers only and names the rows of a unit that have a pair
    whose estimate passes; the second gives only those rows their texts, and compares such a pair in full if the unit hasn't
    joined the two components yet. So a unit returns fewer links than it has rows.
    """
    counts = members.groupBy("key", "component").agg(F.count("*").alias("m"))
    tiles = counts.groupBy("key").agg(F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("m")).select("key", F.col("most.component").alias("major"), F.ceil((F.col("m") - F.col("most.m")) / TILE).cast("int").alias("few"), F.ceil(F.col("most.m") / TILE).cast("int").alias("many"))
    rows = members.join(tiles, "key").withColumn("in", F.col("component") == F.col("major"))
    mine = F.when(F.col("in"), F.col("few") + F.pmod(F.xxhash64("rep", "key"), F.col("many"))).otherwise(F.pmod(F.xxhash64("rep", "key"), F.col("few"))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("in"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)
    rows = rows.withColumn("t", mine).withColumn("o", F.explode(others))
    rows = rows.select("key", "band", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "rep", "component").join(classes.select("rep", "n", "sig"), "rep")
    rows = rows.select("key", "band", "i", "j", "t", "rep", "component", "n", "sig")
    least, percent = passes(threshold), round(threshold * 100)

    def name(unit: pa.Table) -> pa.RecordBatch | None:
        asked = np.zeros(unit.num_rows, dtype=bool)
        for p, q in _candidates(unit, percent, least):
            asked[p] = True
            asked[q] = True
        return unit.filter(pa.array(asked)).combine_chunks().to_batches()[0] if asked.any() else None

    def compare(unit: pa.Table) -> pa.RecordBatch | None:
        rep, comp = unit.column("rep").to_numpy(), unit.column("component").to_numpy()
        z = unit.column("z").to_pylist()
        d = zstandard.ZstdDecompressor()
        sets: dict[int, frozenset[int]] = {}
        joined: dict[int, int] = {}

        def set_of(i: int) -> frozenset[int]:
            if i not in sets:
                sets[i] = frozenset(shingle_set(d.decompress(z[i]).decode(), width).tolist())
            return sets[i]

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        out = []
        for p, others in _candidates(unit, percent, least):
            for i in others:
                x, y = root(comp[p]), root(comp[i])
                if x != y:
                    a, b = set_of(p), set_of(i)
                    both = len(a & b)
                    if both and 100 * both >= percent * (len(a) + len(b) - both):
                        joined[x] = y
                        out.append((int(rep[p]), int(rep[i])))
        return pa.RecordBatch.from_arrays([pa.array(map(min, out), pa.int64()), pa.array(map(max, out), pa.int64())], names=["a", "b"]) if out else None

    # written: what passes decides how the texts are joined
    asked = shared_table(_units(rows, name, rows.schema))
    full = asked.join(texts.select(F.col("doc_id").alias("rep"), "z"), "rep").select(*rows.columns, "z")
    return _units(full, compare, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: component_id is the smallest id reachable over links of similarity >= threshold.

    A text without words has no shingles and is linked with nothing. Rows without id take no part: component_id null, kept false. Rows that
    share an id are one document: a link of one text is a link of all. An empty table gives an empty result.
    """
    spark = df.sparkSession
    ship(spark)
    docs = own(df, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketched = shared_table(_sketches(docs, width))
    known = sketched.where("doc_id is not null and n > 0")
    classes = shared_table(known.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    band = F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring(F.col("sig"), i * (2 * ROWS) + 1, F.lit(2 * ROWS)))))
    banded = classes.select("rep", band.alias("band", "key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    members = shared_table(banded.join(buckets, "key").select("key", "band", "rep", "low", "high"))
    texts = shared_table(_packed(docs).join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    sigs = shared_table(classes.join(members.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.min(F.struct("set", "n", "sig")).alias("x")).select("rep", "x.n", "x.sig"))
    # an id with several texts joins their classes
    same_id = known.join(classes.select("set", "rep"), "set").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.collect_set("rep").alias("all")).where("a < b").select("a", F.explode("all").alias("b"))
    least = passes(threshold)
    first = members.where("rep > low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    found = components(_verified(_likely(first, sigs, least), texts, width, threshold).union(same_id))
    for last in (False, True):
        labelled = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        mixed = labelled.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.max_by("component", "rep").alias("ch")).where("c0 < c1")
        open_rows = shared_table(labelled.join(mixed, "key"))
        if last:
            new = _across(open_rows.select("key", "band", "rep", "component"), sigs, texts, width, threshold)
        else:
            pairs = open_rows.where("rep < high and component <> ch").select(F.col("rep").alias("a"), F.col("high").alias("b")).distinct()
            new = _verified(_likely(pairs, sigs, least), texts, width, threshold)
        new = shared_table(new)
        if not new.isEmpty():
            # what is joined already is one link a node, which keeps the rounds few
            found = components(found.toDF("a", "b").union(new))
    labelled = sketched.join(classes.select("set", "rep"), "set", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    out = labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
