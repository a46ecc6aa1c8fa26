"""A manifest of a table as a Merkle tree: a digest for each row, a subroot for each group, one root, a proof for each row.

Rows of a group are numbered in two phases and cut into aligned blocks. In a block the digests are one contiguous matrix of
64 hex bytes a row: reshaped by the fanout it is the input of the next level, and the same shape gives each row's siblings by index arithmetic.
The tops of blocks are the leaves of the next tier, so no group, however large, passes through one task; the tree over groups is built the same way.
Proofs come down again tier by tier: a block gets the path above it, and each of its rows that path after its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import ordered
from strandline.runtime import own, shared_table, ship

FANOUT = 8
HEX = 64


def field(value: Column) -> Column:
    """A value as `<UTF-8 bytes>:<value>`, `-` for null: no two rows of values have the same text."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, nothing else; a text of one byte a character can't hold other capitals."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# ---- one block: a matrix of hex digests


def rows_of(digests: list[str] | pa.Array) -> np.ndarray:
    """(n, 64) bytes of n hex digests."""
    joined = "".join(digests if isinstance(digests, list) else digests.to_pylist()).encode()
    return np.frombuffer(joined, dtype=np.uint8).reshape(-1, HEX)


def hash_runs(level: np.ndarray) -> np.ndarray:
    """The digests of each run of FANOUT rows; the last run may be shorter."""
    flat, step = level.tobytes(), FANOUT * HEX
    return rows_of([sha256(flat[i : i + step]).hexdigest() for i in range(0, len(flat), step)])


def height(nodes: int) -> int:
    """Levels above so many nodes until one is left."""
    h = 0
    while nodes > 1:
        nodes, h = -(-nodes // FANOUT), h + 1
    return h


def levels_of(leaves: np.ndarray, up: int) -> list[np.ndarray]:
    """The block's matrices, up levels above the leaves."""
    out = [leaves]
    for _ in range(up):
        out.append(hash_runs(out[-1]))
    return out


def split_runs(level: np.ndarray, at: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(bytes before, bytes after) each position in its run, digests in order."""
    flat, step = level.tobytes(), FANOUT * HEX
    run, here = at // FANOUT * step, at * HEX
    return [flat[a:b] for a, b in zip(run, here)], [flat[b + HEX : a + step] for a, b in zip(run, here)]


def block_paths(leaves: np.ndarray, up: int) -> list[tuple[list[bytes], list[bytes]]]:
    """For each level, what stands before and after each leaf's ancestor in its run."""
    at = np.arange(len(leaves))
    return [split_runs(m, at // FANOUT**j) for j, m in enumerate(levels_of(leaves, up)[:up])]


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    for before, after in path:
        digest = sha256(before + digest + after).hexdigest().encode()
    return digest


# ---- tiers of blocks


def numbered(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """df with i, each row's place in its group by order, and n, the group's rows; in two phases, so a large group is many tasks."""
    parts = ordered.dealt(df, keys, order)
    sizes = parts.groupBy(*keys).agg(F.count("*").alias("n"))
    d = ordered.running_sum(parts, keys, order, F.lit(1), "i").drop(ordered.PART)
    return shared_table(d.join(sizes, keys))


def _tops(nodes: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """keys, i, n, h of the next tier: the top of each block."""
    size = FANOUT**depth
    schema = ", ".join(f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys) + ", i long, n long, h string"

    def top(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        n = rows["n"][0].as_py()
        leaves = rows_of(rows.sort_by("i")["h"].combine_chunks())
        h = levels_of(leaves, min(depth, height(n)))[-1].tobytes().decode()
        return pa.table({**{k: [v] for k, v in zip(keys, group)}, "i": pa.array([group[-1].as_py()], pa.int64()), "n": pa.array([-(-n // size)], pa.int64()), "h": [h]})

    d = nodes.select(*keys, "i", "n", "h", F.expr(f"i div {size}").alias("_b"))
    return d.groupBy(*keys, "_b").applyInArrow(top, schema)


def climb(nodes: DataFrame, keys: list[str], depth: int) -> list[DataFrame]:
    """The tiers from nodes (keys, i, n, h; written) to the one that holds a single node a group."""
    tiers = [nodes]
    while (tiers[-1].agg(F.max("n")).first()[0] or 0) > 1:
        tiers.append(shared_table(_tops(tiers[-1], keys, depth)))
    return tiers


def _paths(nodes: DataFrame, above: DataFrame, keys: list[str], depth: int) -> DataFrame:
    """keys, i, before, after of each node: its path up to the root. above: keys, i, before, after of the blocks."""
    size = FANOUT**depth
    schema = ", ".join(f"{k} {nodes.schema[k].dataType.simpleString()}" for k in keys) + ", i long, before array<string>, after array<string>"

    def down(rows: pa.Table, over: pa.Table) -> pa.Table:
        rows = rows.sort_by("i")
        b0, a0 = over["before"][0].as_py(), over["after"][0].as_py()
        found = block_paths(rows_of(rows["h"].combine_chunks()), min(depth, height(rows["n"][0].as_py())))
        before = [[lv[0][r].decode() for lv in found] + b0 for r in range(len(rows))]
        after = [[lv[1][r].decode() for lv in found] + a0 for r in range(len(rows))]
        return pa.table({**{k: rows[k] for k in keys}, "i": rows["i"], "before": pa.array(before, pa.list_(pa.string())), "after": pa.array(after, pa.list_(pa.string()))})

    mine = nodes.select(*keys, "i", "n", "h", F.expr(f"i div {size}").alias("_b"))
    return mine.groupBy(*keys, "_b").cogroup(above.withColumnRenamed("i", "_b").groupBy(*keys, "_b")).applyInArrow(down, schema)


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tampered: Column | None = None, depth: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: one row per row of df.

    A leaf is the digest of the columns as fields. Groups' trees have FANOUT children a node; leaves ascend by id (nulls first), of equal ids by
    digest, so repeated rows are leaves of their own. A group of null comes first, then groups by their UTF-8 bytes.
    tampered: of these rows (a condition on the column id; by default where 3 divides the id's CRC-32) the digest to be verified is that
    of the row with its text's A-Z lower-cased; null is false. depth: levels of a block, so a task holds FANOUT ** depth rows of it.
    An empty table gives an empty result. Other columns of df are not read, whatever their names.
    """
    ship(df.sparkSession)
    names = list(dict.fromkeys([*columns, id_col, group_col, text_col]))
    d = own(df, *names).toDF(*(f"f{i}" for i in range(len(names))))
    at = {n: F.col(f"f{i}") for i, n in enumerate(names)}
    leaf = lambda text: F.sha2(F.concat(*(field(text if c == text_col else at[c]) for c in columns)).cast("binary"), 256)
    chosen = F.crc32(F.col("id").cast("string").cast("binary")) % 3 == 0 if tampered is None else tampered
    leaves = d.withColumn("id", at[id_col]).withColumn("h", leaf(at[text_col])).withColumn("t", F.when(chosen, leaf(lower_ascii(at[text_col]))))
    g = at[group_col].cast("string")
    leaves = shared_table(leaves.select(g.isNotNull().alias("has"), F.coalesce(g, F.lit("")).alias("g"), F.struct("id", "h").alias("o"), "t"))
    keys = ["has", "g"]
    rows = numbered(leaves, keys, "o").select(*keys, "i", "n", F.col("o.h").alias("h"), F.col("o.id").alias("id"), "t")
    tiers = climb(rows, keys, depth)
    groups = tiers[-1].select("has", "g", "h").withColumn("o", F.struct("has", "g")).withColumn("one", F.lit(1))
    groups = numbered(groups, ["one"], "o")
    over = climb(groups, ["one"], depth)
    empty = F.array().cast("array<string>")
    path = over[-1].select("one", "i", empty.alias("before"), empty.alias("after"))
    for t in reversed(over[:-1]):
        path = shared_table(_paths(t, path, ["one"], depth))
    path = shared_table(groups.select("one", "i", *keys).join(path, ["one", "i"]).select(*keys, F.lit(0).cast("long").alias("i"), "before", "after"))
    for t in reversed(tiers[1:-1]):
        path = shared_table(_paths(t, path, keys, depth))
    top = over[-1].select(F.col("h").alias("root"))
    path = path.join(tiers[-1].select(*keys, F.col("h").alias("subroot")), keys).crossJoin(F.broadcast(top))  # one row
    return _verified(rows, path, keys, depth, len(tiers) > 1, rows.schema["id"].dataType.simpleString())


def _verified(rows: DataFrame, above: DataFrame, keys: list[str], depth: int, deep: bool, kind: str) -> DataFrame:
    """Each row's proof, and the root that its tampered (else its own) digest folds to along it."""
    size = FANOUT**depth
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def check(mine: pa.Table, over: pa.Table) -> pa.Table:
        mine = mine.sort_by("i")
        hexes = mine["h"].combine_chunks()
        up = [(b.encode(), a.encode()) for b, a in zip(over["before"][0].as_py(), over["after"][0].as_py())]
        rest = b"".join(b + a for b, a in up)
        root, subroot = over["root"][0].as_py(), over["subroot"][0].as_py()
        found = block_paths(rows_of(hexes), min(depth, height(mine["n"][0].as_py())))
        given = [(t or h).encode() for t, h in zip(mine["t"].to_pylist(), hexes.to_pylist())]
        ends: dict[bytes, str] = {}  # what a block's top folds to: most rows reach the same
        proofs, folded = [], []
        for r, digest in enumerate(given):
            path = [(b[r], a[r]) for b, a in found]
            proofs.append(sha256(b"".join(b + a for b, a in path) + rest).hexdigest())
            here = fold(digest, path)
            if here not in ends:
                ends[here] = fold(here, up).decode()
            folded.append(ends[here])
        n = len(mine)
        return pa.table({"doc_id": mine["id"], "leaf": mine["h"], "subroot": [subroot] * n, "root": [root] * n, "proof_sha256": proofs, "folded_root": folded, "verified": [x == root for x in folded]})

    d = rows.withColumn("_b", F.expr(f"i div {size}"))
    return d.groupBy(*keys, "_b").cogroup(above.withColumnRenamed("i", "_b").groupBy(*keys, "_b")).applyInArrow(check, schema)
