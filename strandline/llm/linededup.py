"""Line dedup by a log-template tree.

A line's tokens that hold a digit become a variable field. The line then descends a tree of fixed depth: its number of tokens, then
its leading tokens. In a leaf, lines that share one of the equal blocks of their remaining tokens are candidates for one
cluster; as a line has three blocks, lines that differ in one or two fields always share one. A cluster's template holds, by position, the token that
most of its lines have, and a variable field where none has a majority. A line belongs to it if enough of its tokens agree. The tree
is never built in one place: lines, positions and clusters are counted by id over all documents, whatever the size of a leaf.
Lines of templates that recur are dropped.

A passage that recurs inside lines, whatever stands around it, is found by runs of words that begin at content-defined
cuts: a word is a cut if the hash of the words from it on is the least among its neighbours, so the cuts of a passage
do not depend on the rest of its line. Runs are counted like templates, and the words of recurring runs are cut out of the line.
For lines and stretches of 50 words two documents are enough; shorter ones may recur by chance or habit, and need min_docs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from strandline.llm.shingles import mixed, slices
from strandline.runtime import own, shared_table, ship

_DIGIT = re.compile(rb"[0-9]")
FIELD = np.uint64(0xF1E1D)  # the hash of a word that holds a digit
DEPTH = 2  # leading tokens on the path
BLOCKS = 3  # equal parts of the rest, one of which the lines of a cluster share
LEAST = DEPTH + 2  # tokens of a line that can be generalised: one may vary and one more is compared
SIMILAR = 0.75  # share of a line's tokens that agree with its template
ANCHOR = 10  # words whose hash decides on a cut
REACH = 11  # neighbouring words of which one is a cut
RUN = 20  # words of a run
LONG_WORDS = 50  # of a line or a stretch of runs that long_docs documents hold
LINE, RUN_KIND, LONG_LINE, CLUSTER = 0, 1, 2, 3  # kinds of ids, in their last two bits: whole lines, runs, whole lines of LONG_WORDS or more, blocks in a leaf
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_WORD = re.compile(rb"\S+")


@dataclass
class Words:
    """Hashes of the words of some lines, in one row, and of any range of them; masked: with one hash for all words that hold a digit."""

    size: np.ndarray  # words of each line
    start: np.ndarray
    raw: np.ndarray
    masked: np.ndarray

    @classmethod
    def of(cls, lines: list[bytes]) -> Words:
        split = [x.split() for x in lines]
        size = np.fromiter(map(len, split), np.int64, len(split))
        raw = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(split)), np.uint64, int(size.sum()))
        start, masked = np.cumsum(size) - size, raw.copy()
        for i, x in enumerate(lines):
            if _DIGIT.search(x):
                masked[[start[i] + k for k, w in enumerate(split[i]) if _DIGIT.search(w)]] = FIELD
        return cls(size, start, raw, masked)

    def ranges(self, of: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """(first word, words) -> a hash of each such range of one of the two rows, the same wherever it stands."""
        n = len(of)
        upto = np.r_[np.uint64(0), np.cumsum(of * np.cumprod(np.r_[np.uint64(1), np.full(max(0, n - 1), _STEP)])[:n])]
        back = np.cumprod(np.r_[np.uint64(1), np.full(n, _BACK)])
        return lambda at, words: mixed((upto[at + words] - upto[at]) * back[at])


def line_ids(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, kind) of lines that aren't blank and of their blocks, and whether a line has blocks.

    A line of which half or more is variable stands for itself alone: tables of numbers are no template. A shorter one than LEAST has no blocks.
    """
    n, at = w.size, w.start
    variable = np.r_[0, np.cumsum(w.masked == FIELD)]
    alone = 2 * (variable[at + n] - variable[at]) >= n
    masked = w.ranges(w.masked)
    salted = lambda h, *by: mixed(h + sum((np.asarray(x).astype(np.uint64) + np.uint64(k + 1)) * m for k, (x, m) in enumerate(zip(by, (_STEP, _BACK)))))
    some = np.flatnonzero(n > 0)
    whole = salted(np.where(alone, w.ranges(w.raw)(at, n), masked(at, n)), n, alone)[some]
    deep = np.flatnonzero((n >= LEAST) & ~alone)
    rest, leaf = n[deep] - DEPTH, masked(at[deep], np.full(len(deep), DEPTH))
    parts = np.minimum(BLOCKS, rest)
    keys, lines, kinds = [whole], [some], [np.where(n[some] >= LONG_WORDS, LONG_LINE, LINE)]
    for i in range(BLOCKS):
        on = parts > i
        a, b = rest[on] * i // parts[on], rest[on] * (i + 1) // parts[on]
        keys.append(salted(masked(at[deep][on] + DEPTH + a, b - a) ^ mixed(leaf[on]), n[deep][on], np.full(on.sum(), i)))
        lines.append(deep[on])
        kinds.append(np.full(on.sum(), CLUSTER))
    has = np.zeros(len(n), dtype=bool)
    has[deep] = True
    return np.concatenate(keys).view(np.int64), np.concatenate(lines), np.concatenate(kinds), has


def runs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, first word) of the runs of all lines. A line's runs begin at its cuts and its first word, and one ends with it.

    So of a passage that two lines share, all but REACH - 1 words at either end is in runs that both have, if it has
    REACH - 1 words more than a run.
    """
    n = len(w.raw)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    line = np.repeat(np.arange(len(w.size)), w.size)
    at = np.arange(n) - np.repeat(w.start, w.size)
    left = np.repeat(w.size, w.size) - at
    run = w.ranges(w.raw)
    most = np.iinfo(np.uint64).max
    anchor = np.full(n + REACH, most, np.uint64)
    fits = np.flatnonzero(left >= ANCHOR)
    anchor[fits] = run(fits, np.full(len(fits), ANCHOR))
    least = anchor[:n].copy()
    for i in range(1, REACH):
        np.minimum(least, anchor[i : n + i], out=least)
    least[left < ANCHOR + REACH - 1] = 0
    top = least.copy()
    for i in range(1, min(REACH, n)):  # a slice may hold fewer words
        np.maximum(top[i:], least[: n - i], out=top[i:])
    cut = ((anchor[:n] == top) & (left >= ANCHOR)) | (at == 0)
    where = np.flatnonzero((cut & (left >= RUN)) | (left == RUN))
    return run(where, np.full(len(where), RUN)).view(np.int64), line[where], at[where]


def _eligible(n: int, spans: list[tuple[bool, int, bool]]) -> list[tuple[bool, int]]:
    """Of a line's runs (first here, first word, held by min_docs) those that count: of min_docs, or in a stretch of LONG_WORDS.

    Runs of one passage begin at most REACH words apart; others that only touch are two stretches. Up to REACH - 1 words at either end of
    a passage inside a line are in no shared run and don't count, so no stretch is longer than what is shared.
    """
    out, group, end = [], [], -1
    for first, at, often in [*sorted(spans, key=lambda x: x[1]), (False, n + RUN, False)]:
        if group and at > end - RUN + REACH:
            long = end - group[0][1] >= LONG_WORDS
            out += [(f, a) for f, a, o in group if o or long]
            group = []
        group.append((first, at, often))
        end = at + RUN
    return out


def cut_text(text: str, places: list[int], firsts: list[bool], often: list[bool]) -> tuple[str, int, int]:
    """The text without what recurs at places, the number of lines that lost all or some of their words, and of those that hold what recurs.

    A line goes if it has recurring templates and is the first to hold none of them; words of a recurring run go where the
    run is held first elsewhere. As first holders have ever smaller ids, one at last keeps each word. In a line that goes, words of
    runs that count and are held here first stay, as other documents lose theirs.
    """
    whole: dict[int, bool] = {}
    spans: dict[int, list[tuple[bool, int, bool]]] = {}
    for place, first, o in zip(places, firsts, often):
        i, at = place >> 32, (place >> 2) & 0x3FFFFFFF
        if place & 3 == RUN_KIND:
            spans.setdefault(i, []).append((first, at, o))
        else:
            whole[i] = whole.get(i, True) and not first
    if all(firsts):
        return text, 0, len(whole.keys() | {i for i, x in spans.items() if _eligible(1 << 30, x)})
    lines, out, lost, held = text.encode().split(b"\n"), [], 0, len(whole)
    for i, x in enumerate(lines):
        if i not in spans:
            if whole.get(i):
                lost += 1
            else:
                out.append(x)
            continue
        words = [m.start() for m in _WORD.finditer(x)]
        gone = np.full(len(words), whole.get(i, False))
        counting = _eligible(len(words), spans[i])
        held += i not in whole and bool(counting)
        for first, at in sorted(counting, reverse=True):  # what is first elsewhere comes last
            gone[at : at + RUN] = not first
        lost += bool(gone.any())
        if gone.all():
            continue
        if gone.any():
            ends = [*words[1:], len(x)]
            x = x[: words[0]] + b"".join(x[s:e] for s, e, g in zip(words, ends, gone) if not g)
            x = x.rstrip() if gone[-1] else x
        out.append(x)
    return b"\n".join(out).decode(), lost, held


def _clusters(keyed: DataFrame, hits: DataFrame, min_docs: int) -> DataFrame:
    """(row, place, first): lines whose template recurs; first is the smallest id that holds it.

    keyed: row, doc_id, codes, starts; hits: (row, key, place) of blocks that min_docs rows or more hold. Equal lines are counted before anything else, and tokens
    by position, so that neither a large leaf nor a large cluster is gathered in one task.
    """
    found = hits.groupBy("row").agg(F.collect_list(F.struct("key", "place")).alias("x"))
    i = F.shiftright("place", 32).cast("int")
    start, end = F.get("starts", i), F.get("starts", i + 1)
    coded = found.join(keyed.select("row", "doc_id", "codes", "starts"), "row").select("row", "doc_id", "codes", "starts", F.inline("x"))
    coded = shared_table(coded.select("row", "doc_id", "key", "place", F.substring("codes", 2 * start + 1, 2 * (end - start)).alias("code")))
    tokens = lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.length(c) / 2).cast("int") - 1), lambda k: F.substring(c, 2 * k + 1, F.lit(2)))
    counts = coded.groupBy("key", "code").agg(F.count("*").alias("n")).select("key", "n", F.posexplode(tokens(F.col("code"))).alias("at", "token"))
    by_token = counts.groupBy("key", "at", "token").agg(F.sum("n").alias("n"))
    best = by_token.groupBy("key", "at").agg(F.max_by("token", F.struct("n", "token")).alias("token"), F.max("n").alias("most"), F.sum("n").alias("all"))
    template = best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.when(2 * F.col("most") > F.col("all"), F.col("token")).alias("token")))).alias("t"))
    agree = F.aggregate(F.zip_with(tokens(F.col("code")), "t", lambda x, t: F.when(x == t["token"], 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    # one row a line on the left, one a cluster on the right; written, so that the join deals lines anew and a large cluster's are split
    template = shared_table(template)
    near = coded.join(template, "key").where(agree >= SIMILAR * F.length("code") / 2).select("row", "doc_id", "key", "place")
    near = shared_table(near)
    held = near.select("row", "doc_id", "key").distinct().groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= min_docs)
    # one row a cluster, written like the templates
    return near.join(shared_table(held.select("key", "first")), "key").select("row", "place", "first")


def recurring_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = True, long_docs: int = 2) -> DataFrame:
    """(doc_id, text_key, places array<long>, firsts array<boolean>, often array<boolean>): what recurs in each text that has any; text_key is xxhash64 of the text.

    A place is the line (from 0) in the upper 32 bits, the first word of a run, and the kind in the last two bits. A line with its digits generalised, or a template, recurs
    if min_docs rows or more hold it, a run or a whole line of LONG_WORDS if long_docs do (or min_docs, if that is less); often marks what min_docs hold.
    Of keep_first, the document with the smallest id that holds it is marked, so that no text is lost from the corpus.
    """
    spark = df.sparkSession
    ship(spark)
    d = own(df, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    schema = T.StructType([d.schema[0], d.schema[1], T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType()), T.StructField("starts", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 2, 1 << 20):  # a slice's words and their hashes take some 40 times its bytes
                texts = [(t.as_py() or "").encode().split(b"\n") for t in b.column(2)]
                lines = list(chain.from_iterable(texts))
                count = np.array([len(t) for t in texts])
                of = np.repeat(np.arange(len(texts)), count)
                at = np.arange(len(lines)) - np.repeat(np.cumsum(count) - count, count)
                w = Words.of(lines)
                keys, of_line, kinds, has = line_ids(w)
                key, line, word = runs(w)
                kind = np.r_[kinds, np.full(len(key), RUN_KIND)]
                key = (np.r_[keys, key] & ~3) | kind
                line = np.r_[of_line, line]
                place = (at[line] << 32) | (np.r_[np.zeros(len(keys), np.int64), word] << 2) | kind
                # two bytes of hash for each token of a line that has blocks
                coded, ends = np.where(has, w.size, 0), np.cumsum(count)
                tokens = [np.cumsum(np.r_[0, coded[e - m : e]]).tolist() for e, m in zip(ends, count)]
                code, stop = w.masked[np.repeat(has, w.size)].astype("<u2").tobytes(), 2 * np.cumsum([t[-1] for t in tokens])
                codes = [code[e - 2 * t[-1] : e] for e, t in zip(stop, tokens)]
                order = np.argsort(of[line], kind="stable")
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(of[line], minlength=len(texts)))], pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(key[order])), pa.ListArray.from_arrays(ends, pa.array(place[order])), pa.array(codes, pa.binary()), pa.array(tokens, pa.list_(pa.int32()))], names=schema.names)

    # ids of lines and runs, not texts; written once, as counting and dropping both read them
    keyed = shared_table(d.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    held = keyed.select("doc_id", F.explode(F.array_distinct("keys")).alias("key"))
    kind = F.col("key").bitwiseAND(F.lit(3))
    least = F.when(kind.isin(LINE, CLUSTER), F.lit(min_docs)).otherwise(F.lit(min(min_docs, long_docs)))
    counted = shared_table(held.groupBy("key").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first")).where(F.col("docs") >= least).select("key", "first", (F.col("docs") >= min_docs).alias("often")))
    lines = keyed.select("row", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.places").alias("place"))
    # one row per key on the right: broadcast if its measured size allows, else both sides are shuffled, and split where skewed
    hits = shared_table(lines.join(counted, "key"))
    exact = hits.where(kind != CLUSTER).select("row", "place", "first", "often")
    loose = _clusters(keyed, hits.where(kind == CLUSTER).select("row", "key", "place"), min_docs).withColumn("often", F.lit(True))
    hit = exact.unionByName(loose).groupBy("row").agg(F.collect_list(F.struct("place", "first", "often")).alias("x"))
    # equal rows have equal places: those of one of them
    heads = keyed.groupBy("doc_id", "text_key").agg(F.min("row").alias("row"))
    mine = F.transform("x.first", lambda x: x.eqNullSafe(F.col("doc_id")) if keep_first else F.lit(False))
    return hit.join(heads, "row").select("doc_id", "text_key", F.col("x.place").alias("places"), mine.alias("firsts"), F.col("x.often").alias("often"))


def drop_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, keep_first: bool = True, marks: tuple[str, str, str] = ("_lines", "_dropped", "_recurring"), long_docs: int = 2) -> DataFrame:
    """df with the recurring lines and runs cut from the texts, and as columns marks the numbers of lines, of lines that lost all or some of their words, and of
    lines that hold what recurs.

    With keep_first the document with the smallest id that holds a template keeps it (the last two numbers say what it kept): without it a text and its exact copies would
    all lose every line, and no later step could keep one of them.
    All columns and rows of df stay. A null text stays null; blank lines are never dropped; repeated rows are treated alike and
    each counts as a document. Rows without id count too, and are nobody's first document unless none has an id.
    """
    drops = recurring_lines(df, id_col, text_col, min_docs, keep_first, long_docs)
    names = df.columns
    at, key = names.index(text_col), names.index(id_col)
    d = df.toDF(*(f"c{i}" for i in range(len(names))))
    n = len(names)
    d = d.withColumn("k", F.xxhash64(f"c{at}"))
    packed = T.StructType([T.StructField(f.name, T.BinaryType()) if i == at else f for i, f in enumerate(d.schema)])
    schema = T.StructType([*d.schema[:n], T.StructField("lines", T.IntegerType()), T.StructField("lost", T.IntegerType()), T.StructField("held", T.IntegerType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for b in slices(batch, at):
                z = pa.array([c.compress(t.as_py().encode()) if t.is_valid else None for t in b.column(at)], pa.binary())
                yield pa.RecordBatch.from_arrays([z if i == at else b.column(i) for i in range(n + 1)], names=packed.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = zstandard.ZstdDecompressor()
        for batch in batches:
            for b in slices(batch, at, 1 << 20):
                texts, lines, lost, held = [], [], [], []
                for z, *x in zip(b.column(at), *(b.column(n + 1 + i) for i in range(3))):
                    t = c.decompress(z.as_py()).decode() if z.is_valid else None
                    lines.append(t.count("\n") + 1 if t is not None else 0)
                    t, gone, recurring = cut_text(t, *(i.as_py() for i in x)) if x[0].is_valid else (t, 0, 0)
                    texts.append(t)
                    lost.append(gone)
                    held.append(recurring)
                columns = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int32()), pa.array(lost, pa.int32()), pa.array(held, pa.int32())], names=schema.names)

    # texts go through the shuffle compressed
    joined = d.mapInArrow(pack, packed).join(drops.toDF("did", "tk", "places", "firsts", "often"), F.col(f"c{key}").eqNullSafe(F.col("did")) & (F.col("k") == F.col("tk")), "left")
    return joined.select(*packed.names, "places", "firsts", "often").mapInArrow(run, schema).toDF(*names, *marks)
