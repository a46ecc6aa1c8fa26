"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart: one on windows of ordinary text, one on windows of toxic text. A window is
compressed with the ordinary dictionary, and with the toxic one before the ordinary one; what it is shorter by is its gain. (Each
dictionary alone was tried: texts that resemble neither then differ by chance, which hides short toxic passages.) The gains of
a document's windows make its features, and a logistic curve calibrated on labelled rows turns them into a score that is compared with a threshold.

A toxic text is mostly ordinary, so the toxic dictionary is trained in rounds. Labelled texts are dealt into folds; each fold is
compressed with dictionaries of the other folds. Windows of toxic texts that gain as ordinary ones hardly ever do are cut down, by the gains of
overlapping windows, to the part that gains, and the next toxic dictionary is trained on those parts. Calibration sees only gains of texts that
the dictionaries were not trained on, and the round with the least log loss there is kept. Texts are read in Spark tasks;
the driver gets a bounded number of windows to train on, and one short row a labelled text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from strandline.llm.shingles import slices
from strandline.runtime import own, shared_table, ship

WINDOW = 12  # words compared at once
PART = 4  # words of the windows that training windows are chosen from
PIECE = 256  # longer words are cut into pieces of so many bytes
FOLDS = 4
ORDINARY_BYTES, ROUND_BYTES, TOXIC_BYTES = 100_000, 4096, 2048
#: By how much more often than ordinary windows those of toxic texts must reach a gain to be trained on, by round.
LIFTS = (8, 16, 24, 30)
#: The bound of the labelled rows that a model is fitted on.
FIT_ROWS = 10_000
#: The bounds of the windows that a dictionary is trained on: those whose hash is lowest.
ORDINARY_WINDOWS, TOXIC_WINDOWS = 200_000, 200_000

Pair = tuple[zs.ZstdCompressor, zs.ZstdCompressor]


def words(raw: bytes) -> list[bytes]:
    w = raw.split()
    if len(raw) > PIECE and any(len(x) > PIECE for x in w):
        return [x[i : i + PIECE] for x in w for i in range(0, len(x), PIECE)]
    return w


def windows(w: list[bytes], size: int) -> list[bytes]:
    return [b" " + b" ".join(w[i : i + size]) + b" " for i in range(0, len(w), size)]


def trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """A trained dictionary; of samples too few to train on, the samples themselves."""
    try:
        return zs.train_dictionary(size, samples, **how).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def ordinary_dictionary(samples: list[bytes]) -> bytes:
    return trained(samples, ORDINARY_BYTES, k=48, d=8)


def toxic_dictionary(samples: list[bytes], size: int = TOXIC_BYTES) -> bytes:
    return trained(samples, size, k=16, d=6)


def compressors(ordinary: bytes, toxic: bytes, min_match: int) -> Pair:
    how = zs.ZstdCompressionParameters(window_log=17, hash_log=17, chain_log=17, search_log=10, min_match=min_match, target_length=64, strategy=zs.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for content in (ordinary, toxic + ordinary):
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        out.append(zs.ZstdCompressor(dict_data=d, compression_params=how))
    return out[0], out[1]


def gains(some: list[bytes], pair: Pair) -> list[int]:
    a, b = pair[0].compress, pair[1].compress
    return [len(a(w)) - len(b(w)) for w in some]


def features(w: list[bytes], pair: Pair) -> list[float]:
    g = np.array(gains(windows(w, WINDOW), pair) or [0])
    best = np.sort(g)[::-1]
    return [float(x) for x in (best[0], best[:3].sum(), np.maximum(g - 1, 0).sum(), g.mean(), (g >= 2).mean(), (g >= 3).sum(), (g >= 4).sum(), math.log(len(g)))]


def gaining(w: list[bytes], g: list[int], pair: Pair, narrow: bool) -> Iterator[tuple[int, int, bytes]]:
    """(gain, hash of its surroundings, window) for each window of PART words that gains; narrow: cut down to the word whose overlapping windows gain most."""
    for j, gain in enumerate(g):
        if gain < 1:
            continue
        if not narrow:
            yield gain, 0, b" " + b" ".join(w[j * PART : (j + 1) * PART]) + b" "
            continue
        at = range(j * PART, min((j + 1) * PART, len(w)))
        first = max(0, at[0] - PART + 1)
        around = np.array(gains([b" " + b" ".join(w[s : s + PART]) + b" " for s in range(first, at[-1] + 1)], pair))
        p = max(at, key=lambda p: around[max(0, p - PART + 1 - first) : p + 1 - first].mean())
        yield gain, xxh3_64_intdigest(b" ".join(w[max(0, p - 1) : p + 2])) >> 1, b" " + w[p] + b" "


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    prior: float
    mean: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    loss: float = math.inf

    def compressors(self) -> Pair | None:
        return compressors(self.ordinary, self.toxic, 5) if self.weights else None

    def scores(self, texts: list[str], pair: Pair | None) -> np.ndarray:
        """Of texts, null ones as empty; without dictionaries each score is the share of toxic labels."""
        if pair is None:
            return np.full(len(texts), self.prior)
        return self.curve(np.array([features(words((t or "").encode()), pair) for t in texts]).reshape(-1, len(self.mean)))

    def curve(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ np.array(self.weights[:-1]) + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0).tolist(), (x.std(axis=0) + 1e-9).tolist()
        a = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(a.shape[1])
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w -= np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.eye(len(w)), a.T @ (p - y) + w)
        self.weights = w.tolist()
        p = np.clip(self.curve(x), 1e-6, 1 - 1e-6)
        self.loss = float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(text, y, fold) of at most rows labelled texts, those whose id hashes lowest. Equal texts share a fold."""
    chosen = own(labels, id_col, label_col).toDF("doc_id", "y").where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.groupBy("doc_id").agg(F.max("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # at most rows ids and labels
    found = own(docs, id_col, text_col).toDF("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id").agg(F.max(F.struct("text", "y")).alias("x")).select("x.text", "x.y")
    return shared_table(one.select("text", "y", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")))


def _lowest(df: DataFrame, n: int) -> list[tuple[int, bytes]]:
    """(fold, window) of the n windows whose hash, with their surroundings, is lowest: equal ones are spread, as the trainer takes them in parts."""
    got = df.select("fold", "window", "around").orderBy(F.xxhash64("window", "around"), "fold").limit(n).toArrow()
    return list(zip(got.column(0).to_pylist(), got.column(1).to_pylist()))


def _windows_of(sample: DataFrame, label: int, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, 0):
                found = [windows(words(t.as_py().encode()), size) for t in b.column(0)]
                folds = np.repeat(b.column(2).to_numpy(), [len(x) for x in found])
                yield pa.RecordBatch.from_arrays([pa.array(folds, pa.int32()), pa.array([w for x in found for w in x], pa.binary()), pa.array(np.zeros(len(folds), np.int64))], names=["fold", "window", "around"])

    return sample.where(F.col("y") == label).mapInArrow(run, "fold int, window binary, around long")


_STUDY = "fold int, y int, gain int, n long, around long, window binary, x array<double>"


def _study(sample: DataFrame, ordinary: list[bytes], toxic: list[bytes], narrow: bool) -> DataFrame:
    """Every text under the dictionaries of the other folds: numbers of windows by gain, parts that gain (of toxic texts), features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choose = [compressors(o, t, 4) for o, t in zip(ordinary, toxic)]
        compare = [compressors(o, t, 5) for o, t in zip(ordinary, toxic)]
        schema = pa.schema([("fold", pa.int32()), ("y", pa.int32()), ("gain", pa.int32()), ("n", pa.int64()), ("around", pa.int64()), ("window", pa.binary()), ("x", pa.list_(pa.float64()))])
        for batch in batches:
            for b in slices(batch, 0, 1 << 20):
                rows = []
                for t, y, f in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                    w = words(t.as_py().encode())
                    g = gains(windows(w, PART), choose[f])
                    values, counts = np.unique(np.maximum(g, 0), return_counts=True)
                    rows += [(f, y, int(v), int(n), None, None, None) for v, n in zip(values, counts)]
                    if y:
                        rows += [(f, y, gain, None, around, part, None) for gain, around, part in gaining(w, g, choose[f], narrow)]
                    rows.append((f, y, None, None, None, None, features(w, compare[f])))
                yield pa.RecordBatch.from_arrays([pa.array(c, s.type) for c, s in zip(zip(*rows), schema)], schema=schema)

    return shared_table(sample.mapInArrow(run, _STUDY))


def _least_gain(study: DataFrame, lift: float) -> int | None:
    """The least gain that windows of toxic texts reach lift times as often as others."""
    at = study.where("n is not null").groupBy("y", "gain").agg(F.sum("n").alias("n")).collect()  # a row per label and gain of a window
    of = lambda y, least: sum(r["n"] for r in at if r["y"] == y and r["gain"] >= least)
    all_0, all_1 = of(0, 0), of(1, 0)
    return next((t for t in range(1, max((r["gain"] for r in at), default=0) + 1) if of(1, t) and of(1, t) * all_0 >= lift * of(0, t) * all_1), None)


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = FIT_ROWS, lifts: tuple[float, ...] = LIFTS) -> Model:
    """A model of at most rows labelled texts; ids that are held out are never used.

    Without texts of both labels, or if no window of toxic texts stands out, it has no dictionaries and its score is the share of toxic labels.
    """
    ship(docs.sparkSession)
    sample = _sample(docs, labels, id_col, text_col, label_col, rows)
    n, prior = sample.agg(F.count("*"), F.coalesce(F.avg("y"), F.lit(0.0))).first()
    best = Model(b"", b"", float(prior))
    if not n or prior in (0.0, 1.0):
        return best
    others = lambda found, f: [w for g, w in found if g != f]
    plain = _lowest(_windows_of(sample, 0, WINDOW), ORDINARY_WINDOWS)
    ordinary = [ordinary_dictionary(others(plain, f)) for f in range(FOLDS)]
    chosen = _lowest(_windows_of(sample, 1, PART).distinct(), TOXIC_WINDOWS)
    for i in range(len(lifts) + 1):
        study = _study(sample, ordinary, [toxic_dictionary(others(chosen, f), ROUND_BYTES) for f in range(FOLDS)], narrow=i > 0)
        got = study.where("x is not null").select("y", "x").toArrow()  # one short row a labelled text
        model = Model(b"", b"", float(prior))
        x, y = np.array(got.column(1).to_pylist()), got.column(0).to_numpy().astype(np.float64)
        order = np.lexsort([*x.T, y])  # sums don't depend on the order of tasks
        model.calibrate(x[order], y[order])
        if i and model.loss < best.loss:
            model.toxic, best = toxic_dictionary([w for _, w in chosen]), model
        least = _least_gain(study, lifts[i]) if i < len(lifts) else None
        if least is None:
            break
        # the same words in the same surroundings, as copies have them, are one
        parts = study.where(F.col("window").isNotNull() & (F.col("gain") >= least)).groupBy("window", "around").agg(F.min("fold").alias("fold"))
        chosen = _lowest(parts, TOXIC_WINDOWS)
    if best.weights:
        best.ordinary = ordinary_dictionary([w for _, w in plain])
    return best


def score(df: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of each whole text; a null text counts as empty. Rows are judged one by one; an empty table gives none."""
    ship(df.sparkSession)
    d = own(df, id_col, text_col)
    schema = T.StructType([d.schema[0], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for batch in batches:
            for b in slices(batch, 1):
                s = model.scores(b.column(1).to_pylist(), pair)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return d.mapInArrow(run, schema)


def keep_ordinary(df: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text is predicted ordinary; all rows if the model has no dictionaries."""
    ship(df.sparkSession)
    names = df.columns
    at = names.index(text_col)
    d = df.toDF(*(f"c{i}" for i in range(len(names))))
    if not model.weights:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = model.compressors()
        for batch in batches:
            for b in slices(batch, at):
                yield b.filter(pa.array(model.scores(b.column(at).to_pylist(), pair) < threshold))

    return d.mapInArrow(run, d.schema).toDF(*names)
