"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a pre-token one token is the last of its encoding. Candidates for it are the tokens that
are suffixes of the prefix, which an Aho-Corasick suffix automaton over the vocabulary reports; a candidate
holds if it and the last token of the prefix before it are compatible, that is, if merging their bytes gives
back the two. A sequence whose neighbours are all compatible is the encoding, so exactly one candidate holds,
and following the stored tokens back from the end yields the ids. Time is linear in the text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandline.runtime import own, ship

#: The pre-tokens of byte-level vocabularies, with white space as Unicode's White_Space.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Bounds of what a worker remembers; beyond them it starts anew.
CACHED_WORDS, CACHED_PAIRS = 300_000, 300_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Words(dict):
    """Ids of pre-tokens met before, as bytes: two generations, so that frequent ones stay when the older is let go."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.old = codec, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = np.array(self.codec.encode_word(word), dtype=np.int32).tobytes()
            if len(word) > 64:
                return ids
        if len(self) >= CACHED_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path}: only byte-level BPE without normalizer or prefix space is supported")
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError(f"{path}: added tokens that strip or match whole words are not supported")
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        raw = lambda s: bytes(byte_of[c] for c in s)
        vocab = {s: i for s, i in model["vocab"].items() if s not in specials}
        self.bytes_of: dict[int, bytes] = {i: raw(s) for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in specials.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = dict.fromkeys(self.bytes_of, -1)
        self.halves: dict[int, tuple[int, int]] = {}
        for m, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = m
            if z not in self.halves:
                self.halves[z], self.rank[z] = (x, y), m
        self.fits: dict[int, bool] = {}
        self.words = Words(self)
        self.single: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            b = raw(s)
            if len(b) == 1:
                self.single[b.decode("latin-1")] = i
            elif i in self.halves and self._meets(*self.halves[i], below=self.rank[i]):
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        self.pre = regex.compile(PATTERN)
        self.specials = specials
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(specials, key=len, reverse=True))) + ")") if specials else None

    def _meets(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """Whether no merge across the boundary of a and b (of a rank lower than below) comes before a and b are whole.

        The tokens at the boundary are undone from the last merge back: at each moment a merge across it would win if
        it ranks before the merge that takes in the left neighbour, and not after the one that takes in the right.
        """
        left_until = right_until = below
        while True:
            m = self.merge.get((a, b))
            if m is not None and m < left_until and m <= right_until and m < below:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                left_until, a = ra, self.halves[a][1]
            else:
                right_until, b = rb, self.halves[b][0]

    def compatible(self, a: int, b: int) -> bool:
        if len(self.fits) > CACHED_PAIRS:
            self.fits.clear()
        got = self.fits[a << 24 | b] = self._meets(a, b)
        return got

    def encode_word(self, word: str) -> list[int]:
        """Tokens of one byte stand in no automaton: of the one candidate that holds, they are it where no longer one is."""
        chars = word if word.isascii() else word.encode("utf-8").decode("latin-1")
        last = [-1] * (len(chars) + 1)
        size = last[:]
        fits, single, done = self.fits.get, self.single, 0
        for end, (token, n) in self.automaton.iter(chars):
            while done < end:
                done += 1
                if last[done] < 0:
                    last[done], size[done] = single[chars[done - 1]], 1
            end += 1
            if last[end] < 0:
                start = end - n
                if start:
                    before = last[start]
                    ok = fits(before << 24 | token)
                    if ok is None:
                        ok = self.compatible(before, token)
                    if not ok:
                        continue
                last[end], size[end] = token, n
        while done < len(chars):
            done += 1
            if last[done] < 0:
                last[done], size[done] = single[chars[done - 1]], 1
        out, at = [], len(chars)
        while at:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        parts = self.cut.split(text) if self.cut else [text]
        raw = [np.int32(self.specials[p]).tobytes() if i % 2 else b"".join(map(self.words.__getitem__, self.pre.findall(p))) for i, p in enumerate(parts)]
        return np.frombuffer(b"".join(raw), dtype=np.int32)

    def decode(self, ids: list[int]) -> str:
        try:
            raw = b"".join(map(self.bytes_of.__getitem__, ids))
        except KeyError:
            raw = b"".join(self.bytes_of[i] for i in ids if i in self.bytes_of)
        return raw.decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One per Python worker and vocabulary."""
    return Codec(path)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))


def _slices(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of about most bytes in the column, one row at least, so that very long rows don't add up."""
    start, total = 0, 0
    c = batch.column(column)
    sizes = (pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c)).fill_null(0).to_pylist()
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) per row: the whole text's token ids; a null text counts as empty and has none.

    Strings of the vocabulary's special tokens become those tokens. Every row gives one row; repeated rows stay, and an
    empty table gives none. The vocabulary file must be readable at this path on the executors.
    """
    ship(df.sparkSession)
    d = own(df, id_col, text_col)
    schema = T.StructType([d.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for b in _slices(batch, 1, 4 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0), _lists([c.encode(t.as_py() or "") for t in b.column(1)])], names=[id_col, "ids"])

    return d.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep_ids: bool = True) -> DataFrame:
    """(id, ids, text): the text of the ids, special tokens included, bytes that are not UTF-8 as U+FFFD; null ids give ''.

    Ids outside the vocabulary are left out, as the tokenizer's own decoder does.
    """
    ship(df.sparkSession)
    d = own(df, id_col, ids_col)
    schema = T.StructType([d.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for b in _slices(batch, 1, 4 << 20):
                ids = b.column(1).cast(pa.list_(pa.int32()))
                flat, ends = ids.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *pc.list_value_length(ids).fill_null(0).to_pylist()])
                texts = pa.array([c.decode(flat[s:e].tolist()) for s, e in zip(ends, ends[1:])], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), ids, texts], names=[id_col, "ids", "text"])

    return d.mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, text) per row: what encode() gives, and what decode() makes of it, in one Python stage instead of two."""
    ship(df.sparkSession)
    d = own(df, id_col, text_col)
    schema = T.StructType([d.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            for b in _slices(batch, 1, 4 << 20):
                ids = [c.encode(t.as_py() or "") for t in b.column(1)]
                texts = pa.array([c.decode(x.tolist()) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids), texts], names=[id_col, "ids", "text"])

    return d.mapInArrow(run, schema)
