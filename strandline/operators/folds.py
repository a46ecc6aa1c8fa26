"""Sequential folds over sorted partitions.

Some operators depend on their own earlier decisions and have no window form. They run as one pass over rows that are
dealt by group and sorted within partitions; a fold sees one group's rows as an iterator, so memory is what the
fold itself keeps and not the size of the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.runtime import ship

Fold = Callable[[Iterator[tuple]], Iterable[tuple]]


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], columns: list[str], fold: Fold, fields: str, batch: int = 20_000) -> DataFrame:
    """keys and fields of what fold yields for each group. fold gets the group's rows, in order, as tuples of columns.

    Rows come in Arrow batches, so whole numbers stay exact beside nulls. A null key is a group of its own.

    Rows are dealt by a hash of the keys, not by the keys: a shuffle by keys is left out where the rows seem to lie so already, and then adaptive execution,
    which sees no need of it after a map, may still split them (parts of a union read apart, a skewed side of a join).
    """
    ship(df.sparkSession)
    picked = df.select(*keys, *order, *columns)
    names = [f"k{i}" for i in range(len(keys))] + [f"o{i}" for i in range(len(order))] + [f"c{i}" for i in range(len(columns))]
    sort_keys = names[: len(keys) + len(order)]
    dealt = picked.toDF(*names).repartition(F.xxhash64(*names[: len(keys)])).sortWithinPartitions(*sort_keys)
    schema = T.StructType([T.StructField(k, f.dataType) for k, f in zip(keys, picked.schema.fields)] + T.StructType.fromDDL(fields).fields)
    nk, skip = len(keys), len(keys) + len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), types)], schema=types)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        out: list[tuple] = []
        for key, group in groupby(rows, key=itemgetter(*range(nk)) if nk > 1 else lambda r: (r[0],)):
            for x in fold(r[skip:] for r in group):
                out.append((*key, *x))
                if len(out) >= batch:
                    yield made(out)
                    out = []
        if out:
            yield made(out)

    return dealt.mapInArrow(run, schema)
