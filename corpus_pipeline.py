"""From raw documents to token ids: toxicity, line dedup, near-dedup, source mix, BPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, linededup, minhash, mixing, queries, toxicity
from strandline.runtime import shared_table, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic. The model is fitted on labelled rows of the stage's own input."""
    return toxicity.keep_ordinary(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines, templates and runs of words that recur in 10 documents or more (2 if of 50 words or more), but for the first document that holds them.

    A document all of whose words were in such lines goes; n_chars follows the text.
    """
    # columns by position: others may have names that differ in case only
    names = docs.columns
    at = {n: f"c{names.index(n)}" for n in ("doc_id", "text", "n_chars") if n in names}
    cut = linededup.drop_lines(docs.toDF(*(f"c{i}" for i in range(len(names)))), at["doc_id"], at["text"], min_docs=10, marks=("lines", "dropped", "recurring"))
    cut = cut.where((F.col("dropped") == 0) | F.rlike(at["text"], F.lit(r"\S")))
    if "n_chars" in at:
        n = at["n_chars"]
        cut = cut.withColumn(n, F.when(F.col("dropped") > 0, F.length(at["text"])).otherwise(F.col(n)).cast(docs.schema[names.index("n_chars")].dataType))
    return cut.drop("lines", "dropped", "recurring").toDF(*names)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id. Of rows that repeat an id and its text one stays, the least by its other columns; rows without id stay."""
    names = docs.columns
    i, t = (f"c{names.index(n)}" for n in ("doc_id", "text"))
    d = docs.toDF(*(f"c{j}" for j in range(len(names))))
    found = minhash.near_duplicates(docs, width=5, threshold=0.8)
    kept = d.join(found.where("kept").select(F.col("doc_id").alias("kept")).distinct(), F.col(i) == F.col("kept"), "left_semi")
    others = F.to_json(F.struct(*(c for c in d.columns if c not in (i, t)), F.lit(0).alias("z")))
    one = kept.groupBy(i, F.xxhash64(t).alias("k")).agg(F.min_by(F.struct(*d.columns), others).alias("row")).select("row.*")
    return one.unionByName(d.where(F.col(i).isNull())).toDF(*names)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by the weights 1, 2, 3 takes them."""
    return mixing.repeat_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and the text decoded from the ids."""
    return bpe.round_trip(docs, queries.tokenizer_path()).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), "text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("near_dedup", near),
    ("source_mix", mixed),
    ("bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs)
    return docs


#: Sketches and token merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None
