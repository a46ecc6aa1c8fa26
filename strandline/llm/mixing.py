"""Mixing sources to target weights by nested hash-threshold histograms.

Each row has a fixed hash of its id, source and text and, where rows repeat, its number among them. Sizes are summed by source and leading hash bits; the bucket in which a
source's budget runs out is split again by the next bits, and only the documents of that boundary bucket are
read for it. At the last level single hash values remain, so every source ends with one exact threshold, and
the mix is a filter against it. Nothing is sorted but histograms of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators import ordered
from strandline.runtime import own, shared_table

HASH_BITS = 60


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null counts 0."""
    spaced = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("long")


def row_key(doc_id: Column, source: Column, text: Column) -> Column:
    """A hash of what the mix knows of a row."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")), F.coalesce(text, F.lit(""))).cast("binary"))


def hashed(df: DataFrame, key: str, out: str) -> DataFrame:
    """out, in place of key: the first 60 bits of a hash of each row's key and number among its repeats (from 0), so that no two rows share it.

    Only rows that repeat are numbered, in two phases, as they may be a large part of the table. They are alike, so it doesn't matter which gets which number.
    """
    d = df.withColumnRenamed(key, "_key")
    again = shared_table(d.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key"))
    d = d.withColumn("_nth", F.lit(0).cast("long"))
    if not again.isEmpty():
        parts = ordered.dealt(d.drop("_nth").join(again, "_key", "left_semi").withColumn("_row", F.monotonically_increasing_id()), ["_key"], "_row")
        numbered = ordered.running_sum(parts, ["_key"], "_row", F.lit(1), "_nth").drop(ordered.PART, "_row")
        d = d.join(again, "_key", "left_anti").unionByName(numbered)
    bits = F.substring(F.md5(F.concat("_key", F.lit(":"), F.col("_nth").cast("string")).cast("binary")), 1, 15)
    return d.withColumn(out, F.conv(bits, 16, 10).cast("long")).drop("_key", "_nth")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """source, has, source_size -> plus weight, target: shares of the sum by weight, none above most * source_size.

    Sources in code-point order, null last, take the weights in turn. What a full source can't take goes to the
    others by weight; the level at which that ends is found from the sources ordered by how soon they fill.
    """
    # One row per source; the two windows are over that list only.
    ordered = sizes.withColumn("i", F.row_number().over(Window.orderBy(F.desc("has"), "source")))
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("i") - 1, F.lit(len(weights))).cast("int") + 1)
    d = ordered.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size"))
    d = d.withColumn("fills", F.col("cap").cast("double") / F.col("weight"))
    by_fill = Window.orderBy("fills", "i")
    every = Window.partitionBy(F.lit(0))
    before, after = by_fill.rowsBetween(Window.unboundedPreceding, -1), by_fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / F.sum("weight").over(after)
    d = d.withColumn("level", level)
    # min over the levels that hold for their own source: later ones repeat or exceed it
    first = F.min_by(F.when(F.col("level") <= F.col("fills"), F.col("level")), F.when(F.col("level") <= F.col("fills"), F.struct("fills", "i"))).over(every)
    d = d.withColumn("level", first)
    return d.select("source", "has", "source_size", "weight", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def thresholds(sized: DataFrame, budgets: DataFrame, levels: tuple[int, ...] = (12, 12, 36)) -> DataFrame:
    """The largest hash taken per source (-1: none), for budgets (source, has, rest) and sized (source, has, size, h).

    A document is taken if the middle of its own span of the running sum, in hash order, lies within rest; documents of
    one source and hash go together; rows have hashes of their own. So the sum is within half a document of rest.
    """
    key = ["source", "has"]
    left = budgets.select(*key, F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"))
    used = 0
    for depth, bits in enumerate(levels):
        shift = HASH_BITS - used - bits
        # the bits so far choose the boundary bucket, the next ones the part of it
        inside = sized.withColumn("prefix", F.shiftright("h", HASH_BITS - used)) if used else sized.withColumn("prefix", F.lit(0).cast("long"))
        inside = inside.join(left.select(*key, "prefix"), [*key, "prefix"], "left_semi") if used else inside
        parts = inside.withColumn("part", F.shiftright("h", shift)).groupBy(*key, "part").agg(F.sum("size").alias("n"))
        run = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("upto", F.sum("n").over(run)).join(left, key)
        last = depth == len(levels) - 1
        if last:
            took = F.when(F.col("upto") - F.col("n") / F.lit(2.0) <= F.col("left"), F.col("part"))
            floor = F.shiftleft(F.first("prefix"), HASH_BITS - used) - 1
            left = parts.groupBy(*key).agg(F.coalesce(F.max(took), floor).alias("upto_hash"))
        else:
            # the first part whose end is beyond the budget
            over = F.col("upto") > F.col("left")
            left = parts.where(over).groupBy(*key).agg(F.min_by(F.struct(F.col("part").alias("prefix"), (F.col("left") - (F.col("upto") - F.col("n"))).alias("left")), "part").alias("b")).select(*key, "b.prefix", "b.left")
        used += bits
    return left


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    d = own(df, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    size = word_count(F.col("text"))
    # keys and sizes in one pass over the texts
    d = shared_table(d.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNotNull().alias("has"), size.alias("size"), row_key(F.col("doc_id"), F.col("source"), F.col("text")).alias("key")))
    return hashed(d, "key", "h")


def _plan(sized: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: its target, whole rounds, and the largest hash taken once more. Written, as each level of the search reads it."""
    key = ["source", "has"]
    target = targets(sized.groupBy(*key).agg(F.sum("size").alias("source_size")), weights, most)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = shared_table(target.withColumn("rounds", rounds).withColumn("rest", F.col("target") - (F.col("rounds") * F.col("source_size")).cast("double")))
    # where whole rounds meet the target nothing is taken once more, empty texts neither
    return shared_table(plan.join(thresholds(sized, plan), key, "left").withColumn("upto_hash", F.when(F.col("rest") > 0, F.col("upto_hash")).otherwise(F.lit(-1))))


def _copies() -> Column:
    return F.col("rounds") + F.when(F.col("h") <= F.coalesce("upto_hash", F.lit(-1)), 1).otherwise(0)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, copies for every row.

    Size: the words of the text (null: 0). Targets: see targets(). taken: every document as often as whole rounds of its
    source fit the target, and once more below the source's hash threshold, times its size. Ids may be null or repeat;
    of rows that are alike in all, the mix takes as many as fit, and reruns agree. A null source is a source of its own, ordered last. An empty table
    gives an empty result; a source without words has target 0.
    """
    sized = _sized(df, id_col, text_col, source_col)
    sized = shared_table(sized)
    # one row per source on the right; the planner broadcasts it if its measured size allows, else both sides are shuffled
    out = sized.join(_plan(sized, weights, most), ["source", "has"])
    return out.select("doc_id", "size", F.when(F.col("has"), F.col("source")).alias("source"), "source_size", "target", (F.col("size") * _copies()).alias("taken"), _copies().alias("copies"))


def repeat_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The rows of df, all columns, each as often as the mix takes it; those it doesn't take are gone."""
    plan = _plan(shared_table(_sized(df, id_col, text_col, source_col)), weights, most).select(F.col("source").alias("s"), F.col("has").alias("k"), "rounds", "upto_hash")
    names = df.columns
    at = {n: f"c{names.index(n)}" for n in (id_col, text_col, source_col)}
    d = df.toDF(*(f"c{i}" for i in range(len(names))))
    d = hashed(d.withColumn("key", row_key(F.col(at[id_col]), F.col(at[source_col]), F.col(at[text_col]))), "key", "h")
    d = d.join(plan, (F.coalesce(at[source_col], F.lit("")) == F.col("s")) & (F.col(at[source_col]).isNotNull() == F.col("k"))).withColumn("n", _copies()).where("n > 0")
    return d.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
