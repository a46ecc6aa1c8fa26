"""Chat formatting by quotation linking.

Lines that begin with > are quotes, nested as deep as they have marks. At each level, quoted lines and whole quoted passages (whatever
their line breaks) are normalised and hashed; the hashes find all earlier messages of the conversation that hold them as their own. So every
level has a message it comes from, that most of its lines agree with, and the message of the outermost level is the one replied to. Messages
lose their quotes and get a position that puts each after the one it answers, next to its other answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import ordered
from strandline.runtime import own

# (?s): a line ends at a line feed only, other separators are part of it
_MARKS = r"(?s)\A((?:[ \t]*>)+)[ \t]?(.*)\z"
_SAYS = r"(?is)\A(?:on|le|am|el)\b.*(?:wrote|a écrit|schrieb|escribió)\s*:\s*\z"


def parse(text: Column) -> Column:
    """array<struct<depth int, line string>> of a text: depth 0 is the author's own."""
    one = lambda x: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(x, _MARKS, 1), r"[^>]", "")).cast("int").alias("depth"),
        F.when(F.rlike(x, F.lit(_MARKS)), F.regexp_extract(x, _MARKS, 2)).otherwise(x).alias("line"),
    )
    return F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n"), one)


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\s\p{Punct}]+", " "))


def _passages(parts: Column) -> Column:
    """array<struct<level, h, lines>>: lines of one depth in a row, without blank ones between them, hashed as one."""
    before = lambda i: F.get(parts, i - 1)
    piece = lambda p, i: F.concat(
        F.when((i > 0) & (before(i)["depth"] == p["depth"]) & (normal(p["line"]) != "") & (normal(before(i)["line"]) != ""), F.lit("\n")).otherwise(F.concat(F.lit("\x01"), p["depth"].cast("string"), F.lit("\x02"))),
        F.translate(p["line"], "\x01\x02", ""),
    )
    cut = F.transform(F.split(F.array_join(F.transform(parts, piece), ""), "\x01"), lambda x: F.struct(F.substring_index(x, "\x02", 1).try_cast("int").alias("level"), normal(F.substring_index(x, "\x02", -1)).alias("text"), (F.size(F.split(x, "\n")).cast("long")).alias("lines")))
    return F.transform(F.filter(cut, lambda x: x["level"].isNotNull() & (x["text"] != "")), lambda x: F.struct(x["level"].alias("level"), F.xxhash64(F.lit("passage"), x["text"]).alias("h"), x["lines"].alias("lines")))


def _keyed(parts: Column) -> Column:
    """array<struct<level, h, lines>> of the lines (lines 0) and the passages (their numbers of lines)."""
    line = F.transform(F.filter(parts, lambda p: normal(p["line"]) != ""), lambda p: F.struct(p["depth"].alias("level"), F.xxhash64(normal(p["line"])).alias("h"), F.lit(0).cast("long").alias("lines")))
    return F.concat(line, _passages(parts))


def link_quotes(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text (without quotes), quoted (lines), depth, links, reply_to, matched (lines), message, position.

    links: array of (level, source, matched), one for each quoted level that an earlier message of this conversation holds: the message with
    most of its lines, of equals the latest. reply_to is the source of the outermost of them, null if there is none. Sorted by position (from 0), the messages
    of a conversation are a dialogue in which each comes after the one it answers. Lines "On ... wrote:" right before a quote are dropped with it. message: role and
    text in the chat form. Rows of equal conv_id and turn share their links; rows without either get none, and rows without turn come first. Every row gives one row.
    """
    d = own(df, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text").withColumn("parts", parse(F.col("text")))
    depth = F.coalesce(F.array_max(F.transform("parts", lambda p: p["depth"])), F.lit(0))
    quotes = F.filter("parts", lambda p: p["depth"] > 0)
    d = d.withColumn("depth", depth).withColumn("quoted", F.size(quotes))
    quoting = d.where(F.col("depth") > 0)
    asked = quoting.select("conv_id", "turn", F.explode(_keyed(F.col("parts"))).alias("q")).where("q.level > 0").groupBy("conv_id", "turn", "q.level", "q.h").agg(F.max("q.lines").alias("lines"))
    # every message that holds an asked line or passage: a repeated message collects votes like the one it repeats
    held = d.where(F.col("turn").isNotNull()).select("conv_id", "turn", F.explode(_keyed(F.col("parts"))).alias("q")).where("q.level = 0").select("conv_id", F.col("turn").alias("source"), "q.h").distinct().join(asked.select("conv_id", "h").distinct(), ["conv_id", "h"], "left_semi")
    found = asked.join(held, ["conv_id", "h"]).where(F.col("source") < F.col("turn"))
    lines = F.col("lines")
    votes = found.groupBy("conv_id", "turn", "level", "source").agg(F.greatest(F.count_if(lines == 0), F.sum(lines)).alias("matched"))
    best = votes.groupBy("conv_id", "turn", "level").agg(F.max(F.struct("matched", "source")).alias("b"))
    # as many as a message has levels
    links = best.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("level", F.col("b.source").alias("source"), F.col("b.matched").alias("matched")))).alias("links"))
    own_lines = F.filter("parts", lambda p, i: (p["depth"] == 0) & ~(F.rlike(p["line"], F.lit(_SAYS)) & (F.coalesce(F.get("parts", i + 1)["depth"], F.lit(0)) > 0)))
    bare = F.when(F.col("depth") == 0, F.col("text")).otherwise(F.regexp_replace(F.array_join(F.transform(own_lines, lambda p: p["line"]), "\n"), r"\A\s+|\s+\z|(?<=\n)\n+(?=\n)", ""))
    out = d.join(links, ["conv_id", "turn"], "left")
    text = F.coalesce(bare, F.lit(""))
    first = F.get("links", F.lit(0))
    out = out.select(
        "conv_id", "turn", "role", text.alias("text"), "quoted", "depth", F.coalesce("links", F.expr("array()")).alias("links"), first["source"].alias("reply_to"), F.coalesce(first["matched"], F.lit(0)).cast("long").alias("matched"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), text, F.lit("\n<|end|>\n")).alias("message"),
    )
    # an answer stands behind the message it answers, which stands earlier, as its own key begins with a smaller turn
    key = F.struct(F.coalesce("reply_to", "turn").alias("a"), F.when(F.col("reply_to").isNotNull(), F.col("turn")).alias("b"), F.xxhash64("message").alias("c"))
    placed = ordered.running_sum(ordered.dealt(out.withColumn("_key", key), ["conv_id"], "_key"), ["conv_id"], "_key", F.lit(1), "position")
    return placed.select(*out.columns, "position")
