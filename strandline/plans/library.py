"""A library of series: edits, imports, batches and sweeps as transformations of tables.

series: series, origin, pack (null: the setting), created; pages: series, page (order), uri, title.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import names
from strandline.operators import grouping, lookup
from strandline.sources import archives
from strandline.sources.settings import Settings


def pages_of(library: DataFrame, uris: str = "uris", titles: str = "titles") -> DataFrame:
    """series, page, uri, title from one row per series; a missing title is "Halaman n"."""
    d = library.select("series", F.posexplode(uris).alias("page", "uri"), F.col(titles).alias("_t"))
    return d.select("series", "page", "uri", F.coalesce(F.get("_t", F.col("page")), F.concat(F.lit("Halaman "), F.col("page") + 1)).alias("title"))


def set_pack(library: DataFrame, series: str, pack: str | None) -> DataFrame:
    """Sets a series' own pack; setting the one it has clears it."""
    hit = F.col("series") == series
    return library.withColumn("pack", F.when(hit & F.col("pack").eqNullSafe(F.lit(pack)), F.lit(None).cast("string")).when(hit, F.lit(pack).cast("string")).otherwise(F.col("pack")))


def remove(library: DataFrame, series: str) -> DataFrame:
    return library.where(~F.col("series").eqNullSafe(F.lit(series)))


def move(pages: DataFrame, keys: list[str], order: str, at: Column, by: int) -> DataFrame:
    """Swaps the row whose order is at with its neighbour above (by -1) or below (by 1); at the end nothing moves."""
    last = F.max(order).over(Window.partitionBy(*keys))
    first = F.min(order).over(Window.partitionBy(*keys))
    to = at + by
    moves = (to >= first) & (to <= last)
    return pages.withColumn(order, F.when(moves & (F.col(order) == at), to).when(moves & (F.col(order) == to), at).otherwise(F.col(order)))


def route(uris: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(archives, pictures): what can be opened as an archive, and the rest."""
    kind = names.archive_kind(F.col(name))
    return uris.where(kind.isNotNull()), uris.where(kind.isNull())


def new_uris(uris: DataFrame, known: DataFrame, uri: str, order: str) -> DataFrame:
    """First occurrence of each uri that known doesn't hold."""
    return lookup.unreferenced(lookup.first_of_each(uris, [uri], order), known, [uri])


def import_archives(files: DataFrame, name: str = "path", content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(pages: series, page, uri, title, content; failed: archive, error). One broken archive doesn't stop the others."""
    got = archives.unpack(files, name, content)
    pages = archives.numbered_entries(got.where("error is null"), ["archive"])
    pages = pages.select(names.base_name(F.col("archive")).alias("series"), (F.col("n") - 1).alias("page"), F.concat_ws("/", "archive", "file").alias("uri"), F.col("entry").alias("title"), "content")
    return pages, got.where("error is not null").select("archive", "error")


def outcomes(library: DataFrame, settings: Settings, strips: DataFrame) -> DataFrame:
    """series, archive, strips, flagged, error: one row per series with pages, by its own pack or the setting's."""
    made = strips.groupBy("series").agg(F.countDistinct("bundle").alias("strips"), F.count_if(F.col("tall") | F.col("seam_cut") | F.col("forced")).alias("flagged"))
    d = with_pages(library).join(made, "series", "left").withColumn("pack", names.resolved_pack(F.col("pack"), settings.pack))
    return d.select("series", names.batch_name(F.coalesce("origin", "series"), F.col("pack")).alias("archive"), F.coalesce("strips", F.lit(0)).alias("strips"), F.coalesce("flagged", F.lit(0)).alias("flagged"), F.when(F.col("strips").isNull(), F.lit("no readable page")).alias("error"))


def with_pages(library: DataFrame) -> DataFrame:
    """The series that have pages; others are no work for a batch."""
    return library.where(F.size("uris") > 0)


def results(strips: DataFrame) -> DataFrame:
    """series, bundle, pieces, height, flagged, reason, banner_cut: one row per strip of strips.build(), for review."""
    one = strips.groupBy("series", "bundle").agg(F.count("*").alias("pieces"), F.sum("rendered").alias("height"), *(F.bool_or(c).alias(c) for c in ("tall", "forced", "seam_cut", "banner_cut")))
    reason = grouping.flag_reason(F.col("tall"), F.col("forced"), F.col("seam_cut"))
    return one.select("series", "bundle", "pieces", "height", reason.isNotNull().alias("flagged"), reason.alias("reason"), "banner_cut")


def swept(files: DataFrame, referenced: DataFrame, path: str = "path", size: str = "length") -> tuple[DataFrame, DataFrame]:
    """(files to delete, one row: files and bytes before and after): mark and sweep of a cache."""
    gone = lookup.unreferenced(files, referenced, [path])
    before = files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    removed = gone.agg(F.count("*").alias("gone"), F.coalesce(F.sum(size), F.lit(0)).alias("gone_bytes"))
    return gone, before.join(removed).select("files", "bytes", (F.col("files") - F.col("gone")).alias("files_after"), (F.col("bytes") - F.col("gone_bytes")).alias("bytes_after"))  # one row each


def cut_marks(strips: DataFrame, preview_width: int, strip_width: int) -> DataFrame:
    """series, bundle, segment, y, colour: where each piece of a strip ends in its preview; red if forced, else green."""
    d = grouping.running_offset(strips, ["series", "bundle"], "segment", "rendered", "_o")
    y = F.floor((F.col("_o") + F.col("rendered")) * preview_width / strip_width)
    return d.select("series", "bundle", "segment", y.cast("long").alias("y"), F.when(F.col("forced"), "red").otherwise("green").alias("colour"))


def failures(outcome: DataFrame, name: str, error: str, shown: int = 3) -> Callable[[], str]:
    """A message with the first names that failed and the number of all; at most shown rows reach the driver."""

    def message() -> str:
        bad = outcome.where(F.col(error).isNotNull())
        first = [r[0] for r in bad.select(name).orderBy(name).limit(shown).collect()]
        n = bad.count() if len(first) == shown else len(first)
        return ", ".join(first) + (f" (+{n - shown})" if n > shown else "")

    return message
