"""Names of files, archives and strips as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names given where one is empty, and endings that count as archives and pictures.
EMPTY_PAGE, EMPTY_ARCHIVE, EMPTY_COMIC = "halaman", "arsip", "komik"
ZIP, RAR, SEVEN = ("zip", "cbz"), ("rar", "cbr"), ("7z", "cb7")
PICTURES = ("png", "jpg", "jpeg", "webp", "bmp", "gif")
KNOWN = (*ZIP, *RAR, *SEVEN, *PICTURES)


def basename(path: Column) -> Column:
    return F.regexp_replace(path, r"^.*[/\\]", "")


def extension(name: Column) -> Column:
    """After the last dot, lower-cased; empty without one."""
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def archive_kind(name: Column) -> Column:
    e = extension(name)
    return F.when(e.isin(*ZIP), "ZIP").when(e.isin(*RAR), "RAR").when(e.isin(*SEVEN), "SEVEN")


def is_picture(name: Column) -> Column:
    return extension(name).isin(*PICTURES)


def base_name(path: Column) -> Column:
    """The file name without its ending, if that is known and something is left."""
    b = basename(path)
    e = extension(b)
    return F.when(e.isin(*KNOWN) & (F.length(b) > F.length(e) + 1), F.substring(b, F.lit(1), F.length(b) - F.length(e) - 1)).otherwise(b)


def sanitise(name: Column, empty: str = EMPTY_PAGE) -> Column:
    """Safe as a file name: reserved characters to _, without white space and dots at the ends."""
    x = F.regexp_replace(name, r"""[\\/:*?"<>|]""", "_")
    x = F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^\.+|\.+$", "")
    return F.when(F.rlike(x, F.lit(r"\S")), x).otherwise(F.lit(empty))


def numbered(pattern: Column, series: Column, chapter: Column, n: Column, width: int, series_default: str = "series", chapter_default: str = "1") -> Column:
    """pattern with {series}, {chapter} and {n} filled in; n is padded with 0 to width and never cut."""
    number = n.cast("string")
    padded = F.when(F.length(number) < max(1, width), F.lpad(number, max(1, width), "0")).otherwise(number)
    filled = lambda c, d: F.when(F.rlike(c, F.lit(r"\S")), c).otherwise(F.lit(d))
    x = F.replace(pattern, F.lit("{series}"), filled(series, series_default))
    x = F.replace(x, F.lit("{chapter}"), filled(chapter, chapter_default))
    return F.replace(x, F.lit("{n}"), padded)


def pack_name(origin: Column, pack: Column, stamp: Column | None = None, empty: str = "pack") -> Column:
    """Name of the output archive: the input's name with the ending of pack (CBZ, else zip), and _stamp before it."""
    raw = F.regexp_replace(basename(origin), r"^\s+|\s+$", "")
    base = F.when(raw == "", F.lit(empty)).otherwise(raw)
    e = extension(base)
    stem = F.when(e.isin(*KNOWN) & (F.length(base) > F.length(e) + 1), F.substring(base, F.lit(1), F.length(base) - F.length(e) - 1)).otherwise(base)
    stem = F.when(F.rlike(stem, F.lit(r"\S")), stem).otherwise(F.lit(empty))
    if stamp is not None:
        stem = F.when(F.rlike(stamp, F.lit(r"\S")), F.concat(stem, F.lit("_"), stamp)).otherwise(stem)
    return F.concat(stem, F.when(pack == "CBZ", F.lit(".cbz")).otherwise(F.lit(".zip")))


def resolved_pack(override: Column, default: str) -> Column:
    return F.coalesce(override, F.lit(default))


def image_extension(fmt: Column) -> Column:
    return F.when(fmt == "JPG", "jpg").when(fmt == "PNG", "png").when(fmt == "WEBP", "webp")


def mime(fmt: Column) -> Column:
    return F.when(fmt == "JPG", "image/jpeg").when(fmt == "PNG", "image/png").when(fmt == "WEBP", "image/webp")


def _filled(name: Column, empty: str) -> Column:
    return F.when(F.rlike(name, F.lit(r"\S")), name).otherwise(F.lit(empty))


def default_file_name(pack: Column, series: Column, chapter: Column, fmt: Column, pattern: Column, width: int, series_default: str = "series", chapter_default: str = "1") -> Column:
    """What an output is called at first: <series>_ch<chapter> with the ending of pack, or the first numbered picture where pictures aren't packed."""
    stem = F.concat(_filled(series, series_default), F.lit("_ch"), _filled(chapter, chapter_default))
    single = F.concat(numbered(pattern, series, chapter, F.lit(1), width, series_default, chapter_default), F.lit("."), image_extension(fmt))
    return F.when(pack == "CBZ", F.concat(stem, F.lit(".cbz"))).when(pack == "ZIP", F.concat(stem, F.lit(".zip"))).otherwise(single)


def default_archive_name(pack: Column, series: Column, chapter: Column, series_default: str = "series", chapter_default: str = "1") -> Column:
    """<series>_ch<chapter>, each safe as a file name (as the defaults are), with the ending of pack (CBZ, else zip)."""
    safe = lambda name, empty: F.when(F.rlike(name, F.lit(r"\S")), sanitise(name)).otherwise(F.lit(empty))
    return F.concat(safe(series, series_default), F.lit("_ch"), safe(chapter, chapter_default), F.when(pack == "CBZ", ".cbz").otherwise(".zip"))


def export_mime(pack: Column, fmt: Column) -> Column:
    return F.when(pack == "CBZ", "application/x-cbz").when(pack == "ZIP", "application/zip").otherwise(mime(fmt))


def batch_name(origin: Column, pack: Column) -> Column:
    """Of a batch each output has its own name: that of the archive it comes from, or else its title, safe as a file name."""
    return F.when(archive_kind(origin).isNotNull(), pack_name(origin, pack)).otherwise(pack_name(sanitise(_filled(origin, EMPTY_COMIC)), pack))


def unique_names(name: Column, rank: Column) -> Column:
    """name, name_1, name_2, ... by rank among equal names (from 1)."""
    return F.when(rank == 1, name).otherwise(F.concat(name, F.lit("_"), (rank - 1).cast("string")))


def format_size(n: Column) -> Column:
    return F.when(n < 1048576, F.concat((n / 1024).cast("long").cast("string"), F.lit(" KB"))).otherwise(F.format_string("%.1f MB", n / 1048576.0))


def display_name(name: Column, path: Column, empty: str = EMPTY_ARCHIVE) -> Column:
    last = F.substring_index(path, "/", -1)
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(last, F.lit("")), F.lit(empty))


def page_limit(text: Column) -> Column:
    """Digits of a typed number, three at most, between 1 and 200; without digits null."""
    digits = F.left(F.regexp_replace(text, "[^0-9]", ""), F.lit(3))
    return F.when(digits != "", F.least(F.greatest(digits.cast("int"), F.lit(1)), F.lit(200)))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")
