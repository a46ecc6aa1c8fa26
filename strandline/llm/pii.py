"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score. Column expressions only.

Patterns are possessive where a match can't depend on giving back, so long runs neither overflow the matcher's stack nor cost more than their length.
A pattern's matches and the gaps between them come from two passes over the text; their running lengths are the spans, and the ends of the gaps are what stands nearby.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.runtime import own

#: The base kinds, in the order of reports, and their patterns (possessive forms of the same languages).
LOCAL, LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Added proposals: a card within a run of digits that is no card, a phone number without +, an account number.
CARD_GROUPS = r"[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}"
PHONE_GROUPS = r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
CONTEXT = 40
#: What a proposal is worth, of 100: by kind, if its checksum or form holds, and by words nearby for and against it.
KEPT = 50


@dataclass(frozen=True)
class Rule:
    prior: int
    checked: int
    near: str
    near_worth: int
    against: str
    against_worth: int


RULES = {
    "email": Rule(60, 20, "e-?mail|contact|kontakt|correo|courriel|write to", 20, "example\\.(?:com|org|net)|noreply", 30),
    "ip": Rule(40, 20, "ip|server|host|address|adresse|login", 20, "version|release|section|chapter", 40),
    "card": Rule(20, 40, "card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte", 30, "order|isbn|tracking|serial|version", 30),
    "phone": Rule(20, 20, "tel|phone|call|mobile|fax|telefon|llamar|appel", 40, "order|isbn|tracking|serial|version", 30),
    "iban": Rule(20, 50, "iban|account|bank|konto|cuenta|compte", 20, "order|tracking|serial|version", 20),
}
SPAN = "struct<start:int,end:int,score:int,base:boolean>"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once; an expression that a lambda names would be computed for each element."""
    return F.transform(F.array(value), then)[0]


def running(values: Column, block: int = 128) -> Column:
    """The sums of the values before each, in blocks, so that no array is copied more than block times plus the number of blocks."""

    def upto(xs: Column, start: Column) -> Column:
        zero = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, zero, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def blocks(xs: Column) -> Column:
        starts = F.transform(F.sequence(F.lit(1), F.size(xs), F.lit(block)), lambda i: F.slice(xs, i, F.lit(block)))
        summed = lambda parts: upto(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, x: a + x)), F.lit(0))
        return let(starts, lambda parts: F.flatten(F.zip_with(parts, summed(parts), upto)))

    return let(values, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(blocks(xs)))


def proposals(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m, before, after, first, last>>: the pattern's matches, leftmost first and none overlapping, in code points; what stands
    before and after each up to the next, CONTEXT characters at most; whether they touch the match before and the one after."""
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))

    def placed(c: Column) -> Column:
        m, gap = c["m"], c["gap"]
        sizes = running(F.zip_with(m, F.slice(gap, F.lit(1), F.size(m)), lambda a, b: F.length(a) + F.length(b)))

        def at(x: Column, i: Column) -> Column:
            start = x["sum"] + F.length(x["b"])
            after = gap[i + 1]
            return F.struct(
                start.alias("start"),
                (start + F.length(x["m"])).alias("end"),
                x["m"].alias("m"),
                F.right(x["b"], F.lit(CONTEXT)).alias("before"),
                F.left(after, F.lit(CONTEXT)).alias("after"),
                ((x["b"] == "") & (i > 0)).alias("first"),
                ((after == "") & (i + 1 < F.size(m))).alias("last"),
            )

        return F.transform(F.arrays_zip(m.alias("m"), F.slice(gap, F.lit(1), F.size(m)).alias("b"), sizes.alias("sum")), at)

    return let(cut, lambda c: F.when(F.size(c["m"]) == 0, F.array()).otherwise(placed(c)))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, -i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters as 10 to 35, leave 1 by 97."""

    def add(total: Column, c: Column) -> Column:
        letter = c >= "A"
        return F.when(letter, total * 100 + F.ascii(c) - 55).otherwise(total * 10 + F.ascii(c) - 48) % 97

    moved = F.concat(F.substring(account, F.lit(5), F.lit(64)), F.substring(account, F.lit(1), F.lit(4)))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0).cast("int"), add) == 1


def is_address(m: Column) -> Column:
    """Four parts of at most 255, leading zeros aside."""
    return F.rlike(m, F.lit(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"))


def is_card(m: Column) -> Column:
    return let(digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))


def is_phone(m: Column) -> Column:
    return F.length(digits(m)).between(9, 15)


def is_account(m: Column) -> Column:
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda a: F.when(F.length(a).between(15, 34), mod97(a)).otherwise(F.lit(False)))


def score(kind: str, x: Column, checked: Column) -> Column:
    """0 to 100."""
    r = RULES[kind]
    near = F.lower(F.concat(x["before"], F.lit(" | "), x["after"]))
    says = lambda words: F.rlike(near, F.lit(rf"(?:^|[^a-z])(?:{words})(?:$|[^a-z])"))
    points = F.lit(r.prior) + F.when(checked, r.checked).otherwise(0) + F.when(says(r.near), r.near_worth).otherwise(0) - F.when(says(r.against), r.against_worth).otherwise(0)
    return F.least(F.lit(100), F.greatest(F.lit(0), points)).cast("int")


def alone(x: Column) -> Column:
    """The match touches no other one, and no letter, digit or +."""
    return ~x["first"] & ~x["last"] & ~F.rlike(F.right(x["before"], F.lit(1)), F.lit("[A-Za-z0-9+]")) & ~F.rlike(F.left(x["after"], F.lit(1)), F.lit("[A-Za-z0-9]"))


def spans_of(kind: str, found: Column, base: bool, shift: Column | int = 0) -> Column:
    return F.transform(found, lambda x: F.struct((x["start"] + shift).cast("int").alias("start"), (x["end"] + shift).cast("int").alias("end"), score(kind, x, F.lit(True)).alias("score"), F.lit(base).alias("base")))


def added(kind: str, where: Column, pattern: str, holds: Callable[[Column], Column]) -> Column:
    """Spans of proposals in each element (start, text, before, after) of where that stand alone, hold, and score KEPT or more."""

    def inside(w: Column) -> Column:
        around = lambda x: F.struct(x["start"], x["end"], x["m"], F.when(x["start"] < CONTEXT, F.concat(w["before"], x["before"])).otherwise(x["before"]).alias("before"), F.when(x["end"] + CONTEXT > F.length(w["text"]), F.concat(x["after"], w["after"])).otherwise(x["after"]).alias("after"), x["first"], x["last"])
        found = F.filter(F.transform(proposals(w["text"], pattern), around), lambda x: alone(x) & holds(x["m"]))
        return spans_of(kind, found, False, w["start"])

    return F.filter(F.flatten(F.transform(where, inside)), lambda s: s["score"] >= KEPT)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, email, ip, card, phone, iban: arrays of (start, end, score, base), in code points, end exclusive, by start.

    base marks what the base pattern of a kind and its check find; these stay whatever their score. The others are proposals with a score of KEPT or more: cards
    of four groups within a run of digits that is no card, phone numbers without + where words nearby speak of phones, and account numbers that pass mod 97.
    Null texts count as empty and give empty arrays, as do texts without such data; other columns aren't read, whatever their names. One row per row.
    """
    d = own(df, id_col, text_col).toDF("doc_id", "t").withColumn("t", F.coalesce("t", F.lit("")))
    t = F.col("t")
    # the pieces are columns first, so each pattern runs over a text once
    d = d.select("doc_id", "t", *(proposals(t, p).alias(f"p_{k}") for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))))
    keep = lambda k, holds: F.filter(f"p_{k}", lambda x: holds(x["m"]))
    runs = F.transform(F.filter("p_card", lambda x: (F.length(x["m"]) >= 16) & ~is_card(x["m"])), lambda x: F.struct(x["start"].alias("start"), x["m"].alias("text"), x["before"].alias("before"), x["after"].alias("after")))
    ends = F.concat(F.array(F.lit(0)), F.transform("p_phone", lambda x: x["end"]))
    gaps = F.zip_with(ends, F.split(t, PHONE, -1), lambda a, b: F.struct(a.alias("start"), b.alias("text"), F.when(a > 0, F.lit("+")).otherwise("").alias("before"), F.lit("").alias("after")))
    base = {"email": spans_of("email", F.col("p_email"), True), "ip": spans_of("ip", keep("ip", is_address), True), "card": spans_of("card", keep("card", is_card), True), "phone": spans_of("phone", keep("phone", is_phone), True)}
    more = {"card": added("card", runs, CARD_GROUPS, is_card), "phone": added("phone", gaps, PHONE_GROUPS, lambda m: F.lit(True)), "iban": added("iban", F.array(F.struct(F.lit(0).alias("start"), t.alias("text"), F.lit("").alias("before"), F.lit("").alias("after"))), IBAN, is_account)}
    both = lambda k: F.array_sort(F.concat(base[k], more[k])) if k in base and k in more else base.get(k, more.get(k))
    return d.select("doc_id", *(both(k).alias(k) for k in RULES))


def joined(kinds: list[str], only_base: bool) -> Column:
    """kind:start:end of all spans, by kind and start, joined by commas."""

    def listed(k: str) -> Column:
        return F.transform(F.filter(k, lambda s: s["base"]) if only_base else F.col(k), lambda s: F.concat(F.lit(f"{k}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*map(listed, kinds)), ",")


def report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base spans' list), spans (the list of all). See find() for odd rows."""
    base = ["email", "ip", "card", "phone"]
    found = find(df, id_col, text_col)
    counts = (F.size(F.filter(k, lambda s: s["base"])).cast("long").alias(f"n_{k}") for k in base)
    return found.select("doc_id", *counts, F.sha2(joined(base, True).cast("binary"), 256).alias("base_sha256"), joined(list(RULES), False).alias("spans"))
