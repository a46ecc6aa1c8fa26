"""URL rules indexed by their rarest literal token.

Every rule is split into literal tokens (host labels and path segments). The rule is filed under the token that
is rarest, by the number of rules and, where given, of corpus URLs that hold it. A URL's tokens fetch its
candidate rules; only their regular expressions run, and the longest rule that matches decides.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandline.runtime import own, ship

_TOKEN = re.compile(r"[^./?#&=:]+")
#: The index travels with each task, so its size has a bound.
MOST_RULES = 200_000
_UPPER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """A host and all its subdomains, a path prefix, and a verdict; or any regular expression over host + path with a literal token it needs."""

    host: str
    path: str
    verdict: str
    pattern: str = ""
    name: str = field(default="")

    @property
    def label(self) -> str:
        return self.name or f"{self.host}{self.path}"

    @property
    def regex(self) -> re.Pattern[str]:
        return re.compile(self.pattern or rf"(?:[^/]*\.)?{re.escape(self.host)}{re.escape(self.path)}", re.S)

    @property
    def tokens(self) -> list[str]:
        """Literal tokens every URL that fits must hold whole: host labels, and path segments that the rule closes."""
        closed = self.path[: self.path.rfind("/") + 1]
        return _TOKEN.findall(self.host) + _TOKEN.findall(closed)


def split_url(url: str | None) -> tuple[str, str]:
    """Host: after the first :// up to / ? # or end, A-Z lower-cased; path: from there up to ? # or end."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    cut = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, path = rest[:cut].translate(_UPPER), rest[cut:]
    end = min((i for c in "?#" if (i := path.find(c)) >= 0), default=len(path))
    return host, path[:end]


class RuleIndex:
    def __init__(self, rules: list[Rule], seen: dict[str, int] | None = None):
        if len(rules) > MOST_RULES:
            raise ValueError(f"{len(rules)} rules; the index holds {MOST_RULES} at most")
        held = Counter(t for r in rules for t in set(r.tokens))
        self.by_token: dict[str, list[tuple[int, str, int, str, re.Pattern[str]]]] = defaultdict(list)
        for n, r in enumerate(rules):
            if not r.tokens:
                raise ValueError(f"rule {r.label!r} has no literal token")
            rarest = min(r.tokens, key=lambda t: ((seen or {}).get(t, 0), held[t], -len(t), t))
            self.by_token[rarest].append((-len(r.label), r.label, n, r.verdict, r.regex))

    def decide(self, host: str, path: str) -> tuple[str | None, str | None]:
        # by number: rules of one host and path may differ in their patterns
        candidates = {c[2]: c for t in set(_TOKEN.findall(host) + _TOKEN.findall(path)) for c in self.by_token.get(t, ())}
        for _, label, _, verdict, rx in sorted(candidates.values(), key=lambda c: c[:3]):
            if rx.match(host + path):
                return label, verdict
        return None, None


def token_counts(df: DataFrame, rules: list[Rule], url_col: str = "url") -> dict[str, int]:
    """How many rows hold each token of the rules: as many numbers as the rules have tokens."""
    from pyspark.sql import functions as F

    own_tokens = sorted({t for r in rules for t in r.tokens})
    d = own(df, url_col).toDF("url")
    parts = F.array_distinct(F.split(F.lower("url"), r"[./?#&=:]+"))
    rows = d.select(F.explode(parts).alias("t")).where(F.col("t").isin(own_tokens)).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def filter_urls(df: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url", seen: dict[str, int] | None = None) -> DataFrame:
    """(id, host, path, rule, verdict) per row. Of several rules that fit the longest wins; without one, rule is null and verdict is default.

    A null url, or one without ://, has empty host and path and fits no rule. Rows are judged one by one: repeated
    rows stay, an empty table gives none.
    """
    ship(df.sparkSession)
    d = own(df, id_col, url_col)
    schema = T.StructType([d.schema[0], *(T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict"))])
    index = RuleIndex(rules, seen)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = [split_url(u) for u in b.column(1).to_pylist()]
            said = [index.decide(h, p) for h, p in urls]
            cols = [[h for h, _ in urls], [p for _, p in urls], [r for r, _ in said], [v or default for _, v in said]]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cols)], names=schema.names)

    return d.mapInArrow(run, schema)
