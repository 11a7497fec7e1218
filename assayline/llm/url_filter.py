"""URL filters: rules are indexed by their rarest literal token, and only rules fetched by a url's tokens run their pattern.

Everything on the path of a url is built-in column functions in one projection: cut
the url, look its tokens up in the index, run the patterns of the fetched rules,
take the longest.  Nothing is shuffled but the counts of the tokens.

The rules are a list in the program.  Index and patterns are two literals of the plan,
whose shape does not depend on how many rules there are: a hash table of tokens, of
which a token reads one bucket, and an array of patterns, of which a fetched rule reads
its own.  So a url's cost follows its tokens and the rules that they fetch.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens in a bucket of the index, on average.
PER_BUCKET = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``allow`` or ``block`` a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"^(?:[^/]*\.)?{quoted(self.host)}{quoted(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Tokens that every matching url has whole: all of the host, and those of the path that something follows."""
        return host_tokens(self.host) + path_tokens(self.path)[: None if re.search(r"[^0-9A-Za-z]$", self.path) else -1]


@dataclass(frozen=True)
class Pattern:
    """A regular expression over host + path that blocks what no rule covers.

    ``needs`` are sets of tokens: every url that matches has all tokens of one of them whole.
    """

    expression: str
    needs: tuple[tuple[str, ...], ...] = ((),)


def quoted(s: str) -> str:
    return re.sub(r"([^0-9A-Za-z])", r"\\\1", s)


def host_tokens(host: str) -> list[str]:
    return [f"h:{t}" for t in re.split(r"[^0-9a-z]+", host) if t]


def path_tokens(path: str) -> list[str]:
    return [f"p:{t}" for t in re.split(r"[^0-9A-Za-z]+", path) if t]


def either(*words: str) -> tuple[tuple[str, ...], ...]:
    """Needs of a pattern whose match has ``words`` whole, all in the host or all in the path (a ``/`` parts them)."""
    return tuple(tuple(kind + w for w in words) for kind in ("h:", "p:"))


#: The lists of the default filter.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
PATTERNS = (
    Pattern(r"(^|[.-])spam-farm\.", either("spam", "farm")),
    Pattern(r"(^|[.-])cheap-pills\.", either("cheap", "pills")),
    Pattern(r"(^|[.-])casino[.-]", either("casino")),
)


def host_of(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    mark = lambda tokens, kind: F.transform(tokens, lambda t: F.concat(F.lit(kind), t))
    return F.array_distinct(F.concat(mark(F.split(host, "[^0-9a-z]+"), "h:"), mark(F.split(path, "[^0-9A-Za-z]+"), "p:")))


def needs_of(rule: Rule | Pattern) -> Sequence[Sequence[str]]:
    return [rule.tokens] if isinstance(rule, Rule) else rule.needs


def token_counts(urls: DataFrame, url: str, wanted: list[str]) -> dict[str, int]:
    """In how many urls each wanted token is; as many rows come back as the rules have tokens."""
    tokens = urls.select(F.explode(url_tokens(host_of(F.col(url)), path_of(F.col(url)))).alias("token"))
    rows = urls.sparkSession.createDataFrame([(t,) for t in wanted], "token string")
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(rows, "token", "left_semi")
    return {r["token"]: r["n"] for r in counted.collect()}


def bucket_of(token: str, n: int) -> int:
    """The bucket of a token, as the columns compute it."""
    return zlib.crc32(token.encode()) % n


def rarest_token_index(rules: Sequence[Rule | Pattern], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rules (by position) under the token of theirs that the fewest urls have; ties go to the smaller token.

    A pattern is under one token of each of its sets.  A rule, or a set, without tokens is under ''.
    """
    index: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        for token in sorted({min(needs, key=lambda t: (counts.get(t, 0), t), default="") for needs in needs_of(rule)}):
            index.setdefault(token, []).append(i)
    return index


def judge_urls(urls: DataFrame, url: str = "url", rules: Sequence[Rule] = RULES, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """``urls`` with host, path, rule and verdict.

    The longest fitting rule decides (equal length: the later in code point order of
    host + path); where none fits, a fitting pattern blocks, else the url is allowed.

    A null url, or one without ``://``, has empty host and path, fits no rule and is
    allowed.  Rows are judged one by one, so repeated rows, null ids and empty tables
    need no care.  Columns of ``urls`` named as the results are replaced.
    """
    every: list[Rule | Pattern] = [*rules, *patterns]
    wanted = sorted({t for r in every for needs in needs_of(r) for t in needs})
    index = rarest_token_index(every, token_counts(urls, url, wanted) if wanted else {})
    n = max(1, len(index) // PER_BUCKET)
    buckets: list[list[dict]] = [[] for _ in range(n)]
    for token, at in sorted(index.items()):
        buckets[bucket_of(token, n)].append({"t": token, "r": at})
    told = [
        {"p": r.pattern, "s": len(r.name), "n": r.name, "v": r.verdict} if isinstance(r, Rule) else {"p": r.expression, "s": -1, "v": "block"}  # patterns come after all rules
        for r in every
    ]
    # One foldable literal each: parsed once, when the plan is optimised.
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<t: string, r: array<int>>>>")
    rule_list = F.from_json(F.lit(json.dumps(told)), "array<struct<p: string, s: int, n: string, v: string>>")
    cut = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    text, tokens = F.concat("host", "path"), F.array_append(url_tokens(F.col("host"), F.col("path")), F.lit(""))
    bucket = lambda t: F.get(table, F.pmod(F.crc32(F.encode(t, "UTF-8")), F.lit(n)).cast("int"))
    fetched = F.flatten(F.transform(tokens, lambda t: F.flatten(F.transform(F.filter(bucket(t), lambda x: x["t"] == t), lambda x: x["r"]))))
    fits = F.filter(F.transform(F.array_distinct(fetched), lambda i: F.get(rule_list, i)), lambda r: F.regexp_like(text, r["p"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["s"].alias("size"), r["n"].alias("rule"), r["v"].alias("verdict"))))
    judged = F.struct(best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit("allow")).alias("verdict"))
    return cut.select(*[F.col(f"`{c}`") for c in cut.columns if c not in ("rule", "verdict")], F.inline(F.array(judged)))
