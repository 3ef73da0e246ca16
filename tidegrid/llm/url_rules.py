"""URL filters: pattern rules indexed by their rarest literal token.

Every rule names literal tokens (runs of a-z and 0-9) that each URL it fits has.
The corpus is counted once for these tokens, and a rule is filed under the one
that the fewest URLs have. The tokens of a URL then fetch candidate rules by an
equi-join, and only these run their regular expressions. A rule without literals
is filed under the empty token, which every URL has.

Site rules (host and path) become patterns of the same index. Of the site rules
that fit, the longest decides, then its name; without one, the longest pattern rule
that fits; without any the URL is allowed. All work is done by DataFrame functions.

The verdict hangs on the URL alone: each different URL is judged once and joined
back to its rows, repeated rows and null ids included. A null URL or one without
``://`` has an empty host and path and is allowed. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many index rows the rules are broadcast (some 50 MB); beyond, both sides are shuffled.
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULE_SCHEMA = "rule string, action string, site boolean, length int, regex string, tokens array<string>"


def tokens_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over host (lower case), path and the rest, with tokens that each match holds whole."""

    rule: str
    action: str
    regex: str
    literals: tuple[str, ...] = ()

    def row(self) -> tuple:
        return (self.rule, self.action, False, len(self.regex), self.regex, sorted(set(self.literals)))


@dataclass(frozen=True)
class SiteRule:
    """Fits its host and all subdomains, where the path starts with ``path``."""

    action: str
    host: str
    path: str

    def row(self) -> tuple:
        host = self.host.translate(str.maketrans(UPPER, LOWER))
        literals = tokens_of(host)
        in_path = tokens_of(self.path)
        if in_path and self.path[-1].isascii() and self.path[-1].isalnum():
            in_path.pop()  # the last token may go on in the URL
        regex = rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(self.path)}"
        name = self.host + self.path
        return (name, self.action, True, len(name), regex, sorted({*literals, *in_path}))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> dict[str, Column]:
    """``host``, ``path`` and ``target`` (host in lower case and all after it)."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    tail = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    return {"host": host, "path": F.regexp_extract(tail, r"^([^?#]*)", 1), "target": F.concat(host, tail)}


def _tokens(urls: DataFrame) -> DataFrame:
    """Each different token of each URL, and the empty one."""
    split = F.split(lower_ascii(F.col("target")), "[^a-z0-9]+", -1)
    return urls.select("url", "target", F.explode(F.array_distinct(F.concat(split, F.array(F.lit(""))))).alias("token"))


def rule_index(urls: DataFrame, rules: Sequence[PatternRule | SiteRule]) -> DataFrame:
    """The rules, each under the literal ``token`` that the fewest of ``urls`` (url, target) have."""
    spark = urls.sparkSession
    rows = spark.createDataFrame([r.row() for r in rules], RULE_SCHEMA)
    wide = rows.withColumn("token", F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))))
    literals = sorted({t for r in rules for t in r.row()[5]})
    wanted = _small(spark.createDataFrame([(t,) for t in literals], "token string"), len(literals))
    counts = _tokens(urls).join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    wide = wide.join(counts, "token", "left")
    rarest = F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("token").alias("token")))
    kept = ["rule", "action", "site", "length", "regex"]
    return wide.groupBy(*kept).agg(rarest.alias("_r")).select(*kept, F.col("_r.token").alias("token"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RULES else df


def judge_urls(
    pages: DataFrame, rules: Sequence[PatternRule | SiteRule], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` (a site rule), ``pattern`` (a pattern rule) and ``verdict`` of each row."""
    if any(r.action not in ("allow", "block") for r in rules):
        raise ValueError("a rule allows or blocks")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    parts = url_parts(F.col("url"))
    urls = rows.where("url IS NOT NULL").select("url").distinct().select("url", parts["target"].alias("target"))
    index = _small(rule_index(urls, rules), len(rules))
    candidates = _tokens(urls).join(index, "token")
    fits = candidates.where(F.expr("target RLIKE regex"))
    rank = F.struct("length", "rule", "action")
    best = fits.groupBy("url").agg(
        F.max(F.when(F.col("site"), rank)).alias("_site"), F.max(F.when(~F.col("site"), rank)).alias("_pattern")
    )
    judged = rows.join(best, "url", "left")
    return judged.select(
        "page_id", parts["host"].alias("host"), parts["path"].alias("path"),
        F.col("_site.rule").alias("rule"), F.col("_pattern.rule").alias("pattern"),
        F.coalesce("_site.action", "_pattern.action", F.lit("allow")).alias("verdict"),
    )
