"""URL filters: pattern rules are indexed by their rarest literal token.

A rule is a regular expression over ``host`` + ``path`` with the literal tokens that every match
must hold as whole tokens.  A URL is cut into tokens once; its tokens fetch the rules filed under
them, and only those rules run their expression on it.  All of it is DataFrame work.

Defined results: a NULL URL, or one without ``://``, has an empty host and path, meets no rule and
gets the default verdict.  Repeated rows give repeated results.  Columns of the input other than id
and URL are not read, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates tokens in a host and a path.
CUT = "[^a-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``rank`` 1 rules are decided before rank 2 rules; inside a rank the longest name wins, then
    the smaller name.  ``literals`` are tokens that any matching text holds."""

    name: str
    verdict: str
    pattern: str
    literals: tuple[str, ...]
    rank: int = 2


def site_rule(verdict: str, site: str) -> Rule:
    """A rule for a host, its subdomains and a path prefix, written like ``example.net/en/``."""
    host, slash, rest = site.partition("/")
    path = slash + rest
    whole = path if re.search(r"[^a-z0-9]$", path.lower()) else path.lower().rstrip(UPPER + LOWER + "0123456789")
    literals = tuple(t for t in re.split(CUT, host.lower()) + re.split(CUT, whole.lower()) if t)
    return Rule(site, verdict, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{re.escape(path)}", literals, 1)


def word_rule(verdict: str, *words: str) -> Rule:
    """A rule for hosts with a label of exactly these words, joined by hyphens."""
    label = "-".join(words)
    return Rule(f"label:{label}", verdict, rf"^(?:[^/]*\.)?{re.escape(label)}\.[^/]*(?:/|$)", tuple(words))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without a host part."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(
    pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row per page: id, host, path, ``rule`` and ``rule_rank`` (NULL if none fits), ``verdict``.

    Rules are a list of the program: the driver gets one count per literal, taken over all URLs, and
    files each rule under its rarest literal.  A rule without literals is filed under the empty token,
    which every URL has.
    """
    urls = pages.select(
        F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")
    ).withColumn("_at", F.concat("host", "path"))
    tokens = F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower("_at"), CUT)))
    wanted = sorted({t.lower() for r in rules for t in r.literals} | {""})
    held = F.array_intersect(tokens, F.array(*map(F.lit, wanted)))
    seen = {
        r["_token"]: r["n"]
        for r in urls.select(F.explode(held).alias("_token")).groupBy("_token").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    filed: dict[str, list[Rule]] = {}
    for r in rules:
        rarest = min((t.lower() for t in r.literals), key=lambda t: (seen.get(t, 0), t), default="")
        filed.setdefault(rarest, []).append(r)

    def entry(r: Rule) -> Column:
        values = {"k": r.rank, "l": -len(r.name), "rule": r.name, "v": r.verdict, "pattern": r.pattern}
        return F.struct(*(F.lit(v).alias(k) for k, v in values.items()))

    index = F.create_map(*(c for t, rs in filed.items() for c in (F.lit(t), F.array(*map(entry, rs)))))
    fetched = F.flatten(F.transform(F.array_intersect(tokens, F.map_keys(index)), lambda t: F.element_at(index, t)))
    order = F.array_sort(F.filter(fetched, lambda r: F.rlike(F.col("_at"), r["pattern"])))
    best = F.get(order, F.lit(0))
    return urls.select(
        F.col("_id").alias(id_col), "host", "path", best.alias("_best")
    ).select(
        id_col, "host", "path", F.col("_best.rule").alias("rule"), F.col("_best.k").alias("rule_rank"),
        F.coalesce(F.col("_best.v"), F.lit(default)).alias("verdict"),
    )
