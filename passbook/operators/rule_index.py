"""Keys under which stored rules are filed, and the keys of a transaction.

A rule holds only where all its terms hold, so it is filed under one of them: the most selective kind
it has (``RANKS``).  A transaction has the keys of all that such a term may ask for and fetches only
the rules filed under these.  A rule without a term that has keys is filed under ``EVERY``.

The keys of a term are such that a transaction which meets it has one of them at least; the rule itself
is still evaluated.
"""

from __future__ import annotations

import math
import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

EVERY = "*"
#: Kinds of terms with keys, the most selective first.
RANKS = {kind: i for i, kind in enumerate(("text", "regex", "tag", "account", "category", "amount", "date"))}
#: Characters of a prefix in a key: as many of these as the prefix has.  Keys of one term at most: a
#: wider term has none.
PREFIXES, KEYS = (8, 4, 2, 1), 24
#: Characters of a pattern's literal in a key.
GRAM = 3

_BREAKS = set("dDsSwWbBAzZ")


def literal_runs(pattern: str) -> list[str] | None:
    """Runs of ASCII characters that every match of a pattern holds, in lower case; None if it has
    alternatives, groups, classes or escapes that this does not read."""
    pattern = re.sub(r"^\(\?[ims]+\)", "", pattern)
    runs, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c in "|([":
            return None
        if c == "\\":
            c, i = pattern[i : i + 1], i + 1
            if c in ("p", "P") and (end := re.match(r"\{\w+\}", pattern[i:])):
                runs, run, i = [*runs, run], "", i + end.end()
                # A class stands for one character that may be repeated, never for the run before it.
                if pattern[i : i + 1] == "{":
                    return None
                continue
            if c and c in _BREAKS:
                runs, run = [*runs, run], ""
                continue
            if not c or c.isalnum() or not c.isascii():
                return None
            run += c
        elif c in "*?{":
            runs, run = [*runs, run[:-1]], ""
            if c == "{":
                end = pattern.find("}", i)
                if end < 0:
                    return None
                i = end + 1
        elif c in "^$.+)]}":
            runs, run = [*runs, run], ""
        elif c.isascii():
            run += c.lower()
        else:
            runs, run = [*runs, run], ""
    return [r for r in [*runs, run] if r]


def _digits(low: float, high: float, magnitude: bool) -> list[int]:
    """Numbers of digits that amounts between the bounds can have."""
    ends = [abs(math.trunc(x)) for x in (low, high)]
    least = 0 if low <= 0 <= high else min(ends)
    return list(range(len(str(least)), len(str(max(ends))) + 1))


def term_keys(term: dict) -> list[str]:
    """Keys of one compiled term; none if it may hold anywhere."""
    kind, keys = term["kind"], []
    if kind == "text":
        keys = ["t:" + max(term["left"], key=lambda w: (len(w), w))]
    elif kind == "regex":
        runs = [r for r in literal_runs(term["pattern"]) or [] if len(r) >= GRAM]
        if runs:
            longest = max(runs, key=lambda r: (len(r), r))
            at = (len(longest) - GRAM) // 2
            keys = ["r:" + longest[at : at + GRAM]]
    elif kind == "tag":
        keys = ["g:" + n for n in term["left"]]
    elif kind == "account":
        pairs = list(zip(term["left"], term["right"]))
        if all(b or a for b, a in pairs):
            keys = ["b:" + _cut(b) if b else "a:" + _cut(a) for b, a in pairs]
    elif kind == "category":
        if not any(p.startswith("/") for p in term["left"]):
            keys = ["c:" + _cut(p) for p in term["left"]]
    elif kind == "amount" and None not in (term["low"], term["high"]) and math.isfinite(term["low"]) and math.isfinite(term["high"]):
        keys = [f"m:{n}" for n in _digits(term["low"], term["high"], bool(term["magnitude"]))]
    elif kind == "date" and None not in (term["date_low"], term["date_high"]):
        first, last = (12 * d.year + d.month for d in (_day(term["date_low"]), _day(term["date_high"])))
        keys = [f"d:{m}" for m in range(first, last + 1)] if last - first < KEYS else []
    keys = list(dict.fromkeys(keys))
    return keys if len(keys) <= KEYS else []


def _cut(prefix: str) -> str:
    return prefix[: next(n for n in PREFIXES if n <= len(prefix))]


def _day(value: object) -> date:
    return value if isinstance(value, date) else date.fromisoformat(str(value)[:10])


def _prefixes(text: Column, mark: str) -> Column:
    return F.array_distinct(F.array(*[F.concat(F.lit(mark), F.substring(text, 1, n)) for n in PREFIXES]))


def _tagged(keys: Column, mark: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(mark), k))


def _ancestors(tag: Column) -> Column:
    parts = F.split(tag, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def row_keys(kinds: set[str]) -> Column:
    """Keys of a transaction for the kinds of terms that rules are filed under; each once.

    Reads the columns that the terms themselves read: ``tokens``, ``description``, ``tags``,
    ``_bank``, ``_account``, ``category_path``, ``amount_cents`` and ``date``.
    """
    none = F.array().cast("array<string>")
    text = F.lower("description")
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (GRAM - 1)), lambda i: F.concat(F.lit("r:"), F.substring(text, i, F.lit(GRAM))))
    digits = F.length(F.translate(F.col("amount_cents").cast("string"), "-", ""))
    month = F.year("date") * 12 + F.month("date")
    parts = {
        "text": lambda: [_tagged(F.col("tokens"), "t:")],
        "regex": lambda: [F.when(F.length(text) >= GRAM, F.array_distinct(grams))],
        "tag": lambda: [_tagged(F.array_distinct(F.flatten(F.transform("tags", _ancestors))), "g:")],
        "account": lambda: [_prefixes(F.col("_bank"), "b:"), _prefixes(F.col("_account"), "a:")],
        "category": lambda: [_prefixes(F.coalesce(F.lower("category_path"), F.lit("")), "c:")],
        "amount": lambda: [F.array(F.concat(F.lit("m:"), digits.cast("string")))],
        "date": lambda: [F.array(F.concat(F.lit("d:"), month.cast("string")))],
    }
    found = [F.coalesce(c, none) for kind in RANKS if kind in kinds for c in parts[kind]()]
    every = F.array(F.lit(EVERY)) if EVERY in kinds else none
    return F.concat(every, *found) if found else every
