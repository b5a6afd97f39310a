"""Typed search terms.  Each builds a ``Predicate``; nothing here reads data."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions import text as text_fn
from passbook.functions.money import Bounds, amount_bounds, confidence_bounds, parse_amount
from passbook.functions.periods import Calendar, resolve

Getter = Callable[[str], Column]


@dataclass(frozen=True)
class Predicate:
    """A condition plus the columns it reads; ``test`` gets a column by name.

    Binding by name lets one predicate run on either side of a transfer.  A test
    that gives None adds no clause, negated or not.
    """

    needs: frozenset[str]
    test: Callable[[Getter], Column | None]
    negated: bool = False

    def clause(self, get: Getter = F.col) -> Column | None:
        found = self.test(get)
        return ~F.coalesce(found, F.lit(False)) if self.negated and found is not None else found

    def column(self, get: Getter = F.col) -> Column:
        found = self.clause(get)
        return F.lit(True) if found is None else found


def _on(name: str, make: Callable[[Column], Column | None]) -> Predicate:
    return Predicate(frozenset([name]), lambda get: make(get(name)))


def everything() -> Predicate:
    return Predicate(frozenset(), lambda get: F.lit(True))


def negate(pred: Predicate) -> Predicate:
    """NULL counts as no match, so the negation keeps rows without a value."""
    return replace(pred, negated=not pred.negated)


def _merge(preds: Iterable[Predicate], op, neutral: bool) -> Predicate:
    kept = [p for p in preds if p is not None]
    if not kept:
        return everything()
    needs = frozenset().union(*(p.needs for p in kept))

    def test(get: Getter) -> Column | None:
        clauses = [c for c in (p.clause(get) for p in kept) if c is not None]
        return reduce(op, clauses) if clauses else None

    return Predicate(needs, test)


def all_of(preds: Iterable[Predicate | None]) -> Predicate:
    return _merge(preds, and_, True)


def any_of(preds: Iterable[Predicate | None]) -> Predicate:
    return _merge(preds, or_, False)


def _values(patterns: str | Iterable[str]) -> list[str]:
    parts = patterns.split("|") if isinstance(patterns, str) else list(patterns)
    return [p for p in parts if p]


# Dates


def date_between(low, high) -> Predicate:
    def test(day: Column) -> Column:
        parts = []
        if low is not None:
            parts.append(day >= F.lit(low))
        if high is not None:
            parts.append(day <= F.lit(high))
        return reduce(and_, parts) if parts else F.lit(True)

    return _on("date", test)


def date_is(spec: str, cal: Calendar | None = None) -> Predicate:
    """Year, month, day, preset, ``last-N-unit`` or ``a..b`` of any of these."""
    return date_between(*resolve(spec, cal))


def date_range(low: str, high: str, cal: Calendar | None = None) -> Predicate:
    return date_is(f"{low}..{high}", cal)


def date_preset(name: str, cal: Calendar) -> Predicate:
    return date_is(name, cal)


def date_last_n(count: int, unit: str, cal: Calendar) -> Predicate:
    return date_is(f"last-{count}-{unit}", cal)


# Amounts and confidence


def _bounded(name: str, bounds: Bounds) -> Predicate:
    if bounds.empty:
        return everything()
    return _on(name, bounds.test)


def amount_is(value: str) -> Predicate:
    return _bounded("amount_cents", amount_bounds(value))


def amount_cmp(op: str, value: str) -> Predicate:
    """Always signed and exact to the cent."""
    if op not in ("<", ">"):
        raise ValueError(f"not a comparison sign: {op}")
    parse_amount(value)
    return amount_is(op + value)


def amount_range(low: str, high: str) -> Predicate:
    return amount_is(f"{low}..{high}")


def confidence_is(value: str) -> Predicate:
    """A percentage, ``<``/``>`` comparison, ``a..b``, ``any`` or ``none``."""
    if value.lower() in ("any", "none"):
        return confidence_present(value.lower() == "any")
    return _bounded("ai_confidence", confidence_bounds(value))


def confidence_present(present: bool) -> Predicate:
    return _on("ai_confidence", lambda c: c.isNotNull() if present else c.isNull())


# Accounts and categories


def _account_pattern(pattern: str) -> Predicate | None:
    bank, _, account = pattern.partition("/")
    parts = []
    if bank:
        parts.append(_on("bank_name", lambda c: F.lower(c).startswith(bank.lower())))
    if account:
        parts.append(_on("account_name", lambda c: F.lower(c).startswith(account.lower())))
    # "/" alone has two empty prefixes and matches all.
    return all_of(parts)


def account_matches(patterns: str | Iterable[str]) -> Predicate:
    """``Bank``, ``Bank/``, ``Bank/Account`` or ``/Account`` prefixes, any of them."""
    return any_of(_account_pattern(p) for p in _values(patterns))


def category_matches(patterns: str | Iterable[str]) -> Predicate:
    """``Food`` is a prefix of the whole path; ``/Food`` starts any later segment."""

    def one(pattern: str) -> Predicate:
        low = pattern.lower()
        if low.startswith("/"):
            return _on("category_path", lambda c: F.contains(F.lower(c), F.lit(low)))
        return _on("category_path", lambda c: F.lower(c).startswith(low))

    return any_of(one(p) for p in _values(patterns))


def validate_account_patterns(patterns: DataFrame, accounts: DataFrame) -> DataFrame:
    """``error`` per (ledger_id, pattern): which half of a pattern is unknown, NULL when fine.

    ``accounts`` holds (ledger_id, bank_name, account_name) of live accounts.
    A ledger without accounts reports nothing.  Prefixes are compared by
    equality: each account is cut to the few lengths its ledger's patterns
    have, so no pattern meets all accounts.
    """
    tail = F.expr("substring(pattern, instr(pattern, '/') + 1)")
    halves = patterns.select(
        "ledger_id",
        "pattern",
        F.lower(F.substring_index("pattern", "/", 1)).alias("_b"),
        F.when(F.contains(F.col("pattern"), F.lit("/")), F.lower(tail)).otherwise("").alias("_a"),
    )
    # A pattern is tried whole and by its bank alone.
    tried = halves.select("ledger_id", "_b", F.explode(F.array_distinct(F.array("_a", F.lit("")))).alias("_a"))
    lengths = tried.groupBy("ledger_id").agg(
        F.collect_set(F.struct(F.length("_b").alias("b"), F.length("_a").alias("a"))).alias("_lengths")
    )
    cut = (
        accounts.join(lengths, "ledger_id")
        .select("ledger_id", "bank_name", "account_name", F.explode("_lengths").alias("_n"))
        .select(
            "ledger_id",
            F.left(F.lower("bank_name"), F.col("_n.b")).alias("_b"),
            F.left(F.lower("account_name"), F.col("_n.a")).alias("_a"),
        )
        .distinct()
        .withColumn("_known", F.lit(True))
    )
    banks = cut.filter(F.col("_a") == "").select("ledger_id", "_b", F.col("_known").alias("_bank"))
    flags = (
        halves.join(cut, ["ledger_id", "_b", "_a"], "left")
        .join(banks, ["ledger_id", "_b"], "left")
        .join(accounts.select("ledger_id").distinct(), "ledger_id", "left_semi")
    )
    no_bank = F.concat(F.lit("no bank starts with "), F.substring_index("pattern", "/", 1))
    no_account = F.concat(
        F.lit("no account starts with "),
        tail,
        F.when(F.col("_b") == "", "").otherwise(
            F.concat(F.lit(" at "), F.substring_index("pattern", "/", 1))
        ),
    )
    return flags.select(
        "ledger_id",
        "pattern",
        F.when(F.col("_bank").isNull(), no_bank).when(F.col("_known").isNull(), no_account).alias("error"),
    )


# Tags, notes and descriptions


def has_tag(names: str | Iterable[str]) -> Predicate:
    """A tag or anything below it; needs the ``tags`` array column."""
    wanted = []
    for name in _values(names):
        clean = text_fn.tag_name(name)
        if not clean:
            raise ValueError(f"not a tag: {name}")
        wanted.append(clean)
    if not wanted:
        return everything()
    hit = lambda t: reduce(or_, [(t == n) | t.startswith(n + "/") for n in wanted])
    return _on("tags", lambda c: F.exists(c, hit))


def tagged(present: bool) -> Predicate:
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    return _on("tags", lambda c: size(c) > 0 if present else size(c) <= 0)


def note_contains(needle: str) -> Predicate:
    clean = needle.lower().replace("%", "").replace("_", "")
    if not clean:
        raise ValueError(f"nothing to look for in notes: {needle}")
    return _on("note", lambda c: F.contains(F.lower(c), F.lit(clean)))


def noted(present: bool) -> Predicate:
    return _on("note", lambda c: c.isNotNull() if present else c.isNull())


def description_matches(pattern: str, ignore_case: bool = False, on_invalid: str = "drop") -> Predicate:
    """Unanchored regular expression of the engine; an invalid one adds no clause unless ``error`` is asked."""
    whole = ("(?i)" if ignore_case else "") + pattern

    def test(c: Column) -> Column | None:
        if text_fn.engine_accepts(whole):
            return c.rlike(whole)
        if on_invalid == "error":
            raise ValueError(f"not a regular expression: {pattern}")
        return None

    return _on("description", test)


def fuzzy_matches(columns: Iterable[str], pattern: str) -> Predicate:
    """Each blank-separated atom is a case-insensitive subsequence of one listed column."""
    names = list(columns)

    def atom(chars: str) -> Predicate:
        expr = "(?is)" + ".*?".join(re.escape(c) for c in chars)
        return any_of(_on(n, lambda c: c.rlike(expr)) for n in names)

    return all_of(atom(a) for a in pattern.split())


def boundary_prefix(col: Column | str, query: str) -> Column:
    """``query`` starts the text or follows a character that is no letter or digit."""
    if not query:
        return F.lit(True)
    column = F.col(col) if isinstance(col, str) else col
    quoted = re.escape(query.lower())
    return F.lower(column).rlike(r"(^|[^\p{L}\p{N}])" + quoted)


# Registry


Builder = Callable[[str, Calendar | None], Predicate | None]


def _tag_term(value: str, cal) -> Predicate:
    return tagged(value.lower() == "any") if value.lower() in ("any", "none") else has_tag(value)


def _note_term(value: str, cal) -> Predicate:
    return noted(value.lower() == "any") if value.lower() in ("any", "none") else note_contains(value)


FIELDS: dict[str, Builder] = {
    "date": lambda v, cal: date_is(v, cal),
    "amount": lambda v, cal: amount_is(v),
    "account": lambda v, cal: account_matches(v),
    "category": lambda v, cal: category_matches(v),
    "confidence": lambda v, cal: confidence_is(v),
    "tag": _tag_term,
    "note": _note_term,
    "regex": lambda v, cal: description_matches(text_fn.regex_term(v)),
}
ALIASES = {"d": "date", "am": "amount", "a": "account", "c": "category", "conf": "confidence"}


# Columns that registered fields sort by; rows without a value come last.
SORTS: dict[str, str] = {}


def register_field(name: str, builder: Builder, alias: str | None = None, sort: str | None = None) -> None:
    """Add a user-defined search field; ``sort`` is the column that its sort key orders by."""
    FIELDS[name] = builder
    if sort:
        SORTS[name] = sort
    if alias:
        ALIASES[alias] = name


def term(field: str, value: str, negated: bool = False, cal: Calendar | None = None) -> Predicate:
    """A predicate from field and value; an empty value matches everything."""
    name = ALIASES.get(field, field)
    if name not in FIELDS:
        raise ValueError(f"no search field {field}")
    if not value:
        return everything()
    pred = FIELDS[name](value, cal) or everything()
    return negate(pred) if negated else pred
