"""Search: predicates, order and limit over the wide view, and over both sides of transfers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passbook.operators import views
from passbook.operators.predicates import SORTS, Predicate, all_of, any_of, fuzzy_matches
from passbook.schema import Books

# Sort names and the columns they stand for (fixed values).
SORT_COLUMNS = {
    "date": "date",
    "description": "description",
    "amount": "amount_cents",
    "balance": "balance_cents",
    "account": "account_name",
    "bank": "bank_name",
    "category": "category_path",
    "confidence": "ai_confidence",
}
NULLS_LAST = ("category", "confidence")

# Scores of an alignment of letters: a letter found, the start of a word, a capital inside one, a letter
# next to the one before, a gap and each further character of it.
HIT, WORD, CAPITAL, RUN, GAP, WIDER = 16, 8, 7, 4, 3, 1


def default_order() -> list[Column]:
    return [F.desc("date"), F.desc("id"), F.asc("ledger_id")]


def parse_sort(value: str) -> list[tuple[str, bool]]:
    """``date,-amount`` as (name, descending) pairs."""
    keys = []
    for part in filter(None, value.split(",")):
        descending = part.startswith("-")
        name = part.removeprefix("-").lower()
        if name not in SORT_COLUMNS and name not in SORTS:
            raise ValueError(f"no such sort key: {part.removeprefix('-')}")
        keys.append((name, descending))
    return keys


def last_sort(terms: Iterable[str]) -> list[tuple[str, bool]]:
    """The last of several sort terms wins; an empty or invalid one clears the order."""
    keys: list[tuple[str, bool]] = []
    for value in terms:
        try:
            keys = parse_sort(value)
        except ValueError:
            keys = []
    return keys


def sort_by(keys: str | list[tuple[str, bool]], columns: Iterable[str]) -> list[Column]:
    """Order columns, absent ones skipped, newest id last as tiebreak."""
    pairs = parse_sort(keys) if isinstance(keys, str) else keys
    present = set(columns)
    order = []
    for name, descending in pairs:
        column = SORT_COLUMNS.get(name) or SORTS[name]
        if column not in present:
            continue
        if name in NULLS_LAST or name in SORTS:
            order.append(F.desc_nulls_last(column) if descending else F.asc_nulls_last(column))
        else:
            order.append(F.desc(column) if descending else F.asc(column))
    return order + [F.desc("id"), F.asc("ledger_id")] if order else default_order()


def supported(preds: Iterable[Predicate], columns: Iterable[str], on_missing: str = "drop") -> list[Predicate]:
    """Predicates whose columns exist; the others are dropped or refused."""
    present = set(columns)
    kept = []
    for pred in preds:
        missing = pred.needs - present
        if not missing:
            kept.append(pred)
        elif on_missing == "error":
            raise ValueError(f"no such column: {', '.join(sorted(missing))}")
    return kept


def where(df: DataFrame, preds: Iterable[Predicate], on_missing: str = "drop") -> DataFrame:
    """Filter ``df`` by all predicates."""
    return df.filter(all_of(supported(preds, df.columns, on_missing)).column())


def _order(df: DataFrame, sort: str | None) -> list[Column]:
    return sort_by(sort, df.columns) if sort else default_order()


def first_rows(df: DataFrame, sort: str | None, limit: int) -> DataFrame:
    """The first ``limit`` rows of each ledger.

    The bound on a row number lets Spark cut each partition before the shuffle, so
    a large ledger sends few rows.
    """
    place = F.row_number().over(Window.partitionBy("ledger_id").orderBy(*_order(df, sort)))
    return df.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place")


def arrange(df: DataFrame, sort: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows in order; a limit holds for each ledger."""
    kept = df if limit is None else first_rows(df, sort, limit)
    return kept.orderBy(*_order(df, sort))


def search(
    books: Books,
    preds: Iterable[Predicate] = (),
    sort: str | None = None,
    limit: int | None = None,
    also: Iterable[str] = (),
    matching: DataFrame | None = None,
    excluding: DataFrame | None = None,
) -> DataFrame:
    """Live transactions that satisfy all predicates, ordered, at most ``limit`` of each ledger.

    Side tables are joined only for columns some predicate, sort key or
    ``also`` uses.  ``matching`` and ``excluding`` are (ledger_id, id) sets from
    the full-text operators.
    """
    preds = list(preds)
    needs = set(also).union(*(p.needs for p in preds))
    if sort:
        needs |= {SORT_COLUMNS[name] for name, _ in parse_sort(sort)}
    view = views.live(views.wide_view(books, needs))
    found = view.filter(all_of(preds).column())
    if matching is not None:
        found = found.join(matching.select("ledger_id", "id"), ["ledger_id", "id"], "left_semi")
    if excluding is not None:
        found = found.join(excluding.select("ledger_id", "id"), ["ledger_id", "id"], "left_anti")
    return arrange(found, sort, limit)


def either_side(
    df: DataFrame, preds: Iterable[Predicate], sides: tuple[str, str] = ("from_tx", "to_tx")
) -> DataFrame:
    """Transfers one of whose sides satisfies all predicates.

    Negated predicates are dropped; a predicate on the score reads the
    transfer's own; a side without any clause leaves the choice to the other.
    """
    own = {"ai_confidence"}
    kept = [p for p in preds if not p.negated]
    tests = []
    for side in sides:
        fields = set(df.schema[side].dataType.names) | own
        usable = supported(kept, fields)
        if usable:
            get = lambda name, s=side: F.col(name) if name in own else F.col(f"{s}.{name}")
            tests.append(all_of(usable).column(get))
    if not tests:
        return df
    return df.filter(tests[0] | tests[1] if len(tests) == 2 else tests[0])


def transfer_order() -> list[Column]:
    return [F.desc("created_at"), F.desc("id"), F.asc("ledger_id")]


def fuzzy_filter(df: DataFrame, columns: Iterable[str], pattern: str) -> DataFrame:
    """Subsequence match on any column; a row with an unresolved (NULL) column is kept."""
    names = list(columns)
    if not pattern.split():
        return df
    unresolved = any_of(
        Predicate(frozenset([n]), lambda get, n=n: get(n).isNull()) for n in names
    )
    hit = fuzzy_matches(names, pattern).column()
    return df.filter(F.coalesce(hit, F.lit(False)) | unresolved.column())


def transactions_in_category(books: Books, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Live transactions of the given (ledger_id, category_id)."""
    key = ["ledger_id", "category_id"]
    view = views.live(views.wide_view(books, {"category_id"}))
    return arrange(view.join(ids.select(*key), key, "left_semi"), limit=limit)


def transactions_in_account(books: Books, ids: DataFrame, limit: int | None = None) -> DataFrame:
    """Live transactions of the given (ledger_id, account_id)."""
    key = ["ledger_id", "account_id"]
    view = views.live(views.wide_view(books, set()))
    return arrange(view.join(ids.select(*key), key, "left_semi"), limit=limit)


def alignment_score(path: Column | str, pattern: str) -> Column:
    """Score of the best way to find the letters of a pattern in order in a text; NULL if there is none.

    Every letter counts ``HIT``.  A letter at the start of a word, or behind a smaller letter as a
    capital, has a bonus, twofold for the first letter; a letter next to the one before has at least
    ``RUN``; a gap costs ``GAP`` and ``WIDER`` for each further character.  Blank-separated parts are found apart
    and their scores added.  One array of scores by place is built for each letter.
    """
    text = F.col(path) if isinstance(path, str) else path
    chars = F.split(text, "")
    lower = F.transform(chars, F.lower)
    word = r"[\p{L}\p{N}]"

    def bonus(at: Column) -> Column:
        here, before = F.get(chars, at), F.get(chars, at - 1)
        start = (at == 0) | (~before.rlike(word) & here.rlike(word))
        capital = before.rlike(r"\p{Ll}") & here.rlike(r"\p{Lu}")
        return F.when(start, WORD).when(capital, CAPITAL).otherwise(0)

    def first(letter: str) -> Column:
        return F.transform(lower, lambda c, i: F.when(c == letter, HIT + 2 * bonus(i)))

    def then(letter: str, scores: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            joined = F.get(scores, i - 1) + F.greatest(bonus(i), F.lit(RUN))
            # Places two or more before this one.
            far = F.transform(F.slice(scores, F.lit(1), F.greatest(i - 1, F.lit(0))), lambda v, k: v - (GAP + (i - k - 2) * WIDER))
            return F.when(c == letter, HIT + F.greatest(joined, F.array_max(far) + bonus(i)))

        return F.transform(lower, one)

    total = F.lit(0)
    for part in pattern.lower().split():
        scores = first(part[0])
        for letter in part[1:]:
            scores = then(letter, scores)
        total = total + F.array_max(scores)
    return total


def find_categories(categories: DataFrame, text: str) -> DataFrame:
    """Fuzzy category lookup with ``score`` and ``place`` in its ledger, best first; equal scores by length, then path."""
    if not text.split():
        return categories.orderBy("ledger_id", "path")
    found = categories.withColumn("score", alignment_score("path", text)).filter(F.col("score").isNotNull())
    best = Window.partitionBy("ledger_id").orderBy(F.desc("score"), F.length("path"), "path")
    return found.withColumn("place", F.row_number().over(best)).orderBy("ledger_id", "place")
