"""Ordered saved searches that assign categories; the first match claims a transaction.

Rules are rows.  Each is filed under its most selective term (``rule_index``);
a transaction fetches the rules filed under its own keys and only these are
evaluated on it.  Terms are compiled and patterns checked on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.money import amount_bounds, confidence_bounds
from passbook.functions.periods import Calendar, resolve
from passbook.functions.text import regex_term, searchable_text, tag_name, token_list, tokens
from passbook.operators import views
from passbook.operators.curate import set_categories
from passbook.operators.predicates import ALIASES, Predicate, term
from passbook.operators.predicates import FIELDS as REGISTERED
from passbook.operators.ranking import rank_sorted
from passbook.operators.rule_index import EVERY, RANKS, row_keys, term_keys
from passbook.schema import OVERRIDE_MODES, Books
from passbook.session import cut_lineage

# A compiled term; ``kind`` says which of the fields count.
COMPILED = (
    "kind string, date_low date, date_high date, low double, high double, "
    "low_open boolean, high_open boolean, magnitude boolean, present boolean, "
    "left array<string>, right array<string>, literal int, pattern string, rank int, keys array<string>"
)

# Fields a stored rule may use besides registered ones (fixed values).
FIELDS = ("date", "amount", "account", "category", "confidence", "tag", "note", "regex", "text")

# Rules of one kind in a ledger that are not worth keys.
FEW = 8

# Transactions of a ledger that one copy of its rules meets.
SPLIT = 2_000_000

# Wide-view columns each field reads.
FIELD_NEEDS = {
    "category": ["category_path"],
    "confidence": ["ai_confidence"],
    "tag": ["tags"],
    "note": ["note"],
}


def compile_term(field: str, value: str, cal: Calendar | None, literals: dict[tuple[str, str], int | None]) -> dict:
    """Typed form of one term; an empty or invalid one constrains nothing (kind NULL).

    ``literals`` numbers the values of registered fields, which are columns of their own.  None stands
    for one that adds no clause.
    """
    out = dict.fromkeys(
        ("kind", "date_low", "date_high", "low", "high", "low_open", "high_open", "magnitude", "present", "left", "right",
         "literal", "pattern", "rank", "keys")
    )
    # Names and aliases registered on the driver are known there, so these are looked up as written.
    if (field, value) in literals:
        if literals[field, value] is not None:
            out.update(kind="literal", literal=literals[field, value])
        return out
    field = ALIASES.get(field, field)
    try:
        if not value:
            return out
        if field == "date":
            low, high = resolve(value, cal)
            if low or high:
                out.update(kind="date", date_low=low, date_high=high)
        elif field in ("confidence", "tag", "note") and value.lower() in ("any", "none"):
            out.update(kind=f"has_{field}", present=value.lower() == "any")
        elif field in ("amount", "confidence"):
            bounds = amount_bounds(value) if field == "amount" else confidence_bounds(value)
            if not bounds.empty:
                out.update(
                    kind=field, low=bounds.low, high=bounds.high, low_open=bounds.low_open,
                    high_open=bounds.high_open, magnitude=bounds.magnitude,
                )
        elif field == "account":
            parts = [p.lower().partition("/") for p in value.split("|") if p]
            if parts:
                out.update(kind="account", left=[p[0] for p in parts], right=[p[2] for p in parts])
        elif field == "category":
            parts = [p.lower() for p in value.split("|") if p]
            if parts:
                out.update(kind="category", left=parts)
        elif field == "tag":
            names = [tag_name(p) for p in value.split("|") if p]
            if names and all(names):
                out.update(kind="tag", left=names)
        elif field == "regex":
            out.update(kind="regex", pattern=regex_term(value))
        elif field == "note":
            needle = value.lower().replace("%", "").replace("_", "")
            if needle:
                out.update(kind="note", left=[needle])
        elif field == "text":
            words = token_list(value)
            if words:
                out.update(kind="text", left=words)
    except ValueError:
        pass
    keys = term_keys(out)
    if keys:
        out.update(rank=RANKS[out["kind"]], keys=keys)
    return out


def literal_terms(rules: DataFrame, cal: Calendar | None) -> tuple[dict[tuple[str, str], int | None], list[Predicate]]:
    """Terms of registered fields, numbered, and their expressions.

    A registered field builds a column from a value on the driver, so each distinct value that rules
    ask of it comes there; no other term does.
    """
    rows = rules.select(F.explode("terms").alias("t")).select("t.field", "t.value").filter(F.length("value") > 0)
    own = [*FIELDS, *(a for a, n in ALIASES.items() if n in FIELDS)]
    known = [n for n in [*REGISTERED, *ALIASES] if n not in own]
    strange = rows.filter(~F.col("field").isin(*own, *known)).select("field").first()
    if strange is not None:
        raise ValueError(f"no search field {strange['field']}")
    found = rows.filter(F.col("field").isin(*known)).distinct().collect() if known else []
    numbers: dict[tuple[str, str], int | None] = {}
    preds: list[Predicate] = []
    for field, value in sorted((r["field"], r["value"]) for r in found):
        try:
            pred = term(ALIASES.get(field, field), value, cal=cal)
        except ValueError:
            pred = None
        numbers[field, value] = None
        if pred is not None and pred.clause(F.col) is not None:
            numbers[field, value] = len(preds)
            preds.append(pred)
    return numbers, preds


def compile_rules(
    rules: DataFrame, cal: Calendar | None, literals: dict[tuple[str, str], int | None] | None = None
) -> DataFrame:
    """Rules that assign a category, one row for each key they are filed under.

    Columns: ledger_id, key, and ``rule`` with its place, id, outcome, tests and all its keys.
    Terms are compiled on the executors by a small vectorised helper; a pattern that the engine of
    regular expressions refuses adds no clause.
    """
    known = literal_terms(rules, cal)[0] if literals is None else literals

    @F.pandas_udf(COMPILED)
    def compiled(field: pd.Series, value: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([compile_term(f, v, cal, known) for f, v in zip(field, value)])
        return out.astype({"literal": "Int32", "rank": "Int32"})

    active = rules.filter(F.col("category_id").isNotNull())
    terms = active.select("ledger_id", "id", F.explode("terms").alias("t")).select(
        "ledger_id",
        "id",
        F.coalesce("t.negated", F.lit(False)).alias("negated"),
        compiled(F.coalesce("t.field", F.lit("")), F.coalesce("t.value", F.lit(""))).alias("term"),
    )
    accepted = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("term.pattern")).isNotNull()
    kept = terms.filter(F.col("term.kind").isNotNull() & (F.col("term.pattern").isNull() | accepted))
    packed = kept.groupBy("ledger_id", "id").agg(
        F.collect_list(F.struct("negated", F.col("term").dropFields("keys", "rank").alias("term"))).alias("tests"),
        F.min_by("term.keys", F.when(~F.col("negated"), F.col("term.rank"))).alias("keys"),
        F.min(F.when(~F.col("negated"), F.col("term.rank"))).alias("rank"),
    )
    none = F.array().cast(packed.schema["tests"].dataType)
    mode_ok = F.col("override_mode").isin(*OVERRIDE_MODES)
    bad_mode = F.raise_error(F.concat(F.lit("unknown override mode: "), F.col("override_mode")))
    keys = F.when(F.col("rank").isNotNull(), F.col("keys")).otherwise(F.array(F.lit(EVERY)))
    rows = active.join(packed, ["ledger_id", "id"], "left").select(
        "ledger_id",
        F.coalesce("rank", F.lit(-1)).alias("rank"),
        F.struct(
            "position",
            F.col("id").alias("rule_id"),
            "category_id",
            F.when(mode_ok, F.col("override_mode")).otherwise(bad_mode).alias("override_mode"),
            "review_required",
            F.coalesce("tests", none).alias("tests"),
            keys.alias("keys"),
        ).alias("rule"),
    )
    return rows.select("ledger_id", F.explode("rule.keys").alias("key"), "rank", "rule")


def _holds(term: Column, columns: set[str], literals: list[Predicate]) -> Column:
    """Whether the row satisfies one compiled term; NULL counts as no."""
    amount = F.when(term["magnitude"], F.abs("amount_cents")).otherwise(F.col("amount_cents"))

    def within(value: Column) -> Column:
        above = term["low"].isNull() | (value > term["low"]) | (~term["low_open"] & (value == term["low"]))
        below = term["high"].isNull() | (value < term["high"]) | (~term["high_open"] & (value == term["high"]))
        return above & below

    lower_bank, lower_account = F.col("_bank"), F.col("_account")
    places = F.zip_with(
        term["left"], term["right"],
        lambda b, a: lower_bank.startswith(b) & lower_account.startswith(a),
    )
    result = (
        F.when(
            term["kind"] == "date",
            (term["date_low"].isNull() | (F.col("date") >= term["date_low"]))
            & (term["date_high"].isNull() | (F.col("date") <= term["date_high"])),
        )
        .when(term["kind"] == "amount", within(amount))
        .when(term["kind"] == "account", F.exists(places, lambda hit: hit))
        .when(term["kind"] == "regex", F.rlike("description", term["pattern"]))
    )
    for i, pred in enumerate(literals):
        result = result.when((term["kind"] == "literal") & (term["literal"] == i), pred.column(F.col))
    if "ai_confidence" in columns:
        score = F.col("ai_confidence")
        result = result.when(term["kind"] == "confidence", within(score)).when(
            term["kind"] == "has_confidence", score.isNotNull() == term["present"]
        )
    if "category_path" in columns:
        path = F.lower("category_path")
        result = result.when(
            term["kind"] == "category",
            F.exists(
                term["left"],
                lambda p: F.when(p.startswith("/"), F.contains(path, p)).otherwise(path.startswith(p)),
            ),
        )
    if "tags" in columns:
        tags = F.coalesce("tags", F.array().cast("array<string>"))
        result = result.when(
            term["kind"] == "tag",
            F.exists(tags, lambda t: F.exists(term["left"], lambda n: (t == n) | t.startswith(F.concat(n, F.lit("/"))))),
        ).when(term["kind"] == "has_tag", (F.size(tags) > 0) == term["present"])
    if "note" in columns:
        result = result.when(term["kind"] == "note", F.contains(F.lower("note"), term["left"][0])).when(
            term["kind"] == "has_note", F.col("note").isNotNull() == term["present"]
        )
    if "tokens" in columns:
        result = result.when(term["kind"] == "text", F.size(F.array_except(term["left"], F.col("tokens"))) == 0)
    return F.coalesce(result, F.lit(False))


def _candidates(books: Books, cal: Calendar | None) -> DataFrame:
    """Live transactions beside each rule they fetch and meet: their columns, ``rule`` and ``_key``.

    A rule with several keys may come several times.
    """
    literals, preds = literal_terms(books.rules, cal)
    # Only known field names come back, so the driver sees a handful of rows.
    fields = books.rules.select(F.explode("terms.field").alias("field"))
    known = fields.filter(F.col("field").isin(*FIELDS, *ALIASES)).distinct().collect()
    used = {ALIASES.get(r.field, r.field) for r in known}
    needs = {c for f in used for c in FIELD_NEEDS.get(f, [])}.union(*(p.needs for p in preds))
    if "text" in used:
        needs.add("note")
    view = views.live(views.wide_view(books, needs))
    if "text" in used:
        view = view.withColumn("tokens", F.array_distinct(tokens(searchable_text("description", "metadata", "note"))))
        needs.add("tokens")
    view = view.withColumn("_bank", F.lower("bank_name")).withColumn("_account", F.lower("account_name"))
    # Stored, so that its size decides how it is joined.
    filed = cut_lineage(compile_rules(books.rules, cal, literals))
    # Keys of a kind pay where a ledger has more than a few such rules; fewer meet all its rows.
    held = filed.groupBy("ledger_id", "rank").agg(F.count_distinct("rule.rule_id").alias("n")).groupBy("rank").agg(F.max("n").alias("n"))
    ranks = {r["rank"]: r["n"] for r in held.collect()}
    kinds = {kind for kind, rank in RANKS.items() if ranks.get(rank, 0) > FEW}
    keyed = F.col("rank").isin([RANKS[kind] for kind in kinds]) if kinds else F.lit(False)
    if any(n <= FEW or rank < 0 for rank, n in ranks.items()):
        kinds = kinds | {EVERY}
        every = F.col("rule").withField("keys", F.array(F.lit(EVERY)))
        rest = filed.filter(~keyed & (F.col("key") == F.col("rule.keys")[0]))
        filed = filed.filter(keyed).unionByName(rest.withColumn("rule", every).withColumn("key", F.lit(EVERY)))
    rows = view.withColumn("_keys", row_keys(kinds)).withColumn("_key", F.explode("_keys"))
    filed = filed.select("ledger_id", F.col("key").alias("_key"), "rule")
    join = ["ledger_id", "_key"]
    # A ledger of very many rows meets copies of its rules, each with a share of its rows.
    hot = cut_lineage(
        books.transactions.groupBy("ledger_id").count().filter(F.col("count") > SPLIT)
        .select("ledger_id", F.ceil(F.col("count") / SPLIT).cast("int").alias("_shares"))
    )
    if not hot.isEmpty():
        shares = F.coalesce("_shares", F.lit(1))
        rows = rows.join(hot, "ledger_id", "left").withColumn("_share", F.pmod(F.xxhash64("id"), shares).cast("int")).drop("_shares")
        filed = filed.join(hot, "ledger_id", "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
        join.append("_share")
    meets = F.forall("rule.tests", lambda test: _holds(test["term"], needs, preds) != test["negated"])
    return rows.join(filed, join).filter(meets)


def claims(books: Books, cal: Calendar | None = None) -> DataFrame:
    """The first matching rule of each live transaction: its id, category and modes."""
    outcome = ("position", "rule_id", "category_id", "override_mode", "review_required")
    first = F.min(F.struct(*[F.col(f"rule.{c}").alias(c) for c in outcome])).alias("rule")
    return _candidates(books, cal).groupBy("ledger_id", "id").agg(first).select(
        "ledger_id",
        F.col("id").alias("transaction_id"),
        "rule.rule_id",
        F.col("rule.category_id").alias("rule_category_id"),
        "rule.override_mode",
        "rule.review_required",
    )


def override_allows() -> Column:
    """Whether a claiming rule may write over what the transaction has.

    Reads ``has_enrichment``, ``category_id``, ``category_source``,
    ``category_confirmed``, ``rule_category_id`` and ``override_mode``.
    """
    settled = F.col("category_confirmed") & F.col("category_id").eqNullSafe(F.col("rule_category_id"))
    return (
        F.when(F.col("has_enrichment").isNull(), True)
        .when(F.coalesce(settled, F.lit(False)), False)
        .when(F.col("override_mode") == "uncategorised", False)
        .when(F.col("override_mode") == "ai", F.col("category_source").eqNullSafe(F.lit("ai")))
        .otherwise(True)
    )


def without_drafts(enrichments: DataFrame) -> DataFrame:
    """Enrichments less the unconfirmed ones that rules wrote."""
    draft = (F.col("category_source") == "rule") & ~F.col("category_confirmed")
    return enrichments.filter(~F.coalesce(draft, F.lit(False)))


@dataclass(frozen=True)
class RuleRun:
    """What a run would write and which rows change their rule category."""

    enrichments: DataFrame
    changes: DataFrame


def apply_rules(books: Books, at: str, cal: Calendar | None = None, materialise: bool = False) -> RuleRun:
    """Run all rules.  A pure function, so it is also the preview.

    With ``materialise`` the rows to write are stored once, for callers that
    use both parts of the result.

    A transaction belongs to the first rule that matches it, even when that
    rule then declines because of a transfer leg or its override mode.
    """
    kept = without_drafts(books.enrichments)
    claimed = claims(books.with_tables(enrichments=kept), cal)
    legs = views.leg_ids(books.transfers).withColumnRenamed("id", "transaction_id")
    key = ["ledger_id", "transaction_id"]
    existing = kept.select(
        *key, "category_id", "category_source", "category_confirmed", F.lit(True).alias("has_enrichment")
    )
    writes = (
        claimed.join(legs, key, "left_anti")
        .join(existing, key, "left")
        .filter(override_allows())
        .select(
            *key,
            F.col("rule_category_id").alias("category_id"),
            F.lit("rule").alias("category_source"),
            (~F.col("review_required")).alias("category_confirmed"),
            F.lit(None).cast("double").alias("ai_confidence"),
            "rule_id",
        )
    )
    if materialise:
        writes = cut_lineage(writes)
    prior = books.enrichments.filter(
        (F.col("category_source") == "rule") & F.col("category_id").isNotNull()
    ).select(*key, F.col("category_id").alias("prior_category_id"))
    changes = (
        writes.join(prior, key, "left")
        .filter(~F.col("category_id").eqNullSafe(F.col("prior_category_id")))
        .select(*key, "rule_id", "prior_category_id", "category_id")
    )
    return RuleRun(set_categories(kept, writes.drop("rule_id"), books.transfers, at), changes)


def preview_rules(books: Books, at: str, cal: Calendar | None = None) -> DataFrame:
    """The changes a run would make."""
    return apply_rules(books, at, cal).changes


def rule_match_counts(books: Books, cal: Calendar | None = None) -> DataFrame:
    """Live transactions each rule matches, counted in one scan; zero included."""
    # Counting needs no category, so a rule without one counts too.
    counted = books.with_tables(rules=books.rules.withColumn("category_id", F.coalesce("category_id", F.lit(0))))
    # A rule that a row fetches by several keys counts at the first of them.
    first = F.element_at(F.array_intersect("rule.keys", "_keys"), 1) == F.col("_key")
    hits = _candidates(counted, cal).filter(first).select("ledger_id", F.col("rule.rule_id").alias("id"))
    counts = hits.groupBy("ledger_id", "id").agg(F.count(F.lit(1)).alias("_n"))
    return books.rules.join(counts, ["ledger_id", "id"], "left").select(
        "ledger_id", "id", "name", F.coalesce("_n", F.lit(0)).alias("matches")
    )


def list_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy("ledger_id", "position", "id")


def rules_using_category(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """Rules that assign one of (ledger_id, category_id), in order."""
    key = ["ledger_id", "category_id"]
    return list_rules(rules.join(ids.select(*key), key, "left_semi").select(*rules.columns))


def edit_rules(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """Change rules by (ledger_id, id, field-wise new values, delete flag).

    ``edits`` columns: name, terms, category_id, clear_category, override_mode,
    review_required, deleted; NULL leaves a value as it is.
    """
    renamed = edits.select(
        "ledger_id", "id", *[F.col(c).alias(f"_{c}") for c in edits.columns if c not in ("ledger_id", "id")]
    )
    both = rules.join(renamed, ["ledger_id", "id"], "left").filter(~F.coalesce("_deleted", F.lit(False)))
    for c in ("name", "terms", "category_id", "override_mode", "review_required"):
        both = both.withColumn(c, F.coalesce(f"_{c}", c))
    cleared = F.when(~F.coalesce("_clear_category", F.lit(False)), F.col("category_id"))
    return both.withColumn("category_id", cleared).select(*rules.columns)


def create_rules(rules: DataFrame, fresh: DataFrame, at: str) -> DataFrame:
    """Append (ledger_id, name, terms): no category, mode ``uncategorised``, no review."""
    tops = rules.groupBy("ledger_id").agg(
        F.max("id").alias("_id"), (F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("_position")
    )
    # Equal names keep apart by their terms.
    ranked = rank_sorted(fresh.withColumn("_terms", F.to_json("terms")), ["ledger_id"], ["name", "_terms"])
    rows = ranked.join(tops, "ledger_id", "left").select(
        "ledger_id",
        (F.coalesce("_id", F.lit(0)) + F.col("_rank")).cast("bigint").alias("id"),
        "name",
        "terms",
        F.lit(None).cast("bigint").alias("category_id"),
        F.lit("uncategorised").alias("override_mode"),
        F.lit(False).alias("review_required"),
        (F.coalesce("_position", F.lit(0)) + F.col("_rank") - 1).cast("bigint").alias("position"),
        F.lit(at).cast("timestamp").alias("created_at"),
    )
    return rules.unionByName(rows)
