"""First match claims, override modes and previews."""

import pytest
from pyspark.sql import functions as F

from conftest import AT, table
from passbook.operators import predicates
from passbook.operators import rules as ops
from passbook.sources import star


def rule(position, category_id, *terms, mode="all", review=False):
    return {
        "id": position + 10, "name": f"r{position}", "position": position, "category_id": category_id,
        "override_mode": mode, "review_required": review,
        "terms": [(t[0], t[1], len(t) > 2) for t in terms],
    }


def run(spark, books, *rules):
    return ops.apply_rules(books.with_tables(rules=table(spark, "rules", list(rules))), AT)


def state(enrichments):
    return {r.transaction_id: (r.category_id, r.category_source, r.category_confirmed) for r in enrichments.collect()}


def test_first_match_claims_even_when_it_declines(spark, golden):
    got = run(
        spark, golden,
        rule(0, 2, ("text", "bakery"), mode="uncategorised"),
        rule(1, 3, ("account", "Meridian/Joint")),
        rule(2, 3, ("note", "shares"), review=True),
    )
    after = state(got.enrichments)
    # Village Bakery was claimed by the first rule, which declined; leg 7 stays free.
    assert after[5] == (1, "ai", False) and 7 not in after
    assert after[4] == (3, "rule", False)
    assert [(r.transaction_id, r.rule_id, r.category_id) for r in got.changes.collect()] == [(4, 12, 3)]


@pytest.mark.parametrize("mode, changed", [("uncategorised", {4}), ("ai", {4, 5}), ("all", {2, 3, 4, 5, 50})])
def test_override_modes(spark, golden, mode, changed):
    got = run(spark, golden, rule(0, 1, mode=mode))
    assert {r.transaction_id for r in got.changes.collect()} == changed


def test_terms_as_data(spark, golden):
    got = run(
        spark, golden,
        rule(0, 3, ("d", "2023-09"), ("am", "..-1")),
        rule(1, 3, ("tag", "#HOUSE"), ("category", "Home"), ("conf", "any", True)),
        rule(2, 2, ("regex", "^Divi"), ("date", "not a date")),
        rule(3, None, ("regex", ".")),
        rule(4, 2, ("confidence", ">60"), ("account", "/joint|nothing")),
    )
    assert {r.transaction_id: r.rule_id for r in got.changes.collect()} == {1: 10, 2: 11, 4: 12, 5: 14}


def test_rerun_reports_nothing(spark, golden):
    rules = [rule(0, 3, ("text", "dividend"), review=True)]
    once = run(spark, golden, *rules)
    again = run(spark, golden.with_tables(enrichments=once.enrichments), *rules)
    assert once.changes.count() == 1 and again.changes.count() == 0
    assert state(again.enrichments) == state(once.enrichments)


def test_counts_and_ledgers_apart(spark, golden):
    rows = [rule(0, 1, ("text", "bakery")), {**rule(1, 1), "ledger_id": "M"}, rule(2, None, ("amount", "..0"))]
    books = golden.with_tables(rules=table(spark, "rules", rows))
    counts = {(r.ledger_id, r.name): r.matches for r in ops.rule_match_counts(books).collect()}
    assert counts == {("L", "r0"): 2, ("M", "r1"): 0, ("L", "r2"): 5}


def test_one_bad_pattern_drops_its_clause_only(spark, golden):
    """A bad pattern in one ledger does not stop the rules of another."""
    other = golden.with_tables(
        transactions=golden.transactions.unionByName(golden.transactions.withColumn("ledger_id", F.lit("M"))),
        accounts=golden.accounts.unionByName(golden.accounts.withColumn("ledger_id", F.lit("M"))),
        banks=golden.banks.unionByName(golden.banks.withColumn("ledger_id", F.lit("M"))),
        rules=table(spark, "rules", [
            rule(0, 1, ("regex", "("), ("amount", ">3000")), {**rule(1, 2, ("regex", "/BAKERY/i")), "ledger_id": "M"},
        ]),
    )
    got = {(r.ledger_id, r.transaction_id, r.rule_id) for r in ops.claims(other).collect()}
    assert got == {("L", 3, 10), ("M", 1, 11), ("M", 5, 11)}


def test_unknown_and_registered_fields(spark, golden):
    rules = lambda *t: golden.with_tables(rules=table(spark, "rules", [rule(0, 1, *t)]))
    with pytest.raises(ValueError, match="no search field"):
        ops.claims(rules(("colour", "red")))
    predicates.register_field("weekday", lambda v, cal: predicates.Predicate(frozenset(["date"]), lambda get: F.weekday(get("date")) == int(v)), "wd")
    try:
        got = {r.transaction_id for r in ops.claims(rules(("wd", "0"), ("amount", "..0"))).collect()}
    finally:
        del predicates.FIELDS["weekday"], predicates.ALIASES["wd"]
    assert got == {1, 6}


def test_many_patterns(spark, golden):
    """A thousand rules, each with a pattern of its own; the first match wins."""
    rows = [rule(i, 1, ("regex", f"nothing{i}x")) for i in range(1000)] + [rule(1000, 2, ("regex", "Bakery"))]
    got = ops.claims(golden.with_tables(rules=table(spark, "rules", rows))).collect()
    assert {(r.transaction_id, r.rule_id) for r in got} == {(1, 1010), (5, 1010)}


def test_shared_views_are_written_once(spark):
    """Tables of ledgers under rules read stored views instead of deriving them again, with the same rows."""
    place = "/root/testdata/sf0.001"
    books = star.books(spark, place, stored=star.SHARED)
    assert "Join" not in books.transactions._jdf.queryExecution().optimizedPlan().toString()
    plain = star.books(spark, place).transactions
    assert sorted(map(tuple, books.transactions.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
