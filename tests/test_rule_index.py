"""Filing of rules: keys lose no match, and neither plan nor driver grows with the rules."""

import random
import re
from datetime import date, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import table
from passbook.operators import rule_index
from passbook.operators import rules as ops

ATOMS = ["ab", "C", "abc", "card", "x+", "y*", "z?", "w{2}", "v{1,}", ".", r"\d", r"\w+", r"\.", r"\p{Alpha}+", "^", "$", "é", "é*", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ATOMS), max_size=8), st.text(alphabet="abcCrdxyzwv1.é ", max_size=25))
def test_runs_stand_in_every_match(atoms, text):
    pattern = "".join(atoms)
    runs = rule_index.literal_runs(pattern)
    found = re.search(pattern.replace(r"\p{Alpha}", "[A-Za-z]"), text)
    if found and runs:
        assert all(r in text.lower() for r in runs)


def test_runs():
    assert rule_index.literal_runs(r"(?i)^Card \p{Alpha}+ machinery$") == ["card ", " machinery"]
    assert rule_index.literal_runs("abc*de+f?g") == ["ab", "de", "g"]
    assert rule_index.literal_runs("ab{0}cd") == ["a", "cd"]
    assert all(rule_index.literal_runs(p) is None for p in ("a|b", "(ab)", "[ab]c", r"\x41bc", r"\Qa.b\E", "ab\\", "a{2", r"\p{L}{2}a"))
    assert rule_index._digits(-5.0, 1000.0, False) == [1, 2, 3, 4] and rule_index._digits(-250.0, -99.5, False) == [2, 3]


def many(spark, golden, rng, count=160):
    """Ledgers of own rows, with rules of all kinds."""
    words = ["corner", "bakery", "village", "hardware", "wages", "train", "savings", "Tïcket", "42"]
    rows, start = [], date(2023, 9, 1)
    for i in range(count):
        rows.append({
            "ledger_id": "LM"[i % 2], "id": i, "account_id": 1 + i % 4, "date": start + timedelta(days=rng.randrange(400)),
            "description": " ".join(rng.choice(words) for _ in range(rng.randrange(4))), "amount_cents": rng.choice([0, 1, -1]) * rng.randrange(10**rng.randrange(1, 7)),
            "balance_cents": 0, "hash": f"h{i}", "metadata": "{}", "source_file": "f", "import_batch_id": 1,
        })
    other = lambda df: df.unionByName(df.withColumn("ledger_id", ops.F.lit("M")))
    books = golden.with_tables(
        transactions=table(spark, "transactions", rows), banks=other(golden.banks), accounts=other(golden.accounts),
        categories=other(golden.categories), tags=other(golden.tags),
        notes=table(spark, "notes", [{"ledger_id": "LM"[i % 2], "transaction_id": i, "note": "train home"} for i in range(0, count, 7)]),
        transaction_tags=table(spark, "transaction_tags", [{"ledger_id": "LM"[i % 2], "transaction_id": i, "tag_id": 1 + i % 3 % 2} for i in range(0, count, 3)]),
        enrichments=table(spark, "enrichments", [
            {"ledger_id": "LM"[i % 2], "transaction_id": i, "category_id": 1 + i % 4, "category_source": "ai", "category_confirmed": False, "ai_confidence": i % 10 / 10}
            for i in range(0, count, 2)
        ]),
    )
    terms = [
        ("text", "Bakery"), ("text", "corner ticket"), ("text", "home"), ("regex", "age"), ("regex", "/^VILL.*y/i"), ("regex", "(a|b)ak"), ("regex", "("),
        ("tag", "#trip"), ("tag", "house|trip/rail"), ("tag", "none"), ("account", "harb"), ("account", "/joi|meridian/t"), ("category", "eating|trips"),
        ("category", "/bak"), ("confidence", ">50"), ("note", "any"), ("amount", "..0"), ("amount", "10..999.99"), ("amount", "+5..5000"), ("date", "2024"),
        ("date", "2023-10"), ("date", "..2024-02"), ("date", "not one"),
    ]
    made = []
    for i in range(60):
        chosen = rng.sample(terms, rng.choice([0, 1, 1, 2, 2, 3])) if i > 2 else []
        if i <= 2 and i < 1:
            chosen = [("text", "bakery"), ("text", "bakery")]
        made.append({
            "ledger_id": rng.choice("LM"), "id": i, "name": f"r{i}", "position": i if chosen else 99, "category_id": 1 + i % 4, "override_mode": "all",
            "review_required": False, "terms": [(*t, rng.random() < 0.25) for t in chosen],
        })
    return books.with_tables(rules=table(spark, "rules", made))


@pytest.mark.parametrize("split", [None, 20])
def test_filed_rules_equal_all_rules(spark, golden, monkeypatch, split):
    books = many(spark, golden, random.Random(11))
    monkeypatch.setattr(ops, "FEW", 3 if split else 0)
    if split:
        monkeypatch.setattr(ops, "SPLIT", split)
    claimed = sorted(map(tuple, ops.claims(books).collect()))
    counts = sorted(map(tuple, ops.rule_match_counts(books).collect()))
    # Every rule beside every row: what the keys must not change.
    monkeypatch.setattr(ops, "term_keys", lambda term: [])
    assert claimed == sorted(map(tuple, ops.claims(books).collect())) and len({c[2] for c in claimed}) > 8
    assert counts == sorted(map(tuple, ops.rule_match_counts(books).collect())) and sum(c[3] > 0 for c in counts) > 30


def test_ten_thousand_rules(spark, golden):
    ledgers = [f"L{n}" for n in range(10)]
    spread = lambda df: df.withColumn("ledger_id", ops.F.explode(ops.F.array(*map(ops.F.lit, ledgers))))
    books = golden.with_tables(transactions=spread(golden.transactions), accounts=spread(golden.accounts), banks=spread(golden.banks))

    def rules(count):
        rows = []
        for i in range(count):
            term = ("regex", f"shop number {i}", False) if i % 2 else ("text", f"word{i}", False)
            rows.append((ledgers[i % 10], i, f"r{i}", [term], 1, "all", False, i, None))
        rows += [(n, 10**6, "last", [("regex", "^Village B", False)], 2, "all", False, 10**6, None) for n in ledgers]
        return books.with_tables(rules=spark.createDataFrame(rows, books.rules.schema))

    plans = []
    for count in (100, 10_000):
        found = ops.claims(rules(count))
        plans.append(len(found._jdf.queryExecution().optimizedPlan().toString()))
        assert sorted((r.ledger_id, r.transaction_id, r.rule_id) for r in found.collect()) == [(n, 5, 10**6) for n in ledgers]
    assert plans[1] < 1.1 * plans[0]
