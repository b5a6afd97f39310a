"""Bulk edits and the integrity of the ledger under them."""

import pytest

from conftest import AT, table
from passbook.operators import curate, predicates as p, views


def keyed(df, *cols):
    return {r.transaction_id: tuple(r[c] for c in cols) for r in df.collect()}


def edits(spark, rows):
    return spark.createDataFrame(
        [("L", *r) for r in rows],
        "ledger_id string, transaction_id long, category_id long, category_source string, "
        "category_confirmed boolean, ai_confidence double, seq long",
    )


def ids(spark, *numbers, name="transaction_id"):
    return spark.createDataFrame([("L", n) for n in numbers], f"ledger_id string, {name} long")


def test_set_categories(spark, golden):
    rows = edits(spark, [
        (1, 2, "manual", True, None, 1), (1, 3, "ai", False, 0.5, 2),
        (4, 3, "manual", True, None, 3), (6, 1, "manual", True, None, 4),
    ])
    after = curate.set_categories(golden.enrichments, rows, golden.transfers, AT)
    got = keyed(after, "category_id", "category_source", "ai_confidence")
    assert got[1] == (3, "ai", 0.5) and got[4] == (3, "manual", None) and 6 not in got and len(got) == 6
    with pytest.raises(Exception, match="transfer leg"):
        curate.set_categories(golden.enrichments, rows, golden.transfers, AT, strict=True).collect()


def test_confirm_and_clear(spark, golden):
    assert keyed(curate.confirm_categories(golden.enrichments, ids(spark, 5, 6), AT), "category_confirmed")[5] == (True,)
    assert set(keyed(curate.clear_categories(golden.enrichments, ids(spark, 1, 9)))) == {2, 3, 5, 50}


def test_category_tree(spark, golden):
    paths = spark.createDataFrame([("L", " /Eating/Bakery/ "), ("L", "New"), ("L", " / ")], "ledger_id string, path string")
    after = curate.get_or_create_categories(golden.categories, paths, AT)
    assert {(r.category_id, r.path) for r in after.collect()} >= {(1, "Eating/Bakery"), (5, "New")} and after.count() == 5
    clash = spark.createDataFrame([("L", 1, "Pay/Wages")], "ledger_id string, category_id long, path string")
    with pytest.raises(Exception, match="category exists"):
        curate.rename_categories(golden.categories, clash).collect()
    swap = spark.createDataFrame([("L", 1, "Pay/Wages"), ("L", 3, "Eating/Bakery")], "ledger_id string, category_id long, path string")
    renamed = {r.category_id: r.path for r in curate.rename_categories(golden.categories, swap).collect()}
    assert renamed == {1: "Pay/Wages", 2: "Home/Repairs", 3: "Eating/Bakery", 4: "Trips/Rail"}


def test_merge_and_delete(spark, golden):
    rules = table(spark, "rules", [{"id": 1, "name": "r", "terms": [], "category_id": 1, "override_mode": "all", "review_required": False, "position": 0}])
    books = golden.with_tables(rules=rules)
    onto = spark.createDataFrame([("L", 1, 2)], "ledger_id string, category_id long, target_id long")
    merged = curate.merge_categories(books, onto, AT)
    assert keyed(merged.enrichments, "category_id") == {1: (2,), 2: (2,), 3: (3,), 5: (2,), 50: (4,)}
    assert merged.rules.first().category_id == 2 and merged.categories.count() == 3
    one = ids(spark, 1, name="category_id")
    assert curate.delete_categories(books, one).categories.count() == 4
    gone = curate.delete_categories(books, one, force=True)
    assert gone.categories.count() == 3 and gone.rules.first().category_id is None
    assert set(keyed(gone.enrichments)) == {2, 3, 50}
    with pytest.raises(Exception, match="into itself"):
        curate.merge_categories(books, spark.createDataFrame([("L", 1, 1)], onto.schema), AT).enrichments.collect()


def test_transfers_exclude_categories(spark, golden):
    pairs = spark.createDataFrame([("L", 5, 4, "auto", False, 0.4)], "ledger_id string, from_transaction_id long, "
                                  "to_transaction_id long, source string, confirmed boolean, ai_confidence double")
    after = curate.create_transfers(golden, pairs, AT)
    assert after.transfers.count() == 2 and set(keyed(after.enrichments)) == {1, 2, 3, 50}
    legs = {r.id for r in views.leg_ids(after.transfers).collect()}
    assert not legs & set(keyed(after.enrichments))
    assert after.notes.count() == 1


def test_mark_transfers(spark, golden):
    pair = lambda a, b: spark.createDataFrame([("L", a, b)], "ledger_id string, a_id long, b_id long")
    assert curate.mark_transfers(golden, pair(7, 6), AT).transfers.first().created_at is None
    assert curate.mark_transfers(golden, pair(1, 2), AT).transfers.count() == 1
    tx = golden.transactions.unionByName(table(spark, "transactions", [{"id": 8, "account_id": 2, "amount_cents": 60000}]))
    moved = curate.mark_transfers(golden.with_tables(transactions=tx), pair(8, 6), AT).transfers.collect()
    assert [(r.from_transaction_id, r.to_transaction_id, r.source, r.confirmed) for r in moved] == [(6, 8, "manual", True)]


def test_notes_and_tags(spark, golden):
    changes = spark.createDataFrame([("L", 4, " \n"), ("L", 1, "new  ")], "ledger_id string, transaction_id long, note string")
    assert keyed(curate.set_notes(golden.notes, changes, AT), "note") == {1: ("new",)}
    wanted = spark.createDataFrame(
        [("L", 1, ["#House", "bad tag", "house", "Trip/2024"]), ("L", 3, [])], "ledger_id string, transaction_id long, tags array<string>"
    )
    tags, bridge = curate.set_tags(golden.tags, golden.transaction_tags, wanted, AT)
    assert sorted(r.name for r in tags.collect()) == ["house", "trip/2024", "trip/rail"]
    lists = {r.transaction_id: r.tags for r in views.tags_per_transaction(tags, bridge).collect()}
    assert lists == {1: ["house", "trip/2024"], 2: ["house"], 50: ["trip/rail"]}


def test_move_and_delete_accounts(spark, golden):
    move = lambda n, path: curate.move_accounts(golden, spark.createDataFrame([("L", n, path)], "ledger_id string, account_id long, path string"))
    after = move(2, " New Bank / Saver ")
    named = {r.path for r in views.live_accounts(after.accounts, after.banks).collect()}
    assert named == {"Harbour/Household", "Meridian/Joint", "Meridian/Travel", "New Bank/Saver"}
    assert move(2, "Harbour/Rainy Day").accounts.count() == 4
    for bad, text in (("Harbour/Household", "account exists"), ("A/B/C", "invalid account path"), ("Only", "invalid account path")):
        with pytest.raises(Exception, match=text):
            move(2, bad).accounts.collect()
    gone = curate.delete_accounts(golden.accounts, ids(spark, 1, name="account_id"), AT)
    assert gone.filter("deleted_at is not null").count() == 1
    assert curate.count_held(golden.transactions, ids(spark, 1, name="account_id")).first().held == 3


def test_bulk(golden):
    after = curate.bulk_categorise(golden, [p.date_range("2023-12-10", "2024-01")], "Home/Repairs", AT)
    assert keyed(after, "category_id", "category_source")[5] == (2, "manual") and after.count() == 5
    assert keyed(curate.bulk_accept_categories(golden, [p.account_matches("Meridian/Joint")], AT), "category_confirmed")[5] == (True,)
