"""Ledger views and lookups: one wide row per transaction, joined only as far as needed.

Dimensions (accounts, banks, categories) are joined without broadcast hints:
Spark broadcasts them when their size is below its threshold and otherwise
shuffles by key, where adaptive execution splits a hot account.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.schema import Books

TX_COLUMNS = [
    "ledger_id", "id", "account_id", "date", "description", "amount_cents", "balance_cents",
]


def ledger_view(tx: DataFrame, accounts: DataFrame, banks: DataFrame) -> DataFrame:
    """Transactions with bank and account names; a bank's own deletion is not exposed."""
    named = accounts.select(
        "ledger_id",
        "account_id",
        "bank_id",
        F.col("name").alias("account_name"),
        F.col("deleted_at").alias("account_deleted_at"),
    ).join(
        banks.select("ledger_id", "bank_id", F.col("name").alias("bank_name")),
        ["ledger_id", "bank_id"],
    ).drop("bank_id")
    return tx.join(named, ["ledger_id", "account_id"])


def live(view: DataFrame) -> DataFrame:
    return view.filter(F.col("account_deleted_at").isNull())


def account_path(bank: Column | str = "bank_name", account: Column | str = "account_name") -> Column:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.concat(as_col(bank), F.lit("/"), as_col(account))


def live_banks(banks: DataFrame) -> DataFrame:
    return banks.filter(F.col("deleted_at").isNull()).orderBy("ledger_id", "name")


def _live_accounts(accounts: DataFrame, banks: DataFrame) -> DataFrame:
    names = banks.filter(F.col("deleted_at").isNull()).select(
        "ledger_id", "bank_id", F.col("name").alias("bank_name")
    )
    return (
        accounts.filter(F.col("deleted_at").isNull())
        .select("ledger_id", "account_id", "bank_id", F.col("name").alias("account_name"))
        .join(names, ["ledger_id", "bank_id"])
        .withColumn("path", account_path())
    )


def live_accounts(accounts: DataFrame, banks: DataFrame) -> DataFrame:
    """Accounts that are live under live banks, by bank and account name."""
    return _live_accounts(accounts, banks).orderBy("ledger_id", "bank_name", "account_name")


def lookup_account(paths: DataFrame, accounts: DataFrame, banks: DataFrame) -> DataFrame:
    """Live account of each (ledger_id, path); a path without two non-blank halves has none."""
    halves = paths.filter(F.contains(F.col("path"), F.lit("/"))).select(
        "ledger_id",
        "path",
        F.trim(F.substring_index("path", "/", 1)).alias("bank_name"),
        F.trim(F.expr("substring(path, instr(path, '/') + 1)")).alias("account_name"),
    )
    halves = halves.filter((F.col("bank_name") != "") & (F.col("account_name") != ""))
    return halves.join(
        _live_accounts(accounts, banks).drop("path"), ["ledger_id", "bank_name", "account_name"]
    ).select("ledger_id", "path", "account_id", "bank_id", "bank_name", "account_name")


def transactions_by_ids(view: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of the given (ledger_id, id); deleted accounts included, unknown ids absent."""
    return view.join(ids.select("ledger_id", "id"), ["ledger_id", "id"], "left_semi")


def category_paths(enrichments: DataFrame, categories: DataFrame) -> DataFrame:
    """(ledger_id, transaction_id, category_id, category_path) of categorised rows."""
    named = categories.select("ledger_id", "category_id", F.col("path").alias("category_path"))
    return (
        enrichments.filter(F.col("category_id").isNotNull())
        .select("ledger_id", "transaction_id", "category_id")
        .join(named, ["ledger_id", "category_id"])
        .select("ledger_id", "transaction_id", "category_id", "category_path")
    )


def category_of(enrichments: DataFrame, categories: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    found = category_paths(enrichments, categories)
    if ids is None:
        return found
    wanted = ids.select("ledger_id", F.col("id").alias("transaction_id"))
    return found.join(wanted, ["ledger_id", "transaction_id"], "left_semi")


def transfer_legs(transfers: DataFrame) -> DataFrame:
    """One row per (transfer, leg); both endpoints in one pass."""
    return transfers.withColumn(
        "transaction_id", F.explode(F.array("from_transaction_id", "to_transaction_id"))
    )


def leg_ids(transfers: DataFrame) -> DataFrame:
    """Distinct legs, so anti joins carry one small row per leg."""
    return transfer_legs(transfers).select("ledger_id", F.col("transaction_id").alias("id")).distinct()


def transfer_of(transfers: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The transfer of each leg; by transaction id."""
    legs = transfer_legs(transfers)
    if ids is None:
        return legs
    wanted = ids.select("ledger_id", F.col("id").alias("transaction_id"))
    return legs.join(wanted, ["ledger_id", "transaction_id"], "left_semi")


def tags_per_transaction(tags: DataFrame, transaction_tags: DataFrame) -> DataFrame:
    """Alphabetical tag list per transaction; untagged transactions are absent."""
    return (
        transaction_tags.join(tags.select("ledger_id", "tag_id", "name"), ["ledger_id", "tag_id"])
        .groupBy("ledger_id", "transaction_id")
        .agg(F.sort_array(F.collect_set("name")).alias("tags"))
    )


def notes_per_transaction(notes: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    found = notes.select("ledger_id", "transaction_id", "note")
    if ids is None:
        return found
    wanted = ids.select("ledger_id", F.col("id").alias("transaction_id"))
    return found.join(wanted, ["ledger_id", "transaction_id"], "left_semi")


def attach(view: DataFrame, side: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Left join a table keyed by transaction_id."""
    chosen = side.select("ledger_id", F.col("transaction_id").alias("id"), *columns)
    return view.join(chosen, ["ledger_id", "id"], "left")


def wide_view(books: Books, needs: Iterable[str] = ()) -> DataFrame:
    """``ledger_view`` plus only those side tables whose columns are needed."""
    wanted = set(needs)
    view = ledger_view(books.transactions, books.accounts, books.banks)
    enriched = {"category_id", "category_path", "category_source", "category_confirmed", "ai_confidence"}
    if wanted & enriched:
        side = books.enrichments
        columns = ["category_id", "category_source", "category_confirmed", "ai_confidence"]
        if "category_path" in wanted:
            named = books.categories.select(
                "ledger_id", "category_id", F.col("path").alias("category_path")
            )
            side = side.join(named, ["ledger_id", "category_id"], "left")
            columns.append("category_path")
        view = attach(view, side, columns)
    if "tags" in wanted:
        view = attach(view, tags_per_transaction(books.tags, books.transaction_tags), ["tags"])
    if "note" in wanted:
        view = attach(view, books.notes, ["note"])
    return view


# Selections built on the view


def _without(view: DataFrame, ids: DataFrame) -> DataFrame:
    return view.join(ids, ["ledger_id", "id"], "left_anti")


def uncategorised(view: DataFrame, enrichments: DataFrame, transfers: DataFrame) -> DataFrame:
    """Live rows without a category that are no transfer leg."""
    done = enrichments.filter(F.col("category_id").isNotNull()).select(
        "ledger_id", F.col("transaction_id").alias("id")
    )
    return _without(_without(live(view), done), leg_ids(transfers))


def unconfirmed(view: DataFrame, enrichments: DataFrame, transfers: DataFrame) -> DataFrame:
    """Live rows without a confirmed category that are no transfer leg."""
    done = enrichments.filter(
        F.col("category_id").isNotNull() & F.col("category_confirmed")
    ).select("ledger_id", F.col("transaction_id").alias("id"))
    return _without(_without(live(view), done), leg_ids(transfers))


def pending_ai_reviews(view: DataFrame, enrichments: DataFrame, categories: DataFrame) -> DataFrame:
    """Live rows with an unconfirmed suggestion, its enrichment and category as structs."""
    pending = enrichments.filter((F.col("category_source") == "ai") & ~F.col("category_confirmed"))
    named = pending.join(
        categories.select("ledger_id", "category_id", F.struct("category_id", "path").alias("_category")),
        ["ledger_id", "category_id"],
        "left",
    )
    rows = live(view)
    enrichment = F.struct(
        "category_id", "category_source", "category_confirmed", "ai_confidence"
    )
    side = named.select(
        "ledger_id",
        F.col("transaction_id").alias("id"),
        enrichment.alias("enrichment"),
        F.col("_category").alias("category"),
    )
    # One struct through the join keeps the names of the two records apart.
    packed = rows.select("ledger_id", "id", F.struct(*rows.columns).alias("transaction"))
    return packed.join(side, ["ledger_id", "id"])


def transfers_with_legs(view: DataFrame, transfers: DataFrame, confirmed_only: bool = True) -> DataFrame:
    """Links with both live legs as structs ``from_tx`` and ``to_tx``."""
    links = transfers.filter(F.col("confirmed")) if confirmed_only else transfers
    rows = live(view)

    def leg(name: str, key: str) -> DataFrame:
        return rows.select(
            "ledger_id", F.col("id").alias(key), F.struct(*rows.columns).alias(name)
        )

    return links.join(leg("from_tx", "from_transaction_id"), ["ledger_id", "from_transaction_id"]).join(
        leg("to_tx", "to_transaction_id"), ["ledger_id", "to_transaction_id"]
    )


def pending_transfer_reviews(view: DataFrame, transfers: DataFrame) -> DataFrame:
    found = transfers_with_legs(view, transfers.filter(~F.col("confirmed")), confirmed_only=False)
    return found.select(*transfers.columns)


def confirmed_category_examples(tx: DataFrame, enrichments: DataFrame) -> DataFrame:
    """Training rows of confirmed categories; deleted accounts included."""
    kept = enrichments.filter(F.col("category_confirmed") & F.col("category_id").isNotNull()).select(
        "ledger_id", F.col("transaction_id").alias("id"), "category_id"
    )
    return tx.join(kept, ["ledger_id", "id"]).select(
        "ledger_id", "id", "description", "amount_cents", "date", "category_id"
    )


def confirmed_transfer_examples(view: DataFrame, transfers: DataFrame) -> DataFrame:
    """Accounts and descriptions of confirmed links between live accounts."""
    return transfers_with_legs(view, transfers).select(
        "ledger_id",
        F.col("from_tx.account_id").alias("from_account_id"),
        F.col("to_tx.account_id").alias("to_account_id"),
        F.col("from_tx.description").alias("from_description"),
        F.col("to_tx.description").alias("to_description"),
    )
