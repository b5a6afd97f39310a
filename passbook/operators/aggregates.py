"""Counts, sums and listing reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.operators import search as search_op
from passbook.operators import views
from passbook.operators.predicates import Predicate
from passbook.schema import Books


def sum_amount(found: DataFrame, limit: int | None = None, sort: str | None = None) -> DataFrame:
    """Sum per ledger over its rows, or over the first ``limit`` of each ledger in list order."""
    rows = found if limit is None else search_op.first_rows(found, sort, limit)
    return rows.groupBy("ledger_id").agg(F.sum("amount_cents").alias("sum_cents"))


def count_by_category(enrichments: DataFrame) -> DataFrame:
    """Enrichment rows per category; unused categories are absent."""
    used = enrichments.filter(F.col("category_id").isNotNull())
    return used.groupBy("ledger_id", "category_id").agg(F.count(F.lit(1)).alias("transactions"))


def count_by_account(tx: DataFrame) -> DataFrame:
    """All transactions per account, deleted accounts included."""
    return tx.groupBy("ledger_id", "account_id").agg(F.count(F.lit(1)).alias("transactions"))


def count_by_tag(tags: DataFrame, transaction_tags: DataFrame) -> DataFrame:
    """Uses per tag, zero for unused; counted before the join."""
    uses = transaction_tags.groupBy("ledger_id", "tag_id").agg(F.count(F.lit(1)).alias("_uses"))
    return tags.join(uses, ["ledger_id", "tag_id"], "left").select(
        "ledger_id", "tag_id", "name", F.coalesce("_uses", F.lit(0)).alias("uses")
    )


def list_tags(tags: DataFrame, transaction_tags: DataFrame) -> DataFrame:
    """Tags, most used first, then by name."""
    return count_by_tag(tags, transaction_tags).orderBy(F.desc("uses"), "name", "ledger_id")


def next_position(rules: DataFrame) -> DataFrame:
    """The position a new rule gets in each ledger that has rules."""
    return rules.groupBy("ledger_id").agg(
        (F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("next_position")
    )


def count_pairs(view: DataFrame) -> DataFrame:
    """Debit and credit pairs with one date, size and two accounts, per (date, size) group.

    Counted from per-account totals: pairs = debits x credits less the pairs
    inside one account, so no pair is ever formed.
    """
    rows = view.filter((F.col("amount_cents") != 0) & (F.col("amount_cents") != -(2**63)))
    debit = F.when(F.col("amount_cents") < 0, 1).otherwise(0)
    per_account = rows.groupBy(
        "ledger_id", "date", F.abs("amount_cents").alias("size_cents"), "account_id"
    ).agg(F.sum(debit).alias("_d"), F.sum(1 - debit).alias("_c"))
    groups = per_account.groupBy("ledger_id", "date", "size_cents").agg(
        F.sum("_d").alias("debits"),
        F.sum("_c").alias("credits"),
        F.sum(F.col("_d") * F.col("_c")).alias("_same"),
    )
    pairs = F.col("debits") * F.col("credits") - F.col("_same")
    return groups.withColumn("pairs", pairs).drop("_same").filter(F.col("pairs") > 0)


def transactions_report(
    books: Books, preds: Iterable[Predicate] = (), sort: str | None = None, limit: int | None = None
) -> DataFrame:
    """Search result with ``Bank/Account`` labels and category paths, at most ``limit`` rows of a ledger.

    Labels come from live banks and accounts; anything else shows as ``?``.
    """
    found = search_op.search(books, preds, sort, limit, also=["category_path"])
    banks = books.banks.select(
        "ledger_id", "bank_id", F.when(F.col("deleted_at").isNull(), F.col("name")).alias("_bank")
    )
    labels = books.accounts.join(banks, ["ledger_id", "bank_id"]).select(
        "ledger_id",
        "account_id",
        F.when(
            F.col("_bank").isNotNull() & F.col("deleted_at").isNull(),
            views.account_path("_bank", "name"),
        ).alias("_label"),
    )
    order = search_op.sort_by(sort, found.columns) if sort else search_op.default_order()
    return (
        found.join(labels, ["ledger_id", "account_id"], "left")
        .orderBy(*order)
        .select(
            "ledger_id",
            "id",
            "date",
            F.coalesce("_label", F.lit("?")).alias("account"),
            "description",
            "amount_cents",
            "balance_cents",
            F.col("category_path").alias("category"),
        )
    )


def list_categories(categories: DataFrame) -> DataFrame:
    return categories.orderBy("ledger_id", "path")


def categories_report(categories: DataFrame, enrichments: DataFrame) -> DataFrame:
    """All categories in path order with their use, zero when unused."""
    return (
        categories.join(count_by_category(enrichments), ["ledger_id", "category_id"], "left")
        .select(
            "ledger_id", "category_id", "path", F.coalesce("transactions", F.lit(0)).alias("transactions")
        )
        .orderBy("ledger_id", "path")
    )


def accounts_report(tx: DataFrame, accounts: DataFrame, banks: DataFrame) -> DataFrame:
    """Live accounts by bank and name with their number of transactions."""
    return (
        views.live_accounts(accounts, banks)
        .join(count_by_account(tx), ["ledger_id", "account_id"], "left")
        .select(
            "ledger_id",
            "account_id",
            "bank_name",
            "account_name",
            F.coalesce("transactions", F.lit(0)).alias("transactions"),
        )
        .orderBy("ledger_id", "bank_name", "account_name")
    )
