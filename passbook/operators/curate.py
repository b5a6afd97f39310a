"""Curation as bulk edits: an edits table is merged into a state table in one job.

Edits of one transaction may repeat; the one with the highest ``seq`` counts
(without a ``seq`` column edits are taken as unique).  Results are new
DataFrames; timestamps are arguments, so a rerun gives the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import normalise_path, valid_tag
from passbook.operators import search as search_op
from passbook.operators import views
from passbook.operators.ingest import sync_dimension
from passbook.operators.predicates import Predicate
from passbook.operators.ranking import rank_along, rank_sorted
from passbook.schema import Books

TX_KEY = ["ledger_id", "transaction_id"]


def _stamp(at: str) -> Column:
    return F.lit(at).cast("timestamp")


def last_edit(edits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One edit per key: the latest by ``seq``."""
    if "seq" not in edits.columns:
        return edits
    rest = [c for c in edits.columns if c not in keys and c != "seq"]
    newest = edits.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_last"))
    return newest.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def _legs(transfers: DataFrame) -> DataFrame:
    return views.leg_ids(transfers).withColumnRenamed("id", "transaction_id")


def _new_ids(rows: DataFrame, existing: DataFrame, id_column: str, order: Sequence[str]) -> DataFrame:
    """Number rows per ledger after the highest existing id."""
    top = existing.groupBy("ledger_id").agg(F.max(id_column).alias("_top"))
    ranked = rank_sorted(rows, ["ledger_id"], order)
    return (
        ranked.join(top, "ledger_id", "left")
        .withColumn(id_column, (F.coalesce("_top", F.lit(0)) + F.col("_rank")).cast("bigint"))
        .drop("_rank", "_top")
    )


# Categories of transactions


def applicable_edits(edits: DataFrame, transfers: DataFrame, strict: bool = False) -> DataFrame:
    """Category edits that touch no transfer leg; ``strict`` raises on one instead."""
    chosen = last_edit(edits, TX_KEY)
    if not strict:
        return chosen.join(_legs(transfers), TX_KEY, "left_anti")
    marked = chosen.join(_legs(transfers).withColumn("_leg", F.lit(True)), TX_KEY, "left")
    problem = F.raise_error(
        F.concat(F.lit("transaction is a transfer leg: "), F.col("transaction_id").cast("string"))
    ).cast("bigint")
    return marked.withColumn(
        "transaction_id", F.when(F.col("_leg"), problem).otherwise(F.col("transaction_id"))
    ).drop("_leg")


def set_categories(
    enrichments: DataFrame, edits: DataFrame, transfers: DataFrame, at: str, strict: bool = False
) -> DataFrame:
    """Upsert (ledger_id, transaction_id, category_id, category_source,
    category_confirmed, ai_confidence); ``created_at`` survives."""
    values = ["category_id", "category_source", "category_confirmed", "ai_confidence"]
    chosen = applicable_edits(edits, transfers, strict).select(
        *TX_KEY, F.struct(*values).alias("_new")
    )
    merged = enrichments.join(chosen, TX_KEY, "full_outer")
    hit = F.col("_new").isNotNull()
    return merged.select(
        *TX_KEY,
        *[F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in values],
        F.coalesce("created_at", _stamp(at)).alias("created_at"),
        F.when(hit, _stamp(at)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def count_applied(edits: DataFrame, transfers: DataFrame) -> DataFrame:
    """How many category edits take effect, per ledger."""
    return applicable_edits(edits, transfers).groupBy("ledger_id").agg(F.count(F.lit(1)).alias("applied"))


def confirm_categories(enrichments: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Mark existing rows of (ledger_id, transaction_id) confirmed."""
    wanted = ids.select(*TX_KEY).distinct().withColumn("_hit", F.lit(True))
    marked = enrichments.join(wanted, TX_KEY, "left")
    return marked.withColumn(
        "category_confirmed", F.when(F.col("_hit"), True).otherwise(F.col("category_confirmed"))
    ).withColumn("updated_at", F.when(F.col("_hit"), _stamp(at)).otherwise(F.col("updated_at"))).select(
        *enrichments.columns
    )


def clear_categories(enrichments: DataFrame, ids: DataFrame) -> DataFrame:
    return enrichments.join(ids.select(*TX_KEY), TX_KEY, "left_anti").select(*enrichments.columns)


# The category tree


def get_or_create_categories(categories: DataFrame, paths: DataFrame, at: str) -> DataFrame:
    """``categories`` plus the missing paths of (ledger_id, path), normalised."""
    wanted = (
        paths.select("ledger_id", normalise_path("path").alias("path"))
        .filter(F.col("path") != "")
        .distinct()
    )
    missing = wanted.join(categories.select("ledger_id", "path"), ["ledger_id", "path"], "left_anti")
    fresh = _new_ids(missing, categories, "category_id", ["path"]).withColumn("created_at", _stamp(at))
    return categories.unionByName(fresh.select(*categories.columns))


def rename_conflicts(categories: DataFrame, renames: DataFrame) -> DataFrame:
    """Renames whose new path another category holds or another rename also takes."""
    chosen = renames.select("ledger_id", "category_id", normalise_path("path").alias("path"))
    moved = chosen.select("ledger_id", "category_id")
    after = (
        categories.join(moved, ["ledger_id", "category_id"], "left_anti")
        .select("ledger_id", "category_id", "path")
        .unionByName(chosen)
    )
    taken = after.groupBy("ledger_id", "path").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return chosen.join(taken.select("ledger_id", "path"), ["ledger_id", "path"], "left_semi").select(
        "ledger_id", "category_id", "path"
    )


def rename_categories(categories: DataFrame, renames: DataFrame) -> DataFrame:
    """New paths for (ledger_id, category_id, path); children keep theirs, a conflict raises."""
    clash = rename_conflicts(categories, renames).select(
        "ledger_id", "category_id", F.lit(True).alias("_clash")
    )
    chosen = renames.select("ledger_id", "category_id", normalise_path("path").alias("_path")).join(
        clash, ["ledger_id", "category_id"], "left"
    )
    problem = F.raise_error(F.concat(F.lit("category exists: "), F.col("_path")))
    return (
        categories.join(chosen, ["ledger_id", "category_id"], "left")
        .withColumn("path", F.when(F.col("_clash"), problem).otherwise(F.coalesce("_path", "path")))
        .select(*categories.columns)
    )


def repoint(df: DataFrame, mapping: DataFrame, at: str | None = None) -> DataFrame:
    """Replace ``category_id`` by ``target_id`` of (ledger_id, category_id, target_id)."""
    joined = df.join(mapping.select("ledger_id", "category_id", "target_id"), ["ledger_id", "category_id"], "left")
    moved = joined.withColumn("category_id", F.coalesce("target_id", "category_id"))
    if at is not None and "updated_at" in df.columns:
        moved = moved.withColumn(
            "updated_at", F.when(F.col("target_id").isNotNull(), _stamp(at)).otherwise(F.col("updated_at"))
        )
    return moved.select(*df.columns)


def merge_categories(books: Books, mapping: DataFrame, at: str) -> Books:
    """Move enrichments and rules from source to target category, then drop the sources."""
    same = F.when(
        F.col("category_id") == F.col("target_id"),
        F.raise_error(F.lit("cannot merge a category into itself")).cast("bigint"),
    ).otherwise(F.col("target_id"))
    checked = mapping.withColumn("target_id", same)
    return books.with_tables(
        enrichments=repoint(books.enrichments, checked, at),
        rules=repoint(books.rules, checked),
        categories=books.categories.join(
            checked.select("ledger_id", "category_id"), ["ledger_id", "category_id"], "left_anti"
        ).select(*books.categories.columns),
    )


def deletable_categories(rules: DataFrame, ids: DataFrame, force: bool = False) -> DataFrame:
    """Categories that may go: without ``force`` those no rule assigns."""
    wanted = ids.select("ledger_id", "category_id").distinct()
    if force:
        return wanted
    return wanted.join(rules.select("ledger_id", "category_id"), ["ledger_id", "category_id"], "left_anti")


def blocked_deletes(rules: DataFrame, ids: DataFrame) -> DataFrame:
    """(ledger_id, category_id, rules): the categories that only ``force`` deletes, with the names of the rules that assign them."""
    key = ["ledger_id", "category_id"]
    used = rules.join(ids.select(*key).distinct(), key, "left_semi")
    return used.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("position", "id", "name"))).alias("_r")).select(
        *key, F.col("_r.name").alias("rules")
    )


def delete_categories(books: Books, ids: DataFrame, force: bool = False) -> Books:
    """Drop categories with their enrichments; rules that assigned them lose the category."""
    key = ["ledger_id", "category_id"]
    gone = deletable_categories(books.rules, ids, force)
    rules = books.rules.join(gone.withColumn("_gone", F.lit(True)), key, "left").withColumn(
        "category_id", F.when(F.col("_gone").isNull(), F.col("category_id"))
    )
    return books.with_tables(
        enrichments=books.enrichments.join(gone, key, "left_anti").select(*books.enrichments.columns),
        categories=books.categories.join(gone, key, "left_anti").select(*books.categories.columns),
        rules=rules.select(*books.rules.columns),
    )


def count_uncategorised_by_delete(books: Books, ids: DataFrame, force: bool = False) -> DataFrame:
    """Enrichments each deleted category takes along."""
    gone = deletable_categories(books.rules, ids, force)
    used = books.enrichments.groupBy("ledger_id", "category_id").agg(F.count(F.lit(1)).alias("uncategorised"))
    return gone.join(used, ["ledger_id", "category_id"], "left").withColumn(
        "uncategorised", F.coalesce("uncategorised", F.lit(0))
    )


# Transfers


def create_transfers(books: Books, pairs: DataFrame, at: str) -> Books:
    """Add links (ledger_id, from_transaction_id, to_transaction_id, source,
    confirmed, ai_confidence); both legs lose their enrichment, notes and tags stay."""
    fresh = _numbered_links(books.transfers, pairs, at)
    return books.with_tables(
        transfers=books.transfers.unionByName(fresh.select(*books.transfers.columns)),
        enrichments=books.enrichments.join(_legs(fresh), TX_KEY, "left_anti").select(
            *books.enrichments.columns
        ),
    )


def _numbered_links(transfers: DataFrame, pairs: DataFrame, at: str) -> DataFrame:
    """Ids follow the debit leg, ranked in ranges so one large ledger is no single task."""
    top = transfers.groupBy("ledger_id").agg(F.max("id").alias("_top"))
    return (
        rank_along(pairs, ["ledger_id"], "from_transaction_id", "_rank")
        .join(top, "ledger_id", "left")
        .withColumn("id", (F.coalesce("_top", F.lit(0)) + F.col("_rank")).cast("bigint"))
        .withColumn("created_at", _stamp(at))
        .drop("_rank", "_top")
    )


def mark_transfers(books: Books, pairs: DataFrame, at: str) -> Books:
    """Manual links from (ledger_id, a_id, b_id).

    Amounts must be exactly opposite (other pairs are ignored); the negative
    leg is the source; an already linked pair changes nothing; other links of
    either leg are broken first.
    """
    amounts = books.transactions.select("ledger_id", "id", "amount_cents")
    sized = pairs.join(
        amounts.select("ledger_id", F.col("id").alias("a_id"), F.col("amount_cents").alias("_a")),
        ["ledger_id", "a_id"],
    ).join(
        amounts.select("ledger_id", F.col("id").alias("b_id"), F.col("amount_cents").alias("_b")),
        ["ledger_id", "b_id"],
    )
    wanted = sized.filter(F.col("_a") == -F.col("_b")).select(
        "ledger_id",
        F.when(F.col("_a") < 0, F.col("a_id")).otherwise(F.col("b_id")).alias("from_transaction_id"),
        F.when(F.col("_a") < 0, F.col("b_id")).otherwise(F.col("a_id")).alias("to_transaction_id"),
        F.least("a_id", "b_id").alias("_low"),
        F.greatest("a_id", "b_id").alias("_high"),
    )
    linked = books.transfers.select(
        "ledger_id",
        F.least("from_transaction_id", "to_transaction_id").alias("_low"),
        F.greatest("from_transaction_id", "to_transaction_id").alias("_high"),
    )
    fresh = wanted.join(linked, ["ledger_id", "_low", "_high"], "left_anti").drop("_low", "_high")
    touched = fresh.select(
        "ledger_id", F.explode(F.array("from_transaction_id", "to_transaction_id")).alias("transaction_id")
    )
    broken = (
        views.transfer_legs(books.transfers)
        .join(touched, TX_KEY, "left_semi")
        .select("ledger_id", "id")
        .distinct()
    )
    kept = books.transfers.join(broken, ["ledger_id", "id"], "left_anti").select(*books.transfers.columns)
    links = fresh.withColumn("source", F.lit("manual")).withColumn("confirmed", F.lit(True)).withColumn(
        "ai_confidence", F.lit(None).cast("double")
    )
    return create_transfers(books.with_tables(transfers=kept), links, at)


def confirm_transfers(transfers: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = ids.select("ledger_id", "id").distinct().withColumn("_hit", F.lit(True))
    return (
        transfers.join(wanted, ["ledger_id", "id"], "left")
        .withColumn("confirmed", F.coalesce("_hit", "confirmed"))
        .select(*transfers.columns)
    )


def delete_transfers(transfers: DataFrame, ids: DataFrame) -> DataFrame:
    return transfers.join(ids.select("ledger_id", "id"), ["ledger_id", "id"], "left_anti").select(
        *transfers.columns
    )


# Notes and tags


def set_notes(notes: DataFrame, edits: DataFrame, at: str) -> DataFrame:
    """Upsert (ledger_id, transaction_id, note): end blanks go, a blank note deletes."""
    chosen = last_edit(edits, TX_KEY).select(
        *TX_KEY,
        F.regexp_replace(F.coalesce("note", F.lit("")), r"(?U)\s+$", "").alias("_new"),
    )
    merged = notes.join(chosen, TX_KEY, "full_outer")
    return merged.select(
        *TX_KEY,
        F.coalesce("_new", "note").alias("note"),
        F.coalesce("created_at", _stamp(at)).alias("created_at"),
        F.when(F.col("_new").isNotNull(), _stamp(at)).otherwise(F.col("updated_at")).alias("updated_at"),
    ).filter(F.col("note").rlike(r"(?U)\S"))


def set_tags(
    tags: DataFrame, transaction_tags: DataFrame, edits: DataFrame, at: str
) -> tuple[DataFrame, DataFrame]:
    """Replace tag sets by (ledger_id, transaction_id, tags array).

    Names are validated, invalid ones dropped; tags without any use disappear.
    Returns the new ``tags`` and ``transaction_tags``.
    """
    chosen = last_edit(edits, TX_KEY)
    touched = chosen.select(*TX_KEY)
    asked = (
        chosen.select(*TX_KEY, F.explode("tags").alias("_raw"))
        .select(*TX_KEY, valid_tag("_raw").alias("name"))
        .filter(F.col("name").isNotNull())
        .distinct()
    )
    names = asked.select("ledger_id", "name").distinct()
    missing = names.join(tags.select("ledger_id", "name"), ["ledger_id", "name"], "left_anti")
    fresh = _new_ids(missing, tags, "tag_id", ["name"]).withColumn("created_at", _stamp(at))
    all_tags = tags.unionByName(fresh.select(*tags.columns))
    bridge = transaction_tags.join(touched, TX_KEY, "left_anti").unionByName(
        asked.join(all_tags.select("ledger_id", "tag_id", "name"), ["ledger_id", "name"]).select(
            *TX_KEY, "tag_id"
        )
    )
    used = bridge.select("ledger_id", "tag_id").distinct()
    return all_tags.join(used, ["ledger_id", "tag_id"], "left_semi").select(*tags.columns), bridge.select(
        *transaction_tags.columns
    )


# Accounts


def move_accounts(books: Books, moves: DataFrame) -> Books:
    """New ``Bank/Account`` paths for (ledger_id, account_id, path).

    The target bank is created or revived; a collision with another account
    and a malformed path raise; the same path is no change.
    """
    parts = F.split("path", "/")
    bank, name = F.trim(F.element_at(parts, 1)), F.trim(F.try_element_at(parts, F.lit(2)))
    well_formed = (F.size(parts) == 2) & (bank != "") & (name != "")
    problem = F.raise_error(F.concat(F.lit("invalid account path: "), F.col("path")))
    wanted = moves.select(
        "ledger_id",
        "account_id",
        F.when(well_formed, bank).otherwise(problem).alias("_bank"),
        name.alias("_name"),
    )
    names = books.banks.select("ledger_id", "bank_id", F.col("name").alias("_old_bank"))
    current = books.accounts.join(names, ["ledger_id", "bank_id"]).select(
        "ledger_id", "account_id", F.col("name").alias("_old_name"), "_old_bank"
    )
    changed = (
        wanted.join(current, ["ledger_id", "account_id"])
        .filter((F.col("_bank") != F.col("_old_bank")) | (F.col("_name") != F.col("_old_name")))
        .select("ledger_id", "account_id", "_bank", "_name")
    )
    targets = changed.select("ledger_id", F.col("_bank").alias("name"))
    touched = targets.distinct().withColumn("_seen", F.lit(True))
    banks = sync_dimension(books.banks, targets, "bank_id", ["name"])
    ids = banks.join(touched, ["ledger_id", "name"]).select(
        "ledger_id", F.col("name").alias("_bank"), F.col("bank_id").alias("_bank_id")
    )
    placed = changed.join(ids, ["ledger_id", "_bank"])
    moved = (
        books.accounts.join(placed, ["ledger_id", "account_id"], "left")
        .withColumn("bank_id", F.coalesce("_bank_id", "bank_id"))
        .withColumn("name", F.coalesce("_name", "name"))
    )
    counts = moved.groupBy("ledger_id", "bank_id", "name").agg(F.count(F.lit(1)).alias("_n"))
    clash = F.raise_error(F.concat(F.lit("account exists: "), F.col("name")))
    accounts = moved.join(counts, ["ledger_id", "bank_id", "name"]).withColumn(
        "name", F.when(F.col("_n") > 1, clash).otherwise(F.col("name"))
    )
    return books.with_tables(banks=banks, accounts=accounts.select(*books.accounts.columns))


def delete_accounts(accounts: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Soft delete; everything the accounts hold is retained."""
    wanted = ids.select("ledger_id", "account_id").distinct().withColumn("_hit", F.lit(True))
    gone = F.col("_hit") & F.col("deleted_at").isNull()
    return (
        accounts.join(wanted, ["ledger_id", "account_id"], "left")
        .withColumn("deleted_at", F.when(gone, _stamp(at)).otherwise(F.col("deleted_at")))
        .select(*accounts.columns)
    )


def count_held(tx: DataFrame, ids: DataFrame) -> DataFrame:
    """Transactions that the given accounts keep after deletion."""
    key = ["ledger_id", "account_id"]
    return tx.join(ids.select(*key), key, "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("held"))


# Bulk edits from a search


def bulk_categorise(
    books: Books, preds: Sequence[Predicate], path: str, at: str, pending: bool = False
) -> DataFrame:
    """Enrichments after giving every match that is no transfer leg a manual, confirmed category.

    The path is resolved in each ledger; a ledger without that category is left alone.  With
    ``pending`` only matches with an open suggestion are edited.
    """
    chosen = books.categories.filter(F.col("path") == path).select("ledger_id", F.col("category_id").alias("_chosen"))
    needs = {"category_source", "category_confirmed"} if pending else set()
    # The order of a search does not matter here.
    found = search_op.where(
        views.live(views.wide_view(books, needs.union(*(p.needs for p in preds)))), preds, "error"
    )
    if pending:
        found = found.filter((F.col("category_source") == "ai") & ~F.col("category_confirmed"))
    edits = found.join(chosen, "ledger_id").select(
        "ledger_id",
        F.col("id").alias("transaction_id"),
        F.col("_chosen").alias("category_id"),
        F.lit("manual").alias("category_source"),
        F.lit(True).alias("category_confirmed"),
        F.lit(None).cast("double").alias("ai_confidence"),
    )
    return set_categories(books.enrichments, edits, books.transfers, at)


def bulk_accept_categories(books: Books, preds: Sequence[Predicate], at: str) -> DataFrame:
    """Enrichments after confirming every matching suggestion."""
    needs = set().union({"category_source", "category_confirmed"}, *(p.needs for p in preds))
    view = search_op.where(views.live(views.wide_view(books, needs)), preds, "error")
    ids = view.filter((F.col("category_source") == "ai") & ~F.col("category_confirmed")).select(
        "ledger_id", F.col("id").alias("transaction_id")
    )
    return confirm_categories(books.enrichments, ids, at)


def bulk_accept_transfers(books: Books, preds: Sequence[Predicate]) -> DataFrame:
    """Transfers after confirming every pending one a side of which matches."""
    view = views.ledger_view(books.transactions, books.accounts, books.banks)
    pending = views.transfers_with_legs(view, books.transfers.filter(~F.col("confirmed")), False)
    return confirm_transfers(books.transfers, search_op.either_side(pending, preds))
