"""The refresh plan: export files to published ledger state, all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions.money import row_hash
from passbook.functions.periods import parse_ledger_date
from passbook.operators import ingest as ops
from passbook.operators.segments import refresh_index
from passbook.schema import Books
from passbook.session import cut_lineage
from passbook.sources import exports, feeds
from passbook.sources.sinks import publish


def typed_records(raw: DataFrame) -> DataFrame:
    """Raw records with a real date and their row hash (over the raw date text)."""
    hashed = raw.withColumn("hash", row_hash("date", "description", "amount_cents", "balance_cents"))
    return hashed.withColumn("date", parse_ledger_date("date"))


def sync_places(books: Books, discovered: DataFrame, at: str) -> Books:
    """Banks and accounts after a scan: added, revived or soft-deleted."""
    names = discovered.select("ledger_id", F.col("bank_name").alias("name"))
    banks = ops.sync_dimension(books.banks, names, "bank_id", ["name"])
    placed = discovered.join(
        banks.select("ledger_id", "bank_id", F.col("name").alias("bank_name")), ["ledger_id", "bank_name"]
    ).select("ledger_id", "bank_id", F.col("account_name").alias("name"))
    accounts = ops.sync_dimension(books.accounts, placed, "account_id", ["bank_id", "name"])
    return books.with_tables(
        banks=ops.soft_delete_missing_banks(banks, discovered, at),
        accounts=ops.soft_delete_missing_accounts(accounts, banks, discovered, at),
    )


def refresh(
    spark: SparkSession,
    books: Books,
    manifest: DataFrame,
    batches: DataFrame,
    root: str,
    source_schema: str,
    mapping: DataFrame,
    ledger_id: str,
    batch_id: int,
    at: str,
    target: str | None = None,
    pulled: DataFrame | None = None,
    index: str | None = None,
    notes: DataFrame | None = None,
) -> tuple[Books, dict[str, DataFrame]]:
    """Import every unseen export of one root, and the records ``pulled`` from feeds, as one batch.

    ``pulled`` has the place of each record (ledger, bank and account name), the columns of a raw
    record and ``position``, its place in the pull; pulled records arrive after the files.
    Returns the new books and the side tables (``imported_files``,
    ``import_batches``, ``labels`` and ``counts``).  With ``target`` everything is published there as one
    version, transactions only in the months that changed; any failure before leaves the old one.  The stored ``index`` then gets one segment of what
    was added or improved; a repeated refresh of the same rows brings it up to date after a failure there.
    """
    files = exports.file_fingerprint(spark, root, ledger_id)
    discovered = exports.listed_accounts(spark, root, ledger_id)
    if pulled is not None:
        discovered = discovered.union(pulled.select("ledger_id", "bank_name", "account_name")).distinct()
    placed = sync_places(books, discovered, at)
    # Dimension tables, small next to the rows, and read by most steps below.
    placed = placed.with_tables(banks=cut_lineage(placed.banks), accounts=cut_lineage(placed.accounts))
    names = placed.banks.select("ledger_id", "bank_id", F.col("name").alias("bank_name"))
    ids = placed.accounts.join(names, ["ledger_id", "bank_id"]).select(
        "ledger_id", "bank_name", F.col("name").alias("account_name"), "account_id"
    )
    place = ["ledger_id", "bank_name", "account_name"]
    unseen = cut_lineage(exports.skip_imported(files.join(ids, place), manifest))
    rows = exports.scan_exports(spark, root, source_schema, ledger_id).join(
        unseen.select("source_file", "account_id"), "source_file"
    )
    mapped = feeds.map_source(rows.drop("account_id"), mapping)
    if pulled is not None:
        # Paths of files are URIs, whose schemes sort before this mark.
        mapped = mapped.unionByName(pulled.withColumn("source_file", F.lit("~pull")).select(*mapped.columns))
    mapped = mapped.join(ids, place)
    records = ops.with_batch(ops.with_arrival(typed_records(mapped)), batch_id)
    incoming = cut_lineage(
        records.select(
            "ledger_id", "account_id", "hash", "seq", "date", "description", "amount_cents",
            "balance_cents", "metadata", "source_file", "import_batch_id",
        )
    )
    labels = ops.label_records(books.transactions, incoming)
    after = placed.with_tables(transactions=ops.ingest(books.transactions, incoming))
    opened = ops.start_batch(batches, discovered, batch_id, at)
    extra = {
        "imported_files": exports.record_imported(manifest, unseen, batch_id, at),
        "import_batches": ops.complete_batch(opened, batch_id, at),
        "labels": labels,
        "counts": ops.refresh_counts(books.banks, after.banks, books.accounts, after.accounts, unseen),
    }
    if target or index:
        moved = labels.filter("outcome <> 'unchanged'").select(*ops.KEY).distinct()
        changed = cut_lineage(after.transactions.join(moved, ops.KEY, "left_semi"))
    if target:
        tables = {n: getattr(after, n) for n in ("banks", "accounts", "transactions")}
        # Dates never move, so a changed transaction touches the month it is in.
        publish({**tables, **extra}, target, {"transactions": changed})
    if index:
        refresh_index(spark, index, changed, notes)
    return after, extra
