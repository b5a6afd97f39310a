"""Row-level ingest: deduplication, refinement, outcome labels and dimension sync.

Incoming records carry ``seq``, a unique integer per ledger in arrival order,
beside the transaction columns.  A key is ``(ledger_id, account_id, hash)``;
copies of one key are reduced by aggregation before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passbook.functions.text import json_entries, json_object
from passbook.operators.ranking import previous_value, rank_along, rank_sorted, sums_sorted

KEY = ["ledger_id", "account_id", "hash"]
FIRST_COLUMNS = ["date", "amount_cents", "balance_cents", "source_file", "import_batch_id"]
TX = [
    "ledger_id", "id", "account_id", "date", "description", "amount_cents", "balance_cents",
    "hash", "metadata", "source_file", "import_batch_id",
]


def _filled(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def with_batch(df: DataFrame, batch_id: int) -> DataFrame:
    return df.withColumn("import_batch_id", F.lit(batch_id).cast("bigint"))


def start_batch(batches: DataFrame, ledgers: DataFrame, batch_id: int, at: str) -> DataFrame:
    """Open one batch per ledger; ``at`` is a timestamp text, so runs are repeatable."""
    row = ledgers.select("ledger_id").distinct().select(
        "ledger_id",
        F.lit(batch_id).cast("bigint").alias("id"),
        F.lit(at).cast("timestamp").alias("started_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )
    return batches.unionByName(row)


def complete_batch(batches: DataFrame, batch_id: int, at: str) -> DataFrame:
    done = F.when(F.col("id") == batch_id, F.lit(at).cast("timestamp")).otherwise(F.col("completed_at"))
    return batches.withColumn("completed_at", done)


def with_arrival(df: DataFrame, file_order: str = "source_file", position: str = "position") -> DataFrame:
    """Add ``seq``: files in order of their path, rows in order of their position.

    Positions are offset by those of the earlier files.
    """
    per_file = df.groupBy("ledger_id", file_order).agg((F.max(position) + 1).alias("_n"))
    starts = sums_sorted(per_file, ["ledger_id"], [file_order], "_n", "_start").drop("_n")
    return (
        df.join(starts, ["ledger_id", file_order])
        .withColumn("seq", (F.col("_start") + F.col(position)).cast("bigint"))
        .drop("_start")
    )


def first_arrivals(incoming: DataFrame) -> DataFrame:
    """The first record of each key, by partial aggregation."""
    kept = ["description", "metadata", *FIRST_COLUMNS]
    first = incoming.groupBy(*KEY).agg(
        F.min("seq").alias("seq"), F.min_by(F.struct(*kept), "seq").alias("_first")
    )
    return first.select(*KEY, "seq", *[F.col(f"_first.{c}").alias(c) for c in kept])


def dedup_insert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """New transactions: first arrival of each unseen key, ids continuing in arrival order."""
    fresh = first_arrivals(incoming).join(existing.select(*KEY), KEY, "left_anti")
    top = existing.groupBy("ledger_id").agg(F.max("id").alias("_top"))
    return (
        rank_along(fresh, ["ledger_id"], "seq", "_rank")
        .join(top, "ledger_id", "left")
        .withColumn("id", F.coalesce("_top", F.lit(0)) + F.col("_rank"))
        .select(*TX)
    )


def _newest_metadata(records: DataFrame) -> DataFrame:
    """Per key, the newest value of every top-level metadata entry."""
    entries = records.select(*KEY, "seq", F.explode(json_entries("metadata")).alias("key", "value"))
    newest = entries.groupBy(*KEY, "key").agg(F.max_by("value", "seq").alias("value"))
    return newest.groupBy(*KEY).agg(F.collect_list(F.struct("key", "value")).alias("_entries"))


def _canonical(metadata: Column | str) -> Column:
    return json_object(F.map_entries(json_entries(metadata)))


def refine_existing(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` with description and metadata moved to what later records say.

    A blank text never replaces one; metadata merges per key with the newest
    value winning; unchanged JSON stays byte-identical; nothing else moves.
    """
    text = incoming.groupBy(*KEY).agg(
        F.max_by("description", F.when(_filled(F.col("description")), F.col("seq"))).alias("_text")
    )
    stored = existing.join(text.select(*KEY), KEY, "left_semi").select(
        *KEY, F.lit(-1).cast("bigint").alias("seq"), "metadata"
    )
    merged = _newest_metadata(stored.unionByName(incoming.select(*KEY, "seq", "metadata")))
    changes = text.join(merged, KEY, "left").select(
        *KEY, "_text", F.when(F.col("_entries").isNotNull(), json_object(F.col("_entries"))).alias("_json")
    )
    same = F.col("_json").isNull() | F.col("_json").eqNullSafe(_canonical("metadata"))
    return (
        existing.join(changes, KEY, "left")
        .withColumn("description", F.coalesce("_text", "description"))
        .withColumn("metadata", F.when(same, F.col("metadata")).otherwise(F.col("_json")))
        .select(*existing.columns)
    )


def ingest(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All transactions after the batch: old and new rows, refined by every record."""
    everything = existing.select(*TX).unionByName(dedup_insert(existing, incoming))
    return refine_existing(everything, incoming)


def label_records(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each raw record as added, updated or unchanged, in arrival order.

    Every record is compared with the state its predecessors left: the last
    non-blank description of its key and, per metadata entry, the last value.
    """
    stored = existing.join(incoming.select(*KEY).distinct(), KEY, "left_semi").select(
        *KEY, F.lit(-1).cast("bigint").alias("seq"), "description", "metadata"
    )
    records = stored.unionByName(incoming.select(*KEY, "seq", "description", "metadata"))
    text = previous_value(
        records.withColumn("_text", F.when(_filled(F.col("description")), F.col("description")))
        .withColumn("_seen", F.lit(True)),
        KEY, "seq", "_seen", "_known",
    )
    # The first record sets the text even when it is blank.
    first_text = records.groupBy(*KEY).agg(F.min_by("description", "seq").alias("_first_text"))
    text = previous_value(text, KEY, "seq", "_text", "_last_text").join(first_text, KEY)
    moved = F.col("_text").isNotNull() & (F.col("_text") != F.coalesce("_last_text", "_first_text"))
    entries = records.select(*KEY, "seq", F.explode(json_entries("metadata")).alias("key", "value"))
    entry = previous_value(entries, [*KEY, "key"], "seq", "value", "_last")
    merged = entry.groupBy(*KEY, "seq").agg(
        F.bool_or(~F.col("value").eqNullSafe(F.col("_last"))).alias("_merged")
    )
    outcome = (
        F.when(F.col("_known").isNull(), "added")
        .when(moved | F.coalesce("_merged", F.lit(False)), "updated")
        .otherwise("unchanged")
    )
    return (
        text.filter(F.col("seq") >= 0)
        .join(merged, [*KEY, "seq"], "left")
        .select(*KEY, "seq", outcome.alias("outcome"))
    )


def ingest_report(labels: DataFrame) -> DataFrame:
    """Records per outcome."""
    return labels.groupBy("outcome").agg(F.count(F.lit(1)).alias("records"))


def refresh_counts(
    existing_banks: DataFrame,
    banks: DataFrame,
    existing_accounts: DataFrame,
    accounts: DataFrame,
    files: DataFrame,
) -> DataFrame:
    """Files processed and dimension rows added or soft-deleted by one refresh, per ledger."""

    def moves(before: DataFrame, after: DataFrame, key: str, kind: str) -> DataFrame:
        old = before.select("ledger_id", key, F.lit(True).alias("_old"), F.col("deleted_at").alias("_was"))
        both = after.join(old, ["ledger_id", key], "left")
        what = F.when(F.col("_old").isNull(), f"{kind}_added").when(
            F.col("_was").isNull() & F.col("deleted_at").isNotNull(), f"{kind}_deleted"
        )
        return both.select("ledger_id", what.alias("event")).filter(F.col("event").isNotNull())

    events = (
        moves(existing_banks, banks, "bank_id", "banks")
        .unionByName(moves(existing_accounts, accounts, "account_id", "accounts"))
        .unionByName(files.select("ledger_id", F.lit("files_processed").alias("event")))
    )
    return events.groupBy("ledger_id", "event").agg(F.count(F.lit(1)).alias("n"))


def sync_dimension(existing: DataFrame, discovered: DataFrame, id_column: str, keys: list[str]) -> DataFrame:
    """Upsert by natural key: live rows stay, deleted ones revive, missing ones are added.

    ``keys`` (such as ``["name"]``) identify a row inside its ledger; new ids
    continue in key order.
    """
    natural = ["ledger_id", *keys]
    seen = discovered.select(*natural).distinct()
    kept = existing.join(seen.withColumn("_seen", F.lit(True)), natural, "left").withColumn(
        "deleted_at", F.when(F.col("_seen"), F.lit(None).cast("timestamp")).otherwise(F.col("deleted_at"))
    )
    fresh = seen.join(existing.select(*natural), natural, "left_anti")
    top = existing.groupBy("ledger_id").agg(F.max(id_column).alias("_top"))
    numbered = (
        rank_sorted(fresh, ["ledger_id"], keys)
        .join(top, "ledger_id", "left")
        .withColumn(id_column, (F.coalesce("_top", F.lit(0)) + F.col("_rank")).cast("bigint"))
        .withColumn("deleted_at", F.lit(None).cast("timestamp"))
    )
    return kept.select(*existing.columns).unionByName(numbered.select(*existing.columns))


def soft_delete_missing_banks(banks: DataFrame, discovered: DataFrame, at: str) -> DataFrame:
    """Live banks that were not discovered get ``deleted_at``."""
    seen = discovered.select("ledger_id", F.col("bank_name").alias("name")).distinct()
    marked = banks.join(seen.withColumn("_seen", F.lit(True)), ["ledger_id", "name"], "left")
    gone = F.col("_seen").isNull() & F.col("deleted_at").isNull()
    return marked.withColumn(
        "deleted_at", F.when(gone, F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at"))
    ).select(*banks.columns)


def soft_delete_missing_accounts(accounts: DataFrame, banks: DataFrame, discovered: DataFrame, at: str) -> DataFrame:
    """Live accounts missing under a discovered bank get ``deleted_at``.

    Accounts of a bank that vanished altogether are left alone, so their
    transactions stay searchable.
    """
    live = banks.filter(F.col("deleted_at").isNull()).select(
        "ledger_id", "bank_id", F.col("name").alias("bank_name")
    )
    found = discovered.join(live, ["ledger_id", "bank_name"])
    checked = found.select("ledger_id", "bank_id", F.lit(True).alias("_bank")).distinct()
    seen = found.select(
        "ledger_id", "bank_id", F.col("account_name").alias("name"), F.lit(True).alias("_seen")
    ).distinct()
    marked = accounts.join(checked, ["ledger_id", "bank_id"], "left").join(
        seen, ["ledger_id", "bank_id", "name"], "left"
    )
    gone = F.col("_bank") & F.col("_seen").isNull() & F.col("deleted_at").isNull()
    return marked.withColumn(
        "deleted_at", F.when(gone, F.lit(at).cast("timestamp")).otherwise(F.col("deleted_at"))
    ).select(*accounts.columns)
