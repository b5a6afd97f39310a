"""Table schemas.  Every table leads with ``ledger_id``; ids are unique inside one ledger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType, _parse_datatype_string

LEDGER = "ledger_id"

# Allowed values of the enumerated string columns (fixed values).
CATEGORY_SOURCES = ("manual", "ai", "rule")
TRANSFER_SOURCES = ("manual", "auto")
OVERRIDE_MODES = ("uncategorised", "ai", "all")

DDL = {
    "banks": "ledger_id string, bank_id long, name string, deleted_at timestamp",
    "accounts": "ledger_id string, account_id long, bank_id long, name string, deleted_at timestamp",
    "transactions": (
        "ledger_id string, id long, account_id long, date date, description string, "
        "amount_cents long, balance_cents long, hash string, metadata string, "
        "source_file string, import_batch_id long"
    ),
    "imported_files": (
        "ledger_id string, account_id long, path string, content_hash string, "
        "imported_at timestamp, import_batch_id long"
    ),
    "import_batches": "ledger_id string, id long, started_at timestamp, completed_at timestamp",
    "categories": "ledger_id string, category_id long, path string, created_at timestamp",
    "enrichments": (
        "ledger_id string, transaction_id long, category_id long, category_source string, "
        "category_confirmed boolean, ai_confidence double, created_at timestamp, updated_at timestamp"
    ),
    "transfers": (
        "ledger_id string, id long, from_transaction_id long, to_transaction_id long, "
        "source string, confirmed boolean, ai_confidence double, created_at timestamp"
    ),
    "rules": (
        "ledger_id string, id long, name string, "
        "terms array<struct<field:string,value:string,negated:boolean>>, category_id long, "
        "override_mode string, review_required boolean, position long, created_at timestamp"
    ),
    "notes": "ledger_id string, transaction_id long, note string, created_at timestamp, updated_at timestamp",
    "tags": "ledger_id string, tag_id long, name string, created_at timestamp",
    "transaction_tags": "ledger_id string, transaction_id long, tag_id long",
}

# One record of a bank feed, before ids are assigned.
RAW_RECORD = (
    "date string, description string, amount_cents long, balance_cents long, "
    "hash string, metadata string"
)


def struct(name: str) -> StructType:
    return _parse_datatype_string(DDL[name])


TABLES = (
    "banks", "accounts", "transactions", "categories", "enrichments",
    "transfers", "rules", "notes", "tags", "transaction_tags",
)


class Books:
    """The state tables of many ledgers as attributes; operators return changed copies.

    A table may be given as a function that makes it, called on first use, so
    a query plans only the tables it reads.
    """

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]) -> None:
        unknown = set(tables) - set(TABLES)
        if unknown:
            raise ValueError(f"no such table: {', '.join(sorted(unknown))}")
        self._tables = dict(tables)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        table = self._tables[name]
        if not isinstance(table, DataFrame):
            table = self._tables[name] = table()
        return table

    def with_tables(self, **tables: DataFrame) -> "Books":
        return Books(**{**self._tables, **tables})


def empty_books(spark) -> Books:
    return Books(**{n: spark.createDataFrame([], struct(n)) for n in TABLES})
