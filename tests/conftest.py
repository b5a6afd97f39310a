import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from passbook.schema import Books, struct  # noqa: E402
from passbook.session import scratch_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = scratch_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "3",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            # A few rows per test: compiling plans would take most of the time.
            "spark.sql.codegen.wholeStage": "false",
            "spark.sql.codegen.factoryMode": "NO_CODEGEN",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


AT = "2024-06-01 00:00:00"


def table(spark, name, rows):
    """Rows as dicts of a state table; absent columns are NULL, the ledger is ``L``."""
    schema = struct(name)
    filled = [tuple({"ledger_id": "L", **r}.get(c) for c in schema.names) for r in rows]
    return spark.createDataFrame(filled, schema)


def own_rows():
    from datetime import date

    rows = [
        (1, 1, date(2023, 9, 4), "Corner Bakery", -1240, 88760),
        (2, 1, date(2023, 10, 11), "Hardware Depot", -15999, 72761),
        (3, 3, date(2023, 10, 28), "Wages October", 312050, 401210),
        (4, 2, date(2023, 11, 2), "Dividend", 4321, 150321),
        (5, 3, date(2023, 12, 19), "Village Bakery", -875, 400335),
        (6, 1, date(2024, 1, 8), "To savings", -60000, 12761),
        (7, 2, date(2024, 1, 8), "From household", 60000, 210321),
        (50, 4, date(2024, 2, 15), "Train ticket", -4410, 9590),
    ]
    names = ("id", "account_id", "date", "description", "amount_cents", "balance_cents")
    return [
        {**dict(zip(names, r)), "hash": f"h{r[0]}", "metadata": "{}", "source_file": "f", "import_batch_id": 1}
        for r in rows
    ]


@pytest.fixture(scope="session")
def golden(spark) -> Books:
    """Eight transactions in four accounts: four filed by hand, one suggested, one linked pair, one open."""
    by_hand = {"category_source": "manual", "category_confirmed": True}
    suggested = {"category_source": "ai", "category_confirmed": False, "ai_confidence": 0.62}
    filed = [(1, 1, by_hand), (2, 2, by_hand), (3, 3, by_hand), (5, 1, suggested), (50, 4, by_hand)]
    paths = ["Eating/Bakery", "Home/Repairs", "Pay/Wages", "Trips/Rail"]
    places = [(1, 1, "Household"), (2, 1, "Rainy Day"), (3, 2, "Joint"), (4, 2, "Travel")]
    return Books(
        banks=table(spark, "banks", [{"bank_id": 1, "name": "Harbour"}, {"bank_id": 2, "name": "Meridian"}]),
        accounts=table(spark, "accounts", [{"account_id": a, "bank_id": b, "name": n} for a, b, n in places]),
        transactions=table(spark, "transactions", own_rows()),
        categories=table(spark, "categories", [{"category_id": i, "path": p} for i, p in enumerate(paths, 1)]),
        enrichments=table(spark, "enrichments", [{"transaction_id": t, "category_id": c, **how} for t, c, how in filed]),
        transfers=table(
            spark,
            "transfers",
            [{"id": 1, "from_transaction_id": 6, "to_transaction_id": 7, "source": "manual", "confirmed": True}],
        ),
        rules=table(spark, "rules", []),
        notes=table(spark, "notes", [{"transaction_id": 4, "note": "Shares of the Club"}]),
        tags=table(spark, "tags", [{"tag_id": 1, "name": "trip/rail"}, {"tag_id": 2, "name": "house"}]),
        transaction_tags=table(
            spark, "transaction_tags", [{"transaction_id": 50, "tag_id": 1}, {"transaction_id": 2, "tag_id": 2}]
        ),
    )
