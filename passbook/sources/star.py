"""Ledger state derived from star-schema tables (orders, customers, events, ...).

Each view is one SELECT that Spark and any ANSI engine read alike; ``{name}``
stands for a base table or an earlier view.
"""

from __future__ import annotations

import re
from collections.abc import Collection
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from passbook.schema import TABLES, Books, struct
from passbook.session import cut_lineage

VIEWS = {
    # Regions are ledgers, nations banks, customers accounts.
    "banks": """
        SELECT CAST(n_regionkey AS STRING) AS ledger_id, CAST(n_nationkey AS BIGINT) AS bank_id,
               n_name AS name, CAST(NULL AS TIMESTAMP) AS deleted_at
        FROM {nation}""",
    "accounts": """
        SELECT CAST(n_regionkey AS STRING) AS ledger_id, c_custkey AS account_id,
               CAST(c_nationkey AS BIGINT) AS bank_id, c_name AS name,
               CASE WHEN c_acctbal < 0 THEN CAST('2002-01-01 00:00:00' AS TIMESTAMP) END AS deleted_at
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "orders_wide": """
        SELECT CAST(n_regionkey AS STRING) AS ledger_id, o_orderkey AS id, o_custkey AS account_id,
               CAST(o_orderdate AS DATE) AS date, c_mktsegment AS segment,
               o_orderstatus AS status, o_orderpriority AS priority,
               CAST(ROUND(o_totalprice * 100) AS BIGINT) AS size_cents,
               CAST(FLOOR(o_totalprice) AS BIGINT) AS whole
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
             JOIN {nation} ON c_nationkey = n_nationkey""",
    "transactions": """
        SELECT ledger_id, id, account_id, date,
               'CARD PURCHASE ' || segment || ' ' || priority || ' REF: ' || CAST(id AS STRING) AS description,
               CASE WHEN status = 'F' THEN -size_cents ELSE size_cents END AS amount_cents,
               whole AS balance_cents,
               'o-' || CAST(id AS STRING) AS hash,
               '{{"status": "' || status || '", "detail": {{"segment": ["' || LOWER(segment) || '", ' || CAST(whole AS STRING) || ']}}}}' AS metadata,
               priority AS source_file, CAST(1 AS BIGINT) AS import_batch_id
        FROM {orders_wide}""",
    "categories": """
        SELECT ledger_id, category_id, path, CAST('2000-01-01 00:00:00' AS TIMESTAMP) AS created_at
        FROM (SELECT DISTINCT CAST(n_regionkey AS STRING) AS ledger_id,
                     CAST(ASCII(c_mktsegment) AS BIGINT) AS category_id, 'Segment/' || c_mktsegment AS path
              FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
              UNION ALL
              SELECT DISTINCT CAST(n_regionkey AS STRING) AS ledger_id,
                     CAST(100 + ASCII(o_orderstatus) AS BIGINT) AS category_id, 'Status/' || o_orderstatus AS path
              FROM {orders} JOIN {customer} ON o_custkey = c_custkey
                   JOIN {nation} ON c_nationkey = n_nationkey) AS c""",
    # Urgent and high orders are confirmed, medium ones suggested, some others drafts of rules.
    "enrichments": """
        SELECT ledger_id, id AS transaction_id,
               CAST(CASE WHEN priority = '3-MEDIUM' AND status = 'P' THEN NULL
                         WHEN priority = '3-MEDIUM' THEN 100 + ASCII(status)
                         ELSE ASCII(segment) END AS BIGINT) AS category_id,
               CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'manual'
                    WHEN priority = '3-MEDIUM' THEN 'ai' ELSE 'rule' END AS category_source,
               priority IN ('1-URGENT', '2-HIGH') AS category_confirmed,
               CASE WHEN priority = '3-MEDIUM' THEN CAST(whole % 100 AS DOUBLE) / 100.0 END AS ai_confidence,
               CAST('2001-01-01 00:00:00' AS TIMESTAMP) AS created_at,
               CAST('2001-01-01 00:00:00' AS TIMESTAMP) AS updated_at
        FROM {orders_wide}
        WHERE priority <> '5-LOW' AND (priority <> '4-NOT SPECIFIED' OR status = 'P')""",
    # Neighbouring low-priority orders of one ledger are linked.
    "transfers": """
        SELECT a.ledger_id AS ledger_id, a.id AS id, a.id AS from_transaction_id, b.id AS to_transaction_id,
               CASE WHEN a.status = 'O' THEN 'manual' ELSE 'auto' END AS source,
               a.status = 'O' AS confirmed,
               CASE WHEN a.status <> 'O' THEN CAST(a.whole % 100 AS DOUBLE) / 100.0 END AS ai_confidence,
               CAST('2001-06-01 00:00:00' AS TIMESTAMP) AS created_at
        FROM {orders_wide} a JOIN {orders_wide} b ON a.ledger_id = b.ledger_id AND b.id = a.id + 1
        WHERE a.priority = '5-LOW' AND b.priority = '5-LOW'""",
    "notes": """
        SELECT ledger_id, id AS transaction_id, text AS note,
               CAST('2001-01-01 00:00:00' AS TIMESTAMP) AS created_at,
               CAST('2001-01-01 00:00:00' AS TIMESTAMP) AS updated_at
        FROM {conversations} JOIN {orders_wide} ON conv_id = id WHERE turn = 0""",
    "order_flags": """
        SELECT DISTINCT ledger_id, id, l_returnflag AS flag, l_linestatus AS linestatus
        FROM {lineitem} JOIN {orders_wide} ON l_orderkey = id""",
    "tags": """
        SELECT ledger_id, tag_id, name, CAST('2000-01-01 00:00:00' AS TIMESTAMP) AS created_at
        FROM (SELECT DISTINCT ledger_id, CAST(ASCII(flag) AS BIGINT) AS tag_id, 'flag/' || LOWER(flag) AS name
              FROM {order_flags}
              UNION ALL
              SELECT DISTINCT ledger_id, CAST(100 + ASCII(linestatus) AS BIGINT) AS tag_id,
                     'ship/' || LOWER(linestatus) AS name
              FROM {order_flags}
              UNION ALL
              SELECT DISTINCT ledger_id, CAST(200 + ASCII(status) AS BIGINT) AS tag_id,
                     'unused/' || LOWER(status) AS name
              FROM {orders_wide}) AS t""",
    "transaction_tags": """
        SELECT DISTINCT ledger_id, id AS transaction_id, CAST(ASCII(flag) AS BIGINT) AS tag_id FROM {order_flags}
        UNION ALL
        SELECT DISTINCT ledger_id, id AS transaction_id, CAST(100 + ASCII(linestatus) AS BIGINT) AS tag_id
        FROM {order_flags} WHERE flag = 'R'""",
    # Every supplier saved one search.
    "supplier_rules": """
        SELECT CAST(n_regionkey AS STRING) AS ledger_id, s_suppkey + 1 AS id, s_name AS name,
               CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(65 + s_nationkey % 3 AS BIGINT) END AS category_id,
               'all' AS override_mode, FALSE AS review_required, s_suppkey AS position,
               CAST('2000-01-01 00:00:00' AS TIMESTAMP) AS created_at
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    # Documents as transactions: languages are ledgers, the text is the description.
    "doc_tx": """
        SELECT lang AS ledger_id, doc_id AS id, CAST(n_chars % 7 AS BIGINT) AS account_id,
               DATE '2024-01-01' AS date, text AS description, n_chars AS amount_cents,
               n_chars AS balance_cents, 'd-' || CAST(doc_id AS STRING) AS hash,
               '{{"source": "' || source || '", "size": {{"chars": [' || CAST(n_chars AS STRING) || ', true, null]}}}}' AS metadata,
               source AS source_file, CAST(1 AS BIGINT) AS import_batch_id
        FROM {documents}""",
    # A note on each labelled document.
    "doc_notes": """
        SELECT lang AS ledger_id, l.doc_id AS transaction_id,
               CASE WHEN quality = 1 THEN 'Réviewed: kept' WHEN toxic = 1 THEN 'Reviewed/dropped' ELSE '  ' END AS note,
               CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at,
               CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at
        FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    # Documents of one source and language follow each other as linked pairs.
    "doc_links": """
        SELECT a.lang AS ledger_id, a.doc_id AS id, a.doc_id AS from_transaction_id, b.doc_id AS to_transaction_id
        FROM {documents} a JOIN {documents} b ON a.lang = b.lang AND b.doc_id = a.doc_id + 1""",
    # Users are accounts of four ledgers; amounts are small and often opposite.
    "tx_events": """
        SELECT CAST(user_id % 4 AS STRING) AS ledger_id, event_id AS id, user_id AS account_id,
               CAST(ts AS DATE) AS date,
               event_type || ' ' || CAST(CAST(FLOOR(value / 40) AS BIGINT) AS STRING) AS description,
               (CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END)
                   * (1 + CAST(FLOOR(value) AS BIGINT) % 20) * 100 AS amount_cents,
               CAST(ROUND(value * 100) AS BIGINT) AS balance_cents,
               'e-' || CAST(event_id AS STRING) AS hash, props AS metadata,
               event_type AS source_file, CAST(1 AS BIGINT) AS import_batch_id
        FROM {events}""",
    # Opposite events four apart were linked by hand.
    "event_links": """
        SELECT a.ledger_id AS ledger_id, a.id AS id,
               CASE WHEN a.amount_cents < 0 THEN a.id ELSE b.id END AS from_transaction_id,
               CASE WHEN a.amount_cents < 0 THEN b.id ELSE a.id END AS to_transaction_id,
               'manual' AS source, TRUE AS confirmed, CAST(NULL AS DOUBLE) AS ai_confidence,
               CAST('2024-02-01 00:00:00' AS TIMESTAMP) AS created_at
        FROM {tx_events} a JOIN {tx_events} b
          ON a.ledger_id = b.ledger_id AND b.id = a.id + 4 AND b.amount_cents = -a.amount_cents""",
    "event_accounts": """
        SELECT DISTINCT CAST(user_id % 4 AS STRING) AS ledger_id, user_id AS account_id, user_id % 3 AS bank_id,
               'User ' || CAST(user_id AS STRING) AS name, CAST(NULL AS TIMESTAMP) AS deleted_at
        FROM {events}""",
    "event_banks": """
        SELECT DISTINCT CAST(user_id % 4 AS STRING) AS ledger_id, user_id % 3 AS bank_id,
               'Bank ' || CAST(user_id % 3 AS STRING) AS name, CAST(NULL AS TIMESTAMP) AS deleted_at
        FROM {events}""",
    # Events as labelled history: sign-ups have one category, other types follow the user.
    "labelled_events": """
        SELECT CAST(user_id % 4 AS STRING) AS ledger_id, event_id AS id, CAST(ts AS DATE) AS date, event_type AS norm,
               (1 + CAST(FLOOR(value) AS BIGINT) % 20) * 100 AS amount_cents,
               CASE WHEN event_type = 'signup' THEN CAST(1 AS BIGINT) ELSE 2 + user_id % 5 END AS category_id
        FROM {events}""",
    # Parts as merchants, brands as ledgers.
    "merchants": """
        SELECT p_brand AS ledger_id, p_partkey AS id, LOWER(p_type || ' ' || p_name) AS norm FROM {part}""",
    # One record per event under a key that repeats: user, type and week.
    "records": """
        SELECT CAST(user_id % 4 AS STRING) AS ledger_id, user_id AS account_id,
               event_type || '-' || CAST(CAST(DATE_TRUNC('week', ts) AS DATE) AS STRING) AS hash,
               event_id AS seq, CAST(ts AS DATE) AS date,
               CASE WHEN value < 20 THEN ' '
                    ELSE event_type || ' ' || CAST(CAST(FLOOR(value / 40) AS BIGINT) AS STRING) END AS description,
               (CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END)
                   * (1 + CAST(FLOOR(value) AS BIGINT) % 20) * 100 AS amount_cents,
               CAST(ROUND(value * 100) AS BIGINT) AS balance_cents,
               CASE WHEN value > 100 THEN '{{"k": ' || SUBSTR(props, 7, LENGTH(props) - 7) || ', "size": "big"}}'
                    ELSE props END AS metadata,
               event_type AS source_file, CAST(2 AS BIGINT) AS import_batch_id
        FROM {events}""",
}

#: Rows of a table that a view deals out by a key for a task, as rows of few bytes are too many in a task by their size.
TASK_ROWS = 500_000
_DEALT = {"order_flags": ("lineitem", "l_orderkey")}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")

#: What several tables of a ledger under rules are derived from.
SHARED = ("orders_wide", "order_flags")

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _inputs(sql: str) -> list[str]:
    return [n for n in dict.fromkeys(_NAME.findall(sql)) if n in VIEWS or n in BASE]


def frame(
    spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None, stored: Collection[str] = ()
) -> DataFrame:
    """A base table or derived view as a DataFrame; ``made`` keeps those already built.

    Views named in ``stored`` are written once, for callers that read them several times over.
    """
    made = {} if made is None else made
    if name not in made:
        if name in BASE:
            made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        else:
            sql = VIEWS[name]
            inputs = {n: frame(spark, sf_dir, n, made, stored) for n in _inputs(sql)}
            if name in _DEALT:
                table, key = _DEALT[name]
                inputs[table] = inputs[table].repartition(1 + inputs[table].count() // TASK_ROWS, key)
            built = spark.sql(sql, **inputs)
            made[name] = cut_lineage(built) if name in stored else built
    return made[name]


def books(spark: SparkSession, sf_dir: str, rules: DataFrame | None = None, stored: Collection[str] = ()) -> Books:
    """All state tables of the order ledgers, each built on first use; views in ``stored`` are written then."""
    made: dict[str, DataFrame] = {}
    tables = {n: partial(frame, spark, sf_dir, n, made, stored) for n in TABLES if n != "rules"}
    return Books(**tables, rules=spark.createDataFrame([], struct("rules")) if rules is None else rules)


def with_views(sql: str) -> str:
    """``sql`` over ``{view}`` names as one statement with the views it needs in front."""
    needed: list[str] = []

    def need(name: str) -> None:
        if name in VIEWS and name not in needed:
            for other in _inputs(VIEWS[name]):
                need(other)
            needed.append(name)

    for name in _inputs(sql):
        need(name)
    known = lambda m: m[1] if m[1] in VIEWS or m[1] in BASE else m[0]
    plain = lambda text: _NAME.sub(known, text).replace("{{", "{").replace("}}", "}")
    head = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in needed)
    body = plain(sql)
    if not head:
        return body
    rest = body.lstrip()
    if rest.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {rest[15:]}"
    if rest[:5].upper() == "WITH ":
        return f"WITH {head}, {rest[5:]}"
    return f"WITH {head} {rest}"
