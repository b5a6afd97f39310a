"""Bulk edits of the order ledgers; each edits table is drawn from whole star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from passbook.operators import aggregates, curate, predicates as p
from passbook.queries import query
from passbook.queries.lookups import LEGS
from passbook.queries.search import ENRICHED, LIVE
from passbook.sources import star

AT = "2005-05-05 00:00:00"
STATE = ["ledger_id", "transaction_id", "category_id", "category_source", "category_confirmed", "ai_confidence"]
STATE_SQL = ", ".join(STATE)


def _state(enrichments):
    return enrichments.select(*STATE, (F.col("updated_at") == F.lit(AT).cast("timestamp")).alias("touched"))


def _edits(books, orders):
    """Every open order becomes manual under its segment's category."""
    return orders.filter("status = 'O'").select(
        "ledger_id", F.col("id").alias("transaction_id"), F.ascii("segment").cast("bigint").alias("category_id"),
        F.lit("manual").alias("category_source"), F.lit(True).alias("category_confirmed"),
        F.lit(None).cast("double").alias("ai_confidence"),
    )


OPEN = f"""(SELECT w.* FROM {{orders_wide}} w WHERE status = 'O'
            AND NOT EXISTS (SELECT 1 FROM {LEGS} l WHERE l.ledger_id = w.ledger_id AND l.id = w.id))"""


@query("set_categories", f"""
    SELECT {STATE_SQL}, FALSE AS touched FROM {{enrichments}} e
    WHERE NOT EXISTS (SELECT 1 FROM {OPEN} o WHERE o.ledger_id = e.ledger_id AND o.id = e.transaction_id)
    UNION ALL SELECT ledger_id, id, CAST(ASCII(segment) AS BIGINT), 'manual', TRUE, NULL, TRUE FROM {OPEN}""")
def set_categories(spark, sf):
    books, orders = star.books(spark, sf), star.frame(spark, sf, "orders_wide")
    return _state(curate.set_categories(books.enrichments, _edits(books, orders), books.transfers, AT))


@query("count_applied", f"SELECT ledger_id, CAST(COUNT(*) AS BIGINT) AS applied FROM {OPEN} GROUP BY 1")
def count_applied(spark, sf):
    books, orders = star.books(spark, sf), star.frame(spark, sf, "orders_wide")
    return curate.count_applied(_edits(books, orders), books.transfers)


def _urgent_lines(spark, sf):
    """Orders with a large line, as (ledger_id, transaction_id)."""
    lines = star.frame(spark, sf, "lineitem").filter("l_quantity >= 45")
    orders = star.frame(spark, sf, "orders_wide")
    return orders.join(lines, F.col("id") == F.col("l_orderkey"), "left_semi").select(
        "ledger_id", F.col("id").alias("transaction_id")
    )


BIG = "EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = transaction_id AND l_quantity >= 45)"


@query("confirm_categories", f"""
    SELECT ledger_id, transaction_id, category_id, category_source, category_confirmed OR {BIG} AS category_confirmed,
           ai_confidence, {BIG} AS touched FROM {{enrichments}}""")
def confirm_categories(spark, sf):
    books = star.books(spark, sf)
    return _state(curate.confirm_categories(books.enrichments, _urgent_lines(spark, sf), AT)).withColumn(
        "touched", F.coalesce("touched", F.lit(False))
    )


@query("clear_categories", f"SELECT ledger_id, transaction_id FROM {{enrichments}} WHERE NOT {BIG}")
def clear_categories(spark, sf):
    books = star.books(spark, sf)
    return curate.clear_categories(books.enrichments, _urgent_lines(spark, sf)).select("ledger_id", "transaction_id")


@query("get_or_create_categories", """
    WITH wanted AS (SELECT DISTINCT CAST(n_regionkey AS STRING) AS ledger_id, 'Type/' || p_type AS path FROM {lineitem}
             JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {part} ON l_partkey = p_partkey
           UNION SELECT CAST(n_regionkey AS STRING), 'Segment/' || c_mktsegment FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey),
         fresh AS (SELECT * FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM {categories} c WHERE c.ledger_id = w.ledger_id AND c.path = w.path)),
         top AS (SELECT ledger_id, MAX(category_id) AS top FROM {categories} GROUP BY 1)
    SELECT ledger_id, category_id, path FROM {categories}
    UNION ALL SELECT f.ledger_id, top + ROW_NUMBER() OVER (PARTITION BY f.ledger_id ORDER BY path), path
              FROM fresh f JOIN top ON top.ledger_id = f.ledger_id""")
def get_or_create_categories(spark, sf):
    """Ledgers want the types of the parts they sold and the segments of their customers."""
    nation = star.frame(spark, sf, "nation")
    sold = (
        star.frame(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
        .join(star.frame(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(star.frame(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(F.col("s_nationkey").alias("n_nationkey"), F.concat(F.lit(" /Type/"), "p_type", F.lit("/ ")).alias("path"))
    )
    served = star.frame(spark, sf, "customer").select(
        F.col("c_nationkey").alias("n_nationkey"), F.concat(F.lit("Segment/"), "c_mktsegment").alias("path")
    )
    wanted = sold.unionByName(served).distinct().join(nation, "n_nationkey").select(
        F.col("n_regionkey").cast("string").alias("ledger_id"), "path"
    )
    categories = star.frame(spark, sf, "categories")
    return curate.get_or_create_categories(categories, wanted, AT).select("ledger_id", "category_id", "path")


@query("rename_categories", """
    SELECT ledger_id, category_id, CASE WHEN category_id < 100 THEN 'Part of ' || path ELSE path END AS path FROM {categories}""")
def rename_categories(spark, sf):
    categories = star.frame(spark, sf, "categories")
    renames = categories.filter("category_id < 100").select(
        "ledger_id", "category_id", F.concat(F.lit(" Part of "), "path", F.lit("/")).alias("path")
    )
    return curate.rename_categories(categories, renames).select("ledger_id", "category_id", "path")


@query("rename_conflicts", """
    SELECT ledger_id, category_id, 'Segment/BUILDING' AS path FROM {categories} WHERE path LIKE 'Status/%'""")
def rename_conflicts(spark, sf):
    categories = star.frame(spark, sf, "categories")
    renames = categories.filter("path LIKE 'Status/%'").select(
        "ledger_id", "category_id", F.lit("Segment/BUILDING").alias("path")
    )
    return curate.rename_conflicts(categories, renames)


def _merge(books):
    """Every status category goes into the first segment."""
    return books.categories.filter("path LIKE 'Status/%'").select(
        "ledger_id", "category_id", F.lit(65).cast("bigint").alias("target_id")
    )


@query("merge_categories", """
    SELECT ledger_id, CASE WHEN category_id > 100 THEN 65 ELSE category_id END AS category_id,
           CAST(COUNT(*) AS BIGINT) AS rows, CAST(COUNT(CASE WHEN category_id > 100 THEN 1 END) AS BIGINT) AS touched
    FROM {enrichments} GROUP BY 1, 2""")
def merge_categories(spark, sf):
    books = star.books(spark, sf)
    after = _state(curate.merge_categories(books, _merge(books), AT).enrichments)
    return after.groupBy("ledger_id", "category_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("touched"), 1)).alias("touched")
    )


@query("delete_categories", """
    SELECT ledger_id, category_id, CAST(COUNT(*) AS BIGINT) AS uncategorised FROM {enrichments} WHERE category_id > 100 GROUP BY 1, 2
    UNION ALL SELECT ledger_id, category_id, 0 FROM {categories} c WHERE category_id > 100
      AND NOT EXISTS (SELECT 1 FROM {enrichments} e WHERE e.ledger_id = c.ledger_id AND e.category_id = c.category_id)""")
def delete_categories(spark, sf):
    books = star.books(spark, sf)
    return curate.count_uncategorised_by_delete(books, books.categories.filter("category_id > 100"))


@query("blocked_deletes", """
    SELECT r.ledger_id AS ledger_id, r.category_id AS category_id, STRING_AGG(r.name, ', ' ORDER BY r.position, r.id) AS rules,
           (SELECT COUNT(*) FROM {categories} c WHERE c.ledger_id = r.ledger_id AND c.category_id = r.category_id) AS kept
    FROM {supplier_rules} r JOIN {categories} c ON c.ledger_id = r.ledger_id AND c.category_id = r.category_id
    WHERE r.category_id < 100 GROUP BY 1, 2""")
def blocked_deletes(spark, sf):
    """Segment categories that rules of suppliers assign: a delete without force names the rules and keeps them."""
    books = star.books(spark, sf)
    rules = star.frame(spark, sf, "supplier_rules")
    asked = books.categories.filter("category_id < 100")
    after = curate.delete_categories(books.with_tables(rules=rules), asked)
    blocked = curate.blocked_deletes(rules, asked)
    kept = after.categories.groupBy("ledger_id", "category_id").agg(F.count(F.lit(1)).alias("kept"))
    return blocked.join(kept, ["ledger_id", "category_id"], "left").select(
        "ledger_id", "category_id", F.array_join("rules", ", ").alias("rules"), F.coalesce("kept", F.lit(0)).alias("kept")
    )


@query("categories_left", "SELECT ledger_id, path, transactions FROM (SELECT c.ledger_id AS ledger_id, path, CAST(COUNT(e.transaction_id) AS BIGINT) AS transactions FROM {categories} c LEFT JOIN {enrichments} e ON c.ledger_id = e.ledger_id AND c.category_id = e.category_id WHERE c.category_id < 100 GROUP BY 1, 2)")
def categories_left(spark, sf):
    books = star.books(spark, sf)
    after = curate.delete_categories(books, books.categories.filter("category_id > 100"), force=True)
    return aggregates.categories_report(after.categories, after.enrichments).select("ledger_id", "path", "transactions")


def _pairs(spark, sf):
    """Medium orders that follow each other in one ledger."""
    wide = star.frame(spark, sf, "orders_wide").filter("priority = '3-MEDIUM'").select("ledger_id", "id")
    later = wide.select("ledger_id", (F.col("id") - 1).alias("id"), F.col("id").alias("to_transaction_id"))
    return wide.join(later, ["ledger_id", "id"]).withColumnRenamed("id", "from_transaction_id")


NEIGHBOURS = """(SELECT a.ledger_id AS ledger_id, a.id AS a_id, b.id AS b_id FROM {orders_wide} a
                 JOIN {orders_wide} b ON a.ledger_id = b.ledger_id AND b.id = a.id + 1
                 WHERE a.priority = '3-MEDIUM' AND b.priority = '3-MEDIUM')"""


@query("create_transfers", f"""
    SELECT ledger_id, a_id AS from_transaction_id, b_id AS to_transaction_id, 'auto' AS source,
           COALESCE((SELECT MAX(id) FROM {{transfers}} t WHERE t.ledger_id = n.ledger_id), 0)
             + ROW_NUMBER() OVER (PARTITION BY ledger_id ORDER BY a_id) AS id FROM {NEIGHBOURS} n
    UNION ALL SELECT ledger_id, from_transaction_id, to_transaction_id, source, id FROM {{transfers}}""")
def create_transfers(spark, sf):
    links = _pairs(spark, sf).select(
        "*", F.lit("auto").alias("source"), F.lit(False).alias("confirmed"), F.lit(0.7).alias("ai_confidence")
    )
    after = curate.create_transfers(star.books(spark, sf), links, AT)
    return after.transfers.select("ledger_id", "from_transaction_id", "to_transaction_id", "source", "id")


@query("legs_lose_categories", f"""
    SELECT ledger_id, transaction_id FROM {{enrichments}} e
    WHERE NOT EXISTS (SELECT 1 FROM {NEIGHBOURS} n WHERE n.ledger_id = e.ledger_id AND e.transaction_id IN (n.a_id, n.b_id))""")
def legs_lose_categories(spark, sf):
    links = _pairs(spark, sf).select(
        "*", F.lit("auto").alias("source"), F.lit(False).alias("confirmed"), F.lit(0.7).alias("ai_confidence")
    )
    return curate.create_transfers(star.books(spark, sf), links, AT).enrichments.select("ledger_id", "transaction_id")


@query("confirm_transfers", "SELECT ledger_id, id, confirmed OR ai_confidence > 0.5 AS confirmed FROM {transfers}")
def confirm_transfers(spark, sf):
    transfers = star.frame(spark, sf, "transfers")
    return curate.confirm_transfers(transfers, transfers.filter("ai_confidence > 0.5")).select(
        "ledger_id", "id", "confirmed"
    )


@query("delete_transfers", "SELECT ledger_id, id FROM {transfers} WHERE NOT COALESCE(ai_confidence > 0.5, FALSE)")
def delete_transfers(spark, sf):
    transfers = star.frame(spark, sf, "transfers")
    return curate.delete_transfers(transfers, transfers.filter("ai_confidence > 0.5")).select("ledger_id", "id")


@query("set_notes", """
    WITH edits AS (SELECT ledger_id, id, CASE WHEN turn = 2 THEN '' ELSE rtrim(text, ' ' || chr(10)) END AS text
                   FROM (SELECT conv_id, MAX(turn) AS turn, arg_max(text, turn) AS text FROM {conversations} GROUP BY 1)
                   JOIN {orders_wide} ON conv_id = id)
    SELECT ledger_id, id AS transaction_id, text AS note FROM edits WHERE text <> ''
    UNION ALL SELECT n.ledger_id, n.transaction_id, n.note FROM {notes} n
      WHERE NOT EXISTS (SELECT 1 FROM edits e WHERE e.ledger_id = n.ledger_id AND e.id = n.transaction_id)""")
def set_notes(spark, sf):
    """All turns of a conversation are edits of one note; the last turn counts."""
    talk, orders = star.frame(spark, sf, "conversations"), star.frame(spark, sf, "orders_wide")
    edits = talk.join(orders.select("ledger_id", "id"), F.col("conv_id") == F.col("id")).select(
        "ledger_id", F.col("id").alias("transaction_id"), F.col("turn").alias("seq"),
        F.when(F.col("turn") == 2, " \n").otherwise(F.concat("text", F.lit(" \n"))).alias("note"),
    )
    return curate.set_notes(star.frame(spark, sf, "notes"), edits, AT).select("ledger_id", "transaction_id", "note")


@query("set_tags", """
    SELECT tt.ledger_id AS ledger_id, tt.transaction_id AS transaction_id, name FROM {transaction_tags} tt
      JOIN {tags} g ON g.ledger_id = tt.ledger_id AND g.tag_id = tt.tag_id
      JOIN {orders_wide} w ON w.ledger_id = tt.ledger_id AND w.id = tt.transaction_id WHERE status <> 'F'
    UNION ALL SELECT ledger_id, id, 'seg/' || LOWER(segment) FROM {orders_wide} WHERE status = 'F'
    UNION ALL SELECT ledger_id, id, 'flag/r' FROM {orders_wide} WHERE status = 'F'""")
def set_tags(spark, sf):
    books = star.books(spark, sf)
    edits = star.frame(spark, sf, "orders_wide").filter("status = 'F'").select(
        "ledger_id", F.col("id").alias("transaction_id"),
        F.array(F.concat(F.lit("#Seg/"), "segment"), F.lit("two words"), F.lit("flag/R"), F.lit(" #FLAG/r ")).alias("tags"),
    )
    tags, bridge = curate.set_tags(books.tags, books.transaction_tags, edits, AT)
    return bridge.join(tags, ["ledger_id", "tag_id"]).select("ledger_id", "transaction_id", "name")


@query("tags_in_use", """
    SELECT DISTINCT ledger_id, 'seg/' || LOWER(segment) AS name FROM {orders_wide} WHERE status = 'F'
    UNION SELECT ledger_id, 'flag/r' FROM {orders_wide} WHERE status = 'F'
    UNION SELECT tt.ledger_id, name FROM {transaction_tags} tt
      JOIN {tags} g ON g.ledger_id = tt.ledger_id AND g.tag_id = tt.tag_id
      JOIN {orders_wide} w ON w.ledger_id = tt.ledger_id AND w.id = tt.transaction_id WHERE status <> 'F'""")
def tags_in_use(spark, sf):
    books = star.books(spark, sf)
    edits = star.frame(spark, sf, "orders_wide").filter("status = 'F'").select(
        "ledger_id", F.col("id").alias("transaction_id"),
        F.array(F.concat(F.lit("#Seg/"), "segment"), F.lit("flag/R")).alias("tags"),
    )
    return curate.set_tags(books.tags, books.transaction_tags, edits, AT)[0].select("ledger_id", "name")


@query("move_accounts", """
    SELECT a.ledger_id AS ledger_id, account_id,
           CASE WHEN a.deleted_at IS NULL THEN b.name ELSE 'Closed' END || '/' || a.name AS path
    FROM {accounts} a JOIN {banks} b ON a.ledger_id = b.ledger_id AND a.bank_id = b.bank_id""")
def move_accounts(spark, sf):
    """Deleted accounts move to a bank of their own."""
    books = star.books(spark, sf)
    moves = books.accounts.filter("deleted_at IS NOT NULL").select(
        "ledger_id", "account_id", F.concat(F.lit("Closed / "), "name").alias("path")
    )
    after = curate.move_accounts(books, moves)
    names = after.banks.select("ledger_id", "bank_id", F.col("name").alias("bank"))
    return after.accounts.join(names, ["ledger_id", "bank_id"]).select(
        "ledger_id", "account_id", F.concat_ws("/", "bank", "name").alias("path")
    )


@query("delete_accounts", """
    SELECT a.ledger_id AS ledger_id, account_id,
           a.deleted_at IS NOT NULL OR EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = account_id AND o_totalprice > 490000) AS deleted
    FROM {accounts} a""")
def delete_accounts(spark, sf):
    books = star.books(spark, sf)
    ids = books.transactions.filter("ABS(amount_cents) > 49000000").select("ledger_id", "account_id")
    after = curate.delete_accounts(books.accounts, ids, AT)
    return after.select("ledger_id", "account_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("count_held", """
    SELECT ledger_id, account_id, CAST(COUNT(*) AS BIGINT) AS held FROM {transactions} t
    WHERE EXISTS (SELECT 1 FROM {accounts} a WHERE a.ledger_id = t.ledger_id AND a.account_id = t.account_id AND a.deleted_at IS NOT NULL)
    GROUP BY 1, 2""")
def count_held(spark, sf):
    books = star.books(spark, sf)
    return curate.count_held(books.transactions, books.accounts.filter("deleted_at IS NOT NULL"))


MATCH = f"""(SELECT ledger_id, id FROM {ENRICHED} v WHERE amount_cents > 30000000 AND NOT COALESCE(ai_confidence >= 0.5, FALSE)
             AND NOT EXISTS (SELECT 1 FROM {LEGS} l WHERE l.ledger_id = v.ledger_id AND l.id = v.id))"""


@query("bulk_categorise", f"""
    SELECT {STATE_SQL}, FALSE AS touched FROM {{enrichments}} e
    WHERE NOT EXISTS (SELECT 1 FROM {MATCH} m WHERE m.ledger_id = e.ledger_id AND m.id = e.transaction_id)
    UNION ALL SELECT ledger_id, id, 66, 'manual', TRUE, NULL, TRUE FROM {MATCH}""")
def bulk_categorise(spark, sf):
    preds = [p.amount_cmp(">", "300000"), p.negate(p.confidence_is("50.."))]
    return _state(curate.bulk_categorise(star.books(spark, sf), preds, "Segment/BUILDING", AT))


@query("bulk_categorise_pending", f"""
    WITH hit AS (SELECT ledger_id, id FROM {ENRICHED} v WHERE date >= DATE '1997-01-01' AND category_source = 'ai' AND NOT category_confirmed
             AND NOT EXISTS (SELECT 1 FROM {LEGS} l WHERE l.ledger_id = v.ledger_id AND l.id = v.id))
    SELECT {STATE_SQL}, FALSE AS touched FROM {{enrichments}} e
    WHERE NOT EXISTS (SELECT 1 FROM hit m WHERE m.ledger_id = e.ledger_id AND m.id = e.transaction_id)
    UNION ALL SELECT ledger_id, id, 66, 'manual', TRUE, NULL, TRUE FROM hit""")
def bulk_categorise_pending(spark, sf):
    after = curate.bulk_categorise(star.books(spark, sf), [p.date_range("1997", "")], "Segment/BUILDING", AT, pending=True)
    return _state(after)


@query("bulk_accept", f"""
    SELECT e.ledger_id AS ledger_id, transaction_id,
           category_confirmed OR category_source = 'ai' AND EXISTS (SELECT 1 FROM {LIVE} v
             WHERE v.ledger_id = e.ledger_id AND v.id = e.transaction_id AND v.date < DATE '1998-01-01') AS category_confirmed
    FROM {{enrichments}} e""")
def bulk_accept(spark, sf):
    after = curate.bulk_accept_categories(star.books(spark, sf), [p.date_range("", "1997")], AT)
    return after.select("ledger_id", "transaction_id", "category_confirmed")


@query("bulk_accept_transfers", f"""
    SELECT tr.ledger_id AS ledger_id, tr.id AS id, tr.confirmed OR EXISTS (
        SELECT 1 FROM {LIVE} f JOIN {LIVE} t ON f.ledger_id = t.ledger_id
        WHERE f.ledger_id = tr.ledger_id AND f.id = tr.from_transaction_id AND t.id = tr.to_transaction_id
          AND (f.date < DATE '1998-01-01' OR t.date < DATE '1998-01-01')) AS confirmed
    FROM {{transfers}} tr""")
def bulk_accept_transfers(spark, sf):
    after = curate.bulk_accept_transfers(star.books(spark, sf), [p.date_range("", "1997")])
    return after.select("ledger_id", "id", "confirmed")


@query("mark_transfers", """
    WITH tx AS (SELECT ledger_id, id, amount_cents FROM {tx_events}),
         old AS (SELECT ledger_id, id, from_transaction_id AS f, to_transaction_id AS t FROM {event_links}),
         asked AS (SELECT a.ledger_id AS ledger_id, CASE WHEN a.amount_cents < 0 THEN a.id ELSE b.id END AS f,
                          CASE WHEN a.amount_cents < 0 THEN b.id ELSE a.id END AS t
                   FROM tx a JOIN tx b ON a.ledger_id = b.ledger_id AND b.amount_cents = -a.amount_cents
                     AND b.id = a.id + CASE WHEN a.id % 32 < 16 THEN 4 ELSE 8 END
                   WHERE a.id % 32 < 16 AND a.id % 8 < 4 OR a.id % 32 >= 16 AND a.id % 16 < 8),
         fresh AS (SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.ledger_id = a.ledger_id AND o.f = a.f AND o.t = a.t)),
         legs AS (SELECT ledger_id, f AS id FROM fresh UNION SELECT ledger_id, t FROM fresh)
    SELECT ledger_id, f AS from_transaction_id, t AS to_transaction_id, FALSE AS fresh FROM old o
    WHERE NOT EXISTS (SELECT 1 FROM legs l WHERE l.ledger_id = o.ledger_id AND l.id IN (o.f, o.t))
    UNION ALL SELECT ledger_id, f, t, TRUE FROM fresh""")
def mark_transfers(spark, sf):
    """Every event is offered in one pair, with the fourth or the eighth after it; all fourths are linked
    already, so pairs of eighths break the links of their legs."""
    books = star.books(spark, sf)
    tx = star.frame(spark, sf, "tx_events")
    step = F.when(F.col("id") % 32 < 16, 4).otherwise(8)
    heads = tx.filter((F.col("id") % (2 * step)) < step)
    pairs = heads.select("ledger_id", F.col("id").alias("a_id"), (F.col("id") + step).alias("b_id"))
    linked = star.frame(spark, sf, "event_links")
    after = curate.mark_transfers(books.with_tables(transactions=tx, transfers=linked), pairs, AT).transfers
    return after.select(
        "ledger_id", "from_transaction_id", "to_transaction_id", (F.col("created_at") == F.lit(AT).cast("timestamp")).alias("fresh")
    )
