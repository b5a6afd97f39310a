"""Joins, lookups and counts over the order ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from passbook.operators import aggregates, predicates as p, search, views
from passbook.queries import query
from passbook.queries.search import BRIEF, BRIEF_SQL, LIVE
from passbook.sources import star

LEGS = """(SELECT ledger_id, from_transaction_id AS id FROM {transfers}
           UNION SELECT ledger_id, to_transaction_id AS id FROM {transfers})"""
NOT_LEG = f"NOT EXISTS (SELECT 1 FROM {LEGS} l WHERE l.ledger_id = v.ledger_id AND l.id = v.id)"


@query("ledger_view", """
    SELECT t.ledger_id AS ledger_id, t.id AS id, a.name AS account_name, b.name AS bank_name,
           a.deleted_at IS NOT NULL AS deleted
    FROM {transactions} t
    JOIN {accounts} a ON t.ledger_id = a.ledger_id AND t.account_id = a.account_id
    JOIN {banks} b ON a.ledger_id = b.ledger_id AND a.bank_id = b.bank_id""")
def ledger_view(spark, sf):
    return views.wide_view(star.books(spark, sf)).select(
        "ledger_id", "id", "account_name", "bank_name", F.col("account_deleted_at").isNotNull().alias("deleted")
    )


@query("live_accounts", """
    SELECT a.ledger_id AS ledger_id, account_id, b.name || '/' || a.name AS path
    FROM {accounts} a JOIN {banks} b ON a.ledger_id = b.ledger_id AND a.bank_id = b.bank_id
    WHERE a.deleted_at IS NULL AND b.deleted_at IS NULL""")
def live_accounts(spark, sf):
    books = star.books(spark, sf)
    return views.live_accounts(books.accounts, books.banks).select("ledger_id", "account_id", "path")


# Every customer is looked up in its region under a path with stray blanks.
PATHS = """
    SELECT CAST(n_regionkey AS STRING) AS ledger_id, ' ' || n_name || ' / ' || c_name AS path
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey"""


@query("lookup_account", f"""
    SELECT q.ledger_id AS ledger_id, q.path AS path, a.account_id AS account_id FROM ({PATHS}) q
    JOIN {{banks}} b ON b.ledger_id = q.ledger_id
    JOIN {{accounts}} a ON a.ledger_id = b.ledger_id AND a.bank_id = b.bank_id
      AND ' ' || b.name || ' / ' || a.name = q.path
    WHERE a.deleted_at IS NULL""")
def lookup_account(spark, sf):
    books = star.books(spark, sf)
    paths = spark.sql(PATHS, customer=star.frame(spark, sf, "customer"), nation=star.frame(spark, sf, "nation"))
    return views.lookup_account(paths, books.accounts, books.banks).select("ledger_id", "path", "account_id")


@query("validate_accounts", """
    WITH asked AS (SELECT DISTINCT CAST(n_regionkey AS STRING) AS ledger_id, n_name AS bank, s_name AS account
                   FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey),
         live AS (SELECT a.ledger_id AS ledger_id, b.name AS bank, a.name AS account
                  FROM {accounts} a JOIN {banks} b ON a.ledger_id = b.ledger_id AND a.bank_id = b.bank_id
                  WHERE a.deleted_at IS NULL AND b.deleted_at IS NULL),
         tried AS (SELECT ledger_id, bank || '/' AS pattern, bank AS b, '' AS a FROM asked
                   UNION SELECT ledger_id, bank || '/' || account, bank, account FROM asked
                   UNION SELECT ledger_id, '/' || REPLACE(account, 'Supplier', 'Customer'), '', REPLACE(account, 'Supplier', 'Customer') FROM asked)
    SELECT t.ledger_id AS ledger_id, pattern,
           CASE WHEN NOT EXISTS (SELECT 1 FROM live l WHERE l.ledger_id = t.ledger_id AND starts_with(LOWER(l.bank), LOWER(t.b)))
                THEN 'no bank starts with ' || t.b
                WHEN NOT EXISTS (SELECT 1 FROM live l WHERE l.ledger_id = t.ledger_id
                       AND starts_with(LOWER(l.bank), LOWER(t.b)) AND starts_with(LOWER(l.account), LOWER(t.a)))
                THEN 'no account starts with ' || t.a || CASE WHEN t.b = '' THEN '' ELSE ' at ' || t.b END END AS error
    FROM tried t""")
def validate_accounts(spark, sf):
    books = star.books(spark, sf)
    named = star.frame(spark, sf, "supplier").join(
        star.frame(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    ledger = F.col("n_regionkey").cast("string").alias("ledger_id")
    other = F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))
    patterns = named.select(
        ledger,
        F.explode(
            F.array(
                F.concat("n_name", F.lit("/")), F.concat_ws("/", "n_name", "s_name"), F.concat(F.lit("/"), other)
            )
        ).alias("pattern"),
    ).distinct()
    return p.validate_account_patterns(patterns, views.live_accounts(books.accounts, books.banks))


@query("transactions_by_ids", """
    SELECT t.ledger_id AS ledger_id, t.id AS id, t.amount_cents AS amount_cents FROM {transactions} t
    WHERE EXISTS (SELECT 1 FROM {lineitem} WHERE l_orderkey = t.id AND l_quantity > 49)""")
def transactions_by_ids(spark, sf):
    books = star.books(spark, sf)
    ids = (
        star.frame(spark, sf, "lineitem").filter("l_quantity > 49")
        .join(books.transactions.select("ledger_id", "id"), F.col("l_orderkey") == F.col("id"))
        .select("ledger_id", "id")
    )
    return views.transactions_by_ids(views.wide_view(books), ids).select("ledger_id", "id", "amount_cents")


@query("category_of", """
    SELECT e.ledger_id AS ledger_id, transaction_id, path AS category_path FROM {enrichments} e
    JOIN {categories} c ON e.ledger_id = c.ledger_id AND e.category_id = c.category_id""")
def category_of(spark, sf):
    books = star.books(spark, sf)
    return views.category_of(books.enrichments, books.categories).select("ledger_id", "transaction_id", "category_path")


@query("transfer_of", """
    SELECT ledger_id, id, from_transaction_id AS transaction_id FROM {transfers}
    UNION ALL SELECT ledger_id, id, to_transaction_id FROM {transfers}""")
def transfer_of(spark, sf):
    return views.transfer_of(star.frame(spark, sf, "transfers")).select("ledger_id", "id", "transaction_id")


@query("uncategorised", f"""
    SELECT {BRIEF_SQL} FROM {LIVE} v
    WHERE NOT EXISTS (SELECT 1 FROM {{enrichments}} e WHERE e.ledger_id = v.ledger_id AND e.transaction_id = v.id
                      AND e.category_id IS NOT NULL) AND {NOT_LEG}""")
def uncategorised(spark, sf):
    books = star.books(spark, sf)
    return views.uncategorised(views.wide_view(books), books.enrichments, books.transfers).select(*BRIEF)


@query("unconfirmed", f"""
    SELECT {BRIEF_SQL} FROM {LIVE} v
    WHERE NOT EXISTS (SELECT 1 FROM {{enrichments}} e WHERE e.ledger_id = v.ledger_id AND e.transaction_id = v.id
                      AND e.category_id IS NOT NULL AND e.category_confirmed) AND {NOT_LEG}""")
def unconfirmed(spark, sf):
    books = star.books(spark, sf)
    return views.unconfirmed(views.wide_view(books), books.enrichments, books.transfers).select(*BRIEF)


@query("pending_ai_reviews", f"""
    SELECT v.ledger_id AS ledger_id, v.id AS id, v.description AS description, e.ai_confidence AS ai_confidence, c.path AS path
    FROM {LIVE} v JOIN {{enrichments}} e ON e.ledger_id = v.ledger_id AND e.transaction_id = v.id
    LEFT JOIN {{categories}} c ON e.ledger_id = c.ledger_id AND e.category_id = c.category_id
    WHERE e.category_source = 'ai' AND NOT e.category_confirmed""")
def pending_ai_reviews(spark, sf):
    books = star.books(spark, sf)
    found = views.pending_ai_reviews(views.wide_view(books), books.enrichments, books.categories)
    return found.select("ledger_id", "id", "transaction.description", "enrichment.ai_confidence", "category.path")


LINKED = f"""{{transfers}} tr
    JOIN {LIVE} f ON tr.ledger_id = f.ledger_id AND tr.from_transaction_id = f.id
    JOIN {LIVE} t ON tr.ledger_id = t.ledger_id AND tr.to_transaction_id = t.id"""


@query("transfers_with_legs", f"""
    SELECT tr.ledger_id AS ledger_id, tr.id AS id, f.description AS from_description, t.description AS to_description
    FROM {LINKED} WHERE tr.confirmed""")
def transfers_with_legs(spark, sf):
    books = star.books(spark, sf)
    return views.transfers_with_legs(views.wide_view(books), books.transfers).select(
        "ledger_id", "id", F.col("from_tx.description").alias("from_description"),
        F.col("to_tx.description").alias("to_description"),
    )


@query("pending_transfer_reviews", f"""
    SELECT tr.ledger_id AS ledger_id, tr.id AS id, tr.from_transaction_id AS from_transaction_id,
           tr.to_transaction_id AS to_transaction_id, tr.ai_confidence AS ai_confidence
    FROM {LINKED} WHERE NOT tr.confirmed""")
def pending_transfer_reviews(spark, sf):
    books = star.books(spark, sf)
    return views.pending_transfer_reviews(views.wide_view(books), books.transfers).select(
        "ledger_id", "id", "from_transaction_id", "to_transaction_id", "ai_confidence"
    )


@query("confirmed_examples", """
    SELECT t.ledger_id AS ledger_id, id, description, amount_cents, date, category_id FROM {transactions} t
    JOIN {enrichments} e ON t.ledger_id = e.ledger_id AND t.id = e.transaction_id
    WHERE category_confirmed AND category_id IS NOT NULL""")
def confirmed_examples(spark, sf):
    books = star.books(spark, sf)
    return views.confirmed_category_examples(books.transactions, books.enrichments)


@query("confirmed_transfer_examples", f"""
    SELECT tr.ledger_id AS ledger_id, f.account_id AS from_account_id, t.account_id AS to_account_id,
           f.description AS from_description, t.description AS to_description
    FROM {LINKED} WHERE tr.confirmed""")
def confirmed_transfer_examples(spark, sf):
    books = star.books(spark, sf)
    return views.confirmed_transfer_examples(views.wide_view(books), books.transfers)


@query("count_by_category", """
    SELECT ledger_id, category_id, CAST(COUNT(*) AS BIGINT) AS transactions FROM {enrichments}
    WHERE category_id IS NOT NULL GROUP BY 1, 2""")
def count_by_category(spark, sf):
    return aggregates.count_by_category(star.frame(spark, sf, "enrichments"))


@query("count_by_account", """
    SELECT ledger_id, account_id, CAST(COUNT(*) AS BIGINT) AS transactions FROM {transactions} GROUP BY 1, 2""")
def count_by_account(spark, sf):
    return aggregates.count_by_account(star.frame(spark, sf, "transactions"))


@query("count_by_tag", """
    SELECT g.ledger_id AS ledger_id, g.name AS name, CAST(COUNT(tt.transaction_id) AS BIGINT) AS uses
    FROM {tags} g LEFT JOIN {transaction_tags} tt ON g.ledger_id = tt.ledger_id AND g.tag_id = tt.tag_id
    GROUP BY 1, 2""")
def count_by_tag(spark, sf):
    rows = aggregates.list_tags(star.frame(spark, sf, "tags"), star.frame(spark, sf, "transaction_tags"))
    return rows.select("ledger_id", "name", "uses")


@query("tags_per_transaction", """
    SELECT tt.ledger_id AS ledger_id, transaction_id, STRING_AGG(name, ',' ORDER BY name) AS tags
    FROM {transaction_tags} tt JOIN {tags} g ON g.ledger_id = tt.ledger_id AND g.tag_id = tt.tag_id GROUP BY 1, 2""")
def tags_per_transaction(spark, sf):
    rows = views.tags_per_transaction(star.frame(spark, sf, "tags"), star.frame(spark, sf, "transaction_tags"))
    return rows.withColumn("tags", F.array_join("tags", ","))


@query("notes_per_transaction", "SELECT ledger_id, transaction_id, note FROM {notes}")
def notes_per_transaction(spark, sf):
    return views.notes_per_transaction(star.frame(spark, sf, "notes"))


@query("categories_report", """
    SELECT c.ledger_id AS ledger_id, c.path AS path, CAST(COUNT(e.transaction_id) AS BIGINT) AS transactions
    FROM {categories} c LEFT JOIN {enrichments} e ON c.ledger_id = e.ledger_id AND c.category_id = e.category_id
    GROUP BY 1, 2""")
def categories_report(spark, sf):
    rows = aggregates.categories_report(star.frame(spark, sf, "categories"), star.frame(spark, sf, "enrichments"))
    return rows.select("ledger_id", "path", "transactions")


@query("accounts_report", """
    SELECT a.ledger_id AS ledger_id, a.account_id AS account_id, b.name AS bank_name, a.name AS account_name,
           CAST(COUNT(t.id) AS BIGINT) AS transactions
    FROM {accounts} a JOIN {banks} b ON a.ledger_id = b.ledger_id AND a.bank_id = b.bank_id
    LEFT JOIN {transactions} t ON t.ledger_id = a.ledger_id AND t.account_id = a.account_id
    WHERE a.deleted_at IS NULL AND b.deleted_at IS NULL GROUP BY 1, 2, 3, 4""")
def accounts_report(spark, sf):
    books = star.books(spark, sf)
    return aggregates.accounts_report(books.transactions, books.accounts, books.banks)


@query("transactions_in_category", f"""
    WITH chosen AS (SELECT ledger_id, CASE WHEN CAST(ledger_id AS INTEGER) % 2 = 0 THEN MIN(category_id) ELSE MAX(category_id) END AS category_id
                    FROM {{categories}} GROUP BY ledger_id)
    SELECT v.ledger_id AS ledger_id, v.id AS id, v.date AS date, v.amount_cents AS amount_cents
    FROM {LIVE} v JOIN {{enrichments}} e ON e.ledger_id = v.ledger_id AND e.transaction_id = v.id
    JOIN chosen c ON c.ledger_id = e.ledger_id AND c.category_id = e.category_id
    QUALIFY ROW_NUMBER() OVER (PARTITION BY v.ledger_id ORDER BY v.date DESC, v.id DESC) <= 200""")
def transactions_in_category(spark, sf):
    """Even and odd ledgers ask for different categories, whose ids occur in all of them."""
    books = star.books(spark, sf)
    pick = F.when(F.col("ledger_id").cast("int") % 2 == 0, F.min("category_id")).otherwise(F.max("category_id"))
    ids = books.categories.groupBy("ledger_id").agg(pick.alias("category_id"))
    return search.transactions_in_category(books, ids, limit=200).select(*BRIEF)


@query("transactions_in_account", f"""
    SELECT {BRIEF_SQL} FROM {LIVE} v WHERE EXISTS (SELECT 1 FROM (SELECT ledger_id, MIN(account_id) AS account_id FROM {{accounts}}
      WHERE deleted_at IS NULL GROUP BY ledger_id) a WHERE a.ledger_id = v.ledger_id AND a.account_id = v.account_id)""")
def transactions_in_account(spark, sf):
    books = star.books(spark, sf)
    ids = books.accounts.filter("deleted_at IS NULL").groupBy("ledger_id").agg(F.min("account_id").alias("account_id"))
    return search.transactions_in_account(books, ids).select(*BRIEF)


@query("transfer_order", """
    SELECT ledger_id, id FROM {transfers} ORDER BY created_at DESC, id DESC LIMIT 25""")
def transfer_order(spark, sf):
    return star.frame(spark, sf, "transfers").orderBy(*search.transfer_order()).select("ledger_id", "id").limit(25)
