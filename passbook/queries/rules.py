"""The rules engine over all order ledgers at once, rules included as data."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from passbook.operators import aggregates, rules as ops
from passbook.queries import query
from passbook.queries.curate import AT
from passbook.queries.lookups import LEGS
from passbook.queries.search import LIVE
from passbook.schema import struct
from passbook.session import cut_lineage
from passbook.sources import star

# Rules of every ledger: one per bank, then general ones (Spark side).
RULES = """
    SELECT CAST(n_regionkey AS STRING) AS ledger_id, CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name,
           ARRAY(NAMED_STRUCT('field', 'account', 'value', n_name || '/', 'negated', FALSE),
                 NAMED_STRUCT('field', 'amount', 'value', '>300000', 'negated', FALSE)) AS terms,
           CAST(65 AS BIGINT) AS category_id, 'all' AS override_mode, FALSE AS review_required,
           CAST(n_nationkey AS BIGINT) AS position, CAST('2000-01-01' AS TIMESTAMP) AS created_at
    FROM {nation}
    UNION ALL
    SELECT CAST(r_regionkey AS STRING), CAST(x.id AS BIGINT), x.name, x.terms, CAST(x.category_id AS BIGINT), x.mode, x.review,
           CAST(x.id AS BIGINT), CAST('2000-01-01' AS TIMESTAMP)
    FROM {region} LATERAL VIEW INLINE(ARRAY(
      NAMED_STRUCT('id', 100, 'name', 'text', 'terms', ARRAY(
         NAMED_STRUCT('field', 'text', 'value', 'Building', 'negated', FALSE),
         NAMED_STRUCT('field', 'd', 'value', '1997..', 'negated', FALSE)), 'category_id', 66, 'mode', 'ai', 'review', TRUE),
      NAMED_STRUCT('id', 101, 'name', 'tag', 'terms', ARRAY(
         NAMED_STRUCT('field', 'tag', 'value', '#ship', 'negated', FALSE),
         NAMED_STRUCT('field', 'confidence', 'value', '<50', 'negated', FALSE)), 'category_id', 170, 'mode', 'all', 'review', TRUE),
      NAMED_STRUCT('id', 102, 'name', 'note', 'terms', ARRAY(
         NAMED_STRUCT('field', 'category', 'value', 'segment', 'negated', TRUE),
         NAMED_STRUCT('field', 'note', 'value', 'any', 'negated', FALSE)), 'category_id', 72, 'mode', 'uncategorised', 'review', FALSE),
      NAMED_STRUCT('id', 103, 'name', 'idle', 'terms', ARRAY(
         NAMED_STRUCT('field', 'regex', 'value', '.', 'negated', FALSE)), 'category_id', NULL, 'mode', 'all', 'review', FALSE),
      NAMED_STRUCT('id', 104, 'name', 'debits', 'terms', ARRAY(
         NAMED_STRUCT('field', 'date', 'value', 'never', 'negated', FALSE),
         NAMED_STRUCT('field', 'amount', 'value', '..0', 'negated', FALSE)), 'category_id', 70, 'mode', 'uncategorised', 'review', FALSE),
      NAMED_STRUCT('id', 105, 'name', 'patterns', 'terms', ARRAY(
         NAMED_STRUCT('field', 'regex', 'value', '/^card \\\\p{{Alpha}}+ machinery/i', 'negated', FALSE),
         NAMED_STRUCT('field', 'regex', 'value', '(', 'negated', TRUE),
         NAMED_STRUCT('field', 'amount', 'value', '<400000', 'negated', FALSE)), 'category_id', 77, 'mode', 'uncategorised', 'review', FALSE)
    )) x AS id, name, terms, category_id, mode, review"""

# The same meaning, written out.
STATE = f"""
    kept AS (SELECT * FROM {{enrichments}} WHERE NOT (category_source = 'rule' AND NOT category_confirmed)),
    seen AS (SELECT v.*, k.category_id AS old_category, k.category_source AS old_source, k.category_confirmed AS old_confirmed,
                    k.ai_confidence AS score, c.path AS path, k.transaction_id IS NOT NULL AS has_old
             FROM {LIVE} v LEFT JOIN kept k ON k.ledger_id = v.ledger_id AND k.transaction_id = v.id
             LEFT JOIN {{categories}} c ON c.ledger_id = k.ledger_id AND c.category_id = k.category_id),
    noted AS (SELECT ledger_id, transaction_id FROM {{notes}}),
    hits AS (SELECT s.*, r.id AS rule_id, r.position AS position, 65 AS new_category, 'all' AS mode, FALSE AS review
             FROM seen s JOIN (SELECT CAST(n_regionkey AS STRING) AS ledger_id, n_nationkey + 1 AS id, n_nationkey AS position, LOWER(n_name) AS prefix FROM {{nation}}) r
               ON r.ledger_id = s.ledger_id AND starts_with(LOWER(s.bank_name), r.prefix) WHERE amount_cents > 30000000
             UNION ALL SELECT s.*, 100, 100, 66, 'ai', TRUE FROM seen s
               LEFT JOIN {{notes}} n ON n.ledger_id = s.ledger_id AND n.transaction_id = s.id
               WHERE (CONTAINS(description, 'BUILDING') OR regexp_matches(LOWER(COALESCE(n.note, '')), '(^|[^a-z])building($|[^a-z])')) AND date >= DATE '1997-01-01'
             UNION ALL SELECT s.*, 101, 101, 170, 'all', TRUE FROM seen s WHERE score < 0.5 AND EXISTS (
               SELECT 1 FROM {{transaction_tags}} tt JOIN {{tags}} g ON g.ledger_id = tt.ledger_id AND g.tag_id = tt.tag_id
               WHERE tt.ledger_id = s.ledger_id AND tt.transaction_id = s.id AND g.name LIKE 'ship/%')
             UNION ALL SELECT s.*, 102, 102, 72, 'uncategorised', FALSE FROM seen s
               WHERE NOT COALESCE(LOWER(path) LIKE 'segment%', FALSE)
                 AND EXISTS (SELECT 1 FROM noted n WHERE n.ledger_id = s.ledger_id AND n.transaction_id = s.id)
             UNION ALL SELECT s.*, 104, 104, 70, 'uncategorised', FALSE FROM seen s WHERE amount_cents <= 0
             UNION ALL SELECT s.*, 105, 105, 77, 'uncategorised', FALSE FROM seen s
               WHERE regexp_matches(description, '(?i)^card [a-z]+ machinery') AND amount_cents < 40000000),
    claimed AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ledger_id, id ORDER BY position, rule_id) AS place FROM hits) WHERE place = 1),
    writes AS (SELECT * FROM claimed c WHERE NOT EXISTS (SELECT 1 FROM {LEGS} l WHERE l.ledger_id = c.ledger_id AND l.id = c.id)
               AND (NOT has_old OR NOT COALESCE(old_confirmed AND old_category = new_category, FALSE)
                    AND (mode = 'all' OR mode = 'ai' AND old_source = 'ai')))"""


def _books(spark, sf):
    rules = spark.sql(RULES, nation=star.frame(spark, sf, "nation"), region=star.frame(spark, sf, "region"))
    return star.books(spark, sf, rules, star.SHARED)


@query("rule_claims", f"WITH {STATE} SELECT ledger_id, id AS transaction_id, CAST(rule_id AS BIGINT) AS rule_id FROM claimed")
def rule_claims(spark, sf):
    books = _books(spark, sf)
    kept = books.with_tables(enrichments=ops.without_drafts(books.enrichments))
    return ops.claims(kept).select("ledger_id", "transaction_id", "rule_id")


@query("apply_rules", f"""
    WITH {STATE}
    SELECT k.ledger_id AS ledger_id, k.transaction_id AS transaction_id, k.category_id AS category_id,
           k.category_source AS category_source, k.category_confirmed AS category_confirmed
    FROM kept k WHERE NOT EXISTS (SELECT 1 FROM writes w WHERE w.ledger_id = k.ledger_id AND w.id = k.transaction_id)
    UNION ALL SELECT ledger_id, id, CAST(new_category AS BIGINT), 'rule', NOT review FROM writes""")
def apply_rules(spark, sf):
    return ops.apply_rules(_books(spark, sf), AT).enrichments.select(
        "ledger_id", "transaction_id", "category_id", "category_source", "category_confirmed"
    )


@query("preview_rules", f"""
    WITH {STATE},
         prior AS (SELECT * FROM {{enrichments}} WHERE category_source = 'rule' AND category_id IS NOT NULL)
    SELECT w.ledger_id AS ledger_id, w.id AS transaction_id, CAST(w.rule_id AS BIGINT) AS rule_id,
           p.category_id AS prior_category_id, CAST(w.new_category AS BIGINT) AS category_id
    FROM writes w LEFT JOIN prior p ON p.ledger_id = w.ledger_id AND p.transaction_id = w.id
    WHERE p.category_id IS NULL OR p.category_id <> w.new_category""")
def preview_rules(spark, sf):
    return ops.preview_rules(_books(spark, sf), AT)


# The enrichments that a run leaves.
ONCE = """
         once AS (SELECT ledger_id, transaction_id, category_id, category_source, category_confirmed, ai_confidence FROM kept k
                  WHERE NOT EXISTS (SELECT 1 FROM writes w WHERE w.ledger_id = k.ledger_id AND w.id = k.transaction_id)
                  UNION ALL SELECT ledger_id, id, CAST(new_category AS BIGINT), 'rule', NOT review, NULL FROM writes)"""
# The state of a second run, over what the first one wrote.
STATE_2 = re.sub(r"\b(kept|seen|noted|hits|claimed|writes)\b", r"\1_2", STATE).replace("{enrichments}", "once")


@query("rules_settle", f"""
    WITH {STATE}, {ONCE}, {STATE_2},
         prior AS (SELECT * FROM once WHERE category_source = 'rule' AND category_id IS NOT NULL)
    SELECT w.ledger_id AS ledger_id, w.id AS transaction_id, CAST(w.rule_id AS BIGINT) AS rule_id,
           p.category_id AS prior_category_id, CAST(w.new_category AS BIGINT) AS category_id
    FROM writes_2 w LEFT JOIN prior p ON p.ledger_id = w.ledger_id AND p.transaction_id = w.id
    WHERE p.category_id IS NULL OR p.category_id <> w.new_category""")
def rules_settle(spark, sf):
    """What a second run over the result of the first changes: rows whose scores and categories moved under
    the rules that read them."""
    books = _books(spark, sf)
    once = ops.apply_rules(books, AT)
    # The second run reads them in three places.
    again = ops.apply_rules(books.with_tables(enrichments=cut_lineage(once.enrichments)), AT)
    return again.changes.select("ledger_id", "transaction_id", "rule_id", "prior_category_id", "category_id")


@query("rule_match_counts", f"""
    WITH {STATE.replace("NOT (category_source = 'rule' AND NOT category_confirmed)", "TRUE")},
         n AS (SELECT ledger_id, rule_id, COUNT(*) AS n FROM hits GROUP BY 1, 2
               UNION ALL SELECT ledger_id, 103, COUNT(*) FROM seen GROUP BY 1)
    SELECT r.ledger_id AS ledger_id, CAST(r.id AS BIGINT) AS id, CAST(COALESCE(n, 0) AS BIGINT) AS matches
    FROM (SELECT CAST(n_regionkey AS STRING) AS ledger_id, n_nationkey + 1 AS id FROM {{nation}}
          UNION ALL SELECT CAST(r_regionkey AS STRING), unnest([100, 101, 102, 103, 104, 105]) FROM {{region}}) r
    LEFT JOIN n ON n.ledger_id = r.ledger_id AND n.rule_id = r.id""")
def rule_match_counts(spark, sf):
    return ops.rule_match_counts(_books(spark, sf)).select("ledger_id", "id", "matches")


def _saved(spark, sf):
    """The rules suppliers saved, each a search for its own name."""
    rows = star.frame(spark, sf, "supplier_rules")
    test = F.struct(F.lit("text").alias("field"), F.col("name").alias("value"), F.lit(False).alias("negated"))
    return rows.withColumn("terms", F.array(test)).select(*struct("rules").names)


@query("rules_using_category", """
    SELECT r.ledger_id AS ledger_id, r.id AS id FROM {supplier_rules} r JOIN {categories} c
      ON c.ledger_id = r.ledger_id AND c.category_id = r.category_id WHERE c.path IN ('Segment/BUILDING', 'Segment/HOUSEHOLD')""")
def rules_using_category(spark, sf):
    ids = star.frame(spark, sf, "categories").filter("path IN ('Segment/BUILDING', 'Segment/HOUSEHOLD')")
    return ops.rules_using_category(_saved(spark, sf), ids).select("ledger_id", "id")


@query("next_position", "SELECT ledger_id, MAX(position) + 1 AS next_position FROM {supplier_rules} GROUP BY 1")
def next_position(spark, sf):
    return aggregates.next_position(_saved(spark, sf))


@query("edit_rules", """
    SELECT ledger_id, id, CASE WHEN category_id = 65 THEN name || '!' ELSE name END AS name,
           CASE WHEN category_id = 65 THEN NULL ELSE category_id END AS category_id, position
    FROM {supplier_rules} WHERE category_id IS NOT NULL
    UNION ALL SELECT ledger_id, MAX(id) + 1, 'fresh', NULL, MAX(position) + 1 FROM {supplier_rules} GROUP BY 1""")
def edit_rules(spark, sf):
    """Rules of one category are renamed and idle, idle ones deleted, a new one appended."""
    rules = _saved(spark, sf)
    chosen = F.col("category_id").eqNullSafe(F.lit(65))
    edits = rules.select(
        "ledger_id", "id",
        F.when(chosen, F.concat("name", F.lit("!"))).alias("name"),
        F.lit(None).cast(rules.schema["terms"].dataType).alias("terms"),
        F.lit(None).cast("bigint").alias("category_id"),
        chosen.alias("clear_category"),
        F.lit(None).cast("string").alias("override_mode"),
        F.lit(None).cast("boolean").alias("review_required"),
        F.col("category_id").isNull().alias("deleted"),
    )
    fresh = rules.select("ledger_id").distinct().select(
        "ledger_id", F.lit("fresh").alias("name"), F.array().cast(rules.schema["terms"].dataType).alias("terms")
    )
    # New rules follow all that were there; the edits then meet the whole table.
    return ops.edit_rules(ops.create_rules(rules, fresh, AT), edits).select("ledger_id", "id", "name", "category_id", "position")
