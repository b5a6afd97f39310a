"""Transfers, history, features, similarity and the linear model."""

from __future__ import annotations

from pyspark.sql import functions as F

from passbook.functions.text import normalise_merchant
from passbook.operators import aggregates, features, history, transfers, views
from passbook.operators.linear import predict_linear, train_linear
from passbook.plans import classify as plan
from passbook.queries import query
from passbook.queries.curate import AT
from passbook.queries.rules import ONCE, RULES, STATE
from passbook.schema import Books
from passbook.session import cut_lineage
from passbook.sources import star


def _event_view(spark, sf, stored=()):
    made: dict = {}
    tables = [star.frame(spark, sf, n, made, stored) for n in ("tx_events", "event_accounts", "event_banks")]
    return views.ledger_view(*tables), star.frame(spark, sf, "event_links", made, stored)


@query("count_pairs", """
    SELECT d.ledger_id AS ledger_id, d.date AS date, c.amount_cents AS size_cents, CAST(COUNT(*) AS BIGINT) AS pairs
    FROM {tx_events} d JOIN {tx_events} c ON d.ledger_id = c.ledger_id AND d.date = c.date AND d.amount_cents = -c.amount_cents
      AND d.account_id <> c.account_id AND d.amount_cents < 0
    GROUP BY 1, 2, 3""")
def count_pairs(spark, sf):
    rows = aggregates.count_pairs(star.frame(spark, sf, "tx_events"))
    return rows.select("ledger_id", "date", "size_cents", "pairs")


@query("nearest_counterpart", """
    SELECT ledger_id, query_id, id, days FROM (
      SELECT q.ledger_id AS ledger_id, q.id AS query_id, c.id AS id, CAST(ABS(c.date - q.date) AS INTEGER) AS days,
             ROW_NUMBER() OVER (PARTITION BY q.ledger_id, q.id
               ORDER BY CASE WHEN c.account_id <> q.account_id THEN 0 ELSE 1 END, ABS(c.date - q.date), c.id) AS place
      FROM {tx_events} q JOIN {tx_events} c ON q.ledger_id = c.ledger_id AND c.amount_cents = -q.amount_cents AND c.id <> q.id)
    WHERE place = 1""")
def nearest_counterpart(spark, sf):
    return transfers.nearest_counterpart(_event_view(spark, sf)[0])


@query("transfer_candidates", """
    WITH asked AS (SELECT t.* FROM {tx_events} t JOIN {supplier} ON s_suppkey = t.id),
         found AS (SELECT q.ledger_id AS ledger_id, q.id AS query_id, c.id AS id, c.account_id AS account_id, CAST(ABS(c.date - q.date) AS INTEGER) AS days,
                          c.account_id <> q.account_id AS other
                   FROM asked q JOIN {tx_events} c ON q.ledger_id = c.ledger_id AND c.amount_cents = -q.amount_cents AND c.id <> q.id),
         usable AS (SELECT *, BOOL_OR(other) OVER (PARTITION BY ledger_id, query_id) AS any_other FROM found)
    SELECT ledger_id, query_id, id, account_id, days, place FROM (
      SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY ledger_id, query_id ORDER BY days, id) AS INTEGER) AS place FROM usable WHERE other OR NOT any_other)
    WHERE place <= 100""")
def transfer_candidates(spark, sf):
    """Counterparts of the events whose ids the supplier table names."""
    asked = star.frame(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    view = _event_view(spark, sf)[0]
    found = transfers.transfer_candidates(view, view.join(asked, "id", "left_semi"))
    return found.select("ledger_id", "query_id", "id", "account_id", "days", "place")


# Candidates are events outside the links; norms are the event types.
PAIRS = """
    legs AS (SELECT ledger_id, from_transaction_id AS id FROM {event_links} UNION SELECT ledger_id, to_transaction_id FROM {event_links}),
    tx AS (SELECT t.*, source_file AS norm FROM {tx_events} t
           WHERE NOT EXISTS (SELECT 1 FROM legs l WHERE l.ledger_id = t.ledger_id AND l.id = t.id)),
    hist AS (SELECT DISTINCT k.ledger_id AS ledger_id, LEAST(f.account_id, t.account_id) AS low, GREATEST(f.account_id, t.account_id) AS high,
                    unnest([f.source_file, t.source_file]) AS norm
             FROM {event_links} k JOIN {tx_events} f ON f.ledger_id = k.ledger_id AND f.id = k.from_transaction_id
             JOIN {tx_events} t ON t.ledger_id = k.ledger_id AND t.id = k.to_transaction_id),
    sizes AS (SELECT ledger_id, date, ABS(amount_cents) AS size, COUNT(*) FILTER (amount_cents < 0) AS debits,
                     COUNT(*) FILTER (amount_cents > 0) AS credits FROM tx GROUP BY 1, 2, 3),
    pairs AS (SELECT d.ledger_id AS ledger_id, d.date AS date, c.amount_cents AS size, d.id AS d, c.id AS c,
                     d.account_id AS da, c.account_id AS ca,
                     CASE WHEN EXISTS (SELECT 1 FROM hist h WHERE h.ledger_id = d.ledger_id AND h.low = LEAST(d.account_id, c.account_id)
                                 AND h.high = GREATEST(d.account_id, c.account_id) AND h.norm IN (d.norm, c.norm)) THEN 0.95
                          WHEN EXISTS (SELECT 1 FROM hist h WHERE h.ledger_id = d.ledger_id AND h.low = LEAST(d.account_id, c.account_id)
                                 AND h.high = GREATEST(d.account_id, c.account_id)) THEN 0.8
                          WHEN debits = 1 AND credits = 1 THEN 0.7 ELSE 0.4 END AS confidence
              FROM tx d JOIN tx c ON d.ledger_id = c.ledger_id AND d.date = c.date AND d.amount_cents = -c.amount_cents
                AND d.amount_cents < 0 AND d.account_id <> c.account_id
              JOIN sizes s ON s.ledger_id = d.ledger_id AND s.date = d.date AND s.size = c.amount_cents)"""


# The greedy order, one pair of each group after the other.
TAKEN = """
    ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ledger_id, date, size ORDER BY confidence DESC, da, d, ca, c) AS place FROM pairs),
    taken AS (
      SELECT ledger_id, date, size, [d, c] AS used, d, c, confidence FROM ranked WHERE place = 1
      UNION ALL
      SELECT ledger_id, date, size, list_concat(used, [best.d, best.c]), best.d, best.c, best.confidence
      FROM (SELECT t.ledger_id AS ledger_id, t.date AS date, t.size AS size, t.used AS used,
                   arg_min({'d': r.d, 'c': r.c, 'confidence': r.confidence}, r.place) AS best
            FROM taken t JOIN ranked r ON r.ledger_id = t.ledger_id AND r.date = t.date AND r.size = t.size
            WHERE NOT list_contains(t.used, r.d) AND NOT list_contains(t.used, r.c)
            GROUP BY 1, 2, 3, 4))"""
# Sign-ups are filed, so a whole run pairs the other events only.
UNFILED_PAIRS = PAIRS.replace("l.id = t.id)),", "l.id = t.id) AND source_file <> 'signup'),", 1)


@query("detect_transfers", f"""
    WITH RECURSIVE {PAIRS}, {TAKEN}
    SELECT ledger_id, d AS from_transaction_id, c AS to_transaction_id, CAST(confidence AS DOUBLE) AS ai_confidence FROM taken""")
def detect_transfers(spark, sf):
    view, links = _event_view(spark, sf, stored=("event_accounts", "event_links"))
    open_rows = view.join(views.leg_ids(links), ["ledger_id", "id"], "left_anti")
    return transfers.detect_transfers(open_rows, views.confirmed_transfer_examples(view, links))


@query("history_exact", """
    SELECT q.ledger_id AS ledger_id, q.id AS id, arg_max(h.category_id, (h.date, h.id)) AS category_id
    FROM {labelled_events} q JOIN {labelled_events} h
      ON h.ledger_id = q.ledger_id AND h.norm = q.norm AND h.amount_cents = q.amount_cents AND h.date < q.date
    GROUP BY 1, 2""")
def history_exact(spark, sf):
    rows = star.frame(spark, sf, "labelled_events")
    return history.history_exact(rows.drop("category_id"), rows).select("ledger_id", "id", "category_id")


NEWEST = """
    day AS (SELECT ledger_id, norm, date, arg_max(category_id, id) AS category_id FROM {labelled_events} GROUP BY 1, 2, 3),
    clear AS (SELECT ledger_id, norm, COUNT(DISTINCT category_id) = 1 AS clear FROM {labelled_events} GROUP BY 1, 2)"""


@query("history_recurring", f"""
    WITH {NEWEST}
    SELECT q.ledger_id AS ledger_id, q.id AS id, d.category_id AS category_id, CASE WHEN clear THEN 0.95 ELSE 0.4 END::DOUBLE AS confidence
    FROM {{labelled_events}} q ASOF JOIN day d ON d.ledger_id = q.ledger_id AND d.norm = q.norm AND d.date < q.date
    JOIN clear c ON c.ledger_id = q.ledger_id AND c.norm = q.norm""")
def history_recurring(spark, sf):
    rows = star.frame(spark, sf, "labelled_events")
    return history.history_recurring(rows.drop("category_id"), rows)


@query("clear_merchants", """
    SELECT ledger_id, norm, COUNT(DISTINCT category_id) = 1 AS clear FROM {labelled_events} GROUP BY 1, 2""")
def clear_merchants(spark, sf):
    return history.clear_merchants(star.frame(spark, sf, "labelled_events"))


@query("history_tiers", """
    SELECT ledger_id, CASE WHEN EXISTS (SELECT 1 FROM {labelled_events} h WHERE h.ledger_id = q.ledger_id AND h.norm = q.norm
                                        AND h.amount_cents = q.amount_cents AND h.date < q.date) THEN 'exact'
                           WHEN EXISTS (SELECT 1 FROM {labelled_events} h WHERE h.ledger_id = q.ledger_id AND h.norm = q.norm
                                        AND h.date < q.date) THEN 'recurring' ELSE 'open' END AS source, CAST(COUNT(*) AS BIGINT) AS rows
    FROM {labelled_events} q GROUP BY 1, 2""")
def history_tiers(spark, sf):
    rows = star.frame(spark, sf, "labelled_events")
    found = history.suggest_from_history(rows.drop("category_id"), rows)
    return plan.classify_report(found.withColumn("source", F.coalesce("suggestion.source", F.lit("open"))))


# Features of merchants written out: word uni- and bigrams, padded character 3- to 5-grams.
GRAMS = """
    docs AS (SELECT ledger_id, norm, MIN(id) AS doc, COUNT(*) AS n FROM {merchants} GROUP BY 1, 2),
    words AS (SELECT *, string_split(norm, ' ') AS w FROM docs),
    feats AS (
      SELECT ledger_id, doc, n, 'w' || unnest(w) AS feature FROM words
      UNION ALL SELECT ledger_id, doc, n, 'w' || unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM words
      UNION ALL SELECT ledger_id, doc, n, 'c' || unnest(CASE WHEN length(p) <= s THEN [p] ELSE [substr(p, CAST(i AS BIGINT), s) FOR i IN range(1, length(p) - s + 2)] END)
        FROM (SELECT ledger_id, doc, n, ' ' || unnest(w) || ' ' AS p FROM words), (SELECT unnest([3, 4, 5]) AS s)),
    counts AS (SELECT ledger_id, doc, n, feature, COUNT(*) AS tf FROM feats GROUP BY 1, 2, 3, 4),
    total AS (SELECT ledger_id, COUNT(*) AS rows FROM {merchants} GROUP BY 1),
    model AS (SELECT c.ledger_id AS ledger_id, feature, SUM(n) AS df, LN((1 + ANY_VALUE(rows)) / (1 + SUM(n))) + 1 AS idf
              FROM counts c JOIN total t ON t.ledger_id = c.ledger_id GROUP BY 1, 2 HAVING SUM(n) >= 2),
    raw AS (SELECT c.ledger_id AS ledger_id, doc, c.feature AS feature, (1 + LN(tf)) * idf AS w FROM counts c
            JOIN model m ON m.ledger_id = c.ledger_id AND m.feature = c.feature),
    vectors AS (SELECT ledger_id, doc, feature, w / SQRT(SUM(w * w) OVER (PARTITION BY ledger_id, doc, feature[1])) AS w FROM raw),
    unit AS (SELECT ledger_id, doc, feature, w / SQRT(SUM(w * w) OVER (PARTITION BY ledger_id, doc)) AS w FROM vectors),
    alike AS (SELECT a.ledger_id AS ledger_id, a.doc AS q, b.doc AS doc, SUM(a.w * b.w) AS similarity
                FROM unit a JOIN unit b ON a.ledger_id = b.ledger_id AND a.feature = b.feature GROUP BY 1, 2, 3 HAVING SUM(a.w * b.w) >= 0.6)"""


@query("document_frequency", f"WITH {GRAMS} SELECT ledger_id, feature, CAST(df AS BIGINT) AS df, ROUND(idf, 9) AS idf FROM model")
def document_frequency(spark, sf):
    docs = features.documents(star.frame(spark, sf, "merchants"))
    return features.tfidf_fit(docs).withColumn("idf", F.round("idf", 9))


@query("tfidf_vectors", f"WITH {GRAMS} SELECT ledger_id, doc, feature, ROUND(w, 7) AS weight FROM vectors")
def tfidf_vectors(spark, sf):
    docs = features.documents(star.frame(spark, sf, "merchants"))
    counts = features.term_counts(docs)
    rows = features.tfidf_transform(counts, features.tfidf_fit(docs, counts))
    return rows.select("ledger_id", "doc", "feature", F.round("weight", 7).alias("weight"))


@query("similar_merchants", f"""
    WITH {GRAMS}
    SELECT s.ledger_id AS ledger_id, a.norm AS norm, b.norm AS match_norm, ROUND(similarity, 7) AS similarity FROM alike s
    JOIN docs a ON a.ledger_id = s.ledger_id AND a.doc = s.q JOIN docs b ON b.ledger_id = s.ledger_id AND b.doc = s.doc WHERE s.q <> s.doc""")
def similar_merchants(spark, sf):
    found = features.similar_merchants(star.frame(spark, sf, "merchants"))
    return found.withColumn("similarity", F.round("similarity", 7))


@query("similar_transactions", f"""
    WITH {GRAMS},
    lists AS (SELECT q.ledger_id AS ledger_id, q.id AS query_id, c.id AS id, ROUND(similarity, 7) AS similarity
              FROM alike s JOIN docs a ON a.ledger_id = s.ledger_id AND a.doc = s.q JOIN docs b ON b.ledger_id = s.ledger_id AND b.doc = s.doc
              JOIN {{merchants}} q ON q.ledger_id = a.ledger_id AND q.norm = a.norm JOIN {{merchants}} c ON c.ledger_id = b.ledger_id AND c.norm = b.norm
              WHERE q.id <> c.id)
    SELECT ledger_id, query_id, id, similarity, CAST(ROW_NUMBER() OVER (PARTITION BY ledger_id, query_id ORDER BY similarity DESC, id) AS INTEGER) AS place
    FROM lists""")
def similar_transactions(spark, sf):
    """Every transaction is looked up, and all its look-alikes are listed."""
    rows = star.frame(spark, sf, "merchants")
    # Rounded like the other side, so that equal similarities tie by id on both.
    return features.similar_transactions(rows, rows, top=None, digits=7)


def _labelled(spark, sf):
    """Orders with their merchant key; urgent and high ones are confirmed examples."""
    books = star.books(spark, sf)
    keyed = lambda df: df.withColumn("norm", normalise_merchant("description"))
    examples = keyed(views.confirmed_category_examples(books.transactions, books.enrichments)).drop("description")
    open_rows = views.uncategorised(views.wide_view(books), books.enrichments, books.transfers)
    return keyed(open_rows).select("ledger_id", "id", "norm", "amount_cents", "date"), examples


# Merchant keys of the orders written out, and which tier finds a row among examples ``known``.
KEYED = """
    keyed AS (SELECT w.ledger_id AS ledger_id, w.id AS id, w.account_id AS account_id, w.date AS date, t.amount_cents AS amount_cents,
                     segment, priority, LOWER(segment || ' ' || regexp_replace(priority, '^[0-9]-', '')) AS norm
              FROM {orders_wide} w JOIN {transactions} t ON t.ledger_id = w.ledger_id AND t.id = w.id)"""
TIER = """CASE WHEN EXISTS (SELECT 1 FROM known h WHERE h.ledger_id = q.ledger_id AND h.norm = q.norm
                              AND h.amount_cents = q.amount_cents AND h.date < q.date) THEN 'exact'
                  WHEN EXISTS (SELECT 1 FROM known h WHERE h.ledger_id = q.ledger_id AND h.norm = q.norm AND h.date < q.date) THEN 'recurring'
                  ELSE 'model' END"""


@query("classify_cascade", f"""
    WITH {KEYED},
         known AS (SELECT k.* FROM keyed k JOIN {{enrichments}} e ON e.ledger_id = k.ledger_id AND e.transaction_id = k.id
                   WHERE e.category_confirmed AND e.category_id IS NOT NULL),
         unfiled AS (SELECT v.*, {TIER.replace("q.", "v.")} AS source
                  FROM keyed v JOIN {{accounts}} a ON a.ledger_id = v.ledger_id AND a.account_id = v.account_id
                  WHERE a.deleted_at IS NULL
                    AND NOT EXISTS (SELECT 1 FROM {{enrichments}} e WHERE e.ledger_id = v.ledger_id AND e.transaction_id = v.id AND e.category_id IS NOT NULL)
                    AND NOT EXISTS (SELECT 1 FROM {{transfers}} t WHERE t.ledger_id = v.ledger_id AND v.id IN (t.from_transaction_id, t.to_transaction_id)))
    SELECT ledger_id, id, CAST(ASCII(segment) AS BIGINT) AS category_id, source, source = 'model' AS by_lead FROM unfiled""")
def classify_cascade(spark, sf):
    """Every open order is recognised by its segment, which its description names.

    Confidences of the model lie between 0.5 and 0.9, by its lead.
    """
    inputs, examples = _labelled(spark, sf)
    by_lead = (F.col("confidence") > 0.5) & (F.col("confidence") < 0.9)
    return plan.classify_cascade(inputs, examples).select("ledger_id", "id", "category_id", "source", by_lead.alias("by_lead"))


@query("predict_linear", f"""
    WITH {GRAMS},
    labelled AS (SELECT d.ledger_id AS ledger_id, d.doc AS doc, CAST(p_size % 7 AS BIGINT) AS class FROM docs d JOIN {{part}} ON p_partkey = d.doc),
    members AS (SELECT ledger_id, class, COUNT(*) AS n FROM labelled GROUP BY 1, 2),
    centres AS (SELECT u.ledger_id AS ledger_id, l.class AS class, u.feature AS feature, SUM(u.w) / ANY_VALUE(m.n) AS c
                FROM unit u JOIN labelled l ON l.ledger_id = u.ledger_id AND l.doc = u.doc
                JOIN members m ON m.ledger_id = l.ledger_id AND m.class = l.class GROUP BY 1, 2, 3),
    biases AS (SELECT ledger_id, class, -SUM(c * c) / 2 AS b FROM centres GROUP BY 1, 2),
    products AS (SELECT u.ledger_id AS ledger_id, u.doc AS doc, c.class AS class, SUM(u.w * c.c) AS s
                 FROM unit u JOIN centres c ON c.ledger_id = u.ledger_id AND c.feature = u.feature GROUP BY 1, 2, 3),
    scores AS (SELECT d.ledger_id AS ledger_id, d.doc AS doc, b.class AS class, ROUND(b.b + COALESCE(p.s, 0), 9) AS score
               FROM docs d JOIN biases b ON b.ledger_id = d.ledger_id
               LEFT JOIN products p ON p.ledger_id = d.ledger_id AND p.doc = d.doc AND p.class = b.class),
    placed AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ledger_id, doc ORDER BY score DESC, class) AS place FROM scores),
    two AS (SELECT ledger_id, doc, MAX(class) FILTER (place = 1) AS category_id, MAX(score) FILTER (place = 1) AS first, MAX(score) FILTER (place = 2) AS second
            FROM placed GROUP BY 1, 2)
    SELECT ledger_id, doc, category_id, ROUND(0.5 + 0.4 * (2 / (1 + EXP(-COALESCE(first - second, ABS(first)))) - 1), 6) AS confidence FROM two""")
def predict(spark, sf):
    """Merchants by the nearest mean vector of a size class: w is the mean, b half its squared length."""
    docs, vectors = features.similarity_vectors(star.frame(spark, sf, "merchants"))
    classes = star.frame(spark, sf, "part").select(F.col("p_partkey").alias("doc"), (F.col("p_size") % 7).cast("bigint").alias("class"))
    labelled = docs.select("ledger_id", "doc").join(classes, "doc")
    members = labelled.groupBy("ledger_id", "class").agg(F.count(F.lit(1)).alias("n"))
    centres = (
        vectors.join(labelled, ["ledger_id", "doc"]).groupBy("ledger_id", "class", "feature").agg(F.sum("weight").alias("_s"))
        .join(members, ["ledger_id", "class"]).select("ledger_id", "class", "feature", (F.col("_s") / F.col("n")).alias("weight"))
    )
    biases = centres.groupBy("ledger_id", "class").agg((-F.sum(F.col("weight") * F.col("weight")) / 2).alias("weight"))
    model = centres.unionByName(biases.withColumn("feature", F.lit("")))
    found = predict_linear(docs, vectors.select("ledger_id", "doc", "feature", "weight"), model)
    return found.withColumn("confidence", F.round("confidence", 6))


@query("train_linear")
def train_model(spark, sf):
    """Weights of the five segments per ledger."""
    _, examples = _labelled(spark, sf)
    docs = features.documents(examples)
    counts = cut_lineage(features.term_counts(docs))
    vectors = features.tfidf_transform(counts, features.tfidf_fit(docs, counts))
    rows = examples.join(docs.drop("n"), ["ledger_id", "norm"])
    return train_linear(rows.select("ledger_id", "id", "doc", "category_id"), vectors)


@query("evaluate", f"""
    WITH {KEYED},
         known AS (SELECT * FROM keyed WHERE priority IN ('1-URGENT', '2-HIGH')),
         tiers AS (SELECT ledger_id, {TIER} AS source FROM keyed q WHERE priority NOT IN ('1-URGENT', '2-HIGH'))
    SELECT ledger_id, CAST(COUNT(*) AS BIGINT) AS rows, CAST(1.0 AS DOUBLE) AS accuracy, CAST(COUNT(*) FILTER (source = 'exact') AS BIGINT) AS exact,
           CAST(COUNT(*) FILTER (source = 'recurring') AS BIGINT) AS recurring, CAST(COUNT(*) FILTER (source = 'model') AS BIGINT) AS model,
           CAST(0 AS BIGINT) AS unclassified
    FROM tiers GROUP BY 1""")
def evaluate(spark, sf):
    """Trained on confirmed orders, tested on all others."""
    made: dict = {}
    rows = star.frame(spark, sf, "transactions", made).join(
        star.frame(spark, sf, "orders_wide", made).select(
            "ledger_id", "id", "priority", F.ascii("segment").cast("bigint").alias("category_id")
        ),
        ["ledger_id", "id"],
    ).select("ledger_id", "id", "description", "amount_cents", "date", "category_id", "priority")
    confirmed = F.col("priority").isin("1-URGENT", "2-HIGH")
    scored = plan.evaluate(rows.filter(confirmed).drop("priority"), rows.filter(~confirmed).drop("priority"))
    return scored


@query("evaluate_documents")
def evaluate_documents(spark, sf):
    """Quality of labelled documents from their whole texts; odd sources train, even ones test."""
    docs = star.frame(spark, sf, "documents").join(star.frame(spark, sf, "labels"), "doc_id")
    rows = docs.select(
        F.col("lang").alias("ledger_id"), F.col("doc_id").alias("id"), F.col("text").alias("description"),
        F.col("n_chars").alias("amount_cents"), F.lit("2024-01-01").cast("date").alias("date"),
        F.col("quality").cast("bigint").alias("category_id"),
        F.col("source").rlike("[13579]$").alias("_train"),
    )
    return plan.evaluate(rows.filter("_train").drop("_train"), rows.filter("not _train").drop("_train"))


@query("apply_to_similar", f"""
    WITH {KEYED},
         asked AS (SELECT * FROM keyed WHERE ledger_id = '0' ORDER BY id LIMIT 1),
         legs AS (SELECT from_transaction_id AS id FROM {{transfers}} WHERE ledger_id = '0' UNION SELECT to_transaction_id FROM {{transfers}} WHERE ledger_id = '0'),
         filed AS (SELECT transaction_id AS id FROM {{enrichments}} WHERE ledger_id = '0' AND category_id IS NOT NULL AND category_confirmed),
         pool AS (SELECT k.* FROM keyed k JOIN {{accounts}} a ON a.ledger_id = k.ledger_id AND a.account_id = k.account_id
                  WHERE k.ledger_id = '0' AND a.deleted_at IS NULL AND k.id NOT IN (SELECT id FROM filed) AND k.id NOT IN (SELECT id FROM legs)),
         corpus AS (SELECT ledger_id, id, norm FROM pool UNION ALL SELECT ledger_id, id, norm FROM keyed WHERE ledger_id = '0' AND id IN (SELECT id FROM filed)),
         {GRAMS.replace("{merchants}", "corpus")},
         listed AS (SELECT c.id AS id, c.date AS date, similarity, ROW_NUMBER() OVER (ORDER BY ROUND(similarity, 9) DESC, c.id) AS place
                    FROM asked q JOIN docs a ON a.norm = q.norm JOIN alike s ON s.q = a.doc JOIN docs b ON b.doc = s.doc JOIN pool c ON c.norm = b.norm
                    WHERE c.id <> q.id)
    SELECT id, ROUND(similarity, 7) AS similarity, NULL::BIGINT AS category_id FROM listed WHERE place <= 200
    UNION ALL SELECT id, NULL, 66 FROM asked""")
def apply_to_similar(spark, sf):
    """The first order of a ledger is filed by hand, and its 200 most similar unconfirmed orders are offered."""
    books = star.books(spark, sf)
    first = books.transactions.filter("ledger_id = '0'").agg(F.min("id")).first()[0]
    enrichments, offer = plan.apply_to_similar(_stored(books), "0", first, 66, AT, top=200)
    filed = enrichments.filter((F.col("ledger_id") == "0") & (F.col("transaction_id") == first))
    offered = offer.select("id", F.round("similarity", 7).alias("similarity"), F.lit(None).cast("bigint").alias("category_id"))
    return offered.unionByName(filed.select(F.col("transaction_id").alias("id"), F.lit(None).cast("double").alias("similarity"), "category_id"))


@query("classify_orders", f"""
    WITH {STATE}, {ONCE}, {KEYED},
         -- No two opposite orders of two accounts share a day; a group that did would show here.
         pairs AS (SELECT ledger_id, date, ABS(amount_cents) AS size FROM keyed GROUP BY 1, 2, 3
                   HAVING COUNT(*) FILTER (amount_cents < 0) > 0 AND COUNT(*) FILTER (amount_cents > 0) > 0 AND COUNT(DISTINCT account_id) > 1),
         prior AS (SELECT * FROM {{enrichments}} WHERE category_source = 'rule' AND category_id IS NOT NULL),
         changed AS (SELECT w.ledger_id AS ledger_id FROM writes w LEFT JOIN prior p ON p.ledger_id = w.ledger_id AND p.transaction_id = w.id
                     WHERE p.category_id IS NULL OR p.category_id <> w.new_category),
         known AS (SELECT k.* FROM keyed k JOIN once e ON e.ledger_id = k.ledger_id AND e.transaction_id = k.id
                   WHERE e.category_confirmed AND e.category_id IS NOT NULL),
         unfiled AS (SELECT v.* FROM keyed v JOIN {{accounts}} a ON a.ledger_id = v.ledger_id AND a.account_id = v.account_id
                  WHERE a.deleted_at IS NULL
                    AND NOT EXISTS (SELECT 1 FROM once e WHERE e.ledger_id = v.ledger_id AND e.transaction_id = v.id AND e.category_id IS NOT NULL)
                    AND NOT EXISTS (SELECT 1 FROM {{transfers}} t WHERE t.ledger_id = v.ledger_id AND v.id IN (t.from_transaction_id, t.to_transaction_id))),
         outcomes AS (SELECT ledger_id, {TIER} AS source FROM unfiled q UNION ALL SELECT ledger_id, 'filtered' FROM changed
                      UNION ALL SELECT ledger_id, 'transfers' FROM pairs)
    SELECT ledger_id, source, CAST(COUNT(*) AS BIGINT) AS rows FROM outcomes GROUP BY 1, 2""")
def classify_orders(spark, sf):
    """A whole run over the order ledgers: transfers, rules, suggestions."""
    rules = spark.sql(RULES, nation=star.frame(spark, sf, "nation"), region=star.frame(spark, sf, "region"))
    return plan.classify(_stored(star.books(spark, sf, rules, star.SHARED)), AT).report


def _stored(books: Books) -> Books:
    """Derived tables written once, as a ledger would keep them."""
    names = ("transactions", "enrichments", "transfers", "accounts", "banks")
    return books.with_tables(**{n: cut_lineage(getattr(books, n)) for n in names})


@query("classify_events", f"""
    WITH RECURSIVE {UNFILED_PAIRS}, {TAKEN},
         used AS (SELECT ledger_id, d AS id FROM taken UNION ALL SELECT ledger_id, c FROM taken),
         outcomes AS (SELECT ledger_id, 'transfers' AS source FROM taken
                      UNION ALL SELECT ledger_id, 'unclassified' FROM tx t WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.ledger_id = t.ledger_id AND u.id = t.id))
    SELECT ledger_id, source, CAST(COUNT(*) AS BIGINT) AS rows FROM outcomes GROUP BY 1, 2""")
def classify_events(spark, sf):
    """A whole run over the event ledgers, where transfers dominate."""
    made: dict = {}
    names = {"transactions": "tx_events", "accounts": "event_accounts", "banks": "event_banks", "transfers": "event_links"}
    base = star.books(spark, sf)
    labelled = star.frame(spark, sf, "labelled_events", made)
    enrichments = labelled.filter("norm = 'signup'").select(
        "ledger_id", F.col("id").alias("transaction_id"), "category_id", F.lit("manual").alias("category_source"),
        F.lit(True).alias("category_confirmed"), F.lit(None).cast("double").alias("ai_confidence"),
        F.lit(AT).cast("timestamp").alias("created_at"), F.lit(AT).cast("timestamp").alias("updated_at"),
    )
    books: Books = base.with_tables(
        **{k: star.frame(spark, sf, v, made) for k, v in names.items()}, enrichments=enrichments
    )
    return plan.classify(_stored(books), AT).report
