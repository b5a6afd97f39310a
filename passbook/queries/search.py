"""Search predicates, order, limits and reports over the order ledgers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from passbook.functions import money, periods, text
from passbook.operators import aggregates, predicates as p, search, views
from passbook.queries import query
from passbook.sources import star

TODAY = periods.Calendar(date(1998, 8, 12))

LIVE = """(SELECT t.*, a.name AS account_name, b.name AS bank_name
           FROM {transactions} t
           JOIN {accounts} a ON t.ledger_id = a.ledger_id AND t.account_id = a.account_id
           JOIN {banks} b ON a.ledger_id = b.ledger_id AND a.bank_id = b.bank_id
           WHERE a.deleted_at IS NULL)"""
ENRICHED = f"""(SELECT v.*, e.category_id, c.path AS category_path, e.category_source, e.category_confirmed, e.ai_confidence
           FROM {LIVE} v
           LEFT JOIN {{enrichments}} e ON v.ledger_id = e.ledger_id AND v.id = e.transaction_id
           LEFT JOIN {{categories}} c ON e.ledger_id = c.ledger_id AND e.category_id = c.category_id)"""

BRIEF = ["ledger_id", "id", "date", "amount_cents"]
BRIEF_SQL = "ledger_id, id, date, amount_cents"


def _brief(df):
    return df.select(*BRIEF)


def _found(spark, sf, *preds):
    """All matches, unordered: the order of a whole result is not compared."""
    books = star.books(spark, sf)
    needs = set().union(*(q.needs for q in preds))
    return _brief(search.where(views.live(views.wide_view(books, needs)), preds, "error"))


def _registered(name: str, source: str, where: str, *preds) -> None:
    query(name, f"SELECT {BRIEF_SQL} FROM {source} WHERE {where}")(
        lambda spark, sf, preds=preds: _found(spark, sf, *preds)
    )


for _name, _source, _where, _preds in [
    ("date_year", LIVE, "date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'", [p.date_is("1997")]),
    ("date_month", LIVE, "date BETWEEN DATE '1996-02-01' AND DATE '1996-02-29'", [p.date_is("1996-2")]),
    ("date_day", LIVE, "date = DATE '1998-03-09'", [p.date_is("1998-03-9")]),
    ("date_span", LIVE, "date BETWEEN DATE '1996-02-01' AND DATE '1998-06-30'", [p.date_range("1996-02", "1998-6")]),
    ("date_open_end", LIVE, "date >= DATE '2000-01-01'", [p.date_range("2000", "")]),
    ("date_last_quarter", LIVE, "date BETWEEN DATE '1998-04-01' AND DATE '1998-06-30'", [p.date_preset("last-quarter", TODAY)]),
    ("date_this_week", LIVE, "date BETWEEN DATE '1998-08-10' AND DATE '1998-08-16'", [p.date_preset("this-week", TODAY)]),
    ("date_last_3_months", LIVE, "date BETWEEN DATE '1998-05-01' AND DATE '1998-07-31'", [p.date_last_n(3, "months", TODAY)]),
    ("date_last_2_financial_years", LIVE, "date BETWEEN DATE '1996-07-01' AND DATE '1998-06-30'", [p.date_last_n(2, "financial-years", TODAY)]),
    ("amount_above", LIVE, "amount_cents > 45000000", [p.amount_cmp(">", "450000")]),
    ("amount_size_between", LIVE, "ABS(amount_cents) BETWEEN 10000000 AND 12000050", [p.amount_range("100000", "120000.50")]),
    ("amount_up_to_zero", LIVE, "amount_cents <= 0", [p.amount_range("", "0")]),
    ("account_prefixes", LIVE, "LOWER(bank_name) LIKE 'nation^_1%' ESCAPE '^' OR LOWER(bank_name) LIKE 'nation^_2%' ESCAPE '^' AND LOWER(account_name) LIKE 'customer#00000001%' OR LOWER(account_name) LIKE 'customer#00000000%'", [p.account_matches("NATION_1|Nation_2/customer#00000001|/CUSTOMER#00000000")]),
    ("category_prefix_or_segment", ENRICHED, "LOWER(category_path) LIKE 'segment/b%' OR LOWER(category_path) LIKE '%/ma%'", [p.category_matches("Segment/B|/ma")]),
    ("category_not", ENRICHED, "NOT COALESCE(LOWER(category_path) LIKE 'segment%', FALSE)", [p.negate(p.category_matches("Segment"))]),
    ("confidence_below", ENRICHED, "ai_confidence < 0.6", [p.confidence_is("<60")]),
    ("confidence_between", ENRICHED, "ai_confidence >= 0.4 AND ai_confidence <= 0.6", [p.confidence_is("40%..60")]),
    ("confidence_bucket", ENRICHED, "ai_confidence >= 0.845 AND ai_confidence < 0.855", [p.confidence_is("85")]),
    ("confidence_none", ENRICHED, "ai_confidence IS NULL", [p.confidence_present(False)]),
    ("description_regex", LIVE, "regexp_matches(description, '(?i)building.*(urgent|low)')", [p.description_matches("building.*(urgent|low)", True)]),
    ("description_not_regex", LIVE, "NOT regexp_matches(description, 'M[AE]')", [p.negate(p.description_matches("M[AE]"))]),
    ("description_java_class", LIVE, "regexp_matches(description, '^\\p{Lu}+ .*URGENT')", [p.description_matches(r"^\p{Lu}+ .*URGENT\b")]),
    ("description_flags", LIVE, "regexp_matches(description, '(?i)machinery 1-u')", [p.term("regex", "/machinery 1-u/i")]),
    ("description_bad_regex", LIVE, "amount_cents > 30000000", [p.description_matches("("), p.negate(p.description_matches("a{")), p.amount_cmp(">", "300000")]),
    ("all_terms", ENRICHED, "date >= DATE '1997-01-01' AND ABS(amount_cents) >= 20000000 AND LOWER(bank_name) LIKE 'nation%' AND NOT COALESCE(LOWER(category_path) LIKE 'status%', FALSE)", [p.date_range("1997", ""), p.amount_range("200000", ""), p.account_matches("nation"), p.negate(p.term("c", "Status"))]),
]:
    _registered(_name, _source, _where, *_preds)


def _amounts(spark, sf, sign: int, decimals: int) -> list[str]:
    """Amounts to look for: those of the three smallest live ids of each sign, as typed text."""
    rows = star.books(spark, sf).transactions.filter(F.signum("amount_cents") == sign).orderBy("id").limit(3)
    cents = [r["amount_cents"] for r in rows.select("amount_cents").collect()]
    text = [f"{'-' if c < 0 else ''}{abs(c) // 100}.{abs(c) % 100:02d}" for c in cents]
    return [t[: len(t) - (3 if decimals == 0 else 2 - decimals)] for t in text]


@query("amount_bucket", f"""
    WITH wanted AS (SELECT amount_cents // 100 AS bucket FROM {{transactions}} WHERE amount_cents > 0 ORDER BY id LIMIT 3)
    SELECT {BRIEF_SQL} FROM {LIVE} WHERE ABS(amount_cents) // 100 IN (SELECT bucket FROM wanted)""")
def amount_bucket(spark, sf):
    """Whole amounts match either sign."""
    return _found(spark, sf, p.any_of([p.amount_is(a) for a in _amounts(spark, sf, 1, 0)]))


@query("amount_debit_bucket", f"""
    WITH wanted AS (SELECT -amount_cents // 10 AS bucket FROM {{transactions}} WHERE amount_cents < 0 ORDER BY id LIMIT 3)
    SELECT {BRIEF_SQL} FROM {LIVE} WHERE amount_cents < 0 AND -amount_cents // 10 IN (SELECT bucket FROM wanted)""")
def amount_debit_bucket(spark, sf):
    """A sign and one decimal match debits in steps of ten cents."""
    return _found(spark, sf, p.any_of([p.amount_is(a) for a in _amounts(spark, sf, -1, 1)]))


FLAGSHIP = f"""
    SELECT ledger_id, id, date, bank_name, account_name, description, amount_cents
    FROM {LIVE}
    WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND amount_cents > 100000
      AND NOT bank_name LIKE 'NATION^_1%' ESCAPE '^'
    QUALIFY ROW_NUMBER() OVER (PARTITION BY ledger_id ORDER BY amount_cents DESC, id DESC) <= 100"""


@query("search_top", FLAGSHIP)
def search_top(spark, sf):
    preds = [p.date_is("1997"), p.amount_cmp(">", "1000"), p.negate(p.account_matches("NATION_1"))]
    found = search.search(star.books(spark, sf), preds, sort="-amount", limit=100)
    return found.select("ledger_id", "id", "date", "bank_name", "account_name", "description", "amount_cents")


@query("sort_category", f"""
    SELECT ledger_id, id, category_path, ai_confidence FROM {ENRICHED}
    QUALIFY ROW_NUMBER() OVER (PARTITION BY ledger_id ORDER BY category_path DESC NULLS LAST, ai_confidence ASC NULLS LAST, id DESC) <= 500""")
def sort_category(spark, sf):
    found = search.search(star.books(spark, sf), sort="-category,confidence", limit=500)
    return found.select("ledger_id", "id", "category_path", "ai_confidence")


@query("newest_first", f"SELECT {BRIEF_SQL} FROM {LIVE} QUALIFY ROW_NUMBER() OVER (PARTITION BY ledger_id ORDER BY date DESC, id DESC) <= 50")
def newest_first(spark, sf):
    return _brief(search.search(star.books(spark, sf), limit=50))


TAGS = """(SELECT tt.ledger_id, tt.transaction_id, g.name FROM {transaction_tags} tt
           JOIN {tags} g ON tt.ledger_id = g.ledger_id AND tt.tag_id = g.tag_id)"""


@query("tag_under", f"""
    SELECT {BRIEF_SQL} FROM {LIVE} v
    WHERE EXISTS (SELECT 1 FROM {TAGS} g WHERE g.ledger_id = v.ledger_id AND g.transaction_id = v.id
                  AND (g.name = 'ship' OR g.name LIKE 'ship/%' OR g.name = 'flag/a'))""")
def tag_under(spark, sf):
    return _found(spark, sf, p.has_tag("#Ship|flag/A"))


@query("untagged", f"""
    SELECT {BRIEF_SQL} FROM {LIVE} v
    WHERE NOT EXISTS (SELECT 1 FROM {{transaction_tags}} g WHERE g.ledger_id = v.ledger_id AND g.transaction_id = v.id)""")
def untagged(spark, sf):
    return _found(spark, sf, p.tagged(False))


@query("note_text", f"""
    SELECT {BRIEF_SQL} FROM {LIVE} v
    WHERE EXISTS (SELECT 1 FROM {{notes}} n WHERE n.ledger_id = v.ledger_id AND n.transaction_id = v.id
                  AND CONTAINS(LOWER(n.note), 'the'))""")
def note_text(spark, sf):
    return _found(spark, sf, p.note_contains("T%he"))


@query("noted", f"""
    SELECT {BRIEF_SQL} FROM {LIVE} v
    WHERE EXISTS (SELECT 1 FROM {{notes}} n WHERE n.ledger_id = v.ledger_id AND n.transaction_id = v.id)""")
def noted(spark, sf):
    return _found(spark, sf, p.noted(True))


@query("fuzzy_description", f"""
    SELECT {BRIEF_SQL} FROM {LIVE}
    WHERE regexp_matches(description, '(?is)b.*d.*g') AND regexp_matches(description, '(?is)u.*t')""")
def fuzzy_description(spark, sf):
    rows = views.live(views.wide_view(star.books(spark, sf)))
    return _brief(search.fuzzy_filter(rows, ["description"], "bdg ut"))


@query("boundary_prefix", """
    SELECT ledger_id, category_id, path FROM {categories}
    WHERE regexp_matches(LOWER(path), '(^|[^a-z0-9])ma')""")
def boundary_prefix(spark, sf):
    rows = star.frame(spark, sf, "categories")
    return rows.filter(p.boundary_prefix("path", "Ma")).select("ledger_id", "category_id", "path")


@query("find_categories", """
    WITH letters AS (SELECT ledger_id, category_id, path, i, LOWER(path[i]) AS c,
                            CASE WHEN i = 1 OR NOT regexp_matches(path[i - 1], '[\\p{{L}}\\p{{N}}]') AND regexp_matches(path[i], '[\\p{{L}}\\p{{N}}]') THEN 8
                                 WHEN regexp_matches(path[i - 1], '\\p{{Ll}}') AND regexp_matches(path[i], '\\p{{Lu}}') THEN 7 ELSE 0 END AS b
                     FROM (SELECT ledger_id, category_id, path, unnest(range(1, length(path) + 1)) AS i FROM {categories})),
         -- Every way to find the three letters in order.
         ways AS (SELECT s.ledger_id AS ledger_id, s.category_id AS category_id, s.path AS path,
                    48 + 2 * s.b + CASE WHEN m.i = s.i + 1 THEN GREATEST(m.b, 4) ELSE m.b - 3 - (m.i - s.i - 2) END
                      + CASE WHEN u.i = m.i + 1 THEN GREATEST(u.b, 4) ELSE u.b - 3 - (u.i - m.i - 2) END AS score
                  FROM letters s JOIN letters m ON m.ledger_id = s.ledger_id AND m.category_id = s.category_id AND m.i > s.i
                  JOIN letters u ON u.ledger_id = s.ledger_id AND u.category_id = s.category_id AND u.i > m.i
                  WHERE s.c = 's' AND m.c = 'm' AND u.c = 'u')
    SELECT ledger_id, category_id, path, CAST(MAX(score) AS INTEGER) AS score,
           CAST(ROW_NUMBER() OVER (PARTITION BY ledger_id ORDER BY MAX(score) DESC, length(path), path) AS INTEGER) AS place
    FROM ways GROUP BY 1, 2, 3""")
def find_categories(spark, sf):
    found = search.find_categories(star.frame(spark, sf, "categories"), "smu")
    return found.select("ledger_id", "category_id", "path", "score", "place")


@query("either_side", f"""
    SELECT tr.ledger_id AS ledger_id, tr.id AS id FROM {{transfers}} tr
    JOIN {LIVE} f ON tr.ledger_id = f.ledger_id AND tr.from_transaction_id = f.id
    JOIN {LIVE} t ON tr.ledger_id = t.ledger_id AND tr.to_transaction_id = t.id
    WHERE f.date >= DATE '1997-01-01' AND f.amount_cents > 20000000
       OR t.date >= DATE '1997-01-01' AND t.amount_cents > 20000000""")
def either_side(spark, sf):
    books = star.books(spark, sf)
    links = views.transfers_with_legs(views.wide_view(books), books.transfers, False)
    preds = [
        p.date_range("1997", ""), p.amount_cmp(">", "200000"), p.category_matches("Food"),
        p.negate(p.account_matches("NATION")),
    ]
    return search.either_side(links, preds).select("ledger_id", "id")


@query("financial_year_totals", """
    SELECT ledger_id, CAST(EXTRACT(YEAR FROM date) AS INTEGER)
             + CASE WHEN date > MAKE_DATE(CAST(EXTRACT(YEAR FROM date) AS BIGINT), 6, 30) THEN 1 ELSE 0 END AS fy,
           CAST(SUM(amount_cents) AS BIGINT) AS total_cents
    FROM {transactions} GROUP BY 1, 2""")
def financial_year_totals(spark, sf):
    rows = star.frame(spark, sf, "transactions")
    return rows.groupBy("ledger_id", periods.financial_year("date").alias("fy")).agg(
        F.sum("amount_cents").alias("total_cents")
    )


@query("formatted_values", """
    SELECT v.ledger_id AS ledger_id, v.id AS id,
           CASE WHEN amount_cents < 0 THEN '-' ELSE '' END || '$' || CAST(ABS(amount_cents) // 100 AS STRING) || '.'
             || LPAD(CAST(ABS(amount_cents) % 100 AS STRING), 2, '0') AS amount,
           CAST(CAST(ROUND(ai_confidence * 100) AS BIGINT) AS STRING) || '%' AS confidence
    FROM {transactions} v LEFT JOIN {enrichments} e ON v.ledger_id = e.ledger_id AND v.id = e.transaction_id""")
def formatted_values(spark, sf):
    books = star.books(spark, sf)
    rows = views.attach(books.transactions, books.enrichments, ["ai_confidence"])
    return rows.select(
        "ledger_id", "id", money.format_cents("amount_cents", "$").alias("amount"),
        money.confidence_percent("ai_confidence").alias("confidence"),
    )


@query("parsed_cents", """
    SELECT l_orderkey AS id, l_linenumber AS line,
           CASE WHEN regexp_matches(v, '^[+-]?[0-9]+(\\.[0-9]{0,2})?$')
                THEN CAST(CAST(v AS DECIMAL(20,2)) * 100 AS BIGINT) END AS cents
    FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN '-' WHEN l_returnflag = 'R' THEN '+' ELSE '' END
            || CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS STRING)
            || CASE WHEN l_linestatus = 'O' THEN '' WHEN l_linenumber = 1 THEN '.5' WHEN l_linenumber = 2 THEN '.05'
                    WHEN l_linenumber = 3 THEN '.' ELSE '.125' END AS v
          FROM {lineitem})""")
def parsed_cents(spark, sf):
    sign = F.when(F.col("l_returnflag") == "A", "-").when(F.col("l_returnflag") == "R", "+").otherwise("")
    n = F.col("l_linenumber")
    tail = (
        F.when(F.col("l_linestatus") == "O", "").when(n == 1, ".5").when(n == 2, ".05").when(n == 3, ".").otherwise(".125")
    )
    value = F.concat(sign, F.floor("l_extendedprice").cast("string"), tail)
    return star.frame(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), n.alias("line"), money.parse_cents(value).alias("cents")
    )


_NORM = "LOWER(description)"
for _pattern in (text.CARD_NUMBER, text.REFERENCE, text.PAYMENT_WORDS, text.DIGITS, text.NON_LETTERS):
    _NORM = f"regexp_replace({_NORM}, '{_pattern}', ' ', 'g')"


@query("merchant_keys", f"""
    SELECT ledger_id, id, TRIM(regexp_replace({_NORM}, '\\s+', ' ', 'g')) AS norm
    FROM (SELECT * FROM {{transactions}}
          UNION ALL SELECT * REPLACE (-id AS id, 'Visa card ending in ' || CAST(1000 + id % 9000 AS STRING) || ' ' || description AS description)
          FROM {{transactions}})""")
def merchant_keys(spark, sf):
    """Each order as it is, and once more as a card payment."""
    rows = star.frame(spark, sf, "transactions")
    card = F.concat(F.lit("Visa card ending in "), 1000 + F.col("id") % 9000, F.lit(" "), "description")
    both = rows.unionByName(rows.withColumn("description", card).withColumn("id", -F.col("id")))
    return both.select("ledger_id", "id", text.normalise_merchant("description").alias("norm"))


@query("sum_visible", f"""
    SELECT ledger_id, CAST(SUM(amount_cents) AS BIGINT) AS sum_cents
    FROM (SELECT ledger_id, amount_cents FROM {LIVE} WHERE amount_cents < 0
          QUALIFY ROW_NUMBER() OVER (PARTITION BY ledger_id ORDER BY date DESC, id DESC) <= 500) GROUP BY ledger_id""")
def sum_visible(spark, sf):
    rows = views.live(views.wide_view(star.books(spark, sf)))
    return aggregates.sum_amount(search.where(rows, [p.amount_cmp("<", "0")]), limit=500)


@query("sum_all", f"""
    SELECT ledger_id, CAST(SUM(amount_cents) AS BIGINT) AS sum_cents FROM {LIVE} WHERE amount_cents < 0 GROUP BY ledger_id""")
def sum_all(spark, sf):
    rows = views.live(views.wide_view(star.books(spark, sf)))
    return aggregates.sum_amount(search.where(rows, [p.amount_cmp("<", "0")]))


REPORT = f"""
    SELECT v.ledger_id AS ledger_id, id, date, bank_name || '/' || account_name AS account, description,
           amount_cents, balance_cents, category_path AS category
    FROM {ENRICHED} v WHERE amount_cents < -1000000"""


@query("transactions_report", REPORT)
def transactions_report(spark, sf):
    return aggregates.transactions_report(star.books(spark, sf), [p.amount_cmp("<", "-10000")])


@query("transactions_report_top", f"""{REPORT}
    QUALIFY ROW_NUMBER() OVER (PARTITION BY v.ledger_id ORDER BY date DESC, id DESC) <= 100""")
def transactions_report_top(spark, sf):
    return aggregates.transactions_report(star.books(spark, sf), [p.amount_cmp("<", "-10000")], limit=100)


@query("lineitem_volume", """
    SELECT l_returnflag AS flag, CAST(COUNT(*) AS BIGINT) AS rows, CAST(SUM(amount_cents) AS BIGINT) AS total_cents
    FROM (SELECT l_returnflag, CAST(l_shipdate AS DATE) AS date,
                 CAST(ROUND(l_extendedprice * 100) AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS amount_cents
          FROM {lineitem})
    WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND ABS(amount_cents) BETWEEN 100000 AND 5000000
    GROUP BY 1""")
def lineitem_volume(spark, sf):
    rows = star.frame(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("flag"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.round(F.col("l_extendedprice") * 100).cast("bigint") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("amount_cents"),
    )
    found = search.where(rows, [p.date_range("1997", "1998"), p.amount_range("1000", "50000")], "error")
    return found.groupBy("flag").agg(F.count(F.lit(1)).alias("rows"), F.sum("amount_cents").alias("total_cents"))
