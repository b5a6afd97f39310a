"""Ingest over the event records, whose keys repeat; feeds and names over star tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from passbook.functions import money, periods
from passbook.functions.text import normalise_path, normalise_tag, valid_tag
from passbook.operators import ingest as ops
from passbook.queries import query
from passbook.session import checkpoint_root
from passbook.sources import feeds, star
from passbook.streaming import ingest as stream

# What was stored before: the first arrivals up to 9 January.
CUT = "2024-01-09"
FIRST = """SELECT * FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY ledger_id, account_id, hash ORDER BY seq) AS arrival FROM {records} r)
           WHERE arrival = 1"""


def _split(spark, sf):
    """(existing transactions, incoming records): the first days are stored, everything comes again."""
    records = star.frame(spark, sf, "records")
    early = records.filter(F.col("date") <= F.lit(CUT).cast("date"))
    empty = spark.createDataFrame([], records.schema).withColumn("id", F.lit(0).cast("bigint"))
    return ops.dedup_insert(empty.select(*ops.TX), early), records


@query("first_arrivals", f"SELECT ledger_id, account_id, hash, seq, description, amount_cents FROM ({FIRST})")
def first_arrivals(spark, sf):
    rows = ops.first_arrivals(star.frame(spark, sf, "records"))
    return rows.select("ledger_id", "account_id", "hash", "seq", "description", "amount_cents")


@query("dedup_insert", f"""
    WITH firsts AS ({FIRST}),
         old AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ledger_id ORDER BY seq) AS id FROM firsts WHERE date <= DATE '{CUT}'),
         top AS (SELECT ledger_id, MAX(id) AS top FROM old GROUP BY 1)
    SELECT f.ledger_id AS ledger_id, top + ROW_NUMBER() OVER (PARTITION BY f.ledger_id ORDER BY f.seq) AS id,
           f.account_id AS account_id, f.hash AS hash, f.amount_cents AS amount_cents
    FROM firsts f JOIN top ON top.ledger_id = f.ledger_id WHERE f.date > DATE '{CUT}'""")
def dedup_insert(spark, sf):
    return ops.dedup_insert(*_split(spark, sf)).select("ledger_id", "id", "account_id", "hash", "amount_cents")


PARTS = """SELECT r.*, TRIM(description) <> '' AS filled,
                  regexp_extract(metadata, '"k": ([0-9]+)', 1) AS k, CONTAINS(metadata, 'big') AS big FROM {records} r"""


@query("ingest", f"""
    WITH parts AS ({PARTS}), firsts AS ({FIRST}),
         newest AS (SELECT ledger_id, account_id, hash, arg_max(description, seq) FILTER (filled) AS text,
                           arg_max(k, seq) AS k, bool_or(big) AS big FROM parts GROUP BY 1, 2, 3)
    SELECT f.ledger_id AS ledger_id, f.account_id AS account_id, f.hash AS hash, f.date AS date,
           COALESCE(n.text, f.description) AS description,
           CASE WHEN regexp_extract(f.metadata, '"k": ([0-9]+)', 1) = n.k AND CONTAINS(f.metadata, 'big') = n.big THEN f.metadata
                ELSE '{{{{"k":' || n.k || CASE WHEN n.big THEN ',"size":"big"' ELSE '' END || '}}}}' END AS metadata
    FROM firsts f JOIN newest n ON f.ledger_id = n.ledger_id AND f.account_id = n.account_id AND f.hash = n.hash""")
def ingest(spark, sf):
    rows = ops.ingest(*_split(spark, sf))
    return rows.select("ledger_id", "account_id", "hash", "date", "description", "metadata")


def _outcomes(stored: str) -> str:
    """Records per outcome; rows of ``stored`` (seq -1) are the state before."""
    return f"""
    WITH parts AS ({PARTS}{stored}),
         line AS (SELECT *, ROW_NUMBER() OVER w AS arrival,
                         LAST_VALUE(CASE WHEN filled THEN description END IGNORE NULLS) OVER before AS last_text,
                         FIRST_VALUE(description) OVER w AS first_text,
                         LAG(k) OVER w AS last_k, MAX(CASE WHEN big THEN 1 ELSE 0 END) OVER before AS was_big
                  FROM parts
                  WINDOW w AS (PARTITION BY ledger_id, account_id, hash ORDER BY seq),
                         before AS (PARTITION BY ledger_id, account_id, hash ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT CASE WHEN arrival = 1 THEN 'added'
                WHEN filled AND description <> COALESCE(last_text, first_text) OR k <> last_k OR big AND was_big = 0 THEN 'updated'
                ELSE 'unchanged' END AS outcome, CAST(COUNT(*) AS BIGINT) AS records
    FROM line WHERE seq >= 0 GROUP BY 1"""


@query("ingest_report", _outcomes(""))
def ingest_report(spark, sf):
    records = star.frame(spark, sf, "records")
    empty = spark.createDataFrame([], records.schema).withColumn("id", F.lit(0).cast("bigint"))
    return ops.ingest_report(ops.label_records(empty.select(*ops.TX), records))


@query("ingest_again", _outcomes(f"""
    UNION ALL SELECT * REPLACE (CAST(-1 AS BIGINT) AS seq) FROM ({PARTS} WHERE date <= DATE '{CUT}'
      QUALIFY ROW_NUMBER() OVER (PARTITION BY ledger_id, account_id, hash ORDER BY seq) = 1)"""))
def ingest_again(spark, sf):
    """Importing the stored records once more adds nothing: only updated and unchanged remain."""
    existing, records = _split(spark, sf)
    return ops.ingest_report(ops.label_records(existing, records))


def _bytes(value: str) -> str:
    """SQL for the eight bytes of a number, lowest first."""
    digits = f"printf('%016x', {value})"
    return "unhex(" + " || ".join(f"substr({digits}, {at}, 2)" for at in range(15, 0, -2)) + ")"


@query("row_hash", f"""
    SELECT l_orderkey AS id, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp,
           sha256(encode(CAST(CAST(l_shipdate AS DATE) AS STRING) || '|' || l_returnflag || '|')
             || {_bytes("cents")} || encode('|') || {_bytes("l_orderkey")}) AS hash
    FROM (SELECT *, CAST(ROUND(l_extendedprice * 100) AS BIGINT) AS cents FROM {{lineitem}})""")
def row_hash(spark, sf):
    rows = star.frame(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"), F.col("l_shipdate").cast("date").cast("string").alias("date"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("cents"), "l_returnflag", "l_orderkey",
    )
    return rows.select(
        "id", "line", "part", "supp", money.row_hash("date", "l_returnflag", "cents", "l_orderkey", None).alias("hash")
    )


@query("parsed_dates", """
    SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date FROM {orders}""")
def parsed_dates(spark, sf):
    day = F.col("o_orderdate").cast("date")
    written = (
        F.when(F.col("o_orderstatus") == "F", day.cast("string"))
        .when(F.col("o_orderstatus") == "O", F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "yyyy.MM.dd"))
    )
    return star.frame(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), periods.parse_ledger_date(written, strict=False).alias("date")
    )


@query("tag_forms", """
    SELECT p_partkey AS id, LOWER(p_name) AS matching, NULL::STRING AS stored FROM {part}
    UNION ALL SELECT p_partkey, LOWER(p_type || '/' || REPLACE(p_name, ' ', '-')), LOWER(p_type || '/' || REPLACE(p_name, ' ', '-')) FROM {part}""")
def tag_forms(spark, sf):
    part = star.frame(spark, sf, "part")
    raw = F.explode(
        F.array(
            F.concat(F.lit(" ##"), F.upper("p_name")),
            F.concat(F.lit("# "), F.concat_ws("/", "p_type", F.replace("p_name", F.lit(" "), F.lit("-"))), F.lit(" ")),
        )
    )
    return part.select(F.col("p_partkey").alias("id"), raw.alias("raw")).select(
        "id", normalise_tag("raw").alias("matching"), valid_tag("raw").alias("stored")
    )


@query("path_forms", "SELECT p_partkey AS id, p_type || '/' || p_name AS path FROM {part}")
def path_forms(spark, sf):
    raw = F.concat(F.lit(" /"), "p_type", F.lit("/"), "p_name", F.lit("// "))
    return star.frame(spark, sf, "part").select(F.col("p_partkey").alias("id"), normalise_path(raw).alias("path"))


@query("sync_banks", """
    SELECT CAST(n_regionkey AS STRING) AS ledger_id, n_name AS name, FALSE AS deleted FROM {nation}
    WHERE EXISTS (SELECT 1 FROM {supplier} WHERE s_nationkey = n_nationkey)
    UNION ALL
    SELECT CAST(n_regionkey AS STRING), 'Desk ' || n_name, NOT EXISTS (SELECT 1 FROM {supplier} WHERE s_nationkey = n_nationkey AND s_acctbal > 9000)
    FROM {nation}""")
def sync_banks(spark, sf):
    """Stored desks meet discovered banks: new ones are added, absent ones deleted."""
    nation, supplier = star.frame(spark, sf, "nation"), star.frame(spark, sf, "supplier")
    ledger = F.col("n_regionkey").cast("string").alias("ledger_id")
    existing = nation.select(
        ledger,
        F.col("n_nationkey").cast("bigint").alias("bank_id"),
        F.concat(F.lit("Desk "), "n_name").alias("name"),
        F.when(F.col("n_nationkey") > 12, F.lit("2020-01-01").cast("timestamp")).alias("deleted_at"),
    )
    at = nation.join(supplier, F.col("n_nationkey") == F.col("s_nationkey"))
    discovered = at.select(ledger, F.col("n_name").alias("bank_name")).unionByName(
        at.filter("s_acctbal > 9000").select(ledger, F.concat(F.lit("Desk "), "n_name").alias("bank_name"))
    )
    names = discovered.withColumnRenamed("bank_name", "name")
    banks = ops.sync_dimension(existing, names, "bank_id", ["name"])
    after = ops.soft_delete_missing_banks(banks, discovered, "2024-01-01")
    return after.select("ledger_id", "name", F.col("deleted_at").isNotNull().alias("deleted"))


@query("soft_delete_accounts", """
    SELECT a.ledger_id AS ledger_id, account_id,
           a.deleted_at IS NOT NULL OR EXISTS (SELECT 1 FROM {supplier} WHERE s_nationkey = bank_id) AND NOT
             EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = account_id AND o_orderpriority = '1-URGENT') AS deleted
    FROM {accounts} a""")
def soft_delete_accounts(spark, sf):
    """Accounts without an urgent order vanish, but only under banks that were discovered."""
    accounts, banks = star.frame(spark, sf, "accounts"), star.frame(spark, sf, "banks")
    names = banks.select("ledger_id", "bank_id", F.col("name").alias("bank_name"))
    seen_banks = names.join(
        star.frame(spark, sf, "supplier").select(F.col("s_nationkey").cast("bigint").alias("bank_id")), "bank_id", "left_semi"
    )
    urgent = star.frame(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'")
    kept = accounts.join(urgent, F.col("account_id") == F.col("o_custkey"), "left_semi")
    discovered = seen_banks.join(
        kept.select("ledger_id", "bank_id", F.col("name").alias("account_name")), ["ledger_id", "bank_id"], "left"
    ).select("ledger_id", "bank_name", F.coalesce("account_name", F.lit("")).alias("account_name"))
    after = ops.soft_delete_missing_accounts(accounts, banks, discovered, "2024-01-01")
    return after.select("ledger_id", "account_id", F.col("deleted_at").isNotNull().alias("deleted"))


@query("map_source", """
    SELECT ledger_id, id, CAST(CAST(date AS DATE) AS STRING) AS date, description, amount_cents FROM {transactions}""")
def map_source(spark, sf):
    """Foreign columns named differently by bank and by account come out alike."""
    books = star.books(spark, sf)
    named = books.banks.select("ledger_id", "bank_id", F.col("name").alias("bank_name")).join(
        books.accounts.select("ledger_id", "account_id", "bank_id", F.col("name").alias("account_name")),
        ["ledger_id", "bank_id"],
    )
    tx = books.transactions.join(named, ["ledger_id", "account_id"])
    amount = (F.col("amount_cents").cast("decimal(18,2)") / 100).cast("decimal(18,2)").cast("string")
    foreign = tx.select(
        "ledger_id", "bank_name", "account_name", F.col("date").cast("string").alias("Day"),
        F.col("description").alias("Payee"), amount.alias("Value"), F.col("id").cast("string").alias("Ref"),
        F.lit("wrong").alias("Memo"),
    )
    fields = [("date", "Day"), ("description", "Memo"), ("amount", "Value"), ("hash", "Ref")]
    pair = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(c).alias("source_column")) for f, c in fields]))
    by_bank = named.select("ledger_id", "bank_name").distinct().select(
        "ledger_id", "bank_name", F.lit(None).cast("string").alias("account_name"), pair.alias("m")
    ).select("ledger_id", "bank_name", "account_name", "m.*")
    by_account = named.select(
        "ledger_id", "bank_name", "account_name", F.lit("description").alias("field"), F.lit("Payee").alias("source_column")
    )
    mapped = feeds.map_source(foreign, by_bank.unionByName(by_account))
    return mapped.select("ledger_id", F.col("hash").cast("bigint").alias("id"), "date", "description", "amount_cents")


@query("overlap_pull", """
    WITH log AS (SELECT ledger_id, account_id, MAX(date) - 14 AS start FROM {tx_events} WHERE source_file = 'purchase' GROUP BY 1, 2)
    SELECT e.ledger_id AS ledger_id, e.id AS id FROM {tx_events} e
    LEFT JOIN log ON log.ledger_id = e.ledger_id AND log.account_id = e.account_id
    WHERE start IS NULL OR e.date >= start""")
def overlap_pull(spark, sf):
    rows = star.frame(spark, sf, "tx_events")
    log = rows.filter("source_file = 'purchase'").select("ledger_id", "account_id", F.col("date").alias("to_date"))
    return feeds.pull_overlap(rows, feeds.overlap_window(log)).select("ledger_id", "id")


@query("normalise_feed", """
    SELECT CAST(user_id % 4 AS STRING) AS ledger_id, user_id AS account_id, CAST(CAST(ts AS DATE) AS STRING) AS date,
           event_type AS description, CAST(0 AS BIGINT) AS balance_cents,
           'ps-' || CAST(event_id AS STRING) AS hash,
           CAST(SIGN(value - 50) * FLOOR(ABS(value - 50) * 100 + 0.5) AS BIGINT) AS amount_cents,
           '{{"pocketsmith_id":' || CAST(event_id AS STRING)
             || ',"pocketsmith_category":"Users/' || CAST(user_id % 4 AS STRING) || '/' || event_type
             || '","pocketsmith_category_id":' || CAST(CAST('0x' || SUBSTR(md5(event_type), 1, 8) AS BIGINT) AS STRING)
             || CASE WHEN event_type = 'error' THEN ',"memo":"failed"' ELSE '' END
             || CASE WHEN value > 100 THEN ',"original_payee":"' || event_type || '!"' ELSE '' END || '}}' AS metadata
    FROM {events}""")
def normalise_feed(spark, sf):
    """All events; each type is a category with an id of its own."""
    number = F.conv(F.substring(F.md5(F.col("event_type").cast("binary")), 1, 8), 16, 10).cast("bigint")
    events = star.frame(spark, sf, "events").withColumn("n", number)
    events = events.withColumn("ledger_id", (F.col("user_id") % 4).cast("string"))
    feed = events.select(
        "ledger_id", F.col("user_id").alias("account_id"), F.col("event_id").alias("id"),
        F.col("ts").cast("date").cast("string").alias("date"), F.col("event_type").alias("payee"),
        F.when(F.col("value") > 100, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type")).alias("original_payee"),
        (F.col("value") - 50).alias("amount"), F.lit(None).cast("double").alias("closing_balance"),
        F.col("n").alias("category_id"), F.col("event_type").alias("category_title"),
        F.array().cast("array<string>").alias("labels"), F.lit("  ").alias("note"),
        F.when(F.col("event_type") == "error", "failed").alias("memo"),
    )
    paths = events.select(
        "ledger_id", F.col("n").alias("id"), F.concat_ws("/", F.lit("Users"), "ledger_id", "event_type").alias("path")
    ).distinct()
    return feeds.normalise_feed(feed, paths).select(
        "ledger_id", "account_id", "date", "description", "balance_cents", "hash", "amount_cents", "metadata"
    )


TREE = """SELECT 'r' || CAST(r_regionkey AS STRING) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS title FROM {region}
          UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), n_name FROM {nation}
          UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), 'n' || CAST(c_nationkey AS STRING), c_name FROM {customer}
          UNION ALL SELECT 'o' || CAST(o_orderkey AS STRING), 'c' || CAST(o_custkey AS STRING), o_orderstatus FROM {orders}"""


@query("hierarchy_paths", """
    SELECT 'o' || CAST(o_orderkey AS STRING) AS id, r_name || '/' || n_name || '/' || c_name || '/' || o_orderstatus AS path
    FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
         JOIN {region} ON n_regionkey = r_regionkey
    UNION ALL SELECT 'c' || CAST(c_custkey AS STRING), r_name || '/' || n_name || '/' || c_name
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), r_name || '/' || n_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
    UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), r_name FROM {region}""")
def hierarchy_paths(spark, sf):
    names = ("region", "nation", "customer", "orders")
    tree = spark.sql(TREE, **{n: star.frame(spark, sf, n) for n in names})
    return feeds.hierarchy_paths(tree.withColumn("ledger_id", F.lit("0"))).select("id", "path")


@query("disambiguate_names", """
    WITH s AS (SELECT p_partkey AS id, regexp_replace(p_brand, '[^A-Za-z0-9_]+', '-', 'g') AS bank,
                      regexp_replace(p_name, '[^A-Za-z0-9_]+', '-', 'g') AS name FROM {part})
    SELECT id, bank AS bank_slug, CASE WHEN COUNT(*) OVER (PARTITION BY bank, name) > 1
             THEN name || '-' || CAST(id AS STRING) ELSE name END AS account_slug FROM s""")
def disambiguate_names(spark, sf):
    rows = star.frame(spark, sf, "part").select(
        F.lit("0").alias("ledger_id"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("bank_title"),
        F.concat(F.lit(" "), "p_name", F.lit("  -")).alias("title"),
    )
    return feeds.disambiguate_names(rows).select("id", "bank_slug", "account_slug")


@query("check_unique_assignment", """
    SELECT ledger_id, account_id, STRING_AGG(DISTINCT status, ',' ORDER BY status) AS collections
    FROM {orders_wide} GROUP BY 1, 2 HAVING COUNT(DISTINCT status) > 1""")
def check_unique_assignment(spark, sf):
    rows = star.frame(spark, sf, "orders_wide").select("ledger_id", "account_id", F.col("status").alias("collection"))
    return feeds.check_unique_assignment(rows).select(
        "ledger_id", "account_id", F.array_join("collections", ",").alias("collections")
    )


@query("ingest_stream", """
    SELECT COUNT(DISTINCT ledger_id || account_id::STRING || '|' || hash)::BIGINT AS keys FROM {records}""")
def ingest_stream(spark, sf):
    """The events file as a stream: each key arrives once."""
    schema = star.frame(spark, sf, "events").schema.simpleString().removeprefix("struct<").removesuffix(">")
    source = stream.feed_stream(spark, sf, schema.replace(":", " "), glob="events.parquet")
    rows = source.select(
        (F.col("user_id") % 4).cast("string").alias("ledger_id"),
        F.col("user_id").alias("account_id"),
        F.concat_ws("-", "event_type", F.date_trunc("week", "ts").cast("date").cast("string")).alias("hash"),
        F.col("ts").cast("timestamp").alias("event_ts"),
    )
    place = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    stream.ingest_stream(rows, f"{place}/out", f"{place}/log").awaitTermination()
    return spark.read.parquet(f"{place}/out").groupBy().agg(F.count(F.lit(1)).alias("keys"))
