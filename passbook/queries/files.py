"""Files: tables are written as exports, feeds and reports, and read back by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from passbook.operators import ingest as ops
from passbook.queries import query
from passbook.session import checkpoint_root
from passbook.sources import exports, feeds, sinks, star


def _place(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _exported(spark, sf) -> str:
    """Customers as exports: a folder for each nation, in it one for each segment."""
    root = _place(spark, "exports")
    rows = star.frame(spark, sf, "customer").select(
        F.concat(F.lit("Nation "), "c_nationkey").alias("bank"), F.col("c_mktsegment").alias("account"), "c_custkey", "c_name", "c_acctbal",
    )
    rows.repartition("bank", "account").write.partitionBy("bank", "account").option("header", True).csv(root)
    return root


EXPORT = "c_custkey long, c_name string, c_acctbal double"


@query("scan_exports", """
    SELECT 'L' AS ledger_id, 'bank=Nation ' || CAST(c_nationkey AS STRING) AS bank_name, 'account=' || c_mktsegment AS account_name,
           c_custkey, c_name, c_acctbal FROM {customer}""")
def scan_exports(spark, sf):
    rows = exports.scan_exports(spark, _exported(spark, sf), EXPORT, "L")
    return rows.select("ledger_id", "bank_name", "account_name", "c_custkey", "c_name", "c_acctbal")


@query("listed_accounts", """
    SELECT DISTINCT 'L' AS ledger_id, 'bank=Nation ' || CAST(c_nationkey AS STRING) AS bank_name, 'account=' || c_mktsegment AS account_name
    FROM {customer}""")
def listed_accounts(spark, sf):
    return exports.listed_accounts(spark, _exported(spark, sf), "L")


@query("skip_imported", """
    SELECT DISTINCT 'bank=Nation ' || CAST(c_nationkey AS STRING) AS bank_name, 'account=' || c_mktsegment AS account_name
    FROM {customer} WHERE c_nationkey % 2 = 1""")
def skip_imported(spark, sf):
    """The exports of even nations were imported before, under other names."""
    files = exports.file_fingerprint(spark, _exported(spark, sf), "L").withColumn("account_id", F.abs(F.hash("bank_name", "account_name")).cast("bigint"))
    even = F.regexp_extract("bank_name", "([0-9]+)$", 1).cast("int") % 2 == 0
    manifest = files.filter(even).select(
        "ledger_id", "account_id", F.concat(F.lit("renamed/"), "source_file").alias("path"), "content_hash",
        F.lit("2024-01-01").cast("timestamp").alias("imported_at"), F.lit(1).cast("bigint").alias("import_batch_id"),
    )
    return exports.skip_imported(files, manifest).select("bank_name", "account_name")


@query("read_feed_json", """
    SELECT CAST(CAST(ts AS DATE) AS STRING) AS date, event_type AS description, CAST(ROUND(value * 100) AS BIGINT) AS amount_cents,
           event_id AS balance_cents, CASE WHEN event_id % 3 = 0 THEN 'h' || CAST(event_id AS STRING) END AS hash,
           CASE WHEN event_id % 2 = 0 THEN REPLACE(props, ' ', '') ELSE '{{}}' END AS metadata
    FROM {events}""")
def read_feed_json(spark, sf):
    """Events as feed files, each one array of up to 500 records; odd ones lack metadata."""
    root = _place(spark, "feed")
    record = F.concat(
        F.regexp_replace(
            F.to_json(F.struct(
                F.col("ts").cast("date").cast("string").alias("date"), F.col("event_type").alias("description"),
                F.round(F.col("value") * 100).cast("bigint").alias("amount_cents"), F.col("event_id").alias("balance_cents"),
                F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("h"), "event_id")).alias("hash"),
            )), "[}]$", "",
        ),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"metadata":'), "props")).otherwise(F.lit("")), F.lit("}"),
    )
    rows = star.frame(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 500).alias("file")).agg(F.collect_list(record).alias("r"))
    lines = rows.select("file", F.concat(F.lit("["), F.array_join("r", ","), F.lit("]")).alias("value"))
    lines.write.partitionBy("file").text(root)
    return feeds.read_feed_json(spark, f"{root}/*").select(
        "date", "description", "amount_cents", "balance_cents", "hash", "metadata"
    )


@query("with_batch", """
    SELECT ledger_id, account_id, hash, seq, CAST(9 AS BIGINT) AS import_batch_id FROM {records}""")
def with_batch(spark, sf):
    rows = ops.with_batch(star.frame(spark, sf, "records"), 9)
    return rows.select("ledger_id", "account_id", "hash", "seq", "import_batch_id")


@query("write_csv", '''
    SELECT 'id,"text,quoted",size' AS line
    UNION ALL SELECT CAST(p_partkey AS STRING) || ',"' || p_name || ', ""' || p_brand || '""",' || CAST(p_size AS STRING) FROM {part}''')
def write_csv(spark, sf):
    place = _place(spark, "csv")
    rows = star.frame(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')).alias("text,quoted"),
        F.col("p_size").alias("size"),
    )
    sinks.write_csv(rows, place)
    return spark.read.option("lineSep", "\r\n").text(place).select(F.col("value").alias("line"))


@query("write_json", """
    SELECT p_partkey AS id, CASE WHEN p_size > 20 THEN p_name END AS name, p_retailprice AS price FROM {part}""")
def write_json(spark, sf):
    place = _place(spark, "json")
    rows = star.frame(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 20, F.col("p_name")).alias("name"), F.col("p_retailprice").alias("price"),
    )
    sinks.write_json(rows, place)
    # Every line names every field, NULL or not.
    whole = spark.read.text(place).filter(F.col("value").contains('"name":'))
    return whole.select(F.from_json("value", rows.schema).alias("r")).select("r.*")


@query("published_parts", """
    SELECT ledger_id, id, CASE WHEN DATE_TRUNC('month', date) = (SELECT MAX(DATE_TRUNC('month', date)) FROM {tx_events})
                               THEN UPPER(description) ELSE description END AS description
    FROM {tx_events}""")
def published_parts(spark, sf):
    """All events are published, then those of the last month again, in capitals: one month of files is new."""
    root, rows = _place(spark, "published"), star.frame(spark, sf, "tx_events")
    sinks.publish({"transactions": rows}, root)
    last = rows.agg(F.max(F.date_trunc("month", "date"))).first()[0]
    newest = F.date_trunc("month", "date") == F.lit(last)
    after = rows.withColumn("description", F.when(newest, F.upper("description")).otherwise(F.col("description")))
    sinks.publish({"transactions": after}, root, {"transactions": rows.filter(newest)})
    return sinks.current(spark, root, "transactions").select("ledger_id", "id", "description")
