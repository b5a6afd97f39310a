"""Feed records: reading, mapping foreign columns, aggregator feeds and their accounts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passbook.functions.text import slug
from passbook.schema import RAW_RECORD
from passbook.session import cut_lineage

OVERLAP_DAYS = 14
MAPPED = ["date", "description", "amount", "balance", "hash"]


def read_feed_json(spark: SparkSession, path: str) -> DataFrame:
    """Arrays of raw records; missing metadata is ``{}``, a missing required field fails."""
    schema = RAW_RECORD.replace("metadata string", "metadata variant")
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = [
        F.coalesce(c, F.raise_error(F.lit(f"missing field: {c}")).cast(t)).alias(c)
        for c, t in (
            ("date", "string"), ("description", "string"),
            ("amount_cents", "bigint"), ("balance_cents", "bigint"),
        )
    ]
    return rows.select(*checked, "hash", F.coalesce(F.to_json("metadata"), F.lit("{}")).alias("metadata"))


def map_source(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Foreign columns to raw records by a mapping table.

    ``mapping`` rows are (ledger_id, bank_name, account_name, field, source_column)
    with ``account_name`` NULL for the whole bank; an account's own row wins.
    ``df`` holds its foreign columns as strings beside ledger, bank and account.
    """
    names = [c for c in df.columns if c not in ("ledger_id", "bank_name", "account_name", "source_file", "position")]
    bank = mapping.filter(F.col("account_name").isNull()).groupBy("ledger_id", "bank_name").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "source_column"))).alias("_bank")
    )
    own = mapping.filter(F.col("account_name").isNotNull()).groupBy(
        "ledger_id", "bank_name", "account_name"
    ).agg(F.map_from_entries(F.collect_list(F.struct("field", "source_column"))).alias("_own"))
    rows = df.join(bank, ["ledger_id", "bank_name"], "left").join(
        own, ["ledger_id", "bank_name", "account_name"], "left"
    )
    values = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("string"))])

    def pick(field: str) -> Column:
        source = F.coalesce(F.try_element_at("_own", F.lit(field)), F.try_element_at("_bank", F.lit(field)))
        return F.try_element_at(values, source)

    def cents(field: str) -> Column:
        return (F.regexp_replace(pick(field), r"[,$\s]", "").cast("decimal(18,2)") * 100).cast("bigint")

    passed = [c for c in ("ledger_id", "bank_name", "account_name", "source_file", "position") if c in df.columns]
    return rows.select(
        *passed,
        pick("date").alias("date"),
        F.coalesce(pick("description"), F.lit("")).alias("description"),
        cents("amount").alias("amount_cents"),
        F.coalesce(cents("balance"), F.lit(0)).alias("balance_cents"),
        pick("hash").alias("hash"),
        F.lit("{}").alias("metadata"),
    )


def overlap_window(log: DataFrame, days: int = OVERLAP_DAYS) -> DataFrame:
    """Start of the next pull per account: the last successful end less the overlap."""
    return log.groupBy("ledger_id", "account_id").agg(F.date_sub(F.max("to_date"), days).alias("start_date"))


def pull_overlap(feed: DataFrame, windows: DataFrame) -> DataFrame:
    """Feed rows inside their account's window; an account without a log pulls everything."""
    rows = feed.join(windows, ["ledger_id", "account_id"], "left")
    inside = F.col("start_date").isNull() | (F.col("date") >= F.col("start_date"))
    return rows.filter(inside).drop("start_date")


def normalise_feed(
    df: DataFrame, paths: DataFrame | None = None, hash_prefix: str = "ps-", key_prefix: str = "pocketsmith_"
) -> DataFrame:
    """Aggregator transactions to raw records.

    Amounts round half away from zero; the hash is stable per source id; empty
    labels, blank notes and an unchanged payee leave no metadata key.  Reads id,
    date, payee, original_payee, amount, closing_balance, category_id,
    category_title, labels (array), note and memo.
    """
    rows = df
    path = F.col("category_title")
    if paths is not None:
        named = paths.select("ledger_id", F.col("id").alias("category_id"), F.col("path").alias("_path"))
        rows = rows.join(named, ["ledger_id", "category_id"], "left")
        path = F.coalesce("_path", "category_title")

    def cents(c: str) -> Column:
        return F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * 100).cast("bigint")

    def unless_blank(c: str) -> Column:
        return F.when(F.col(c).rlike(r"(?U)\S"), F.col(c))

    meta = F.to_json(
        F.struct(
            F.col("id").alias(f"{key_prefix}id"),
            F.when(F.col("category_id").isNotNull(), path).alias(f"{key_prefix}category"),
            F.col("category_id").alias(f"{key_prefix}category_id"),
            F.when(F.size("labels") > 0, F.col("labels")).alias(f"{key_prefix}labels"),
            unless_blank("note").alias("note"),
            unless_blank("memo").alias("memo"),
            F.when(~F.col("original_payee").eqNullSafe(F.col("payee")), F.col("original_payee")).alias(
                "original_payee"
            ),
        ),
        {"ignoreNullFields": "true"},
    )
    passed = [c for c in ("ledger_id", "account_id") if c in df.columns]
    return rows.select(
        *passed,
        "date",
        F.coalesce("payee", F.lit("")).alias("description"),
        cents("amount").alias("amount_cents"),
        cents("closing_balance").alias("balance_cents"),
        F.concat(F.lit(hash_prefix), F.col("id").cast("string")).alias("hash"),
        meta.alias("metadata"),
    )


def hierarchy_paths(df: DataFrame, id_col: str = "id", parent: str = "parent_id", title: str = "title") -> DataFrame:
    """``/``-joined ancestor titles of each tree node, one join per doubling of depth.

    Every node keeps the path gathered so far and the ancestor above it; joining
    the table with itself on that ancestor doubles the gathered length.  A cycle raises.
    """
    nodes = df.select(
        "ledger_id", F.col(id_col).alias("id"), F.col(parent).alias("_up"), F.col(title).alias("path")
    )
    left = None
    while True:
        climbing = nodes.filter(F.col("_up").isNotNull()).count()
        if not climbing:
            break
        # The deepest node has an ancestor at every depth below its own, so without a
        # cycle each round ends the climb of some node.
        if climbing == left:
            raise ValueError("nodes are their own ancestors")
        left = climbing
        above = nodes.select(
            "ledger_id",
            F.col("id").alias("_up"),
            F.col("_up").alias("_next"),
            F.col("path").alias("_prefix"),
            F.lit(True).alias("_found"),
        )
        nodes = nodes.join(above, ["ledger_id", "_up"], "left").select(
            "ledger_id",
            "id",
            # An unknown parent ends the climb like a root.
            F.when(F.col("_found"), F.col("_next")).alias("_up"),
            F.when(F.col("_found"), F.concat_ws("/", "_prefix", "path")).otherwise(F.col("path")).alias("path"),
        )
        nodes = cut_lineage(nodes)
    return nodes.select("ledger_id", "id", "path")



def disambiguate_names(df: DataFrame, bank: str = "bank_title", name: str = "title", id_col: str = "id") -> DataFrame:
    """Folder-friendly bank and account names; a repeated pair gets ``-<id>``."""
    slugs = df.withColumn("bank_slug", slug(F.coalesce(bank, F.lit("Unknown")))).withColumn("_slug", slug(name))
    counts = slugs.groupBy("ledger_id", "bank_slug", "_slug").agg(F.count(F.lit(1)).alias("_n"))
    account = F.when(F.col("_n") > 1, F.concat("_slug", F.lit("-"), F.col(id_col).cast("string"))).otherwise(
        F.col("_slug")
    )
    return (
        slugs.join(counts, ["ledger_id", "bank_slug", "_slug"])
        .withColumn("account_slug", account)
        .drop("_slug", "_n")
    )


def check_unique_assignment(df: DataFrame) -> DataFrame:
    """Account ids listed under more than one collection, with the collections."""
    return (
        df.groupBy("ledger_id", "account_id")
        .agg(F.array_sort(F.collect_set("collection")).alias("collections"))
        .filter(F.size("collections") > 1)
        .withColumn(
            "error",
            F.concat(
                F.lit("account "), F.col("account_id").cast("string"), F.lit(" appears in both "),
                F.array_join("collections", " and "),
            ),
        )
    )
