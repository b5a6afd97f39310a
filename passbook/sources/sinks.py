"""Report files: CSV and JSON lines, and snapshot publishing of state tables."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from passbook.sources import store

#: Buckets of ledgers in a published table.
BUCKETS = 64
PART = ["_bucket", "_month"]
_ENTRY = "name string, part string, path string, schema string"


def csv_field(col: str) -> Column:
    """Text of a CSV field: quoted only around comma, quote, CR or LF; NULL is empty."""
    text = F.coalesce(F.col(col).cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def write_csv(df: DataFrame, path: str) -> None:
    """CRLF lines under one header; the part files in order form one CSV file.

    Lines are built as text, as the CSV writer would turn line breaks inside
    fields into its own line ends.
    """
    names = [n if not set(n) & set(',"\r\n') else '"' + n.replace('"', '""') + '"' for n in df.columns]
    header = df.sparkSession.createDataFrame([(",".join(names),)], "value string").coalesce(1)
    lines = df.select(F.concat_ws(",", *[csv_field(f"`{c}`") for c in df.columns]).alias("value"))
    header.union(lines).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines; NULL fields are present."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


# Published state: parts by ledger and month


def _part(columns: list[str]) -> list[Column]:
    """The part of a row: a hash of its ledger, and its month if the table has dates."""
    bucket = F.pmod(F.xxhash64("ledger_id"), F.lit(BUCKETS)).cast("int") if "ledger_id" in columns else F.lit(0)
    month = F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none")) if "date" in columns else F.lit("all")
    return [bucket.alias("_bucket"), month.alias("_month")]


def publish(
    tables: dict[str, DataFrame], root: str, touched: dict[str, DataFrame] | None = None
) -> int:
    """Publish these tables as the next version, and return its number.

    Of a table in ``touched`` only the parts (ledger bucket and month) are written that its touched rows
    fall in: those added, changed or, as they were before, removed.  The others keep their files, as do
    tables not given.  One manifest names the files of all parts and is written last, so readers see a
    version whole or not at all.
    """
    root, spark = root.rstrip("/"), next(iter(tables.values())).sparkSession
    version = store.latest(spark, root)
    last = store.manifest(spark, root, version) if version is not None else []
    entries = {(e["name"], e["part"]): e["path"] for e in last if e["part"]}
    schemas = {e["name"]: e["schema"] for e in last if not e["part"]}
    number = 0 if version is None else version + 1
    for name, df in tables.items():
        rows = df.withColumns({c: p for c, p in zip(PART, _part(df.columns))})
        if name in schemas and touched is not None and name in touched:
            # As many as there are buckets and months at most.
            changed = touched[name].select(*_part(touched[name].columns)).distinct().collect()
            parts = spark.createDataFrame(changed, "_bucket int, _month string")
            rows = rows.join(parts, PART, "left_semi")
            gone = {f"_bucket={r['_bucket']}/_month={r['_month']}" for r in changed}
        else:
            gone = {part for n, part in entries if n == name}
        path = f"data/{name}/{number:012d}-{uuid.uuid4().hex}"
        # A part is one file, or a few where it is large: a hot ledger is split.
        rows.hint("rebalance", *PART).write.partitionBy(*PART).parquet(f"{root}/{path}")
        for part in gone:
            entries.pop((name, part), None)
        for bucket in store.children(spark, f"{root}/{path}"):
            if bucket.startswith("_bucket="):
                for month in store.children(spark, f"{root}/{path}/{bucket}"):
                    entries[name, f"{bucket}/{month}"] = path
        # An entry without a part holds the columns, also of a table without rows.
        schemas[name] = df.schema.json()
    made = [(name, part, path, "") for (name, part), path in entries.items()]
    store.commit(spark, root, number, made + [(name, "", "", schema) for name, schema in schemas.items()], _ENTRY)
    return number


def current(spark: SparkSession, root: str, table: str, months: tuple[str, str] | None = None) -> DataFrame:
    """The last published state of a table; with ``months`` (first, last as yyyy-MM) only the files of these."""
    root = root.rstrip("/")
    mine = [e for e in store.manifest(spark, root) if e["name"] == table]
    if not mine:
        raise ValueError(f"never published: {table}")
    schema = StructType.fromJson(json.loads(next(e["schema"] for e in mine if not e["part"])))
    paths = [f"{root}/{e['path']}/{e['part']}" for e in mine if e["part"]]
    if months is not None:
        paths = [p for p in paths if months[0] <= p.rpartition("_month=")[2] <= months[1]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
