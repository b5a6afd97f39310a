"""Bank exports laid out as ``Bank/Account/*.csv`` and their fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CSV_GLOB = "*.[cC][sS][vV]"
_PLACE = r"([^/]+)/([^/]+)/[^/]+$"


def _place(path: Column, part: int) -> Column:
    """Bank (1) or account (2) folder of a file path, with URL escapes undone."""
    # ``+`` in a path is literal, unlike in a query string.
    raw = F.regexp_extract(path, _PLACE, part)
    return F.url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))


def scan_exports(spark: SparkSession, root: str, schema: str | StructType, ledger_id: str) -> DataFrame:
    """Rows of all exports with ``ledger_id``, ``bank_name``, ``account_name``, ``source_file``.

    Exactly two folder levels; files deeper or higher are not read.
    """
    path = F.col("_metadata.file_path")
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("pathGlobFilter", CSV_GLOB)
        .csv(f"{root.rstrip('/')}/*/*")
    )
    named = rows.select(
        F.lit(ledger_id).alias("ledger_id"),
        _place(path, 1).alias("bank_name"),
        _place(path, 2).alias("account_name"),
        path.alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        *rows.columns,
    )
    # A split starts at a byte offset and a row takes at least one byte, so
    # offset + row number inside the split keeps the order of the file.
    first = named.groupBy("source_file", "_block").agg(F.min("_row").alias("_first"))
    return (
        named.join(first, ["source_file", "_block"])
        .withColumn("position", F.col("_block") + F.col("_row") - F.col("_first"))
        .drop("_block", "_row", "_first")
    )


def listed_accounts(spark: SparkSession, root: str, ledger_id: str) -> DataFrame:
    """(ledger_id, bank_name, account_name) of every account folder, with or without files.

    A listing of two folder levels, as Spark itself makes one before it reads files.
    """
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*/*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or []
    folders = [s.getPath() for s in found if s.isDirectory()]
    rows = [(ledger_id, p.getParent().getName(), p.getName()) for p in folders]
    return spark.createDataFrame(rows, "ledger_id string, bank_name string, account_name string")


#: Bytes of a chunk of whole lines, and what a text reader takes off the start of a file.
CHUNK, MARK = 1 << 16, b"\xef\xbb\xbf"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines as chunks, with the split they come from and their number in it."""
    now, number, lines, held = None, 0, [], 0

    def chunk() -> pa.RecordBatch:
        columns = [[now[0]], [now[1]], [number], [b"\n".join([*lines, b""])]]
        kinds = pa.string(), pa.int64(), pa.int64(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "block", "n", "data"])

    for batch in batches:
        for path, block, line in zip(*batch.columns):
            key = path.as_py(), block.as_py()
            if lines and (key != now or held >= CHUNK):
                yield chunk()
                number, lines, held = number + 1 if key == now else 0, [], 0
            now = key
            lines.append(line.as_py())
            held += len(lines[-1]) + 1
    if lines:
        yield chunk()


class _Fingerprint:
    """SHA-256 of a file from its lines in order, each with a line end, and its size.

    The size tells whether the last line has an end and whether a byte order mark was taken off.
    """

    def __init__(self, size: int):
        self.size, self.seen = size, 0
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(MARK)
        self.end = b""

    def add(self, data: bytes) -> None:
        self.seen += len(data)
        for digest in (self.plain, self.marked):
            digest.update(self.end)
            digest.update(memoryview(data)[:-1])
        self.end = data[-1:]

    def value(self) -> str:
        missing = self.size - self.seen
        digest = self.marked if missing >= 2 else self.plain
        if missing in (0, 3):
            digest.update(self.end)
        elif missing not in (-1, 2):
            raise ValueError("a file changed while it was read")
        return digest.hexdigest()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each file of a sorted partition; holds one chunk at a time."""
    now, file = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([file.value()])], names=["path", "content_hash"])

    for batch in batches:
        for path, size, data in zip(batch.column(0), batch.column(1), batch.column(2)):
            if path.as_py() != now:
                if file is not None:
                    yield done()
                now, file = path.as_py(), _Fingerprint(size.as_py())
            file.add(data.as_py())
    if file is not None:
        yield done()


def file_fingerprint(spark: SparkSession, root: str, ledger_id: str) -> DataFrame:
    """SHA-256 of each export file; Spark lists no empty ones.

    Files are read in splits, as chunks of whole lines; the chunks of a file are sorted into one stream
    and hashed as they come, so a task holds a chunk and never a file.
    """
    at = f"{root.rstrip('/')}/*/*"
    path = F.col("_metadata.file_path").alias("path")
    # Contents are not read here.
    files = spark.read.format("binaryFile").option("pathGlobFilter", CSV_GLOB).load(at).select(path, F.col("length").alias("size"))
    lines = spark.read.option("pathGlobFilter", CSV_GLOB).option("lineSep", "\n").text(at).select(
        path, F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")
    )
    chunks = lines.mapInArrow(_chunks, "path string, block bigint, n bigint, data binary")
    ordered = chunks.join(files, "path").repartition("path").sortWithinPartitions("path", "block", "n")
    found = ordered.select("path", "size", "data").mapInArrow(_digests, "path string, content_hash string")
    # A file without lines is nothing but a mark.
    bare = F.sha2(F.lit(MARK), 256)
    return files.join(found, "path", "left").select(
        F.lit(ledger_id).alias("ledger_id"),
        _place(F.col("path"), 1).alias("bank_name"),
        _place(F.col("path"), 2).alias("account_name"),
        F.col("path").alias("source_file"),
        F.coalesce("content_hash", bare).alias("content_hash"),
    )


def skip_imported(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content this account has not imported; a renamed copy is skipped.

    Of equal files in one batch the first by path is kept.
    """
    key = ["ledger_id", "account_id", "content_hash"]
    first = files.groupBy(*key).agg(F.min("source_file").alias("source_file"))
    fresh = first.join(manifest.select(*key), key, "left_anti")
    return files.join(fresh, [*key, "source_file"], "left_semi")


def record_imported(manifest: DataFrame, files: DataFrame, batch_id: int, at: str) -> DataFrame:
    """The manifest with this batch's files; known contents are not added again."""
    rows = skip_imported(files, manifest).select(
        "ledger_id",
        "account_id",
        F.col("source_file").alias("path"),
        "content_hash",
        F.lit(at).cast("timestamp").alias("imported_at"),
        F.lit(batch_id).cast("bigint").alias("import_batch_id"),
    )
    return manifest.unionByName(rows)
