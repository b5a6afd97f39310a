"""A stored full-text index in immutable segments.

A segment holds the postings of the transactions it was written for, in blocks (``fulltext.build_blocks``):
one row for each ledger, term and span of ids.  A task groups whole spans and sorts its own file by term,
so no word is shuffled, a search reads only the row groups of its words, and a common word is many rows,
never one.  A merged segment may have several rows for a span.

A segment also lists the transactions it speaks for.  Postings of older segments for these count no
more, so a change or a removal writes one small segment and touches no other file.  Small segments of
similar size are merged, which drops what is superseded, so that the number of segments grows with the
logarithm of the size of the index.
"""

from __future__ import annotations

import uuid
from itertools import takewhile
from math import log

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from passbook.operators.fulltext import BLOCK_COLUMNS, POSTING_COLUMNS, SPAN, build_blocks
from passbook.session import cut_lineage
from passbook.sources import store

#: Segments of one size that are merged into one.
FAN = 4

_BLOCK = f"{BLOCK_COLUMNS}, segment long"
_TOUCHED = "ledger_id string, id long, segment long"
#: Bytes of a row group, so that a search reads little beside its words.
ROW_GROUP = 16 << 20
#: ``first`` to ``segment`` are the changes a segment speaks for.
_ENTRY = "segment long, first long, path string, postings long, touched long"
_ID = ["ledger_id", "id"]
_COLUMNS = ["ledger_id", "term", "block", "ids", "places"]


def _flat(blocks: DataFrame) -> DataFrame:
    """Blocks as postings; filters on terms pass through to the scan."""
    hits = blocks.select("ledger_id", "term", "block", F.explode(F.arrays_zip("ids", "places")).alias("hit"))
    return hits.select(
        "ledger_id", "term", (F.shiftleft("block", SPAN) + F.col("hit.ids")).alias("id"),
        F.col("hit.places").alias("pos"),
    )


def _read(spark: SparkSession, root: str, entries: list[Row], part: str, schema: str) -> DataFrame:
    paths = [f"{root}/{e.path}/{part}" for e in entries]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _live(spark: SparkSession, root: str, entries: list[Row]) -> DataFrame:
    """Blocks of these segments less the postings that a newer one of them speaks for."""
    found = _read(spark, root, entries, "blocks", _BLOCK)
    speaking = [e for e in entries if e.touched]
    if not speaking:
        return found
    touched = _read(spark, root, speaking, "touched", _TOUCHED)
    newest = touched.groupBy(*_ID).agg(F.max("segment").alias("_newest"))
    # One row a span, of at most 2^SPAN ids, so that blocks are joined and not their postings.
    near = F.map_from_entries(
        F.collect_list(F.struct(F.col("id").bitwiseAND((1 << SPAN) - 1).cast("int").alias("key"), "_newest"))
    )
    # A place for each id of the span, as a map is searched key by key.
    places = F.transform(F.sequence(F.lit(0), F.lit((1 << SPAN) - 1)), lambda at: F.col("_near")[at])
    spans = (
        newest.groupBy("ledger_id", F.shiftright("id", SPAN).alias("block")).agg(near.alias("_near"), F.max("_newest").alias("_last"))
        .select("ledger_id", "block", places.alias("_newest"), "_last")
    )
    joined = found.join(spans, ["ledger_id", "block"], "left")

    def live(near: Column) -> Column:
        return F.coalesce(F.col("segment") >= F.col("_newest")[near], F.lit(True))

    # Blocks as new as all that speaks for their span are whole.
    whole = F.coalesce(F.col("segment") >= F.col("_last"), F.lit(True))
    hits = F.filter(F.arrays_zip("ids", "places"), lambda h: live(h["ids"]))
    return joined.filter(whole | F.exists("ids", live)).select(
        "ledger_id", "term", "block", F.when(whole, F.col("ids")).otherwise(F.filter("ids", live)).alias("ids"),
        F.when(whole, F.col("places")).otherwise(hits["places"]).alias("places"), "segment",
    )


def _write(spark: SparkSession, root: str, blocks: DataFrame, touched: DataFrame | None, first: int, segment: int) -> tuple:
    """One segment's files, and its entry for the manifest."""
    path = f"segments/{segment:012d}-{uuid.uuid4().hex}"
    number = F.lit(segment).cast("bigint").alias("segment")
    sorted_blocks = blocks.sortWithinPartitions("term", "ledger_id", "block").select(*_COLUMNS, number)
    sorted_blocks.write.option("parquet.block.size", ROW_GROUP).parquet(f"{root}/{path}/blocks")
    size = spark.read.parquet(f"{root}/{path}/blocks").agg(F.sum(F.size("ids"))).first()[0] or 0
    count = 0
    if touched is not None:
        touched.select(*_ID).distinct().select("*", number).write.parquet(f"{root}/{path}/touched")
        count = spark.read.parquet(f"{root}/{path}/touched").count()
    return segment, first, path, size, count


def create_index(spark: SparkSession, root: str, tx: DataFrame, notes: DataFrame | None = None) -> None:
    """Index every transaction as version 0; raises if there is an index."""
    root = root.rstrip("/")
    if store.latest(spark, root) is not None:
        raise ValueError(f"an index is stored there: {root}")
    store.commit(spark, root, 0, [_write(spark, root, build_blocks(tx, notes), None, 0, 0)], _ENTRY)


def refresh_index(
    spark: SparkSession, root: str, changed: DataFrame | None = None, notes: DataFrame | None = None,
    removed: DataFrame | None = None,
) -> int:
    """Index the changed transactions anew and forget the removed ones; the new version.

    ``changed`` has whole transactions, ``removed`` at least (ledger_id, id).  Repeating a refresh gives
    the same postings.
    """
    root = root.rstrip("/")
    version = store.latest(spark, root)
    if version is None:
        raise ValueError(f"no index is stored there: {root}")
    if changed is None and removed is None:
        return version
    entries = store.manifest(spark, root, version)
    number = version + 1
    touched = None
    blocks = spark.createDataFrame([], BLOCK_COLUMNS)
    gone = None if removed is None else removed.select(*_ID)
    if changed is not None:
        rows = cut_lineage(changed.select("ledger_id", "id", "description", "metadata"))
        touched = rows.select(*_ID)
        if gone is not None:
            # A transaction that is changed as well as removed is removed.
            gone = cut_lineage(gone)
            rows = rows.join(gone, _ID, "left_anti")
        blocks = build_blocks(rows, notes)
    if gone is not None:
        touched = gone if touched is None else touched.union(gone)
    written = _write(spark, root, blocks, touched, number, number)
    store.commit(spark, root, number, [*map(tuple, entries), written], _ENTRY)
    return number


def _tier(entry: Row, fan: int) -> int:
    return int(log(max(entry.postings + entry.touched, 1), fan))


def merge_segments(spark: SparkSession, root: str, fan: int = FAN, whole: bool = False) -> int | None:
    """Merge the newest segments where ``fan`` or more are of about one size (all, if ``whole``).

    Answers of the index stay the same.  Returns the new version, None if there was nothing to merge.
    """
    root = root.rstrip("/")
    version = store.latest(spark, root)
    entries = sorted(store.manifest(spark, root, version), key=lambda e: e.segment)
    run: list[Row] = []
    if whole:
        run = entries
    else:
        # Newest segments up to a tier, once enough are of that tier: each posting is merged once a tier.
        for tier in sorted({_tier(e, fan) for e in entries}, reverse=True):
            newest = list(takewhile(lambda e: _tier(e, fan) <= tier, reversed(entries)))
            if sum(_tier(e, fan) == tier for e in newest) >= fan:
                run = newest[::-1]
                break
    if len(run) < 2:
        return None
    rest = entries[: len(entries) - len(run)]
    # The oldest segment speaks for no older ones.
    touched = _read(spark, root, [e for e in run if e.touched], "touched", _TOUCHED) if rest else None
    written = _write(spark, root, _live(spark, root, run), touched, run[0].first, run[-1].segment)
    store.commit(spark, root, version + 1, [*map(tuple, rest), written], _ENTRY)
    return version + 1


def index_blocks(spark: SparkSession, root: str) -> DataFrame:
    """What the index holds, as blocks; an id of a term is in one of them."""
    root = root.rstrip("/")
    entries = store.manifest(spark, root)
    if not entries:
        raise ValueError(f"no index is stored there: {root}")
    return _live(spark, root, entries).drop("segment")


def index_postings(spark: SparkSession, root: str) -> DataFrame:
    """The same for the searches of ``fulltext``; read without the row groups of other terms."""
    return _flat(index_blocks(spark, root))


def segments(spark: SparkSession, root: str) -> DataFrame:
    """The segments of the newest version."""
    return spark.createDataFrame([tuple(e) for e in store.manifest(spark, root.rstrip("/"))], _ENTRY)
