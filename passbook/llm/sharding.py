"""Two-pass external shuffle into shards of equal row counts.

Pass one scatters records uniformly into buckets of a bounded size by a seeded hash.  Pass two
shuffles each bucket in memory by Fisher-Yates and writes it.  The buckets in turn give one global
order; shards are cut from it, so their counts differ by one at most.

A record is told apart by its place in the input (part and row of the part), so rows that repeat an
id, or hold none, scatter like all others, and a repeated task scatters its rows the same way as long
as the input is a stored table.  Defined results: a NULL text has size 8; an empty table gives none;
an input column called ``shard`` or ``slot`` comes back as ``shard_input`` or ``slot_input``.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of records in a bucket.  A bucket is shuffled in the memory of one task.
BUCKET = 4 << 20
SEED = 20_240_531


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A uniform order of n rows: each place in turn, from the last, swaps with one not after it."""
    order = np.arange(n)
    swaps = (np.random.default_rng(seed).random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = swaps[i]
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(
    docs: DataFrame, shards: int, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET
) -> DataFrame:
    """The records with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard)."""
    taken = {"shard", "slot"}
    rows = docs.select(
        F.struct(*[F.col(c).alias(f"{c}_input" if c.lower() in taken else c) for c in docs.columns]).alias("_row"),
        F.monotonically_increasing_id().alias("_place"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 8).alias("_size"),
    )
    size, total = rows.agg(F.sum("_size"), F.count(F.lit(1))).first()
    buckets = max(1, ceil((size or 0) / bucket_bytes))
    scattered = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), "_place"), F.lit(buckets)).cast("int"))
    # One count for each bucket gives the place of its first record in the global order.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = scattered.groupBy("_bucket").count().select(
        "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start")
    )

    def shuffle(table: pa.Table) -> pa.Table:
        table = table.sort_by("_place")
        bucket, start = table["_bucket"][0].as_py(), table["_start"][0].as_py()
        position = start + np.arange(len(table))
        # Shard s holds positions from ceil(s * total / shards).
        shard = position * shards // total
        slot = position - -(-shard * total // shards)
        table = table.take(pa.array(fisher_yates(len(table), seed + bucket)))
        return pa.table({"_row": table["_row"], "shard": pa.array(shard, pa.int32()), "slot": pa.array(slot, pa.int64())})

    shuffle.__annotations__ = {"table": pa.Table, "return": pa.Table}
    schema = rows.select("_row").schema.add("shard", "integer").add("slot", "long")
    return (
        scattered.select("_row", "_place", "_bucket").join(starts, "_bucket")
        .groupBy("_bucket").applyInArrow(shuffle, schema).select("_row.*", "shard", "slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int, text: str = "text", seed: int = SEED,
                 bucket_bytes: int = BUCKET) -> DataFrame:
    """Write the shuffled records as Parquet, a folder for each shard in order of slot, and read them."""
    out = shuffled(docs, shards, text, seed, bucket_bytes)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    schema = out.select(*[c for c in out.columns if c != "shard"], "shard").schema
    return docs.sparkSession.read.schema(schema).parquet(path)
