"""Continuous ingest of feed records from a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from passbook.operators.ingest import KEY, ingest
from passbook.sources.store import children

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def feed_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    """Files arriving under ``path`` as a stream."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def ingest_stream(
    stream: DataFrame, sink: str, checkpoint: str, order: str = "event_ts", partitions: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append the first record of each key to a parquet folder, once for all time.

    The keys are kept in the state of the stream: hash buckets on RocksDB under ``checkpoint``, each with
    the micro-batch times at which the key came first and last.  A key is new where both are the same, so
    a batch looks up its own keys and reads nothing else, however many are stored, and a record may come
    late or repeat a key of any age.  Of the records of one batch the first by ``order`` is kept; one
    without ``order`` comes after those that have it.

    Each batch owns one folder of the sink, which a replay writes anew: the times of a batch are
    part of its log.  Damaged state raises, and so does a sink that belongs to another checkpoint.
    ``partitions`` is the number of buckets; the first run of a checkpoint fixes it.
    """
    spark = stream.sparkSession
    # A struct is never NULL, so that min_by sees records without a time as well.
    last = F.struct(F.col(order).isNull(), F.col(order))
    kept = stream.withColumn("_now", F.current_timestamp()).groupBy(*KEY).agg(
        F.min_by(F.struct(*[F.col(c) for c in stream.columns]), last).alias("_r"),
        F.min("_now").alias("_first"), F.max("_now").alias("_last"),
    )

    def step(batch: DataFrame, number: int) -> None:
        if number == 0 and set(children(spark, sink)) - {"_SUCCESS", "batch=0"}:
            raise ValueError(f"{sink} holds the records of another checkpoint")
        fresh = batch.filter(F.col("_first") == F.col("_last")).select("_r.*")
        fresh.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    # A query takes the settings of the session as it starts.
    settings = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        return (
            kept.writeStream.outputMode("update").foreachBatch(step)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def refine_stream(
    stream: DataFrame,
    load: Callable[[], DataFrame],
    store: Callable[[DataFrame, int], None],
    checkpoint: str,
) -> StreamingQuery:
    """Batch-wise ingest with refinement, for feeds that improve their texts later.

    ``load`` reads the current transactions and ``store`` publishes the new
    ones under the given batch number.  A replayed batch finds its keys known
    and changes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        store(ingest(load(), batch), number)

    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
