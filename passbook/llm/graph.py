"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passbook.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, of every node of ``edges`` (``a``, ``b``).

    Nodes may be of any ordered type; loops and repeated edges do no harm.  Each round is two joins on
    a node with its smallest neighbour, which is found by a partial aggregation, so the neighbours of
    a hot node are never gathered.  A round is written to the shared folder, which cuts the lineage.
    """
    current = cut_lineage(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    before = None
    while True:
        # Large star: each larger neighbour of a node is tied to the smallest one.
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, as Spark splits hot keys only where both sides of a join come straight from a shuffle.
        least = cut_lineage(
            both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        )
        large = cut_lineage(
            both.join(least, F.col("a") == F.col("n")).where("b > a and b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        # Small star: all not larger neighbours of a node are tied to the smallest of them.
        least = cut_lineage(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")))
        small = large.join(least, F.col("a") == F.col("n"))
        current = cut_lineage(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("n").alias("a"), F.col("m").alias("b"))).distinct()
        )
        after = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if after == before:
            break
        before = after
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
