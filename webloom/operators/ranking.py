"""First rows per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _ranked_by_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key by range partitions of (key, order): each partition counts its rows per key, a prefix
    sum over partitions gives each (partition, key) the rows of the key before it, and rows are ranked within their
    partition only. No task holds more than a range partition, however large ``n`` or a key."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The partition number is read once and kept: AQE may read the same exchange in other numbers elsewhere.
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order).withColumn(
        "_rank_part", F.spark_partition_id()).persist()
    counts = ranged.groupBy("_rank_part", *keys).agg(F.count("*").alias("_rank_n"))
    earlier = Window.partitionBy(*keys).orderBy("_rank_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_rank_before", F.coalesce(F.sum("_rank_n").over(earlier), F.lit(0))).filter(
        F.col("_rank_before") < n).select(F.col("_rank_part").alias("_start_part"),
                                         *[F.col(k).alias(f"_start_{i}") for i, k in enumerate(keys)], "_rank_before")
    same = F.col("_rank_part") == F.col("_start_part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_start_{i}"))
    local = Window.partitionBy("_rank_part", *keys).orderBy(*order)
    joined = ranged.join(starts, same)
    return (joined.withColumn("rank", (F.col("_rank_before") + F.row_number().over(local)).cast("int"))
            .filter(F.col("rank") <= n)
            .drop("_rank_part", "_start_part", "_rank_before", *[f"_start_{i}" for i in range(len(keys))]))


def ranked_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key with their ``rank``; ``order`` must be total within a key.

    Up to the window group limit, Spark cuts each key to ``n`` rows before the shuffle, so a key of any size costs at
    most ``n`` rows per task. A larger ``n`` is ranked over range partitions of (key, order), counted first, so a key
    of any size spreads over many tasks.
    """
    if n <= 0:
        return df.limit(0).withColumn("rank", F.lit(0))
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n > limit:
        return _ranked_by_ranges(df, keys, order, n)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= n)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, or of the whole table without keys."""
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if not keys and n <= limit:
        return df.orderBy(*order).limit(n)
    return ranked_per_key(df, keys, order, n).drop("rank")
