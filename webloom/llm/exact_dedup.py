"""Exact duplicates by content sort.

Texts are normalised and range-partitioned by Spark's sampled splitters; the external sort of each partition places
equal texts next to each other, and a window compares neighbours in full. Splitters are the first characters of a text
and its digest, so the sample that Spark gathers on the driver has a bounded size however long texts are. A text that fills more than its share of a
partition (and ``MIN_SHARE`` rows) is found first, with counts of its digest that are combined before they move, and is
dealt out in slices, so no task receives a whole hot group; its rows are still compared in full within each slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import one_space, shuffle_partitions

HEAD_CHARS = 32
#: Rows a group of copies must exceed before its counts come from digests; below, it is sorted and compared in full.
MIN_SHARE = 4096


def exact_dedup(docs: DataFrame, carry: Sequence[str] = ("doc_id",), id_column: str = "doc_id",
                text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: (row, keep_id, group_size, kept, text_sha256).

    ``row`` is a struct of the columns in ``carry``, so no name clashes with the others. Texts are equal when they are
    the same after each run of white space became one space; null counts as empty, so null, empty and no other texts
    are one group. Of equal texts the row with the smallest id is kept, null ids last; of rows that repeat an id, one.
    An empty table gives an empty result. Very long texts are compared whole. A text moves once: normalised, or as it
    is where ``carry`` names it.
    """
    norm = one_space(F.col(text_column))
    carried = list(carry).count(text_column) == 1
    base = docs.select(F.struct(*[F.col(c) for c in carry]).alias("row"), F.col(id_column).alias("id"),
                       norm.alias("norm"), F.sha2(norm, 256).alias("sha"))
    parts = shuffle_partitions(docs.sparkSession)
    share = max(MIN_SHARE, docs.count() // (2 * parts))
    # Groups above half a partition's share (and above MIN_SHARE rows): fewer than 2 * parts + 2 of them, whatever the
    # input. Smaller groups, and all groups of small tables, are compared in full on the sorted path.
    hot = (
        docs.select(F.col(id_column).alias("id"), F.sha2(norm, 256).alias("hot_sha"))
        .groupBy("hot_sha").agg(F.min("id").alias("hot_keep"), F.count("*").alias("hot_size"))
        .filter((F.col("hot_size") > share) & (F.col("hot_size") > 1))
    )
    slices = F.ceil(F.col("hot_size") / share)
    dealt = (
        base.join(F.broadcast(hot), F.col("sha") == F.col("hot_sha"), "left")
        .withColumn("slice", F.when(F.col("hot_size").isNull(), F.lit(0))
                    .otherwise(F.pmod(F.xxhash64("id"), slices)).cast("long"))
        .withColumn("head", F.substring("norm", 1, HEAD_CHARS))
        .drop("hot_sha", *["norm"] * carried)
        .repartitionByRange(parts, "head", "sha", "slice")
    )
    if carried:
        dealt = dealt.withColumn("norm", one_space(F.col("row").getField(text_column)))
    group = Window.partitionBy("head", "sha", "slice", "norm")
    ordered = group.orderBy(F.asc_nulls_last("id"))
    found = (
        dealt.withColumn("place", F.row_number().over(ordered))
        .withColumn("first_id", F.min("id").over(group))
        .withColumn("n_slice", F.count("*").over(group))
    )
    keep_id = F.when(F.col("hot_size").isNull(), F.col("first_id")).otherwise(F.col("hot_keep"))
    return found.select(
        "row", keep_id.alias("keep_id"), F.coalesce("hot_size", "n_slice").alias("group_size"),
        ((F.col("place") == 1) & F.col("id").eqNullSafe(keep_id)).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The kept rows of ``docs`` with all their columns."""
    return exact_dedup(docs, docs.columns, id_column, text_column).filter("kept").select("row.*")
