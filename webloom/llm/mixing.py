"""Mixing sources to target weights, by exponential keys sorted within each source.

A document's key is ``-ln(u) / weight``, with u from a hash of its id and weight its quality: sorting by key draws
documents in order of a weighted sample without replacement. A source's target is spent on complete epochs first, then
on the documents whose place in the prefix sum of sizes lies below the rest. Only (source, key, id, size) is moved.
Rows are range-partitioned by (source, key), so a source of any share of the table lies in many partitions; sums per
partition come first, and a prefix sum by row is made only in the partition that holds the cut. Texts stay where they
are: bitmaps of the documents drawn and of those not drawn tell them apart, and only the few that both hold are joined
with their labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.llm.common import WORDS, screened, shuffle_partitions, stored

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix"
_UNIT = 2.0 ** 52
_WIDE = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def sample_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """Exponential key of a document; null, zero or negative weights count as 1."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / F.lit(_UNIT)
    return -F.log(u) / F.when(weight > 0, weight).otherwise(1.0)


def label_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """(label_id, weight) of labelled documents, the best label of each."""
    return labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.when(F.max("quality") == 1, good).when(F.max("quality") == 0, bad).otherwise(1.0).alias("weight"))


def sized(docs: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text",
          source_column: str = "source", seed: str = SEED) -> DataFrame:
    """(source, key, id, size, part), stored: one row per document in order of (source, key, id), with the partition
    it lies in."""
    rows = docs.select(F.col(source_column).alias("source"), F.col(id_column).alias("id"),
                       n_words(F.col(text_column)).alias("size"))
    weight = F.lit(1.0)
    if labels is not None:
        rows = rows.join(label_weights(labels), F.col("id") == F.col("label_id"), "left")
        weight = F.coalesce("weight", F.lit(1.0))
    keyed = rows.select("source", sample_key(F.col("id"), weight, seed).alias("key"), "id", "size")
    parts = shuffle_partitions(docs.sparkSession)
    return stored(keyed.repartitionByRange(parts, F.asc_nulls_last("source"), "key", "id")
                  .withColumn("part", F.spark_partition_id()))


def source_weights(sums: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """``sums`` plus ``weight``: the weights in turn, by source in code point order, null last. ``sums`` has one row
    per source; they are numbered by partition, so no task receives all of them."""
    spark = sums.sparkSession
    ordered = stored(sums.repartitionByRange(shuffle_partitions(spark), F.asc_nulls_last("source"))
                     .withColumn("slot", F.spark_partition_id()))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, whatever the number of sources.
    starts = ordered.groupBy("slot").agg(F.count("*").alias("n")).select(
        F.col("slot").alias("start_slot"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("slot").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("start")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    return ordered.join(F.broadcast(starts), F.col("slot") == F.col("start_slot")).withColumn(
        "weight", F.element_at(cycle, (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))) \
        .drop("slot", "start_slot", "start")


def source_targets(sums: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    All sizes together are shared by weight. A target above ``max_epochs`` times its source's size stops there, and the
    excess is shared again among the rest until none is above. A round changes three sums; the sources stay where
    they are.
    """
    table = stored(source_weights(sums, weights).withColumn(
        "cap", F.col("source_size").cast(_WIDE) * max_epochs))
    capped = F.lit(False)
    total = int(table.agg(F.sum(F.col("source_size").cast(_WIDE))).first()[0] or 0)
    state = None
    while True:
        row = table.agg(F.sum(F.when(capped, F.col("cap"))).alias("caps"), F.count(F.when(capped, 1)).alias("n"),
                        F.sum(F.when(~capped, F.col("weight"))).alias("free")).first()
        left, free = total - int(row["caps"] or 0), int(row["free"] or 0)
        if row["n"] == state or not free:
            break
        state = row["n"]
        capped = F.col("cap") * F.lit(free).cast("decimal(18,0)") <= \
            F.col("weight").cast("decimal(9,0)") * F.lit(left).cast(_WIDE)
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(free or 1))
    return table.select("source", "source_size",
                        F.when(capped, F.col("cap").cast("double")).otherwise(share).alias("target"))


def source_cuts(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, cut), stored: every document of a source is taken ``epochs`` times, and
    those with struct(key, id) <= ``cut`` once more; ``cut`` is null where there is no rest. ``rows`` is from
    ``sized``."""
    sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"),
                                              F.max(F.struct("key", "id")).alias("last"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_epochs)
    size = F.col("source_size")
    epochs = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(max_epochs))).otherwise(0)
    planned = targets.withColumn("epochs", epochs.cast("long")) \
        .withColumn("rest", F.col("target") - F.col("epochs") * size)
    # At most one row per partition and source.
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = _join_source(sums.withColumn("start", F.coalesce(F.sum("part_size").over(before), F.lit(0))), planned)
    inside = placed.filter("rest > 0 AND start + part_size > rest AND start <= rest").select(
        F.col("source").alias("cut_source"), F.col("part").alias("cut_part"), "start", "rest")
    running = Window.partitionBy("source", "part").orderBy("key", "id", "size").rowsBetween(
        Window.unboundedPreceding, -1)
    cut_rows = (
        rows.join(inside, rows["source"].eqNullSafe(inside["cut_source"]) & (F.col("part") == F.col("cut_part")))
        .withColumn("ahead", F.col("start") + F.coalesce(F.sum("size").over(running), F.lit(0)))
        .filter("ahead + size / 2 <= rest").select("source", F.struct("key", "id").alias("last"))
    )
    whole = placed.filter("rest > 0 AND start + part_size <= rest").select("source", "last")
    cuts = whole.unionByName(cut_rows).groupBy("source").agg(F.max("last").alias("cut"))
    joined = planned.join(cuts.withColumnRenamed("source", "cut_source"),
                          F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return stored(joined.select("source", "source_size", "target", "epochs", "cut"))


def _join_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    right = sources.withColumnRenamed("source", "right_source")
    return rows.join(right, F.col("source").eqNullSafe(F.col("right_source"))).drop("right_source")


def _drawn() -> Column:
    return F.coalesce(F.struct("key", "id") <= F.col("cut"), F.lit(False))


def _copies(drawn: Column) -> Column:
    return F.col("epochs") + drawn.cast("long")


def mix(docs: DataFrame, labels: DataFrame | None = None, **options) -> DataFrame:
    """One row per document: (doc_id, size, source_size, target, taken, copies).

    A null or empty text has size 0. Rows that repeat an id share one decision, equal keys are ordered by id, and a
    null source is a source of its own. A source with no words has target 0. An empty table gives an empty result.
    The same ids and sizes give the same mix in every run.
    """
    rows = sized(docs, labels, **options)
    joined = _join_source(rows, source_cuts(rows)).withColumn("copies", _copies(_drawn()))
    return joined.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                         (F.col("copies") * F.col("size")).alias("taken"), "copies")


def take_mix(docs: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text",
             source_column: str = "source", seed: str = SEED) -> DataFrame:
    """The documents of the mix with their columns, each as often as the mix takes it."""
    sizes = sized(docs, labels, id_column, text_column, source_column, seed)
    cuts = source_cuts(sizes)
    row_key = F.xxhash64("id", "source").alias("row_key")
    known = stored(_join_source(sizes, cuts).select(row_key, _drawn().alias("drawn")).distinct())
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_column).alias("id"),
                       F.col(source_column).alias("source")).withColumn("row_key", row_key)
    rows = screened(rows, "row_key", known.filter("drawn"), "maybe_drawn")
    rows = screened(rows, "row_key", known.filter("NOT drawn"), "maybe_not")
    sure = _join_source(rows.filter("maybe_drawn <> maybe_not"), cuts).withColumn("copies", _copies(F.col("maybe_drawn")))
    # Only these move: about one row in sixteen, and those whose hash stands for rows of both kinds.
    unsure = rows.filter("maybe_drawn = maybe_not")
    weight = F.lit(1.0)
    if labels is not None:
        unsure = unsure.join(label_weights(labels), F.col("id") == F.col("label_id"), "left")
        weight = F.coalesce("weight", F.lit(1.0))
    keyed = unsure.select("row", "source", "id", sample_key(F.col("id"), weight, seed).alias("key"))
    decided = _join_source(keyed, cuts).withColumn("copies", _copies(_drawn()))
    taken = sure.select("row", "copies").unionAll(decided.select("row", "copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
