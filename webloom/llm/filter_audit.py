"""Filter interaction audit by sorted posting lists.

Each filter keeps, per part, the sorted list of the row ids that fail it; the labels give two more lists (good and
toxic rows). The lists are range-partitioned by (part, id), so one task holds every list of one id range, already
sorted, and merges them: a galloping k-way merge (exponential search into each list from its last position) yields,
for every id in the range, which lists hold it. The task sums sizes by that pattern, so what leaves it is at most
2**7 counts per part. Spark adds the counts of all ranges; every union, difference and intersection the report needs
is a sum of those sizes. An order of filters removes a row at the first of its failing filters; over all 120 orders a
row failing k filters is removed by each of them in 120 / k orders.

Only the 120 orders are written out by rule (all permutations of the five letters); nothing is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import WORDS, shuffle_partitions, stored

# Fixed values of the contract: the five filters, in letter order.
FILTERS = "ABCDE"
MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 2
SYMBOLS = "[#$%&*|]"
GOOD, TOXIC = 5, 6
ORDERS = ["".join(p) for p in permutations(FILTERS)]


def failures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source") -> DataFrame:
    """(part, rid, doc_id, fails): one row per row of ``docs``, ``fails`` a bit per filter (A = 1 ... E = 16).

    Null text counts as empty and a null part as the empty string. E fails where a row with a smaller id has the
    identical text anywhere in the table; null ids count as the largest, so a null-id row fails E when a row with an id
    has its text, and rows of equal id and text never fail each other. ``rid`` numbers rows uniquely.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORDS), 0)
    n_words = F.size(words)
    upper = F.length(F.regexp_replace(text, "[^A-Z]", ""))
    bits = (
        F.when(n_words < MIN_WORDS, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n_words, 2).otherwise(0)
        + F.when(100 * upper > UPPER_PERCENT * F.length(text), 4).otherwise(0)
        + F.when(text.rlike(SYMBOLS), 8).otherwise(0))
    # Texts leave the scan as digests; only ids, digests and bits move.
    base = docs.select(
        F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"), F.col(id_column).alias("doc_id"),
        F.sha2(text, 256).alias("digest"), bits.alias("fails"), F.monotonically_increasing_id().alias("rid"))
    # Smallest id per text: counts combine before they move, so a text held by a third of all rows is one row per task.
    firsts = base.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    first = F.col("first_id")
    fails_e = F.when(F.col("doc_id").isNull(), first.isNotNull()).otherwise(F.coalesce(F.col("doc_id") > first, F.lit(False)))
    return stored(base.join(firsts, "digest", "left").select(
        "part", "rid", "doc_id", (F.col("fails") + F.when(fails_e, 16).otherwise(0)).alias("fails")))


def posting_lists(failed: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(part, list, rid): one entry per failing filter of a row (list 0-4), and per good (5) or toxic (6) row."""
    lists = F.array_compact(F.array(*[F.when(F.col("fails").bitwiseAND(1 << k) != 0, F.lit(k)) for k in range(5)]))
    if labels is not None:
        marks = labels.groupBy(F.col("doc_id").alias("label_id")).agg(
            F.max(F.when(F.col("quality") == 1, 1)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1)).alias("toxic"))
        failed = failed.join(marks, failed["doc_id"] == marks["label_id"], "left")
        lists = F.concat(lists, F.array_compact(F.array(F.when(F.col("good") == 1, F.lit(GOOD)),
                                                          F.when(F.col("toxic") == 1, F.lit(TOXIC)))))
    return failed.select("part", "rid", F.explode(lists).alias("list"))


def _gallop(ids: np.ndarray, start: int, target: int) -> int:
    """First position at or after ``start`` whose id is not below ``target``: steps double, then halve."""
    step, hi = 1, start
    while hi < len(ids) and ids[hi] < target:
        start, hi, step = hi + 1, hi + step, step * 2
    return int(np.searchsorted(ids[start:min(hi + 1, len(ids))], target) + start)


def merge_counts(lists: list[np.ndarray]) -> dict[int, int]:
    """Counts of ids by the pattern of sorted lists that hold them (bit i: list i), by a galloping k-way merge."""
    heads = [0] * len(lists)
    counts: dict[int, int] = {}
    while True:
        live = [lists[i][heads[i]] for i in range(len(lists)) if heads[i] < len(lists[i])]
        if not live:
            return counts
        low = min(live)
        mask = 0
        for i, ids in enumerate(lists):
            if heads[i] < len(ids) and ids[heads[i]] == low:
                mask |= 1 << i
                heads[i] += 1
        # Runs that one list holds alone are counted at once: gallop to the next id of any other list.
        if mask & (mask - 1) == 0:
            i = mask.bit_length() - 1
            others = [lists[j][heads[j]] for j in range(len(lists)) if j != i and heads[j] < len(lists[j])]
            stop = _gallop(lists[i], heads[i], min(others)) if others else len(lists[i])
            counts[mask] = counts.get(mask, 0) + 1 + stop - heads[i]
            heads[i] = stop
        else:
            counts[mask] = counts.get(mask, 0) + 1


def _merge_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: the sorted entries of its id range, merged per part."""
    table = pa.Table.from_batches(list(batches))
    if table.num_rows == 0:
        return
    parts = table.column("part").to_pylist()
    lists = table.column("list").to_numpy()
    rids = table.column("rid").to_numpy()
    out_part, out_mask, out_n = [], [], []
    edges = [0] + [i for i in range(1, len(parts)) if parts[i] != parts[i - 1]] + [len(parts)]
    for lo, hi in zip(edges, edges[1:]):
        sub_lists, sub_rids = lists[lo:hi], rids[lo:hi]
        counts = merge_counts([np.sort(sub_rids[sub_lists == k]) for k in range(7)])
        for mask, n in counts.items():
            out_part.append(parts[lo])
            out_mask.append(mask)
            out_n.append(n)
    yield pa.RecordBatch.from_arrays([pa.array(out_part, pa.string()), pa.array(out_mask, pa.int64()),
                                      pa.array(out_n, pa.int64())], ["part", "mask", "n"])


def pattern_counts(failed: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(part, fails, n, n_good, n_toxic): rows by their set of failing filters; rows failing none included."""
    spark = failed.sparkSession
    entries = posting_lists(failed, labels)
    merged = (entries.repartitionByRange(shuffle_partitions(spark), "part", "rid").sortWithinPartitions("part", "list", "rid")
              .mapInArrow(_merge_ranges, "part string, mask long, n long")
              .groupBy("part", "mask").agg(F.sum("n").alias("n")))
    fails = F.col("mask").bitwiseAND(31)
    sized = merged.filter(fails != 0).groupBy("part", fails.alias("fails")).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("mask").bitwiseAND(1 << GOOD) != 0, F.col("n")).otherwise(0)).alias("n_good"),
        F.sum(F.when(F.col("mask").bitwiseAND(1 << TOXIC) != 0, F.col("n")).otherwise(0)).alias("n_toxic"))
    totals = failed.groupBy("part").agg(F.count("*").alias("n_rows"))
    return totals.join(sized, "part", "left")


def audit(docs: DataFrame, labels: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text",
          part_column: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step: (part, filter_order, step, filter, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley).

    Counts are of rows within the part. ``kept``: rows failing none of the first ``step`` filters; ``removed``: rows
    failing this step's filter and none before; ``redundant``: failing it and one before; ``unique_fails``: failing this
    filter only; ``good_lost`` and ``toxic_lost``: removed rows that ``labels`` (doc_id, quality, toxic) marks good
    (quality 1) or toxic (toxic 1) in any of their label rows; ``shapley``: this filter's removals summed over all 120
    orders. Every part present gets all 600 rows, zeros included; an empty table gives no rows. Repeated rows count
    each time; null ids never match labels. Other columns of ``docs``, whatever their names, are not read.
    """
    counts = pattern_counts(failures(docs, id_column, text_column, part_column), labels)
    per_part = counts.groupBy("part").agg(
        F.first("n_rows").alias("n_rows"),
        F.filter(F.collect_list(F.struct("fails", "n", "n_good", "n_toxic", (F.col("n") * F.expr("120 div bit_count(fails)")).alias("w"))),
                 lambda s: s["fails"].isNotNull()).alias("pats"))
    steps = F.array(*[F.struct(F.lit(order).alias("filter_order"), F.lit(step + 1).alias("step"),
                               F.lit(order[step]).alias("filter"), F.lit(1 << FILTERS.index(order[step])).alias("bit"),
                               F.lit(sum(1 << FILTERS.index(c) for c in order[:step])).alias("before"))
                      for order in ORDERS for step in range(5)])
    rows = per_part.select("part", "n_rows", "pats", F.explode(steps).alias("s")).select("part", "n_rows", "pats", "s.*")

    def total(cond, field="n"):
        return F.aggregate(F.filter("pats", cond), F.lit(0).cast("long"), lambda acc, p: acc + p[field])

    def has(p, m):
        return p["fails"].bitwiseAND(m) != 0

    bit, before = F.col("bit"), F.col("before")
    removed = lambda p: has(p, bit) & ~has(p, before)
    failing_so_far = total(lambda p: has(p, bit.bitwiseOR(before)))
    ones = total(lambda p: has(p, bit), "w")
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), "filter",
        (F.col("n_rows") - failing_so_far).alias("kept"), total(removed).alias("removed"),
        total(lambda p: has(p, bit) & has(p, before)).alias("redundant"),
        total(lambda p: p["fails"] == bit).alias("unique_fails"), total(removed, "n_good").alias("good_lost"),
        total(removed, "n_toxic").alias("toxic_lost"), ones.alias("shapley"))
