"""Document fingerprints by Order MinHash.

A text's k-mers are runs of words, long words being cut. Each k-mer gets the number of its occurrence, so repetition
counts. For each of 64 orders the two least k-mers are chosen and hashed in the order they stand in the text: moving
text changes the tuples as replacing it does, which follows edit distance where a plain MinHash would not.

To compare neighbours in order of id, texts move once: ids are cut into ranges at sampled quantiles, and the first
document of each range is given to the range before it as well, so each range is one sorted stream that holds one
document over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import shuffle_partitions
from webloom.llm.hashing import U64, mixed, prefix_hashes, span_hashes
from webloom.llm.words import gather, split_words
from webloom.operators.batches import pieces

ORDERS = 64
KMER_WORDS = 2
#: Bytes of a word that count as one unit.
UNIT_BYTES = 16
_PLACE_BITS = U64(28)
_HELD_CHARS = 4 << 20
_NONE = U64(2 ** 64 - 1)
_OUT = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double")


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each unit, first unit of each text plus the end)."""
    distinct, places, first = split_words(texts)
    sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer("".join(distinct.to_pylist()).encode(), np.uint8)
    per_word = -(-sizes // UNIT_BYTES)
    word_of = np.repeat(np.arange(len(sizes)), per_word)
    unit_base = np.cumsum(per_word) - per_word
    start = (ends - sizes)[word_of] + (np.arange(len(word_of)) - unit_base[word_of]) * UNIT_BYTES
    hashes = span_hashes(prefix_hashes(raw), start, np.minimum(start + UNIT_BYTES, ends[word_of]))
    order, unit_ends = gather(unit_base, per_word, places)
    return hashes[order], np.concatenate([[0], unit_ends])[first]


def signatures(texts: pa.Array, orders: int = ORDERS, kmer_words: int = KMER_WORDS) -> np.ndarray:
    """One row of 16-bit tuple hashes per text; all zero where a text has no word."""
    units, first = _units(texts)
    n_units = np.diff(first)
    counts = np.where(n_units >= kmer_words, n_units - kmer_words + 1, np.minimum(n_units, 1))
    result = np.zeros((len(texts), orders), np.uint16)
    rows = np.flatnonzero(counts)
    if not len(rows):
        return result
    counts, begins = counts[rows], first[:-1][rows]
    ends = np.cumsum(counts)
    base = ends - counts
    row_of = np.repeat(np.arange(len(rows)), counts)
    place = np.arange(len(row_of)) - base[row_of]
    start = begins[row_of] + place
    stop = np.minimum(start + kmer_words, first[1:][rows][row_of])
    kmers = span_hashes(prefix_hashes(units), start, stop)
    # The number of an occurrence is its place among equal k-mers of the text.
    own = kmers ^ mixed(row_of.astype(U64))
    by = np.argsort(own, kind="stable")
    new = np.concatenate([[True], own[by][1:] != own[by][:-1]])
    run = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    number = np.empty(len(by), np.int64)
    number[by] = run
    kmers = mixed(kmers + number.astype(U64) * U64(0x9E3779B97F4A7C15))
    marks = place.astype(U64)
    low = (U64(1) << _PLACE_BITS) - U64(1)
    seeds = mixed(np.arange(1, 2 * orders + 1, dtype=U64))
    single = counts == 1
    for i in range(orders):
        value = kmers ^ seeds[2 * i]
        value *= seeds[2 * i + 1] | U64(1)
        value &= ~low
        value |= marks
        least = np.minimum.reduceat(value, base)
        at = (least & low).astype(np.int64)
        value[base + at] = _NONE
        second = np.where(single, at, (np.minimum.reduceat(value, base) & low).astype(np.int64))
        left, right = kmers[base + np.minimum(at, second)], kmers[base + np.maximum(at, second)]
        result[rows, i] = (mixed(left * U64(3) + right) >> U64(48)).astype(np.uint16)
    return result


def _text(row: np.ndarray, empty: bool) -> str:
    return "" if empty else row.astype(">u2").tobytes().hex()


def likeness(left: np.ndarray, right: np.ndarray, left_empty: np.ndarray, right_empty: np.ndarray) -> np.ndarray:
    """Share of equal tuples; 1 of two texts without words, 0 of one with and one without."""
    same = (left == right).mean(axis=1)
    return np.where(left_empty | right_empty, (left_empty & right_empty).astype(float), same)


def edited(text: str, other: str) -> str:
    """``text`` with its second half replaced by as much of ``other``."""
    half = len(text) // 2
    return text[:len(text) - half] + other[:half]


def _described(texts: list[str]) -> list[tuple]:
    """Results for all texts but the last, each against the one after it."""
    changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:])]
    both = texts + changed
    marks = signatures(pa.array(both, pa.string()))
    empty = np.array([not t.strip(" \t\n\v\f\r") for t in both])
    n = len(texts)
    own, nxt, new = marks[:n - 1], marks[1:n], marks[n:]
    to_edited = likeness(own, new, empty[:n - 1], empty[n:])
    to_next = likeness(own, nxt, empty[:n - 1], empty[1:n])
    return [(len(texts[i]), hashlib.sha256(changed[i].encode()).hexdigest(), _text(own[i], empty[i]),
             _text(new[i], empty[n + i]), float(to_edited[i]), float(to_next[i])) for i in range(n - 1)]


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next).

    The next document is that of the next smaller id; the largest follows the smallest. Null ids come last, rows that
    repeat an id in the order of their texts' hashes. A null text counts as empty; a text without words has the empty
    fingerprint. A single document is its own next. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_column]
    tasks = shuffle_partitions(docs.sparkSession)
    probabilities = [i / (3 * tasks) for i in range(1, 3 * tasks)]
    row = docs.agg(F.percentile_approx(F.col(id_column), probabilities, 10_000)).first()[0]
    cuts = np.unique(np.array(row if row is not None else [], np.int64))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), 0, np.searchsorted(cuts, ids.fillna(0).astype(np.int64), "left")))

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).withColumn("range", range_of("doc_id"))
    # One row per range: its first document, and the range before it in descending order.
    tops = sorted((r["range"], r["top"]) for r in rows.groupBy("range").agg(F.max("doc_id").alias("top")).collect())
    follows = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    firsts = docs.sparkSession.createDataFrame(follows, f"top {kind}, before int")
    places = F.array_compact(F.array(
        F.struct(F.col("range"), F.lit(0).alias("borrowed")),
        F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(1).alias("borrowed")))))
    dealt = rows.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("top")), "left").select(
        "doc_id", "text", F.explode(places).alias("p")).select("p.range", "p.borrowed", "doc_id", "text")
    order = ["range", "borrowed", F.desc_nulls_last("doc_id"), F.xxhash64("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        current, closed, held = None, False, 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*_described(texts)))
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(ids[:len(texts) - 1], id_type), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            del ids[:-1], texts[:-1]
            return batch

        for batch in pieces(batches, 3):
            id_type = batch.schema.field(2).type
            for part, borrowed, doc_id, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if part != current:
                    ids, texts, current, closed, held = [], [], part, False, 0
                if closed:
                    continue
                ids.append(doc_id)
                texts.append(value)
                held += len(value)
                if borrowed:
                    closed = True
                if len(texts) > 1 and (closed or held >= _HELD_CHARS):
                    yield flush()
                    held = len(value)

    return dealt.repartition(tasks, "range").sortWithinPartitions(*order).mapInArrow(run, f"doc_id {kind}, {_OUT}")
