"""Line dedup with two Bloom filters.

A line's key is the line stripped of white space at both ends, with A-Z lower-cased; each document counts a key once.
Spark hashes the keys; builder tasks stream the 64-bit hashes through two Bloom filters: "once" takes every hash, "twice"
those already in "once" (or twice in one batch). Builders merge associatively: twice = twice_a | twice_b | (once_a &
once_b), once = once_a | once_b, block by block. A hash in no "twice" filter was seen in one document only, so its lines
stay without moving. Only lines whose hash the merged "twice" filter holds (suspected repeats: real ones and false
positives) leave their task, with their key; an exact count of distinct documents per key confirms them, and the lines
of keys found in at least ``MIN_DOCS`` documents are dropped in every document.

The filters have ``BITS_PER_KEY`` bits for each (document, key) pair, at most ``MAX_BITS``; beyond that the false
positive rate rises and more lines take the exact path, which still decides every line. Nothing is sampled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import shuffle_partitions, stored

#: Fixed values of the contract: lines end at \n, keys are stripped of ASCII white space, repeats span 10 documents.
MIN_DOCS = 10
EDGE_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BITS_PER_KEY = 10
PROBES = 6
MIN_BITS, MAX_BITS = 1 << 16, 1 << 28
BLOCK_BITS = 1 << 21
PAIRS_PER_BUILDER = 1 << 20


def line_key(line: Column) -> Column:
    """The line without ASCII white space (0x20, 0x09 to 0x0D) at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(EDGE_CHARS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(text: Column) -> Column:
    """Distinct hashes of the non-empty keys of a text."""
    keys = F.filter(F.transform(_lines(text), line_key), lambda k: F.length(k) > 0)
    return F.array_distinct(F.transform(keys, lambda k: F.xxhash64(k)))


def _probes(h: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash, by double hashing: (PROBES, n)."""
    h = h.astype(np.uint64)
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)[:, None]
    return ((a[None, :] + steps * b[None, :]) & np.uint64(bits - 1)).astype(np.int64)


def _build(bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = np.zeros(bits, dtype=bool)
        twice = np.zeros(bits, dtype=bool)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            if len(flat) == 0:
                continue
            values, counts = np.unique(flat, return_counts=True)
            pos = _probes(values, bits)
            seen = once[pos].all(axis=0) | (counts > 1)
            twice[pos[:, seen].ravel()] = True
            once[pos.ravel()] = True
        blocks = max(1, bits // BLOCK_BITS)
        width = bits // blocks
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(blocks, dtype=np.int64)),
             pa.array([np.packbits(once[i * width:(i + 1) * width]).tobytes() for i in range(blocks)], pa.binary()),
             pa.array([np.packbits(twice[i * width:(i + 1) * width]).tobytes() for i in range(blocks)], pa.binary())],
            ["block", "once", "twice"])
    return build


def _merge(rows):
    """Merges the filters of all builders of one block."""
    import pandas as pd

    once = twice = None
    for a, b in zip(rows["once"], rows["twice"]):
        a = np.frombuffer(a, dtype=np.uint8)
        b = np.frombuffer(b, dtype=np.uint8)
        if once is None:
            once, twice = a.copy(), b.copy()
        else:
            twice |= b | (once & a)
            once |= a
    return pd.DataFrame({"block": [int(rows["block"].iloc[0])], "twice": [twice.tobytes()]})


def twice_filter(hashes: DataFrame, pairs: int) -> tuple[int, np.ndarray]:
    """(bits, packed "twice" filter) over the ``hashes`` column of arrays of key hashes."""
    bits = 1 << max(int(math.log2(MIN_BITS)), min(int(math.log2(MAX_BITS)), math.ceil(math.log2(max(1, pairs * BITS_PER_KEY)))))
    builders = max(1, min(shuffle_partitions(hashes.sparkSession), math.ceil(pairs / PAIRS_PER_BUILDER)))
    built = (hashes.repartition(builders).mapInArrow(_build(bits), "block long, once binary, twice binary")
             .groupBy("block").applyInPandas(_merge, "block long, twice binary"))
    # At most MAX_BITS / 8 bytes come to the driver, whatever the input.
    blocks = sorted(built.collect(), key=lambda r: r["block"])
    if not blocks:
        return bits, np.zeros(bits // 8, dtype=np.uint8)
    return bits, np.concatenate([np.frombuffer(r["twice"], dtype=np.uint8) for r in blocks])


def _suspects(bits: int, packed):
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            arrays = batch.column(2)
            offsets = arrays.offsets.to_numpy()
            flat = arrays.flatten().to_numpy(zero_copy_only=False)
            hit = twice[_probes(flat, bits)].all(axis=0) if len(flat) else np.zeros(0, dtype=bool)
            out = [flat[offsets[i]:offsets[i + 1]][hit[offsets[i]:offsets[i + 1]]].tolist() for i in range(len(arrays))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))],
                                             ["rid", "t", "suspect"])
    return probe


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, dropped = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        n_lines, n_dropped, digests = [], [], []
        for t, gone in zip(text, dropped):
            lines = (t or "").split("\n")
            gone = set(gone or ())
            kept = [line for i, line in enumerate(lines) if i not in gone]
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
            digests.append(hashlib.sha256("\n".join(kept).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                                          pa.array(digests, pa.string())], ["row", "n_lines", "n_dropped", "kept_sha256"])


def line_dedup(docs: DataFrame, min_docs: int = MIN_DOCS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: (row, n_lines, n_dropped, kept_sha256), ``row`` the struct of its columns.

    Texts split at \\n; null or empty text is one empty line. A key of at least one code point found in at least
    ``min_docs`` documents loses all its lines in every document; the other lines stay, joined by \\n. A document is a
    row: repeated rows count as often as they occur (rows are told apart by their place in the table, which a file scan
    gives alike each time). Lines whose key is empty always stay. Very long texts are split whole; an empty table gives
    an empty result. Columns of any name are carried untouched inside ``row``.
    """
    spark = docs.sparkSession
    base = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("t"), F.monotonically_increasing_id().alias("rid"))
    hashes = stored(base.select(_hashes(F.col("t")).alias("h")))
    pairs = hashes.agg(F.sum(F.size("h"))).first()[0] or 0
    bits, packed = twice_filter(hashes, pairs)
    shared = spark.sparkContext.broadcast(packed)
    # Suspected lines with their keys, found where the text lies: the only rows that move.
    probed = base.select("rid", "t", _hashes(F.col("t")).alias("h")).mapInArrow(
        _suspects(bits, shared), "rid long, t string, suspect array<long>")
    lines = stored(
        probed.filter(F.size("suspect") > 0)
        .select("rid", "suspect", F.posexplode(_lines(F.col("t"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .filter((F.length("key") > 0) & F.array_contains("suspect", F.xxhash64("key")))
        .select("rid", "pos", "key"))
    # An exact count of documents per key; counts combine before they move, so a key of a third of all rows is no task's load.
    repeated = (lines.select("key", "rid").distinct().groupBy(F.col("key").alias("r_key"))
                .agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs))
    dropped = (lines.join(repeated, F.col("key") == F.col("r_key")).groupBy(F.col("rid").alias("d_rid"))
               .agg(F.collect_list("pos").alias("dropped")))
    joined = base.join(dropped, F.col("rid") == F.col("d_rid"), "left").select("t", "dropped", "row")
    row_type = base.schema["row"].dataType.simpleString()
    return joined.mapInArrow(_assemble, f"row {row_type}, n_lines long, n_dropped long, kept_sha256 string")
