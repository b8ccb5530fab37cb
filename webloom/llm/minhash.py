"""Near-duplicate documents by one-permutation MinHash.

A document's shingles are hashed once; the hash range is cut into bins and the least hash of each bin is its signature,
with empty bins filled from others in an order that hashing gives (optimal densification). Rows of the signature form
bands. Documents with the same set are one class; classes that share a band are linked as a star to a centre, so a
bucket gives as many pairs as it has members. Every pair is confirmed on the full sets. Buckets that still hold several
components are asked again with other centres a few times. The classes of those that stay open meet in an exact join on
their rarest shingles, so no pair of a bucket is left untried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import screened, stored
from webloom.llm.graph import components
from webloom.llm.hashing import U64, mixed, prefix_hashes, span_hashes
from webloom.llm.words import split_words
from webloom.operators.batches import pieces

SHINGLE_WORDS = 5
PERCENT = 80
BINS = 128
BAND_ROWS = 4
_PROBES = 4096


def _lower(texts: pa.Array) -> pa.Array:
    """Texts with A to Z in lower case and all else unchanged."""
    texts = pc.fill_null(texts, "")
    data = texts.buffers()[2]
    if data is None:
        return texts
    raw = np.frombuffer(data, np.uint8)
    small = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    return pa.Array.from_buffers(texts.type, len(texts), [texts.buffers()[0], texts.buffers()[1], pa.py_buffer(small)],
                                 texts.null_count, texts.offset)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text plus the end)."""
    distinct, places, first = split_words(texts)
    sizes = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(x.as_buffer() for x in distinct), np.uint8) if len(distinct) else np.zeros(0, np.uint8)
    hashes = span_hashes(prefix_hashes(raw), ends - sizes, ends)
    return hashes[places], first


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer words than ``width`` are one shingle; no word, none."""
    words, first = word_hashes(_lower(texts))
    sums = prefix_hashes(words)
    sets = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a <= width:
            start, end = np.array([a] if b > a else [], np.int64), np.array([b] if b > a else [], np.int64)
        else:
            start = np.arange(a, b - width + 1)
            end = start + width
        sets.append(np.unique(span_hashes(sums, start, end)))
    return sets


def _probe_table(bins: int) -> np.ndarray:
    """Which bin an empty bin looks at in each attempt, the same for all documents."""
    grid = np.arange(bins, dtype=U64)[:, None] * U64(_PROBES) + np.arange(_PROBES, dtype=U64)[None, :]
    return (mixed(grid + U64(0x5851F42D4C957F2D)) % U64(bins)).astype(np.int64)


class Signer:
    def __init__(self, bins: int = BINS, band_rows: int = BAND_ROWS):
        self.bins, self.band_rows, self.probes = bins, band_rows, _probe_table(bins)
        self.edges = (np.arange(bins + 1, dtype=np.float64) * (2.0 ** 64 / bins))
        self.edges = np.array([min(int(e), 2 ** 64 - 1) for e in self.edges], U64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """Least hash per bin of a sorted set that is not empty."""
        at = np.searchsorted(shingles, self.edges)
        full = at[1:] > at[:-1]
        values = shingles[np.minimum(at[:-1], len(shingles) - 1)]
        empty = np.flatnonzero(~full)
        for attempt in range(_PROBES):
            if not len(empty):
                break
            looked = self.probes[empty, attempt]
            ok = full[looked]
            # Filled bins differ by the attempt, so two empty bins that look at the same one are no copies.
            values[empty[ok]] = mixed(values[looked[ok]] + U64(attempt + 1))
            empty = empty[~ok]
        return values

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.zeros(0, np.int64)
        rows = self.signature(shingles).reshape(-1, self.band_rows)
        key = np.arange(len(rows), dtype=U64)
        for i in range(self.band_rows):
            key = mixed(key * U64(0x9E3779B97F4A7C15) + rows[:, i])
        return key.view(np.int64)


def _sketched(docs: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(row_key, doc_id, n_shingles, cls, bands): ``cls`` is the hash of the set, null where it is empty."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in pieces(batches, 2):
            sets = shingle_sets(batch.column(2), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_class_of(s) for s in sets], pa.int64()),
                 pa.array([signer.bands(s) for s in sets], pa.list_(pa.int64()))],
                ["row_key", "doc_id", "n_shingles", "cls", "bands"])

    return _keyed(docs, id_column, text_column).mapInArrow(
        run, f"row_key long, doc_id {kind}, n_shingles long, cls long, bands array<long>")


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(F.xxhash64(id_column, text).alias("row_key"), F.col(id_column).alias("doc_id"),
                       text.alias("text"))


def _class_of(shingles: np.ndarray) -> int | None:
    import xxhash

    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), U64).view(np.int64)) if len(shingles) else None


def _sets(docs: DataFrame, wanted: DataFrame, id_column: str, text_column: str, width: int) -> DataFrame:
    """(cls, sig, shingles) of the wanted classes (row_key, cls), which are stored: one byte per bin, and the whole set.
    Texts of other classes stay where they are, but for a few that the screen lets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for batch in pieces(batches, 1):
            sets = shingle_sets(batch.column(1), width)
            rows = [(c, s) for c, s in zip(batch.column(0).to_pylist(), sets) if _class_of(s) == c]
            yield pa.RecordBatch.from_arrays(
                [pa.array([c for c, _ in rows], pa.int64()),
                 pa.array([signer.signature(s).astype(np.uint8).tobytes() for _, s in rows], pa.binary()),
                 pa.array([s.view(np.int64) for _, s in rows], pa.list_(pa.int64()))], ["cls", "sig", "shingles"])

    texts = screened(_keyed(docs, id_column, text_column).select("row_key", "text"), "row_key", wanted, "maybe") \
        .filter("maybe").select("row_key", "text").join(wanted, "row_key")
    return texts.select("cls", "text").mapInArrow(run, "cls long, sig binary, shingles array<long>")


#: Signature agreement under which a pair of large sets is not compared in full: more than five standard deviations
#: below that of a pair at the threshold.
_FAR = 0.18
_LEAST_FOR_ESTIMATE = 64


def _promising(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (a, b) without those whose signatures and sizes rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, sig_a, sig_b, size_a, size_b = (batch.column(i) for i in range(6))
            if not len(a):
                continue
            left, right = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(a), -1) for x in (sig_a, sig_b))
            agree = (left == right).mean(axis=1)
            small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
            keep = (100 * small >= percent * large) & (
                (small < _LEAST_FOR_ESTIMATE) | (agree >= percent / 100 - _FAR))
            yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], ["a", "b"])

    left = sets.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a"), F.size("shingles").cast("long").alias("n_a"))
    right = sets.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b"), F.size("shingles").cast("long").alias("n_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b") \
        .mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike enough. Sets are compared row by row in the JVM, so what a task holds is two
    sets and not a batch of them. The size of their file says little about what they take in memory, so they are merged
    at all sizes and never broadcast."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("set_a")).hint("merge")
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("set_b")).hint("merge")
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    sized = pairs.join(left, "a").join(right, "b").select(
        "a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).cast("long").alias("both"))
    return sized.filter(F.col("shared") * 100 >= percent * (F.col("both") - F.col("shared"))).select("a", "b")


def _with_centre(members: DataFrame, rank) -> DataFrame:
    """``members`` (band, cls, root, n) of the buckets that hold several components, with each bucket's centre ``c`` as
    struct(rank, cls, root): the member of the highest rank."""
    ranked = F.struct(rank.alias("rank"), F.col("cls"), F.col("root"))
    centres = members.groupBy("band").agg(F.max(ranked).alias("c"), F.min("root").alias("low"),
                                          F.max("root").alias("high")).filter("low <> high").select("band", "c")
    return members.join(centres, "band")


def _star(centred: DataFrame) -> DataFrame:
    """Pairs (a, b) of each member with the centre of its bucket, where their components differ."""
    return centred.filter("root <> c.root").select(
        F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b")).distinct()


def _rest(centred: DataFrame) -> DataFrame:
    """The buckets without their centres, which have met all other members, where two or more are left."""
    return centred.filter("cls <> c.cls AND n > 2").select("band", "cls", (F.col("n") - 1).alias("n"))


#: Rounds of stars after the first. They only save rows of the exact join that follows.
STAR_ROUNDS = 3
#: Postings of a shingle that meet in one task, on either side.
BLOCK = 512
_COUNTERS = 1 << 20


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (band, cls, n) with the component of each class."""
    return members.join(roots, members["cls"] == roots["node"], "left").select(
        "band", "cls", "n", F.coalesce("root", "cls").alias("root"))


def _open(members: DataFrame) -> DataFrame:
    """(cls, root) of the classes in buckets that hold several components."""
    several = members.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")) \
        .filter("low <> high").select("band")
    return members.join(several, "band", "left_semi").select("cls", "root").distinct()


def _shingle_counts(sets: DataFrame) -> np.ndarray:
    """In how many sets shingles lie, by hash: shingles of one counter share a count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_COUNTERS, np.int64)
        for batch in batches:
            tokens = batch.column(0).flatten().to_numpy()
            counts += np.bincount(tokens & (_COUNTERS - 1), minlength=_COUNTERS)
        used = np.flatnonzero(counts)
        for at in range(0, len(used), 1 << 16):
            some = used[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["counter", "n"])

    found = sets.select("shingles").mapInArrow(run, "counter long, n long").groupBy("counter").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros(_COUNTERS, np.int64)
    counts[found["counter"].to_numpy()] = found["n"].to_numpy()
    return counts


def _postings(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(token, cls, root, n, pos) of the rarest shingles of each set. Two sets at the threshold share one of them: fewer
    than all but ``percent`` of a set can be missing in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
            for cls, root, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         np.split(values, ends[:-1])):
                n = len(tokens)
                first = np.lexsort((tokens, counts[tokens & (_COUNTERS - 1)]))[:n + percent * -n // 100 + 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tokens[first]), *(pa.array(np.full(len(first), x)) for x in (cls, root, n)),
                     pa.array(np.arange(len(first)))], ["token", "cls", "root", "n", "pos"])

    return sets.select("cls", "root", "shingles").mapInArrow(run, "token long, cls long, root long, n long, pos long")


def _prefix_pairs(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``classes`` (cls, root) that hold every pair at the threshold whose components differ.

    Shingles stand in one order, rare ones first. A shared shingle counts only where what follows it in both sets still
    reaches the threshold, as it does for the first one that such a pair shares. Each component but the largest of a
    shingle meets all others, dealt in blocks of both sides.
    """
    held = stored(sets.join(classes, "cls").select("cls", "root", "shingles"))
    postings = stored(_postings(held, _shingle_counts(held), percent))
    shared = postings.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")) \
        .filter("low <> high").select("token")
    postings = stored(postings.join(shared, "token"))
    tops = postings.groupBy("token", "root").agg(F.count("*").alias("c")).groupBy("token").agg(
        F.max_by("root", F.struct("c", "root")).alias("top"), F.ceil(F.sum("c") / BLOCK).alias("n_right"),
        F.ceil((F.sum("c") - F.max("c")) / BLOCK).alias("n_left"))
    dealt = postings.join(tops, "token")

    def blocks(n: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select("token", "p", "q", *[F.col(c).alias(f"{c}_{name}") for c in ("cls", "root", "n", "pos")],
                           *["top"] * (name == "l"))

    left = side(dealt.filter("root <> top").withColumn("p", F.pmod(F.xxhash64("cls"), "n_left"))
                .withColumn("q", blocks("n_right")), "l")
    right = side(dealt.withColumn("q", F.pmod(F.xxhash64("cls", F.lit(1)), "n_right"))
                 .withColumn("p", blocks("n_left")), "r")
    near = F.expr(f"root_l <> root_r AND (root_r = top OR cls_l < cls_r) AND "
                  f"least(n_l - pos_l, n_r - pos_r) * {100 + percent} >= {percent} * (n_l + n_r)")
    same = [left[c] == right[c] for c in ("token", "p", "q")]
    return left.join(right, same[0] & same[1] & same[2] & near).select(
        F.least("cls_l", "cls_r").alias("a"), F.greatest("cls_l", "cls_r").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                    shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id, kept).

    Documents with ``100 * intersection >= percent * union`` of their shingle sets are linked; ``component_id`` is the
    smallest id that links reach, and the document with that id is kept. A null or empty text has no shingle, is linked
    with nothing and kept. Rows that repeat an id and text share a class. An empty table gives an empty result.

    Candidates come from 32 bands of 4 rows: a pair at 0.8 misses all of them once in ten million. The first round
    takes as centre of each bucket the class that lies in the largest buckets. A centre has met all members and leaves.
    Buckets whose other members still belong to several components are asked again with a centre drawn by hash, up to
    ``STAR_ROUNDS`` times or until a round links nothing new. The classes of buckets that are still open are joined by
    their rarest shingles, which finds all their pairs at the threshold.
    """
    sketch = stored(_sketched(docs, id_column, text_column, shingle_words))
    classes = stored(sketch.filter("cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("least_id"), F.min_by("bands", "row_key").alias("bands"),
        F.min("row_key").alias("row_key")))
    banded = classes.select("cls", F.explode("bands").alias("band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    # Spark takes an exploded table for no longer than the one it comes from, so it does not choose this join.
    members = stored(banded.join(sizes.hint("merge"), "band").select("band", "cls", "n"))
    wanted = stored(classes.join(members.select("cls").distinct(), "cls", "left_semi").select("row_key", "cls"))
    sets = stored(_sets(docs, wanted, id_column, text_column, shingle_words).dropDuplicates(["cls"]))
    standing = members.groupBy("cls").agg(F.sum("n").alias("standing"))
    centred = _with_centre(members.join(standing, "cls").withColumn("root", F.col("cls")), F.col("standing")).persist()
    links = stored(_confirmed(_promising(_star(centred), sets, percent), sets, percent))
    roots = components(links)
    for seed in range(1, STAR_ROUNDS + 1):
        members = stored(_rest(centred))
        centred.unpersist()
        centred = _with_centre(_rooted(members, roots), F.xxhash64("cls", "band", F.lit(seed))).persist()
        new = stored(_confirmed(_promising(_star(centred), sets, percent), sets, percent))
        if new.isEmpty():
            break
        links = links.union(new)
        roots = components(links)
    left_open = stored(_open(_rooted(_rest(centred), roots)))
    centred.unpersist()
    if not left_open.isEmpty():
        new = stored(_confirmed(_prefix_pairs(left_open, sets, percent), sets, percent))
        roots = components(links.union(new))
    labelled = classes.select("cls", "least_id").join(roots, classes["cls"] == roots["node"], "left").select(
        "cls", "least_id", F.coalesce("root", "cls").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = labelled.join(least, "root").select("cls", "component_id", "root")
    found = sketch.select("row_key", "doc_id", "n_shingles", "cls").join(names, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.col("doc_id").eqNullSafe(component).alias("kept"), "row_key", "root")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                         shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stays, with all their columns.

    Decided by row, not by id: of each group of linked texts the row with the smallest id stays (null ids last, then the
    smaller row key), so two texts under one id are judged apart and a group of null-id rows keeps one. Rows that repeat
    both id and text are one document and stay or go together. Null, empty and wordless texts link with nothing and
    stay. An empty table gives an empty table; other columns, whatever their names, come back unchanged.
    """
    found = stored(near_duplicates(docs, id_column, text_column, shingle_words, percent).select("doc_id", "row_key", "root")
                   .filter("root IS NOT NULL"))
    # The best row of a group by an aggregate that combines before it moves: a group of a third of all rows is no task's load.
    # A row without shingles is a group of its own (and of its exact repeats), so it stays.
    keep = found.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), "row_key"))["row_key"].alias("kept_key")
    ).select("kept_key")
    gone = stored(found.select("row_key").distinct().join(keep, F.col("row_key") == F.col("kept_key"), "left_anti")
                  .select(F.col("row_key").alias("__row_key")))
    # Only rows that the screen takes for dropped ones move: most texts stay where they are.
    keyed = screened(docs.withColumn("__row_key", F.xxhash64(F.col(id_column), F.col(text_column).cast("string"))),
                     "__row_key", gone, "__maybe")
    checked = keyed.filter("__maybe").join(gone, "__row_key", "left_anti")
    return keyed.filter("NOT __maybe").drop("__row_key", "__maybe").unionAll(checked.drop("__row_key", "__maybe"))
