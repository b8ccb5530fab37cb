"""Repeated passages removed by hashing units.

A text is cut into paragraphs, lines and sentences. Whole lines and paragraphs are compared with each other, and
sentences with sentences, by a digest of their normalised form over the whole corpus; the occurrence that comes first by
(document id, offset) stays. Every other whole line or paragraph is removed, however short. Of repeated sentences inside
lines a run of neighbours that is long enough is removed: short phrases that many documents share by nature stay, while
a passage goes whole, with the short sentences inside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import stored
from webloom.operators.batches import pieces

#: Least number of words of a removed run of sentences inside lines.
MIN_RUN_WORDS = 20
_UNIT = re.compile(r"[^\n]*?[.!?]+(?=\s|$)|[^\n]+")
_LINE = re.compile(r"[^\n]+")
_ROWS = 1 << 16
#: What a span is: a sentence, a whole line or paragraph, or both.
_SENTENCE, _WHOLE = 1, 2


def units(text: str) -> list[tuple[int, int]]:
    """Spans of sentences within lines, without the white space around them."""
    found = []
    for match in _UNIT.finditer(text):
        piece = match[0]
        body = piece.strip()
        if body:
            start = match.start() + len(piece) - len(piece.lstrip())
            found.append((start, start + len(body)))
    return found


def wholes(text: str) -> list[tuple[int, int]]:
    """Spans of lines, and of paragraphs of several lines, without the white space around them. Blank lines part
    paragraphs."""
    found, first, last, lines = [], 0, -1, 0
    for match in _LINE.finditer(text):
        piece = match[0]
        body = piece.strip()
        if not body:
            continue
        start = match.start() + len(piece) - len(piece.lstrip())
        if last < 0 or text[last:start].count("\n") > 1:
            if lines > 1:
                found.append((first, last))
            first, lines = start, 0
        last, lines = start + len(body), lines + 1
        found.append((start, last))
    if lines > 1:
        found.append((first, last))
    return found


def digest(unit: str) -> tuple[int, int]:
    """128 bits of a unit in small letters with single spaces, as two signed numbers."""
    import xxhash

    value = xxhash.xxh3_128_digest(" ".join(unit.lower().split()).encode("utf-8", "surrogatepass"))
    return int.from_bytes(value[:8], "little", signed=True), int.from_bytes(value[8:], "little", signed=True)


def _occurrences(docs: DataFrame) -> DataFrame:
    """(d1, d2, doc_id, start, what) of every sentence, line and paragraph."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            rows: list[tuple] = []

            def flush() -> pa.RecordBatch:
                d1, d2, own, start, what = zip(*rows)
                rows.clear()
                return pa.RecordBatch.from_arrays(
                    [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(own, id_type),
                     pa.array(start, pa.int32()), pa.array(what, pa.int8())], ["d1", "d2", "doc_id", "start", "what"])

            id_type = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = dict.fromkeys(units(text or ""), _SENTENCE)
                for span in wholes(text or ""):
                    spans[span] = spans.get(span, 0) | _WHOLE
                for (start, end), what in spans.items():
                    rows.append((*digest(text[start:end]), doc_id, start, what))
                if len(rows) >= _ROWS:
                    yield flush()
            if rows:
                yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, f"d1 long, d2 long, doc_id {kind}, start int, what byte")


def removed_runs(text: str, repeats: set[tuple[int, int]], min_run_words: int) -> tuple[int, list[tuple[int, int]]]:
    """(number of units, spans to remove): runs of units whose (start, first half of the digest) is in ``repeats``."""
    spans, run, words = [], [], 0
    found = units(text)
    for start, end in [*found, (len(text), len(text))]:
        unit = text[start:end]
        if unit and (start, digest(unit)[0]) in repeats:
            run.append((start, end))
            words += len(unit.split())
            continue
        if words >= min_run_words:
            spans.append((run[0][0], run[-1][1]))
        run, words = [], 0
    return len(found), spans


def joined_spans(text: str, *lists: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of all lists in order; those that overlap, or with only white space between them, are one."""
    merged: list[tuple[int, int]] = []
    for start, end in sorted(span for spans in lists for span in spans):
        if merged and (start <= merged[-1][1] or not text[merged[-1][1]:start].strip()):
            merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
        else:
            merged.append((start, end))
    return merged


def without(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for start, end in spans:
        kept.append(text[at:start])
        at = end
    return "".join([*kept, text[at:]])


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 min_run_words: int = MIN_RUN_WORDS) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_units, n_removed_chars, removed, text).

    ``removed`` lists the removed spans of the original text as start:end in code points, end exclusive, and ``text`` is
    what remains. A null text counts as empty. Null ids rank first; rows that repeat an id rank alike, and rows that
    repeat id and text keep the same. A text of one repeated unit becomes empty, not a missing row. ``n_units`` counts
    sentences; ``min_run_words`` holds for runs of them and not for whole lines and paragraphs. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    # Written once: the grouping and the join below would otherwise each run the Python pass over all texts.
    seen = stored(_occurrences(rows))
    rank = F.struct("doc_id", "start")
    # Combined before it moves, so a unit in every document costs a row per task.
    sentence, whole = (F.col("what").bitwiseAND(kind_of) != 0 for kind_of in (_SENTENCE, _WHOLE))
    first = seen.groupBy("d1", "d2").agg(
        F.min(F.when(sentence, rank)).alias("first"), F.min(F.when(whole, rank)).alias("first_whole"),
        F.count("*").alias("n")).filter("n > 1").select("d1", "d2", "first", "first_whole")
    again = F.when(sentence & (rank != F.col("first")), _SENTENCE).otherwise(0) + F.when(
        whole & (rank != F.col("first_whole")), _WHOLE).otherwise(0)
    later = seen.join(first, ["d1", "d2"]).withColumn("again", again).filter("again > 0") \
        .groupBy("doc_id").agg(F.collect_list(F.struct("start", "d1", "again")).alias("repeats"))
    listed = later.select(F.col("doc_id").alias("repeat_id"), "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            counts, removed, texts, lost = [], [], [], []
            for text, repeats in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                text = text or ""
                known = {(r["start"], r["d1"]) for r in repeats or () if r["again"] & _SENTENCE}
                gone = {(r["start"], r["d1"]) for r in repeats or () if r["again"] & _WHOLE}
                n, spans = removed_runs(text, known, min_run_words)
                if gone:
                    spans = joined_spans(text, spans, [
                        (a, b) for a, b in wholes(text) if (a, digest(text[a:b])[0]) in gone])
                counts.append(n)
                removed.append(",".join(f"{a}:{b}" for a, b in spans))
                texts.append(without(text, spans))
                lost.append(len(text) - len(texts[-1]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(lost, pa.int64()),
                 pa.array(removed, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_units", "n_removed_chars", "removed", "text"])

    joined = rows.join(listed, rows["doc_id"].eqNullSafe(listed["repeat_id"]), "left").select("doc_id", "text", "repeats")
    return joined.mapInArrow(run, f"doc_id {kind}, n_units long, n_removed_chars long, removed string, text string")
