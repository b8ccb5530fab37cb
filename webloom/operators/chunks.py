"""Text chunks: whole pages to reader text, and long text to overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from webloom.functions import dom
from webloom.functions.text import PRODUCT_FILE_INDICATORS, PRODUCT_INDICATORS, contains_any
from webloom.operators.batches import pieces
from webloom.operators.nodes import parse_nodes

# Where the text of a shop page is, where it is not, and how long text is cut.
TEXT_TAGS = ("div", "span", "p", "h1", "h2", "h3", "h4", "img", "a")
TEXT_FILE_TAGS = (*TEXT_TAGS, "li")
SKIPPED_TAGS = ("script", "style", "nav", "footer", "header")
SEPARATORS = ("\n\n", "\n", " ", "")
CHUNK_CHARS = 4000
CHUNK_FILE_CHARS = 3000
OVERLAP_CHARS = 200


def _packed(pieces: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbouring pieces up to ``size``; each run starts with the end of the one before, up to ``overlap``."""
    first, total = 0, 0
    for last, piece in enumerate(pieces):
        if total + len(piece) > size and last > first:
            yield "".join(pieces[first:last]).strip()
            while total > overlap or (total > 0 and total + len(piece) > size):
                total -= len(pieces[first])
                first += 1
        total += len(piece)
    yield "".join(pieces[first:]).strip()


def _chunks(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> Iterator[str]:
    """Cut at the first separator that occurs; what is still too long is cut at the next ones."""
    level = next(i for i, s in enumerate(separators) if s in text)
    mark, finer = separators[level], separators[level + 1:]
    first, *others = text.split(mark) if mark else [""]
    pieces = [p for p in (first, *(mark + part for part in others)) if p] if mark else list(text)
    run: list[str] = []
    for piece in pieces:
        if len(piece) < size:
            run.append(piece)
            continue
        yield from _packed(run, size, overlap)
        run = []
        if finer:
            yield from _chunks(piece, size, overlap, finer)
        else:
            yield piece
    yield from _packed(run, size, overlap)


def chunk_text(texts: DataFrame, text: str = "text", keep: Sequence[str] = ("page_id",),
               size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``keep`` columns plus (chunk_no, chunk), greedy chunks of at most ``size`` characters, in order."""
    schema = T.StructType([texts.schema[c] for c in keep] + [
        T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, len(keep)):
            rows, numbers, chunks = [], [], []
            for row, value in enumerate(part.column(len(keep)).to_pylist()):
                for number, chunk in enumerate(c for c in _chunks(value or "", size, overlap) if c):
                    rows.append(row)
                    numbers.append(number)
                    chunks.append(chunk)
            kept = [column.take(pa.array(rows, pa.int64())) for column in part.columns[:len(keep)]]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(numbers, pa.int32()), pa.array(chunks, pa.string())], [*keep, "chunk_no", "chunk"])

    return texts.select(*keep, text).mapInArrow(cut, schema)


def chunk_fixed(texts: DataFrame, text: str = "text", keep: Sequence[str] = ("page_id",),
                size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Chunks at a fixed stride of ``size - overlap`` characters, without regard to words; all in the JVM."""
    stride = size - overlap
    starts = f"sequence(0, greatest(cast(ceil((length({text}) - {overlap}) / {stride}) AS INT) - 1, 0))"
    cut = f"transform({starts}, k -> substring({text}, k * {stride} + 1, {size}))"
    return texts.filter(f"length({text}) > 0").selectExpr(*keep, f"posexplode_outer({cut}) AS (chunk_no, chunk)")


def html_to_text(pages: DataFrame, tags: Sequence[str] = TEXT_TAGS, keep: Sequence[str] = ("page_id",)) -> DataFrame:
    """``keep`` columns plus ``text``: reader text of each page on one line."""
    return parse_nodes(pages, keep=keep, groups=(tags, SKIPPED_TAGS)).selectExpr(
        *keep, f"{dom.html_to_text('nodes')} AS text")


def filter_product_chunks(chunks: DataFrame, indicators: Sequence[str] = PRODUCT_INDICATORS) -> DataFrame:
    return chunks.filter(contains_any("chunk", indicators))


def product_chunks(pages: DataFrame, size: int = CHUNK_CHARS, from_file: bool = False) -> DataFrame:
    """(page_id, chunk_no, chunk): chunks of page text that are likely to show products."""
    tags = TEXT_FILE_TAGS if from_file else TEXT_TAGS
    indicators = PRODUCT_FILE_INDICATORS if from_file else PRODUCT_INDICATORS
    return filter_product_chunks(chunk_text(html_to_text(pages, tags), size=size), indicators)
