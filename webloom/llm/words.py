"""Words of Arrow text columns, counted once each: a text column becomes distinct words and places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def large_slices(batches: Iterator[pa.RecordBatch], text_column: int, limit: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of about ``limit`` bytes of text, or one row: the larger a piece, the fewer distinct words per text."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, place of each word in them, first word of each text plus the end). Null counts as empty; words
    lie between white space 0x20 and 0x09 to 0x0D."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    return indexed(lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()),
                    lists.offsets.to_numpy() - lists.offsets[0].as_py())


def indexed(values: pa.Array, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate([[0], np.cumsum(full)])
    coded = values.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), before[offsets]


def gather(starts: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the elements of ragged rows taken in ``order``, and where each row ends among them."""
    n = lengths[order]
    ends = np.cumsum(n)
    shift = np.repeat(starts[order] - (ends - n), n)
    return shift + np.arange(len(shift)), ends


class Memo(dict):
    """A bounded memory of a worker: what was not asked for while ``limit`` new entries came is forgotten."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
