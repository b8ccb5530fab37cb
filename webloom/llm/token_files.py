"""Token ids in binary files: canonical length-limited Huffman codes from global counts.

Texts are encoded where they lie, each distinct run of letters or other unit of a batch once. The counts of all ids give one code book; ids are
placed in order of document id and written in blocks that can be read alone. A block is a row of a Parquet file: code
bits, bit offsets of every 64th id, and the ids and lengths of its documents. Spark's writer commits the files, so lost
executors leave no half-written block.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.llm.common import shared_folder, shuffle_partitions, stored
from webloom.llm.huffman import Decoder, canonical_codes, code_lengths, pack
from webloom.llm.words import Memo, large_slices, split_words

END_ID = 1
BLOCK_IDS = 1 << 19
#: Words remembered by a worker: this many, and as many from before.
MEMO_WORDS = 800_000
_TOKENS = "doc_id long, n_tokens long, ids binary"
_BLOCKS = "part int, block long, n_tokens long, doc_ids binary, doc_sizes binary, checkpoints binary, code binary"
_DOCS = "part int, block long, doc_id long, before long, n_tokens long, ids_crc32 long"
_memo: dict[str, Memo] = {}


def _id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


#: A run of letters up to Latin-1 and the ASCII punctuation behind it.
_PLAIN = r"^(?P<body>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[!-/:-@\[-`{-~]*)$"
_LETTERS = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+")


def _units(words: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(distinct units, place of each word's first one in them, place of its second one). The tokenizer reads capitals as
    small letters and never joins a letter to punctuation behind it, so plain words fall into small letters and closing
    punctuation. Letters beyond Latin-1 may turn into letter and mark when normalised, and special tokens hold letters
    behind punctuation: words with either are units as written, with an empty second one."""
    cut = pc.extract_regex(words, _PLAIN)
    plain = pc.is_valid(cut)
    body = pc.if_else(plain, pc.utf8_lower(pc.struct_field(cut, "body")), words)
    tail = pc.if_else(plain, pc.struct_field(cut, "tail"), "")
    coded = pa.concat_arrays([body, tail]).dictionary_encode()
    return coded.dictionary, coded.indices.slice(0, len(words)), coded.indices.slice(len(words))


class _WordEncoder:
    """Ids of words by the tokenizer. It drops white space, so a text's ids are those of its words in turn."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        # Tasks already share out the cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = _id_type(self.vocabulary)
        self.memo = _memo.setdefault(path, Memo(MEMO_WORDS))
        # Ids that close a run of letters, where the model marks them.
        mark = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closes = np.zeros(self.vocabulary, bool)
        if mark:
            self.closes[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(mark)]] = True

    def _spaced(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, where each run's end) of runs of letters read as one text; nothing if their ends do not show."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.closes[ids]) + 1
        return (ids, ends) if len(ends) == len(runs) and ends[-1] == len(ids) else None

    def _apart(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each unit's end) of any units."""
        coded = self.tokenizer.encode(units, is_pretokenized=True, add_special_tokens=False)
        owner = np.array([-1 if w is None else w for w in coded.word_ids], np.int64)
        return np.array(coded.ids, np.int64), np.searchsorted(owner, np.arange(1, len(units) + 1))

    def ids_of(self, units: list[str]) -> list[bytes]:
        memo, width = self.memo, np.dtype(self.kind).itemsize
        found = [memo[u] for u in units]
        new = [i for i, ids in enumerate(found) if ids is None]
        runs = [i for i in new if _LETTERS.fullmatch(units[i])]
        others = sorted(set(new).difference(runs))
        for places, spaced in ((runs, True), (others, False)):
            for at in range(0, len(places), 8192):
                asked = places[at:at + 8192]
                texts = [units[i] for i in asked]
                ids, ends = spaced and self._spaced(texts) or self._apart(texts)
                raw, begin = ids.astype(self.kind).tobytes(), 0
                for i, text, end in zip(asked, texts, (width * ends).tolist()):
                    found[i] = raw[begin:end]
                    memo.keep(text, found[i])
                    begin = end
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, where each text's end), ``end_id`` after each text."""
        distinct, places, first = split_words(texts)
        units, body, tail = _units(distinct)
        coded = pa.array(self.ids_of(units.to_pylist()), pa.large_binary())
        words = pc.binary_join_element_wise(coded.take(body), coded.take(tail), pa.scalar(b"", pa.large_binary()))
        words = pa.concat_arrays([words, pa.array([np.array([end_id], self.kind).tobytes()], pa.large_binary())])
        taken = words.take(pa.array(np.insert(places, first[1:], len(words) - 1)))
        _, offsets, data = taken.buffers()
        ends = np.frombuffer(offsets, np.int64)[taken.offset:][first[1:] + np.arange(1, len(first))]
        return np.frombuffer(data or b"", self.kind), ends // np.dtype(self.kind).itemsize


def token_ids(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text",
              end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian integers, two bytes each where the vocabulary allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _WordEncoder(tokenizer_path)
        for batch in large_slices(batches, 1):
            ids, ends = encoder.encode(batch.column(1), end_id)
            begins = np.concatenate([[0], ends[:-1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ends - begins),
                 pa.array([ids[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist())], pa.binary())],
                ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")) \
        .mapInArrow(run, _TOKENS)


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; tasks count first, so at most one row per task and id moves, and one per id arrives."""
    kind = _id_type(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            joined = b"".join(batch.column(0).to_pylist())
            counts += np.bincount(np.frombuffer(joined, kind), minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocabulary, np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_column: str = "doc_id",
                      text_column: str = "text", end_id: int = END_ID) -> None:
    """Blocks in ``folder``/blocks in order of document id, null ids first, and the code book in ``folder``/codebook.

    A null text counts as empty and holds the end id alone. Rows that repeat an id follow each other. A document is
    never cut, so one that is longer than a block has a block of its own. An empty table gives files without rows.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    vocabulary = max(end_id + 1, Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True))
    kind = _id_type(vocabulary)
    tokens = stored(token_ids(docs, tokenizer_path, id_column, text_column, end_id))
    counts = id_counts(tokens, vocabulary)
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)], "id long, bits int") \
        .coalesce(1).write.parquet(f"{folder}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def packed() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(v for _, v in held), kind)
            code, marks = pack(ids, codes, lengths)
            doc_ids = np.array([(0, 0) if d is None else (1, d) for d, _ in held], "<i8")
            sizes = np.array([len(v) // np.dtype(kind).itemsize for _, v in held], "<i8")
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block]), pa.array([len(ids)]), pa.array([doc_ids.tobytes()]),
                 pa.array([sizes.tobytes()]), pa.array([marks.astype("<u4").tobytes()]), pa.array([code])],
                ["part", "block", "n_tokens", "doc_ids", "doc_sizes", "checkpoints", "code"])

        for batch in batches:
            for doc_id, n, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and size + n > BLOCK_IDS:
                    yield packed()
                    held, size, block = [], 0, block + 1
                held.append((doc_id, value))
                size += n
        if held:
            yield packed()

    order = ["doc_id", "spread"]
    placed = tokens.withColumn("spread", F.xxhash64("ids")).repartitionByRange(shuffle_partitions(spark), *order)
    placed.sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids").mapInArrow(run, _BLOCKS) \
        .write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def read_code_book(spark: SparkSession, folder: str) -> np.ndarray:
    """Bits per id: at most one row per id of the vocabulary."""
    rows = spark.read.schema("id long, bits int").parquet(f"{folder}/codebook").collect()
    lengths = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.uint8)
    for row in rows:
        lengths[row["id"]] = row["bits"]
    return lengths


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the blocks: the number of ids before it in
    the whole corpus, its own, and the CRC of its ids as little-endian 32-bit integers."""
    lengths = read_code_book(spark, folder)
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                ids = decoder.unpack(row["code"], np.frombuffer(row["checkpoints"], "<u4"), row["n_tokens"])
                known = np.frombuffer(row["doc_ids"], "<i8").reshape(-1, 2)
                sizes = np.frombuffer(row["doc_sizes"], "<i8")
                ends = np.cumsum(sizes)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - s):4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int32()), pa.array([row["block"]] * n),
                     pa.array(known[:, 1], pa.int64(), mask=known[:, 0] == 0), pa.array(ends - sizes), pa.array(sizes),
                     pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "before", "n_tokens", "ids_crc32"])

    sizes = blocks.select("part", "block", "n_tokens")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, whatever the number of documents.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("block_start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part") \
        .select("part", "block", (F.col("part_start") + F.col("block_start")).alias("block_start"))
    docs = blocks.mapInArrow(run, _DOCS)
    return docs.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and read them back."""
    folder = shared_folder(docs.sparkSession)
    write_token_files(docs, tokenizer_path, folder, **options)
    return read_token_files(docs.sparkSession, folder)
