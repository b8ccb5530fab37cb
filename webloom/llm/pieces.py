"""Sampled SentencePiece segmentations by forward filtering and backward sampling over the piece lattice.

A text is a dummy space and its characters. Every vocabulary piece that matches is an edge of its lattice; a character
that no piece holds is the edge of its bytes. The weight of a piece falls with its rank. Forward sums give the share of
all weighted paths that reach a place; a path is then drawn backwards from the end. No piece has a space behind another
character or a line break, so the lattice falls apart at these places, and the sums of a stretch are made once for all
its occurrences in a slice. Edges are found by walking a trie of the pieces from all places at once, and stay in arrays:
a worker remembers no stretch from slice to slice, since most of them do not come again. Draws are hashes of the row key, the stretch and the step, so they depend on nothing else.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.hashing import U64, mixed
from webloom.llm.words import gather, indexed, large_slices

#: Exponent of the piece weights: 0 draws all paths alike, larger values prefer frequent pieces.
SHARPNESS = 0.5
#: Longer stretches are walked one by one.
LONG = 48
_STRETCH = re.compile(r" *[^ \n]+|\n| +")
_MARK = "\x1f"
_PER_CHAR = 8.0
#: What a worker holds at a time grows with these two, results do not depend on them. Places of the characters whose
#: lattices are built together fit 16 bits.
CHARS_AT_ONCE = 60_000
SLICE_BYTES = 1 << 20
_SPREAD = U64(0x9E3779B97F4A7C15)
_SLOT_BITS = 20
_models: dict[tuple[str, float], "Lattice"] = {}


def _seeds(row_keys: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    return mixed(row_keys.astype(np.int64).view(U64) + stretch.astype(U64) * U64(0x9E3779B97F4A7C15))


def _draws(seeds: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Uniform numbers in [0, 1)."""
    return (mixed(seeds + (step.astype(U64) + U64(1)) * U64(0xD1B54A32D192ED03)) >> U64(11)) * 2.0 ** -53


def _spread(nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Different numbers for all pairs of a node and a character; their first bits are well spread."""
    return ((nodes.astype(U64) << U64(21)) | chars) * _SPREAD


def _chosen(edge: np.ndarray, shares: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The first edge from ``edge`` on whose running share is above the draw; the last share of a place is 1."""
    rest = np.arange(len(edge))
    while len(rest):
        rest = rest[shares[edge[rest]] <= draws[rest]]
        edge[rest] += 1
    return edge


class Lattice:
    """The pieces of a model, and lattices of stretches by them."""

    def __init__(self, path: str, sharpness: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.byte_id = [0] * 256
        self.weight: dict[str, tuple[int, float]] = {}
        raw: list[bytes] = []
        rank = 0
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                rank += 1
                text = piece.replace("▁", " ")
                self.weight[text] = (i, (1.0 / (rank + 2)) ** sharpness * _PER_CHAR ** len(text))
                raw.append(text.encode())
        self.longest = max(map(len, self.weight))
        self.code_weight = np.zeros(self.size)
        for code, weight in self.weight.values():
            self.code_weight[code] = weight
        self._plant()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_sizes = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        # Codes from ``size`` on stand for characters without a piece.
        self.other: dict[str, int] = {}
        self.code_ids: list[list[int]] = []

    def _plant(self) -> None:
        """The trie of the pieces. The node under ``node`` by ``char`` stands in ``links`` at its spread key; ``slots`` says
        where links with the same first bits begin."""
        nodes: dict[tuple[int, str], int] = {}
        code_of, inner = [-1], [False]
        for text, (code, _) in self.weight.items():
            node = 0
            for char in text:
                inner[node] = True
                below = nodes.get((node, char))
                if below is None:
                    below = nodes[node, char] = len(code_of)
                    code_of.append(-1)
                    inner.append(False)
                node = below
            code_of[node] = code
        self.code_of, self.inner = np.array(code_of, np.int32), np.array(inner)
        links = _spread(np.array([n for n, _ in nodes], U64), np.array([ord(c) for _, c in nodes], np.uint32))
        by = np.argsort(links)
        self.links, self.below = links[by], np.array(list(nodes.values()), np.int32)[by]
        slot = self.links >> U64(64 - _SLOT_BITS)
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        self.slots = np.full(1 << _SLOT_BITS, -1, np.int32)
        self.slots[slot[first]] = first
        self.most_in_slot = int(np.diff(np.append(first, len(slot))).max())

    def _step(self, nodes: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the nodes have a node below them by their character, that node)."""
        links = _spread(nodes, chars)
        at = self.slots[links >> U64(64 - _SLOT_BITS)]
        maybe = np.flatnonzero(at >= 0)
        at, links = at[maybe], links[maybe]
        same = self.links[at] == links
        rest = np.flatnonzero(~same)
        for _ in range(1, self.most_in_slot):
            at[rest] = np.minimum(at[rest] + 1, len(self.links) - 1)
            hit = self.links[at[rest]] == links[rest]
            same[rest[hit]] = True
            rest = rest[~hit]
        return maybe[same], self.below[at[same]]

    def _other(self, char: str) -> int:
        code = self.other.get(char)
        if code is None:
            code = self.other[char] = self.size + len(self.code_ids)
            self.code_ids.append([self.byte_id[b] for b in char.encode("utf-8", "surrogatepass")])
        return code

    def _edges(self, text: str, end: int) -> list[tuple[int, int, float]]:
        """(start, code, weight) of the edges that end at a place."""
        get, found = self.weight.get, []
        for start in range(max(0, end - self.longest), end):
            hit = get(text[start:end])
            if hit is not None:
                found.append((start, hit[0], hit[1]))
        if text[end - 1] not in self.weight:
            found.append((end - 1, self._other(text[end - 1]), _PER_CHAR / self.size))
        return found

    def _built(self, chars: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of edges that end behind each character; running share, start in the word, code of each edge) of words
        of some ``sizes``, edges by end and start. All places of all words walk down the trie together, and forward sums
        are made for all words together."""
        word_ends = np.cumsum(sizes)
        offset = np.arange(1, len(chars) + 1) - np.repeat(word_ends - sizes, sizes)
        left = np.repeat(word_ends, sizes)
        found = []
        start, nodes = np.arange(len(chars)), np.zeros(len(chars), np.int32)
        for size in range(1, self.longest + 1):
            which, nodes = self._step(nodes, chars[start + (size - 1)])
            start = start[which]
            code = self.code_of[nodes]
            hit = np.flatnonzero(code >= 0)
            ends, code = start[hit] + size, code[hit]
            if size == 1:
                bare = np.ones(len(chars), bool)
                bare[ends - 1] = False
                lost = np.flatnonzero(bare)
                if len(lost):
                    unique, kind = np.unique(chars[lost], return_inverse=True)
                    others = np.array([self._other(chr(c)) for c in unique.tolist()], np.int32)
                    ends, code = np.concatenate([ends, lost + 1]), np.concatenate([code, others[kind]])
            found.append((ends, np.full(len(ends), size), code))
            on = np.flatnonzero(self.inner[nodes] & (start + size < left[start]))
            if not len(on):
                break
            start, nodes = start[on], nodes[on]
        # Long pieces first, so the starts of an end ascend.
        end, size, code = map(np.concatenate, zip(*found[::-1]))
        order = np.argsort(end.astype(np.uint16) if len(chars) < 1 << 16 else end, kind="stable")
        end, size, code = end[order], size[order], code[order]
        counts = np.bincount(end, minlength=len(chars) + 1)[1:]
        weight = np.where(code < self.size, self.code_weight[np.minimum(code, self.size - 1)], _PER_CHAR / self.size)
        # Sums that reach an end lie at its place; a word's begin counts as 1.
        ahead = np.zeros(len(chars) + 1)
        reach = np.zeros(len(end))
        place = offset[end - 1]
        by_place = np.argsort(place.astype(np.int16), kind="stable")
        cuts = np.searchsorted(place[by_place], np.arange(1, int(sizes.max()) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            own = by_place[a:b]
            stop, back = end[own], size[own]
            value = np.where(place[own] == back, 1.0, ahead[stop - back]) * weight[own]
            reach[own] = value
            first = np.flatnonzero(np.concatenate([[True], stop[1:] != stop[:-1]]))
            ahead[stop[first]] = np.add.reduceat(value, first)
        share = np.cumsum(reach / ahead[end])
        edge_ends = np.cumsum(counts)
        share -= np.repeat(np.concatenate([[0.0], share[edge_ends[:-1] - 1]]), counts)
        share[edge_ends - 1] = 1.0
        return counts.astype(np.int32), share, (place - size).astype(np.int8), code

    def _lattices(self, words: pa.Array, sizes: np.ndarray) -> list[np.ndarray]:
        """What ``_built`` gives for words that are not long, joined."""
        parts = [(np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int8), np.zeros(0, np.int32))]
        bounds = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1] if len(words) else [0, 0]
        raw = memoryview(words.buffers()[2] or b"")[bounds[0]:bounds[-1]]
        chars = np.frombuffer(str(raw, "utf-8").encode("utf-32-le"), np.uint32)
        ends, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
        while begin < len(words):
            stop = max(begin + 1, int(np.searchsorted(ends, ends[begin] + CHARS_AT_ONCE, "right")) - 1)
            parts.append(self._built(chars[ends[begin]:ends[stop]], sizes[begin:stop]))
            begin = stop
        return [np.concatenate(column) for column in zip(*parts)]

    def _walked(self, text: str, row_key: int, place: int) -> list[int]:
        """Codes of one long stretch; sums are kept as logarithms."""
        n = len(text)
        ahead, edges_at = [0.0], []
        for end in range(1, n + 1):
            edges = self._edges(text, end)
            logs = [ahead[s] + math.log(w) for s, _, w in edges]
            top = max(logs)
            ahead.append(top + math.log(math.fsum(math.exp(x - top) for x in logs)))
            edges_at.append([(s, c, x) for (s, c, _), x in zip(edges, logs)])
        draws = _draws(_seeds(np.full(n, row_key, np.int64), np.full(n, place, np.int64)), np.arange(n)).tolist()
        end, path = n, []
        while end:
            edges, draw, run = edges_at[end - 1], draws[len(path)], 0.0
            for start, code, x in edges:
                run += math.exp(x - ahead[end])
                if draw < run:
                    break
            path.append(code)
            end = start
        return path[::-1]

    def sample(self, texts: pa.Array, row_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids of all texts, where each text's end)."""
        distinct, places, first = _stretches(texts)
        rows = np.repeat(np.arange(len(texts)), np.diff(first))
        inside = np.arange(len(places)) - first[rows]
        nodes = pc.utf8_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
        short = nodes <= LONG
        counts, shares, starts, codes = self._lattices(
            distinct if short.all() else distinct.filter(pa.array(short)), nodes[short])
        nodes[~short] = 0
        node_base = np.cumsum(nodes) - nodes
        edge_base = np.cumsum(counts) - counts
        # All occurrences step back together.
        taken_by, taken, taken_step = [], [], []
        n_steps = np.zeros(len(places), np.int64)
        active = np.flatnonzero(nodes[places] > 0)
        at, base = nodes[places[active]], node_base[places[active]]
        seeds = _seeds(row_keys[rows[active]], inside[active])
        step = 0
        while len(active):
            node = base + at - 1
            edge = _chosen(edge_base[node], shares, _draws(seeds, np.full(1, step)))
            taken_by.append(active)
            taken.append(codes[edge])
            taken_step.append(np.full(len(active), step))
            n_steps[active] += 1
            at = starts[edge]
            more = at > 0
            active, at, base, seeds, step = active[more], at[more], base[more], seeds[more], step + 1
        long_at = np.flatnonzero(nodes[places] == 0)
        for o in long_at.tolist():
            path = self._walked(distinct[int(places[o])].as_py(), int(row_keys[rows[o]]), int(inside[o]))
            n_steps[o] = len(path)
            taken_by.append(np.full(len(path), o))
            taken.append(np.array(path, np.int32))
            taken_step.append(np.arange(len(path))[::-1])
        ends = np.cumsum(n_steps)
        path = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        if len(path):
            by = np.concatenate(taken_by)
            path[ends[by] - 1 - np.concatenate(taken_step)] = np.concatenate(taken)
        row_ends = np.concatenate([[0], ends])[first[1:]]
        if not len(path) or path.max() < self.size:
            return path.astype(np.int32), row_ends
        sizes = np.array([1] * self.size + [len(c) for c in self.code_ids], np.int64)
        flat = np.concatenate([np.arange(self.size), *map(np.array, self.code_ids)])
        order, code_ends = gather(np.cumsum(sizes) - sizes, sizes, path)
        return flat[order].astype(np.int32), np.concatenate([[0], code_ends])[row_ends]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        order, ends = gather(self.raw_starts, self.raw_sizes, ids)
        raw = self.raw[order].tobytes()
        cuts = np.concatenate([[0], ends])[offsets].tolist()
        return [raw[a + 1:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:])]


def _stretches(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct stretches, place of each in them, first of each text plus the end). A text that is not empty gets a
    dummy space in front."""
    texts = pc.fill_null(texts, "")
    texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", texts, " "))
    odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, _MARK))
    if pc.any(odd).as_py():
        lists = pa.array([_STRETCH.findall(t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        marked = pc.replace_substring(pc.replace_substring(texts, "\n", f"{_MARK}\n{_MARK}"), " ", f"{_MARK} ")
        lists = pc.split_pattern(marked, _MARK)
    begin = lists.offsets[0].as_py()
    return indexed(lists.values.slice(begin, lists.offsets[-1].as_py() - begin), lists.offsets.to_numpy() - begin)


def _model(path: str, sharpness: float) -> Lattice:
    key = (path, sharpness)
    if key not in _models:
        _models[key] = Lattice(path, sharpness)
    return _models[key]


def encode(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text",
           sharpness: float = SHARPNESS) -> DataFrame:
    """(doc_id, text_sha256, pieces): one row per row of ``docs``, with a segmentation drawn by the row's id.

    A null text counts as empty and has no pieces. Rows with the same id and text get the same pieces; a null id is a
    key of its own. Texts are segmented whole, however long. An empty table gives an empty result.
    """
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path, sharpness)
        for batch in large_slices(batches, 3, SLICE_BYTES):
            ids, ends = model.sample(batch.column(3), batch.column(1).to_numpy())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists],
                                             ["doc_id", "text_sha256", "pieces"])

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(id_column).alias("key"),
                       F.sha2(text, 256).alias("text_sha256"), text.alias("text")) \
        .mapInArrow(run, f"doc_id {kind}, text_sha256 string, pieces array<int>")


def decode(encoded: DataFrame, model_path: str, sharpness: float = SHARPNESS) -> DataFrame:
    """``encoded`` plus ``text``, joined from the pieces; the dummy space goes."""
    kind = dict(encoded.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path, sharpness)
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            ids = lists.values.to_numpy()[offsets[0]:offsets[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.decode(ids, offsets - offsets[0]))],
                                             ["doc_id", "text_sha256", "pieces", "text"])

    return encoded.select("doc_id", "text_sha256", "pieces").mapInArrow(
        run, f"doc_id {kind}, text_sha256 string, pieces array<int>, text string")


def round_trip(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text",
               sharpness: float = SHARPNESS, with_pieces: bool = False) -> DataFrame:
    """(doc_id, n_pieces, pieces_sha256, decoded_sha256, lossless): the sampled pieces of each document, as ``encode``
    gives them, and whether they give its text back. Pieces stay in the task that decodes them; their digest runs over
    little-endian 32-bit integers. ``with_pieces`` adds the pieces themselves (``pieces``, array of ids), drawn and
    decoded in the same Python stage. Null text counts as empty and has no pieces; an empty table gives no rows."""
    kind = dict(docs.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(model_path, sharpness)
        for batch in large_slices(batches, 2, SLICE_BYTES):
            ids, ends = model.sample(batch.column(2), batch.column(1).to_numpy())
            offsets = np.concatenate([[0], ends])
            texts = model.decode(ids, offsets)
            raw = memoryview(ids.astype("<i4").tobytes())
            spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            columns = [batch.column(0), pa.array(np.diff(offsets)),
                       pa.array([hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in spans]),
                       pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]),
                       pa.array([x == y for x, y in zip(texts, batch.column(2).to_pylist())], pa.bool_())]
            names = ["doc_id", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"]
            if with_pieces:
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("pieces")
            yield pa.RecordBatch.from_arrays(columns, names)
        # Workers outlive their tasks: what Arrow keeps for later would count against the next stage.
        pa.default_memory_pool().release_unused()

    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    schema = f"doc_id {kind}, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean"
    return docs.select(F.col(id_column).alias("doc_id"), F.xxhash64(id_column).alias("key"), text.alias("text")).mapInArrow(
        run, schema + (", pieces array<int>" if with_pieces else ""))
