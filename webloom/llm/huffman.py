"""Length-limited canonical Huffman codes over token ids, with packing and table-driven unpacking in numpy."""

from __future__ import annotations

import numpy as np

MAX_BITS = 20
#: Ids between two bit-offset checkpoints.
STRIDE = 64


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bits per symbol, 0 for those that never occur: the cheapest prefix code of at most ``max_bits`` bits, by merging
    packages of symbols level by level."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more symbols than codes of this length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        levels.append(by < len(leaves))
        merged = both[by]
        merged = merged[: len(merged) // 2 * 2]
        packages = merged[::2] + merged[1::2]
    taken = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        own = int(is_leaf[:taken].sum())
        lengths[order[:own]] += 1
        taken = 2 * (taken - own)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == bits)
        code <<= bits - last
        codes[own] = code + np.arange(len(own), dtype=np.uint64)
        code, last = code + len(own), bits
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code bits of ``ids``, first bit first, and the bit offset of every STRIDE-th id."""
    bits = lengths[ids].astype(np.int64)
    ends = np.cumsum(bits)
    at = ends - bits
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        word, room = at >> 6, 64 - (at & 63) - bits
        value = codes[ids]
        over = room < 0
        head = np.where(over, value >> np.where(over, -room, 0).astype(np.uint64),
                        value << np.where(over, 0, room).astype(np.uint64))
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.bitwise_or.reduceat(head, first)
        words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8], at[::STRIDE].astype(np.uint32)


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=0)))
        codes = canonical_codes(lengths)
        self.symbol = np.zeros(1 << self.bits, np.uint32)
        self.length = np.ones(1 << self.bits, np.uint8)
        # Canonical codes fill the table from the front, shorter ones first.
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = (1 << (self.bits - lengths[order].astype(np.int64)))
        filled = int(spans.sum())
        assert not len(order) or int(codes[order[0]]) == 0
        self.symbol[:filled] = np.repeat(order, spans)
        self.length[:filled] = np.repeat(lengths[order], spans)

    def unpack(self, packed: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` ids of a block. All stretches between checkpoints are read side by side, one id of each a step."""
        raw = np.frombuffer(packed + b"\0\0\0\0", np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        at = checkpoints.astype(np.int64)
        out = np.zeros((len(at), STRIDE), np.uint32)
        last = n - (len(at) - 1) * STRIDE
        for step in range(min(STRIDE, n)):
            if step == last:
                at = at[:-1]
            byte = at >> 3
            look = (window[byte] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.bits)
            out[: len(at), step] = self.symbol[look]
            at = at + self.length[look]
        return out.reshape(-1)[:n]
