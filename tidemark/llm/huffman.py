"""Length-limited canonical Huffman codes for token ids: code lengths, block encoder, table decoder.

A block is a run of whole documents. Its payload is the bits of all its ids; every STEP ids the
number of bits used is kept, so that a decoder starts in many places at once.
"""

from __future__ import annotations

import numpy as np

STEP = 64


def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths of at most max_bits for positive counts (package-merge by sorted levels).

    At each level the leaves and the pairs of the level below are sorted together; walking back from
    the top, of the `need` cheapest entries the leaves get one bit more and the pairs ask for two
    entries below each.
    """
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit codes of {max_bits} bits")
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    pairs, levels = np.zeros(0, np.int64), []
    for _ in range(max_bits):
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < n)
        both = both[rank]
        both = both[: len(both) // 2 * 2]
        pairs = both[0::2] + both[1::2]
    bits, need = np.zeros(n, np.int64), 2 * n - 2
    for is_leaf in reversed(levels):
        taken = int(is_leaf[:need].sum())
        bits[:taken] += 1
        need = 2 * (need - taken)
    out = np.zeros(n, np.int64)
    out[order] = bits
    return out


def canonical(symbols: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The codes, by length and then by symbol."""
    order = np.lexsort((symbols, bits))
    codes, below = np.zeros(len(symbols), np.int64), int(bits.max(initial=1)) - bits[order]
    # Each begins where those before it end, all taken as numbers of the longest's length.
    step = 1 << below
    codes[order] = (np.cumsum(step) - step) >> below
    return codes


class Coder:
    def __init__(self, symbols: np.ndarray, bits: np.ndarray):
        self.width = int(bits.max(initial=1))
        codes = canonical(symbols, bits)
        top = int(symbols.max(initial=0)) + 1
        self.code, self.bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
        self.code[symbols], self.bits[symbols] = codes, bits
        # Of every `width` bits: the symbol that they begin with, and its length.
        self.table = np.zeros(1 << self.width, np.int64)
        order = np.lexsort((symbols, bits))
        runs = np.repeat((symbols << 5 | bits)[order], 1 << (self.width - bits[order]))
        self.table[: len(runs)] = runs

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload, and the bits that each STEP ids take (32-bit)."""
        bits = self.bits[ids]
        end = np.cumsum(bits)
        total = int(end[-1]) if len(end) else 0
        at = end - bits
        # Each code lies in two 32-bit words at most; its parts share no bit with others, so sums join them.
        wide = self.code[ids] << (64 - (at & 31) - bits).astype(np.uint64)
        word, n = at >> 5, (total >> 5) + 2
        sums = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), n) + np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
        starts = np.arange(0, len(ids), STEP)
        spans = np.add.reduceat(bits, starts) if len(ids) else np.zeros(0, np.int64)
        return sums.astype(">u4").tobytes()[: (total + 7) // 8], spans.astype("<u4").tobytes()

    def decode(self, payload: bytes, spans: bytes, n: int) -> np.ndarray:
        lanes = np.frombuffer(spans, "<u4").astype(np.int64)
        at = np.cumsum(lanes) - lanes
        raw = np.frombuffer(payload + bytes(16 + STEP * 4), np.uint8).astype(np.uint32)
        four = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
        out, drop = np.empty((len(at), STEP), np.int64), 32 - self.width
        last = len(four) - 1
        if self.width > 25:
            raise ValueError("codes over 25 bits aren't read")
        for k in range(STEP):
            got = self.table[(four[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(drop)]
            out[:, k] = got >> 5
            at = at + (got & 31)
        return out.reshape(-1)[:n]
