"""Word shingles of text columns as 64-bit hashes, computed on the flat UTF-8 buffer of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time.
SLICE_BYTES = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _P)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int, base: np.uint64, held: dict = {}) -> np.ndarray:
    if len(held.get(base, ())) < n:
        p = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        p[0] = 1
        held[base] = np.cumprod(p)
    return held[base][:n]


def word_hashes(texts: pa.Array, lower: bool = True):
    """Hashes of the words of a slice of large_string texts, and each text's number of words."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = _SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    heads = offsets[:-1][offsets[:-1] < len(raw)]
    start[heads] = ~space[heads]
    end = ~space
    end[:-1] &= space[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    end[tails] = ~space[tails]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    value = _BYTE[_LOWER[raw] if lower else raw]
    value *= _powers(len(raw), _P)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value, out=sums[1:])
    h = (sums[ends] - sums[starts]) * _powers(len(raw), _P_INV)[starts]
    at = np.searchsorted(starts, offsets)
    return mix(h ^ (ends - starts).astype(np.uint64) * _P), np.diff(at)


def _scale(k: int) -> np.uint64:
    return np.uint64(mix(np.array([k * 2 + 1], np.uint64))[0] | np.uint64(1))


def shingle_sets(texts: pa.Array, size: int = 5):
    """Yield each text's sorted distinct shingles of size words; one shingle of all words if there are fewer; none
    without words. Null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    total = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    scales = [_scale(k) for k in range(size)]
    at = 0
    while at < len(texts):
        base = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + SLICE_BYTES, side="right")))
        words, counts = word_hashes(texts.slice(at, to - at))
        if len(words) >= size:
            n = len(words) - size + 1
            grams = words[:n] * scales[0]
            for k in range(1, size):
                grams += words[k : n + k] * scales[k]
            grams = mix(grams)
        begin = np.cumsum(counts) - counts
        for b, c in zip(begin.tolist(), counts.tolist()):
            if c >= size:
                yield np.unique(grams[b : b + c - size + 1])
            elif c:
                one = np.array([c], np.uint64) * _P
                for k in range(c):
                    one = mix(one + words[b + k : b + k + 1] * scales[k])
                yield one
            else:
                yield np.zeros(0, np.uint64)
        at = to
