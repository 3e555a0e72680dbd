"""Vectorised work on batches of UTF-8 texts: words, their hashes, sliding windows.

All patterns used here are defined on ASCII characters, so they hold unchanged on UTF-8 bytes;
a batch of texts is one byte buffer and every step is a NumPy operation over that buffer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xC2B2AE3D27D4EB4F)
M3 = np.uint64(0x165667B19E3779F9)
#: Other odd multipliers for a second, independent hash.
OTHER = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))
R29, R32 = np.uint64(29), np.uint64(32)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)

#: Bytes of ``[^\x20\x09-\x0D]``.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``: digits, lower-case letters, all beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

KEEP_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
SPACES = b" \t\n\x0b\x0c\r"


def mix(a, b, second: bool = False):
    """A 64-bit hash of two 64-bit values; the order matters."""
    m1, m2, m3 = OTHER if second else (M1, M2, M3)
    h = (a * m1) ^ (b + m3)
    h ^= h >> R32
    h *= m2
    h ^= h >> R29
    return h


def text_bytes(column) -> list[bytes]:
    """The values of an Arrow string or binary column; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def groups_of(lengths, limit: int):
    """Slices of consecutive texts of about ``limit`` bytes together, one text at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(lengths) > start:
        yield start, len(lengths)


@dataclass
class Words:
    """Words of a batch of texts. ``first[i]:first[i+1]`` are those of text i."""

    data: np.ndarray  # bytes of all texts, padded
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    lengths: np.ndarray  # words of each text

    def hashes(self, second: bool = False) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends, second)

    def doc(self) -> np.ndarray:
        """The text's number of each word."""
        return np.repeat(np.arange(len(self.lengths)), self.lengths)

    def left(self) -> np.ndarray:
        """How many words of the same text begin at each word, itself included."""
        return np.repeat(self.first[1:], self.lengths) - np.arange(len(self.starts))


def split_words(texts: list[bytes], table: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    data = np.frombuffer(b" " + b" ".join(texts) + b" " * 17, dtype=np.uint8)
    if lower:
        data = LOWER[data]
    inside = table[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begin = 1 + np.concatenate([[0], np.cumsum(sizes + 1)])
    first = np.searchsorted(starts, begin)
    return Words(data, starts, ends, first, np.diff(first))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; at least 8 bytes must follow the last span."""
    data = np.ascontiguousarray(data)
    eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data.data, strides=(1,))
    size = ends - starts
    h = mix(eight[starts] & KEEP_BYTES[np.minimum(size, 8)], size.astype(np.uint64), second)
    more, at = np.flatnonzero(size > 8), 8
    while len(more):
        part = eight[starts[more] + at] & KEEP_BYTES[np.minimum(size[more] - at, 8)]
        h[more] = mix(h[more], part, second)
        at += 8
        more = more[size[more] > at]
    return h


def windows(h: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hashes of every n consecutive values; ``len(h) - n + 1`` of them."""
    if len(h) < n:
        return np.zeros(0, dtype=np.uint64)
    have, power, out, at = h, 1, None, 0
    rest = n
    while rest:
        if rest & 1:
            piece = have[at : at + len(h) - n + 1]
            out = piece.copy() if out is None else mix(out, piece, second)
            at += power
        rest >>= 1
        if rest:
            have = mix(have[:-power], have[power:], second)
            power *= 2
    return mix(out, np.uint64(n), second)


def sliding(x: np.ndarray, n: int, pick=np.minimum) -> np.ndarray:
    """The least (or by ``pick`` the greatest) of every n consecutive values."""
    if len(x) < n:
        return x[:0]
    have, power = x, 1
    while power * 2 <= n:
        have = pick(have[:-power], have[power:])
        power *= 2
    return pick(have[: len(x) - n + 1], have[n - power : n - power + len(x) - n + 1])


def covered(starts: np.ndarray, span: int, n: int) -> np.ndarray:
    """Which of n positions lie in ``[s, s + span)`` for any s."""
    step = np.zeros(n + 1, dtype=np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + span, n), -1)
    return np.cumsum(step[:-1]) > 0


def wide_tally(high: np.ndarray, low: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct 128-bit keys, sorted, in two halves, and how often each occurs (or the sum of its weights)."""
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    if not len(high):
        return high, low, np.zeros(0, dtype=np.int64)
    new = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return high[new], low[new], np.diff(np.append(new, len(high))) if weights is None else np.add.reduceat(weights[order], new)


def wide_place(high: np.ndarray, low: np.ndarray, of_high: np.ndarray, of_low: np.ndarray) -> np.ndarray:
    """The places of 128-bit values among sorted distinct keys, -1 for those that are not there."""
    out = np.full(len(high), -1)
    if not len(of_high):
        return out
    at = np.searchsorted(of_high, high)
    left = np.arange(len(high))
    while len(left):  # once, unless keys agree in their high halves
        left = left[at[left] < len(of_high)]
        left = left[of_high[at[left]] == high[left]]
        hit = of_low[at[left]] == low[left]
        out[left[hit]] = at[left[hit]]
        left = left[~hit]
        at[left] += 1
    return out


def member(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which values are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return keys[at] == values
