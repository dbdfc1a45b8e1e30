"""Vectorised text kernels shared by the operators (numpy over Arrow buffers).

A text column arrives as one UTF-8 byte buffer plus offsets.  Words, their
hashes and n-gram hashes are computed for a whole slice of documents at once,
so no Python code runs per word.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Freed memory goes back to the system at once, as workers share an executor's memory with its heap: Arrow takes the
# system's allocator, and that maps every array of a megabyte or more by itself (parameter -3) rather than keeping the space.
pa.set_memory_pool(pa.system_memory_pool())
if sys.platform == "linux":
    ctypes.CDLL(None).mallopt(-3, 1 << 20)

#: Bytes of text that one vectorised step takes; a longer document is a step of its own.
STEP_BYTES = 4 << 20

U64 = np.uint64
#: Multiplier of the rolling hash, odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INV = pow(BASE, -1, 1 << 64)

#: The separators of the contracts' words: [\x20\x09-\x0D].
SPACES = np.zeros(256, bool)
SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))


VALUES = {seed: _byte_values(seed) for seed in (1, 2)}
#: Powers are products of one from each of two short tables.
_SPAN = 4096


def _tables(base: int) -> tuple[np.ndarray, np.ndarray]:
    near = np.full(_SPAN, base, U64)
    near[0] = 1
    near = np.cumprod(near)
    far = np.full(_SPAN, pow(base, _SPAN, 1 << 64), U64)
    far[0] = 1
    return near, np.cumprod(far)


_UP, _DOWN = _tables(BASE), _tables(BASE_INV)


def power(table: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    """base**at modulo 2**64, for at below 2**36."""
    near, far = table
    low = near[at & (_SPAN - 1)] * far[(at >> 12) & (_SPAN - 1)]
    top = at >> 24
    if len(at) and top.max():
        step = pow(int(far[1]), _SPAN, 1 << 64)
        low = low * np.array([pow(step, int(k), 1 << 64) for k in range(int(top.max()) + 1)], U64)[top]
    return low


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string())
    _, offs, data = column.buffers()
    n, o = len(column), column.offset
    offsets = np.frombuffer(offs, np.int64, n + 1 + o)[o:] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes (or one document)."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


class Words:
    """The words of a slice of documents.

    starts, ends: byte positions of each word in ``data``; first: index of
    each document's first word, with the total as the last entry.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, *, lower: bool = False, spaces: np.ndarray = SPACES):
        self.offsets = offsets
        self.data = LOWER[data] if lower else data
        inside = ~spaces[data]
        n = len(data)
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        edges = offsets[:-1][offsets[:-1] < n]
        before[edges] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        last = offsets[1:] - 1
        after[last[last >= 0]] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 1) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends, seed)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit Rabin-Karp hash of each byte span: differences of prefix sums of value * BASE**position."""
    if not len(starts):
        return np.zeros(0, U64)
    n = len(data)
    near, far = _UP
    total = np.zeros(n + 1, U64)
    value = VALUES[seed][data]
    if n <= _SPAN * _SPAN:
        for i in range(0, n, _SPAN):
            part = value[i : i + _SPAN]
            part *= near[: len(part)] * far[i // _SPAN]
    else:
        value *= power(_UP, np.arange(n))
    np.cumsum(value, out=total[1:])
    h = (total[ends] - total[starts]) * power(_DOWN, starts)
    return mix(h + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def gram_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of k consecutive word hashes within each document.

    Returns (hashes, bounds): document d has hashes[bounds[d]:bounds[d+1]].
    Documents of fewer than k words have none.
    """
    counts = np.maximum(np.diff(first) - (k - 1), 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    n = len(words) - k + 1
    if n <= 0 or not bounds[-1]:
        return np.zeros(0, U64), np.zeros_like(bounds)
    h = words[:n].copy()
    for j in range(1, k):
        h *= U64(0xC2B2AE3D27D4EB4F)
        h += words[j : n + j]
    index = np.repeat(first[:-1] - bounds[:-1], counts) + np.arange(bounds[-1])
    return mix(h[index]), bounds


def first_of_equal(values: np.ndarray) -> np.ndarray:
    """True at the first of each run of equal neighbours."""
    out = np.ones(len(values), bool)
    out[1:] = values[1:] != values[:-1]
    return out


def mark_of(values: np.ndarray) -> bytes:
    """A fingerprint of a list of uint64 values and their order, in eight bytes."""
    return int(np.bitwise_xor.reduce(mix(values) * (np.arange(len(values)).astype(U64) + U64(1)), initial=0)).to_bytes(8, "little")


def take_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates byte spans: (bytes, offsets)."""
    lengths = ends - starts
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    index = np.repeat(starts - offsets[:-1], lengths) + np.arange(offsets[-1])
    return data[index], offsets


def put_varints(values: np.ndarray) -> bytes:
    """Unsigned integers below 2**35 in groups of 7 bits, low group first."""
    v = values.astype(np.uint64)
    if not len(v):
        return b""
    n = np.ones(len(v), np.int64)
    for k in range(1, 5):
        n += v >= U64(1 << (7 * k))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(at[-1], np.uint8)
    for k in range(5):
        here = n > k
        if not here.any():
            break
        out[at[:-1][here] + k] = ((v[here] >> U64(7 * k)) & U64(127)).astype(np.uint8) | ((n[here] > k + 1) * 128).astype(np.uint8)
    return out.tobytes()


def get_varints(blob: bytes) -> np.ndarray:
    a = np.frombuffer(blob, np.uint8)
    if not len(a):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(a < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    n = last - begin + 1
    out = np.zeros(len(last), np.int64)
    for k in range(int(n.max())):
        here = n > k
        out[here] |= (a[begin[here] + k] & 127).astype(np.int64) << (7 * k)
    return out


def put_sorted(values: np.ndarray) -> bytes:
    """Ascending uint64 values as differences of one fixed byte width (the first byte)."""
    if not len(values):
        return b""
    gaps = np.diff(values, prepend=U64(0))
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def get_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, U64)
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return np.cumsum(full.view("<u8").ravel(), dtype=U64)
