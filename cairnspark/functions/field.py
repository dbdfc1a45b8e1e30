"""Arithmetic in the field of 256 elements, over numpy arrays.

Products come from tables of logarithms to the generator 2 of the polynomial
0x11d, built here.  A code is a matrix of parity rows over ``k`` data shares;
recovery solves the survivors' rows.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np


@cache
def _logs() -> tuple[np.ndarray, np.ndarray]:
    power, log, x = np.zeros(510, np.uint8), np.zeros(256, np.int64), 1
    for i in range(255):
        power[i] = power[i + 255] = x
        log[x] = i
        x = x << 1 ^ (0x11D if x & 128 else 0)
    return power, log


@cache
def _products() -> np.ndarray:
    """All 256 x 256 products."""
    power, log = _logs()
    out = power[log[:, None] + log[None, :]]
    out[0, :] = out[:, 0] = 0
    return out


def multiply(a: int, values: np.ndarray) -> np.ndarray:
    return values if a == 1 else _products()[a][values]


def combined(row: np.ndarray, shares: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """The sum of the shares times a row's factors; factors of 0 cost nothing."""
    out = np.zeros(len(shares[0]), np.uint8)
    for c, share in zip(row.tolist(), shares, strict=True):
        if c:
            out ^= multiply(c, share)
    return out


def inverse(a: int) -> int:
    power, log = _logs()
    return int(power[(255 - log[a]) % 255])


@cache
def parity_rows(k: int, m: int) -> np.ndarray:
    """Two rows are ones and 1, 2, 3, ...; more are a Cauchy matrix, of which every square part can be inverted."""
    if m == 2:
        return np.array([[1] * k, list(range(1, k + 1))], np.uint8)
    return np.array([[inverse(r ^ (m + c)) for c in range(k)] for r in range(m)], np.uint8)


def split(data: bytes, k: int, share: int | None = None) -> np.ndarray:
    """``k`` shares of equal length, padded with zeros; by default as short as the data allows."""
    share = -(-len(data) // k) if share is None else share
    out = np.zeros(k * share, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(k, share)


def encode(data: bytes, k: int = 4, m: int = 2, share: int | None = None) -> list[bytes]:
    """All k + m shares."""
    shares = split(data, k, share)
    parity = [combined(row, shares) for row in parity_rows(k, m)]
    return [s.tobytes() for s in [*shares, *parity]]


@cache
def _solver(k: int, m: int, present: tuple[int, ...]) -> np.ndarray:
    """The matrix that turns k present shares into the data shares: Gauss-Jordan elimination."""
    rows = np.vstack([np.eye(k, dtype=np.uint8), parity_rows(k, m)])[list(present)]
    work = np.hstack([rows, np.eye(k, dtype=np.uint8)])
    for c in range(k):
        pivot = c + int(np.flatnonzero(work[c:, c])[0])
        work[[c, pivot]] = work[[pivot, c]]
        work[c] = multiply(inverse(int(work[c, c])), work[c])
        for r in range(k):
            if r != c and work[r, c]:
                work[r] ^= multiply(int(work[r, c]), work[c])
    return work[:, k:]


def reconstruct(shares: list[bytes | None], length: int, k: int = 4, m: int = 2) -> bytes:
    """The data from any k of the shares; fewer are an error."""
    present = tuple(i for i, s in enumerate(shares) if s is not None)[:k]
    if len(present) < k:
        raise ValueError("too few shares are left")
    if present == tuple(range(k)):
        return b"".join(shares[:k])[:length]
    have = [np.frombuffer(shares[i], np.uint8) for i in present]
    solver = _solver(k, m, present)
    # Present data shares are taken as they are; only missing ones are worked out.
    return b"".join(shares[i] if shares[i] is not None else combined(solver[i], have).tobytes() for i in range(k))[:length]


def loss_patterns(total: int, most: int, least: int = 1) -> list[tuple[int, ...]]:
    return [p for n in range(least, most + 1) for p in combinations(range(total), n)]
