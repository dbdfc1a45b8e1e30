"""A byte-context trie for prediction by partial matching (escape method C with symbol exclusion).

The trie of depth D is held as sorted arrays, one per order: a node is a
context of k bytes and the symbol that followed it, with its count.  Each text
is D start signs, its bytes, and an end sign; 0xFE and 0xFF, which UTF-8 never
uses, serve as those signs.  Every position has a full context, so the symbols
of a context are among those of its suffix, and exclusion comes down to sums
over the longer context's symbols.  All probabilities are of base 10.
"""

from __future__ import annotations

import numpy as np

from . import kernel

START, END = 0xFE, 0xFF
#: Bytes and the end sign; the start sign is never predicted.
SYMBOLS = 255
U64 = np.uint64


def grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every predicted position, first position of each document): ``depth`` context bytes and the symbol, as one number."""
    n, size = len(offsets) - 1, np.diff(offsets)
    base = np.arange(n) * (depth + 1)
    total = len(data) + n * (depth + 1)
    text = np.full(total, START, np.uint8)
    text[np.repeat(base + depth, size) + np.arange(len(data))] = data
    text[offsets[1:] + base + depth] = END
    gram = np.zeros(total - depth, U64)
    for k in range(depth + 1):
        gram = (gram << U64(8)) | text[k : total - depth + k]
    predicted = np.ones(total, bool)
    for k in range(depth):
        predicted[offsets[:-1] + base + k] = False
    return gram[predicted[depth:]], offsets + np.arange(n + 1)


def bits(k: int) -> np.uint64:
    """Mask of k bytes."""
    return U64((1 << (8 * k)) - 1)


class Index:
    """Places of numbers in an array of distinct ones: open addressing, vectorised."""

    def __init__(self, keys: np.ndarray):
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask = U64(size - 1)
        self.slot = np.full(size, -1, np.int32)
        self.keys = keys
        left = np.arange(len(keys))
        at = (kernel.mix(keys) & self.mask).astype(np.int64)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & int(self.mask)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where it is absent."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        at = (kernel.mix(keys) & self.mask).astype(np.int64)
        got = self.slot[at]
        same = (got >= 0) & (self.keys[got] == keys)
        out[same] = got[same]
        left = np.flatnonzero(~same & (got >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & int(self.mask)
            got = self.slot[at]
            same = (got >= 0) & (self.keys[got] == keys[left])
            out[left[same]] = got[same]
            on = ~same & (got >= 0)
            left, at = left[on], at[on]
        return out


class Trie:
    """Pretrained counts, with the code length of every case worked out once.

    ``low`` is a trie of the lower orders.  ``keys`` may then be a part of the
    deepest grams, if it has all those of each context of order low.depth + 1
    that it has: every longer context is within one such part.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, low: Trie | None = None):
        self.depth, own = depth, low.depth + 1 if low else 0
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        self.node: list[Index] = [None] * (depth + 1)
        self.context: list[Index] = [None] * (depth + 1)
        self.log_count, self.log_total, self.log_escape = {}, {}, {}
        self.log_rest, self.log_rest_escape = {}, {}
        self.kinds0 = 0
        level = {depth: (keys, counts)}
        for k in range(depth - 1, own - 1, -1):
            up, c = level[k + 1]
            suffix = up & bits(k + 1)
            order = np.argsort(suffix, kind="stable")
            new = kernel.first_of_equal(suffix[order])
            at = np.flatnonzero(new)
            level[k] = (suffix[order][new], np.add.reduceat(c[order], at) if len(at) else c[:0])
        stats = {}
        for k, (key, c) in level.items():
            context = key >> U64(8)
            new = kernel.first_of_equal(context)
            at = np.flatnonzero(new)
            total = np.add.reduceat(c, at) if len(at) else c[:0]
            kinds = np.diff(np.append(at, len(key))).astype(np.float64)
            stats[k] = (context[new], total, kinds, at)
            self.node[k], self.context[k] = Index(key), Index(context[new])
            self.log_count[k] = np.log10(c)
            self.log_total[k] = np.log10(total + kinds)
            self.log_escape[k] = np.log10(kinds) - self.log_total[k]
        if low:
            self.kinds0 = low.kinds0
            level[own - 1], stats[own - 1] = low.top
            for k in range(own):
                self.node[k], self.context[k] = low.node[k], low.context[k]
            for name in ("log_count", "log_total", "log_escape", "log_rest", "log_rest_escape"):
                getattr(self, name).update(getattr(low, name))
        else:
            self.kinds0 = int(stats[0][2][0]) if len(stats[0][2]) else 0
        self.top = level[depth], stats[depth]
        for k in range(max(own, 1), depth + 1):
            key, _ = level[k]
            context, _, kinds, at = stats[k]
            low_key, low_count = level[k - 1]
            place = np.searchsorted(low_key, key & bits(k))
            if low and k == own and not np.array_equal(np.append(low_key, bits(8))[place], key & bits(k)):
                raise RuntimeError("grams differ between two readings of the input; checkpoint the input first")
            seen = low_count[place]
            excluded = np.add.reduceat(seen, at) if len(at) else seen
            low_context, low_total, low_kinds, _ = stats[k - 1]
            y = np.searchsorted(low_context, context & bits(k - 1))
            rest_kinds = low_kinds[y] - kinds
            rest = low_total[y] - excluded + rest_kinds
            with np.errstate(divide="ignore"):
                self.log_rest[k] = np.where(rest > 0, np.log10(rest), 0)
                self.log_rest_escape[k] = np.where(rest_kinds > 0, np.log10(rest_kinds) - self.log_rest[k], 0)
        top = self.node[depth].keys >> U64(8)
        self.log_hit = (self.log_count[depth] - self.log_total[depth][self.context[depth].find(top)]).astype(np.float32)

    def score(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's symbol after its context."""
        got = self.node[self.depth].find(gram)
        out = np.zeros(len(gram))
        hit = got >= 0
        out[hit] = self.log_hit[got[hit]]
        left = np.flatnonzero(~hit)
        out[left] = self._lower(gram[left])
        return out

    def _lower(self, gram: np.ndarray) -> np.ndarray:
        """For grams that are not nodes of the deepest order."""
        out = np.zeros(len(gram))
        left = np.arange(len(gram))
        above = np.full(len(gram), -1, np.int32)  # the longer context that was escaped from
        for k in range(self.depth, -1, -1):
            g = gram[left]
            context = self.context[k].find((g >> U64(8)) & bits(k))
            node = self.node[k].find(g & bits(k + 1))
            known, found, first = context >= 0, node >= 0, above < 0
            add = np.zeros(len(left))
            if k < self.depth:
                x = known & first & found
                add[x] = self.log_count[k][node[x]] - self.log_total[k][context[x]]
            x = known & first & ~found
            add[x] = self.log_escape[k][context[x]]
            if k < self.depth:
                x = ~first & found
                add[x] = self.log_count[k][node[x]] - self.log_rest[k + 1][above[x]]
                x = ~first & ~found
                add[x] = self.log_rest_escape[k + 1][above[x]]
            out[left] += add
            left, above = left[~found], context[~found]
        out[left] -= np.log10(SYMBOLS - self.kinds0) if self.kinds0 < SYMBOLS else 0
        return out
