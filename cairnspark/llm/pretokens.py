"""The pre-tokens of byte-level BPE vocabularies, vectorised.

The split is that of the pattern in ``public_tokenizers.PATTERN``: optional
space plus a run of letters, of numbers or of other signs; runs of white space
that leave their last sign to what follows; English contractions.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

#: Unicode's White_Space property; fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
LETTER, NUMBER, OTHER, SPACE, UNKNOWN = 0, 1, 2, 3, 4


@cache
def classes() -> np.ndarray:
    """The class of each code point; UNKNOWN where this Python's Unicode tables assign none, as newer tables may differ."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.full(sys.maxunicode + 2, OTHER, np.uint8)
    for c in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(c))
        out[c] = UNKNOWN if category == "Cn" else kind.get(category[0], OTHER)
    out[WHITE_SPACE] = SPACE
    return out


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point, byte position) of each character of valid UTF-8."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[starts].astype(np.uint32)
    out = lead.copy()
    wide = np.flatnonzero(lead >= 0xC0)
    if len(wide):
        at, b = starts[wide], lead[wide]
        n = 1 + (b >= 0xE0) + (b >= 0xF0)
        value = b & np.where(n == 1, 0x1F, np.where(n == 2, 0x0F, 0x07)).astype(np.uint32)
        for k in range(1, 4):
            here = n >= k
            value[here] = (value[here] << 6) | (data[at[here] + k] & 0x3F)
        out[wide] = value
    return out, starts


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) in bytes of the pre-tokens of the documents, and those documents that hold a code point of unknown class.

    The pre-tokens cover all bytes, in order; none crosses a document's edge.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp, at = code_points(data)
    n = len(cp)
    kind = classes()[cp]
    odd = np.flatnonzero(kind == UNKNOWN)
    strange = np.unique(np.searchsorted(offsets, at[odd], "right") - 1) if len(odd) else np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)  # a document begins here
    edge[np.searchsorted(at, offsets)] = True
    head = np.ones(n, bool)  # a run of one class begins here
    head[1:] = kind[1:] != kind[:-1]
    head |= edge[:-1]
    tail = np.ones(n, bool)
    tail[:-1] = head[1:]
    white = kind == SPACE
    begin = head & ~white
    # The last sign of white space before other text stands alone, or joins that text if it is a plain space.
    lone = white & tail & ~edge[1:]
    begin |= lone
    begin |= head & white
    joined = np.flatnonzero(lone & (cp == 0x20)) + 1
    begin[joined] = False
    # Contractions: a single apostrophe that begins a pre-token.
    quote = np.flatnonzero((cp == 0x27) & head & tail & begin)
    if len(quote):
        quote = quote[quote + 1 < n]
        quote = quote[~edge[quote + 1]]
        one = cp[quote + 1]
        two = np.where(quote + 2 < n, cp[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(edge[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, width in ((short, 2), (long, 3)):
            q = quote[found]
            begin[q + 1] = False
            after = q + width
            after = after[after < n]
            begin[after] = True
    first = np.flatnonzero(begin)
    starts = at[first]
    return starts, np.append(starts[1:], len(data)), strange
