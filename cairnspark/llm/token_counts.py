"""Operator 3, token counts: the whole-token shortcut.

Offline, every string of the vocabulary is merged by itself; those that end as
one token are proven whole.  A pre-token that is one of them counts 1 without
merging; only the rest are merged, each distinct one once in a step.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, pretokens, vocabulary
from .shared import whole_texts


class Counter:
    """Counts the tokens of texts under one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], whole: set[bytes], broken: dict[bytes, list[bytes]], special: list[str]):
        self.known = dict.fromkeys(whole, 1) | {k: len(v) for k, v in broken.items()}
        self.special = [s.encode() for s in special]
        self.encode = vocabulary.merger(ranks)

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        h = kernel.span_hashes(data, starts, ends)
        order = np.argsort(h)
        new = kernel.first_of_equal(h[order])
        each = np.empty(len(h), np.int64)
        each[order] = np.cumsum(new) - 1
        one = order[new]
        text, known, encode = data.tobytes(), self.known.get, self.encode
        counts = [known(p := text[s:e], 0) or len(encode(p)) for s, e in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
        return np.array(counts, np.int64)[each]

    def step(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each document; special strings count 1 and part the text around them."""
        text = data.tobytes()
        extra = np.zeros(len(offsets) - 1, np.int64)
        cuts = []
        for s in self.special:
            at = text.find(s)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(s) <= offsets[d + 1]:
                    extra[d] += 1
                    cuts.append((at, at + len(s)))
                    at = text.find(s, at + len(s))
                else:
                    at = text.find(s, at + 1)
        edges = np.unique(np.concatenate([offsets, np.array(cuts, np.int64).ravel()])) if cuts else offsets
        starts, ends, strange = pretokens.split(data, edges)
        if cuts:
            keep = ~np.isin(starts, self._inside(starts, cuts))
            starts, ends = starts[keep], ends[keep]
        n = self.pieces(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        first = np.searchsorted(starts, offsets)
        counts = total[first[1:]] - total[first[:-1]] + extra
        if len(strange):
            docs = np.unique(np.searchsorted(offsets, edges[strange], "right") - 1)
            counts[docs] = [self.slow(text[offsets[d] : offsets[d + 1]].decode()) for d in docs]
        return counts

    @staticmethod
    def _inside(starts: np.ndarray, cuts: list[tuple[int, int]]) -> np.ndarray:
        """Starts of pre-tokens within a special string."""
        cuts = np.array(sorted(cuts), np.int64)
        i = np.searchsorted(cuts[:, 0], starts, "right") - 1
        return starts[(i >= 0) & (starts < cuts[np.maximum(i, 0), 1])]

    def slow(self, text: str) -> int:
        """For texts with code points of unknown class: the library's own split."""
        import public_tokenizers
        import regex

        parts, n = [text], 0
        for s in self.special:
            n += sum(p.count(s.decode()) for p in parts)
            parts = [q for p in parts for q in p.split(s.decode())]
        split = regex.compile(public_tokenizers.PATTERN)
        return n + sum(self.known.get(b := m.group().encode(), 0) or len(self.encode(b)) for p in parts for m in split.finditer(p))


def count_tokens(docs: DataFrame, path: str, *, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    ``path`` is a byte-level BPE in the json format; the driver reads and
    proves it, and tasks get it with the function.  One narrow pass: no
    shuffle, a step holds a few MB.  A null text counts as empty: 0 bytes,
    0 tokens.  Rows are independent: repeated and null ids, and further
    columns of any name, change nothing; an empty table gives no rows.
    """
    ranks, special = vocabulary.read_json(path)
    whole, broken = vocabulary.prove_whole(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks, whole, broken, special)
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(1))
            n = np.zeros(batch.num_rows, np.int64)
            for i, j in kernel.steps(offsets):
                a, b = offsets[i], offsets[j]
                n[i:j] = counter.step(data[a:b], offsets[i : j + 1] - a)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = whole_texts(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)
