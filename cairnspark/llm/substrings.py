"""Operator 8, substring deduplication by Rabin-Karp hashes of every window of a fixed number of words.

Each block of documents sends the hashes of all its windows, sorted and packed
by hash range; a range finds, for every hash, the smallest document that has
it; blocks learn which of their windows an earlier document has, and repeated
windows merge into maximal removal intervals.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange, kernel
from .shared import buckets_for, whole_texts

#: The place of a null id: after all others.
LAST = np.iinfo(np.int64).max


class Windows:
    """The windows of a block: distinct hashes in order, the smallest document of each, and where each window stands."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, width: int):
        self.words = kernel.Words(data, offsets)
        self.hash, self.bounds = kernel.gram_hashes(self.words.hashes(), self.words.first, width)
        check, _ = kernel.gram_hashes(self.words.hashes(2), self.words.first, width)
        self.doc = np.repeat(ids, np.diff(self.bounds))
        order = np.argsort(self.hash)
        new = kernel.first_of_equal(self.hash[order])
        at = np.flatnonzero(new)
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.distinct = self.hash[order][new]
        self.check = (check[order][new] >> np.uint64(48)).astype("<u2")
        self.least = np.minimum.reduceat(self.doc[order], at) if len(at) else self.doc

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """Windows that start in a smaller document, given which distinct ones do so in another block."""
        return elsewhere[self.group] | (self.doc > self.least[self.group])

    def covered(self, flag: np.ndarray, width: int) -> np.ndarray:
        """Words inside the flagged windows."""
        change = np.zeros(len(self.words.starts) + 1, np.int64)
        place = np.repeat(self.words.first[:-1] - self.bounds[:-1], np.diff(self.bounds)) + np.arange(len(self.hash))
        np.add.at(change, place[flag], 1)
        np.add.at(change, place[flag] + width, -1)
        return np.cumsum(change)[:-1] > 0


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy()


def deduplicate(docs: DataFrame, *, width: int = 13, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Removes each word that is covered by a window which also starts in a document with a smaller id.

    Returns (id, n_words, n_removed, removed, kept): ``removed`` lists maximal
    intervals [start, end) of words, ``kept`` is the rest joined by spaces.
    Windows are judged on the input.  A null text has no words.  Rows with
    equal ids don't remove from one another; a null id counts as larger than
    all others.  Further columns are ignored; an empty table gives no rows.
    Hashes have 64 bits and 16 more of a second hash.
    """
    buckets = buckets or buckets_for(docs)
    rows = whole_texts(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # Ranges of equal width in the space of hashes.
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray, Windows]]:
        for number, part, data, offsets in exchange._blocks(batches, exchange.BLOCK_BYTES):
            yield number, part, data, offsets, Windows(data, offsets, _ids(part.column(0)), width)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, _, _, w in blocks(batches):
            cut = np.concatenate([[0], np.searchsorted(w.distinct, edges), [len(w.distinct)]])
            payload, full = [], np.flatnonzero(np.diff(cut))
            for k in full:
                i, j = cut[k], cut[k + 1]
                ids, rank = np.unique(w.least[i:j], return_inverse=True)
                payload.append(exchange.pack(kernel.put_sorted(w.distinct[i:j]), w.check[i:j].tobytes(), kernel.put_varints(rank), kernel.put_sorted(ids.astype(np.uint64) ^ np.uint64(1 << 63))))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), number)), pa.array(payload, pa.binary())], ["bucket", "block", "payload"])

    def count(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [exchange.unpack(b) for b in table["payload"].to_pylist()]
        h = [kernel.get_sorted(p[0]) for p in parts]
        ids = [(kernel.get_sorted(p[3]) ^ np.uint64(1 << 63)).astype(np.int64)[kernel.get_varints(p[2])] for p in parts]
        size = np.array([len(x) for x in h])
        h, doc = np.concatenate(h), np.concatenate(ids)
        check = np.concatenate([np.frombuffer(p[1], "<u2") for p in parts])
        order = np.argsort(h)
        new = kernel.first_of_equal(h[order]) | kernel.first_of_equal(check[order])
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[order], at)[np.cumsum(new) - 1]
        earlier = np.empty(len(h), bool)
        earlier[order] = least < doc[order]
        cut = np.concatenate([[0], np.cumsum(size)])
        found = [np.flatnonzero(earlier[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)]
        payload = [struct.pack("<q", n) + kernel.put_varints(np.diff(x, prepend=0)) for n, x in zip(size.tolist(), found, strict=True)]
        return pa.table({"bucket": pa.array(np.full(len(parts), key[0].as_py(), np.int32)), "block": table["block"], "payload": pa.array(payload, pa.binary())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, part, data, offsets in exchange._blocks(batches, exchange.BLOCK_BYTES):
            payload = exchange.pack(data.tobytes(), np.diff(offsets).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([number]), pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), kernel.binary([payload])], ["bucket", "block", "ids", "payload"])

    def finish(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = table["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        blobs = table["payload"].to_pylist()
        text, size = exchange.unpack(blobs[order[0]])
        column = table["ids"][int(order[0])].values
        data, offsets = np.frombuffer(text, np.uint8), np.concatenate([[0], np.cumsum(np.frombuffer(size, "<i8"))])
        w = Windows(data, offsets, _ids(column), width)
        elsewhere, at = np.zeros(len(w.distinct), bool), 0
        for k in order[1:]:
            (n,) = struct.unpack_from("<q", blobs[k])
            elsewhere[at + np.cumsum(kernel.get_varints(blobs[k][8:]))] = True
            at += n
        if at != len(w.distinct):
            raise RuntimeError("a block's windows differ between two readings of the input; checkpoint the input first")
        gone = w.covered(w.repeated(elsewhere), width)
        first = w.words.first
        total = np.concatenate([[0], np.cumsum(gone)])
        # Intervals: the edges of runs, numbered within their documents.
        inner = np.zeros(len(gone) + 1, bool)
        inner[first] = True
        begin = gone & (inner[:-1] | ~np.concatenate([[False], gone[:-1]]))
        end = gone & (inner[1:] | ~np.concatenate([gone[1:], [False]]))
        b, e = np.flatnonzero(begin), np.flatnonzero(end)
        base = np.repeat(first[:-1], np.diff(np.searchsorted(b, first)))
        runs = pa.StructArray.from_arrays([pa.array((b - base).astype(np.int32)), pa.array((e + 1 - base).astype(np.int32))], ["start", "end"])
        removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(b, first).astype(np.int32)), runs)
        keep = np.flatnonzero(~gone)
        starts, ends = w.words.starts[keep], w.words.ends[keep]
        length = ends - starts
        place = np.concatenate([[0], np.cumsum(length + 1)])
        out = np.full(place[-1], 32, np.uint8)
        if len(keep):
            inside = np.concatenate([[0], np.cumsum(length)])
            span = np.repeat(np.arange(len(keep)), length)
            within = np.arange(inside[-1]) - inside[span]
            out[place[span] + within] = data[starts[span] + within]
        cut = np.searchsorted(keep, first)
        kept = [out[place[i] : max(place[j] - 1, place[i])].tobytes().decode() for i, j in zip(cut[:-1], cut[1:], strict=True)]
        return pa.table({"id": column, "n_words": np.diff(first), "n_removed": total[first[1:]] - total[first[:-1]], "removed": removed, "kept": pa.array(kept, pa.string())})

    asked = rows.mapInArrow(hashes, "bucket int, block long, payload binary")
    answered = asked.groupBy("bucket").applyInArrow(count, "bucket int, block long, payload binary")
    stored = rows.mapInArrow(texts, "bucket int, block long, ids array<long>, payload binary")
    out = stored.unionByName(answered, allowMissingColumns=True).groupBy("block").applyInArrow(finish, T.StructType.fromDDL("id long, n_words long, n_removed long, removed array<struct<start: int, end: int>>, kept string"))
    return out.withColumnRenamed("id", id_col)
