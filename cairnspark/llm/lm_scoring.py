"""Operator 1, language-model scoring by prediction by partial matching.

The counts of all training texts at full depth stay in parts, by a hash of the
context's last bytes.  Each block of texts sends its distinct byte grams with
their training counts; a part sums them, which makes its share of the context
trie, and answers each gram with its code length.  Only the lowest orders,
whose nodes are bounded whatever the corpus, are held by all tasks.  Word
counts for the unigram base come from the distinct-word exchange, so no word,
however common, is a hot key.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange, kernel, ppm
from .shared import buckets_for, kept, whole_texts

#: Depth of the trie.
DEPTH = 5
#: Order of the trie that all tasks hold: 2**24 possible nodes, of which UTF-8 allows a part, whatever the corpus.
LOW = 2
#: Nodes of a trie that ``train`` makes in one piece; ``score`` has it make order LOW only, to which this does not apply.
MOST_NODES = 1 << 22
#: The end of a text as a word; a space is in no word.
END_WORD = 0x20


def gram_counts(texts: DataFrame, depth: int) -> DataFrame:
    """(gram, n) of all texts of a one-column table; each task sums its own before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            g, n = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(g)
            g, n = g[order], n[order]
            at = np.flatnonzero(kernel.first_of_equal(g))
            return g[at], np.add.reduceat(n, at)

        found, size = [], 0
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(0))
            for i, j in kernel.steps(offsets):
                a, b = offsets[i], offsets[j]
                found.append(np.unique(ppm.grams(data[a:b], offsets[i : j + 1] - a, depth)[0], return_counts=True))
                size += len(found[-1][0])
                if size > 4 << 20:
                    found = [out(found)]
                    if len(found[0][0]) > 2 << 20:  # what stays distinct goes on; memory keeps its bound
                        yield pa.RecordBatch.from_arrays([pa.array(found[0][0].astype(np.int64)), pa.array(found[0][1])], ["gram", "n"])
                        found = []
                    size = sum(len(x[0]) for x in found)
        if found:
            g, n = out(found)
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(n)], ["gram", "n"])

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def train(texts: DataFrame, depth: int = DEPTH, most: int = MOST_NODES) -> ppm.Trie:
    """The trie of all texts of a one-column table, as deep as its proven size allows."""
    counted = kept(gram_counts(texts, depth))
    while depth > 2 and counted.count() > most:
        depth -= 1
        counted = kept(counted.groupBy(F.col("gram").bitwiseAND((1 << (8 * (depth + 1))) - 1).alias("gram")).agg(F.sum("n").alias("n")))
    rows = counted.toArrow()
    return ppm.Trie(rows["gram"].to_numpy().astype(np.uint64), rows["n"].to_numpy(), depth)


@dataclass
class Grams:
    """A block's grams: the distinct ones in order of part and number, what part each has, and a fingerprint of the list."""

    distinct: np.ndarray
    bounds: np.ndarray
    mark: bytes

    @classmethod
    def of(cls, ordered: np.ndarray, depth: int, buckets: int) -> tuple[Grams, np.ndarray]:
        """Of ascending distinct grams; also the place of each in that order."""
        place = (kernel.mix((ordered >> ppm.U64(8)) & ppm.bits(min(depth, LOW + 1))) % ppm.U64(buckets)).astype(np.int64)
        sent = np.argsort(place, kind="stable")
        mark = int(np.bitwise_xor.reduce(kernel.mix(ordered) * (np.arange(len(ordered)).astype(np.uint64) + ppm.U64(1))))
        return cls(ordered[sent], np.searchsorted(place[sent], np.arange(buckets + 1)), struct.pack("<Q", mark)), sent


def gram_rows(docs: DataFrame, depth: int, buckets: int, size: int = exchange.BLOCK_BYTES) -> DataFrame:
    """(bucket, block, payload): the distinct grams of each block and their counts in the documents marked ``counted``.

    All grams whose contexts end in the same LOW + 1 bytes have one bucket.
    ``docs`` has the columns id, text, counted in this order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, data, offsets in exchange._blocks(batches, size):
            gram, first = ppm.grams(data, offsets, depth)
            counted = np.repeat(rows.column(2).to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
            ordered = np.unique(gram)
            learned, n = np.unique(gram[counted], return_counts=True)
            weight = np.zeros(len(ordered), np.int64)
            weight[np.searchsorted(ordered, learned)] = n
            found, sent = Grams.of(ordered, depth, buckets)
            weight = weight[sent]
            full = np.flatnonzero(np.diff(found.bounds))
            payload = [exchange.pack(kernel.put_sorted(found.distinct[i:j]), kernel.put_varints(weight[i:j]), found.mark) for i, j in zip(found.bounds[full], found.bounds[full + 1], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), number)), pa.array(payload, pa.binary())], ["bucket", "block", "payload"])

    return docs.mapInArrow(run, "bucket int, block long, payload binary")


def gram_answers(asked: DataFrame, depth: int, low: Broadcast) -> DataFrame:
    """(bucket, block, payload): the code length of each gram that was asked, after its block's fingerprint."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lists, weights, marks = [], [], []
        for blob in table["payload"].to_pylist():
            g, w, mark = exchange.unpack(blob)
            lists.append(kernel.get_sorted(g))
            weights.append(kernel.get_varints(w))
            marks.append(mark)
        gram = np.concatenate(lists)
        order = np.argsort(gram)
        new = kernel.first_of_equal(gram[order])
        at = np.flatnonzero(new)
        distinct, n = gram[order][new], np.add.reduceat(np.concatenate(weights)[order], at)
        trie = ppm.Trie(distinct[n > 0], n[n > 0], depth, low.value) if depth > low.value.depth else low.value
        value = np.empty(len(gram), np.float32)
        value[order] = np.repeat(trie.score(distinct), np.diff(np.append(at, len(gram))))
        parts = np.split(value, np.cumsum([len(x) for x in lists])[:-1])
        # the four bytes of the numbers apart, which compresses better
        payload = [mark + exchange.pack(v.view(np.uint8).reshape(-1, 4).T.tobytes()) for mark, v in zip(marks, parts, strict=True)]
        return pa.table({"bucket": pa.array(np.full(len(marks), key[0].as_py(), np.int32)), "block": table["block"], "payload": pa.array(payload, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, "bucket int, block long, payload binary")


def code_lengths(met: exchange.Met, depth: int, buckets: int) -> np.ndarray:
    """The sum of each document's code lengths, from the answers that its block has got."""
    data, sizes = met.texts
    offsets = np.concatenate([[0], np.cumsum(kernel.get_varints(sizes))])
    gram, first = ppm.grams(np.frombuffer(data, np.uint8), offsets, depth)
    order = np.argsort(gram)
    gram = gram[order]
    at = np.flatnonzero(kernel.first_of_equal(gram))
    found, sent = Grams.of(gram[at], depth, buckets)
    if any(p[:8] != found.mark for p in met.further):
        raise RuntimeError("a block's grams differ between two readings of the input; checkpoint the input first")
    value = np.empty(len(at))
    value[sent] = np.concatenate([np.frombuffer(exchange.unpack(p[8:])[0], np.uint8).reshape(4, -1).T.copy().view(np.float32).ravel() for p in met.further])
    each = np.empty(len(gram))
    each[order] = np.repeat(value, np.diff(np.append(at, len(gram))))
    return np.add.reduceat(each, first[:-1])


def _tokens(data: np.ndarray, offsets: np.ndarray) -> exchange.Tokens:
    """Lower-cased words, and the end word after each document's last."""
    words = kernel.Words(data, offsets, lower=True)
    text, at = kernel.take_spans(words.data, words.starts, words.ends)
    where = words.first[1:]
    text = np.insert(text, at[where], END_WORD)
    sizes = np.insert(np.diff(at), where, 1)
    return exchange.Tokens(exchange.spans(text, np.concatenate([[0], np.cumsum(sizes)])), words.first + np.arange(len(words.first)))


def score(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, buckets: int | None = None) -> DataFrame:
    """Scores every whole text; learns from the rows for which ``learn`` is true.

    Returns (id, learned, n_tokens, n_known, train_tokens, base_score, score).
    A null text counts as empty: one token, its end.  ``learn`` that is null
    counts as false.  Each input row is scored by itself, so null and repeated
    ids and further columns of any name do no harm; without training rows all
    symbols are equally likely.  An empty table gives an empty one.
    """
    buckets = buckets or buckets_for(docs)
    rows = whole_texts(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("counted"))
    low = docs.sparkSession.sparkContext.broadcast(train(rows.where("counted").select("text"), min(depth, LOW)))

    def counts(asked: exchange.Asked):
        return (lambda code: exchange.pack(kernel.put_varints(asked.weight[code]))), int((asked.weight > 0).sum())

    words = exchange.word_rows(rows, _tokens, buckets)
    replies = kept(exchange.answers(words, counts))
    distinct = replies.agg(F.sum("total")).first()[0] or 0

    def finish(met: exchange.Met) -> list[pa.Array]:
        c = np.concatenate([kernel.get_varints(exchange.unpack(r)[0]) for r in met.replies])[met.answer]
        n = np.diff(met.first)
        value = np.add.reduceat(np.log10(c + 1.0), met.first[:-1])
        known = np.add.reduceat((c > 0).astype(np.int64), met.first[:-1])
        return [met.ids, pa.array(met.counted), pa.array(n), pa.array(known), pa.array(value), pa.array(code_lengths(met, depth, buckets))]

    schema = T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("learned", T.BooleanType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("score", T.DoubleType())])
    met = kept(exchange.reassemble(exchange.sequence_rows(rows, _tokens, buckets, texts=True), replies, finish, schema, gram_answers(gram_rows(rows, depth, buckets), depth, low)))
    seen = met.where("learned").agg(F.sum("n_tokens")).first()[0] or 0
    base = F.col("value") - F.col("n_tokens") * F.log10(F.lit(float(seen + distinct + 1)))
    return met.select(F.col("id").alias(id_col), "learned", "n_tokens", "n_known", F.lit(seen).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
