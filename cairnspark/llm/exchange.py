"""The distinct-word exchange: one fact per distinct word, found once for the corpus and brought back to every place of the word.

Documents are cut into blocks of a few MB, each within one task.  A block's
tokens become indices into the block's own list of distinct words (the
position of each token is its place in that sequence).  The words alone are
shuffled, by a hash of the word; all copies of a word meet there, one per
block, and are answered once.  Answers go back by block and meet the sequences.

A word that is in every text arrives once per block, so no key is hot; a block
has a bounded size however long or common its texts are.  Both sides read the
same deterministic input; a fingerprint of the word list that travels with
both makes a difference an error rather than a wrong result.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel

#: Bytes of text in a block; a longer document is a block of its own.
BLOCK_BYTES = 4 << 20
#: Added to the buckets of further replies where they meet the others.
FURTHER = 1 << 30


def pack(*parts: bytes) -> bytes:
    body = b"".join(struct.pack("<q", len(p)) + p for p in parts)
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> list[bytes]:
    body, at, parts = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(body):
        (n,) = struct.unpack_from("<q", body, at)
        parts.append(body[at + 8 : at + 8 + n])
        at += 8 + n
    return parts


@dataclass
class Tokens:
    """The tokens of a slice of documents as one array of byte strings; document d has first[d]:first[d+1]."""

    words: pa.LargeBinaryArray
    first: np.ndarray


def spans(data: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def view(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return kernel.buffers(words)


@dataclass
class Block:
    """A block's tokens: indices into its distinct words, which are in order of frequency; ``sent`` lists the words by bucket."""

    index: np.ndarray
    words: pa.LargeBinaryArray
    weight: np.ndarray
    sent: np.ndarray
    bounds: np.ndarray
    mark: int

    @classmethod
    def of(cls, tokens: Tokens, buckets: int, counted: np.ndarray) -> Block:
        coded = tokens.words.dictionary_encode()
        words, index = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(words)
        order = np.argsort(-np.bincount(index, minlength=n), kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        index, words = rank[index], words.take(pa.array(order))
        data, offs = view(words)
        h = kernel.span_hashes(data, offs[:-1], offs[1:]) if n else np.zeros(0, np.uint64)
        place = (h % np.uint64(buckets)).astype(np.int64)
        sent = np.argsort(place, kind="stable")
        weight = np.bincount(index, np.repeat(counted, np.diff(tokens.first)), minlength=n).astype(np.int64)
        mark = int(np.bitwise_xor.reduce(h * (np.arange(n).astype(np.uint64) + np.uint64(1)))) if n else 0
        return cls(index, words, weight, sent, np.searchsorted(place[sent], np.arange(buckets + 1)), mark)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches of at most ``size`` bytes of text, with a number unique in the job."""
    task, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        data, offsets = kernel.buffers(batch.column(1))
        for i, j in kernel.steps(offsets, size):
            a, b = offsets[i], offsets[j]
            yield (task << 24) | number, batch.slice(i, j - i), data[a:b], offsets[i : j + 1] - a
            number += 1


def word_rows(docs: DataFrame, tokens: Callable[[np.ndarray, np.ndarray], Tokens], buckets: int, size: int = BLOCK_BYTES) -> DataFrame:
    """(bucket, block, payload): the distinct words of each block and their counts in the documents marked ``counted``.

    ``docs`` has the columns id, text, counted in this order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, data, offsets in _blocks(batches, size):
            counted = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            block = Block.of(tokens(data, offsets), buckets, counted)
            text, offs = view(block.words.take(pa.array(block.sent)))
            weight = block.weight[block.sent]
            lengths = np.diff(offs)
            full = np.flatnonzero(np.diff(block.bounds))
            payload = []
            for k in full:
                i, j = block.bounds[k], block.bounds[k + 1]
                payload.append(pack(kernel.put_varints(lengths[i:j]), text[offs[i] : offs[j]].tobytes(), kernel.put_varints(weight[i:j]), struct.pack("<Q", block.mark)))
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), number)), pa.array(payload, pa.binary())], ["bucket", "block", "payload"])

    return docs.mapInArrow(run, "bucket int, block long, payload binary")


@dataclass
class Asked:
    """What a bucket holds: every word once per block, and each word's number among the distinct ones."""

    words: pa.LargeBinaryArray
    code: np.ndarray
    weight: np.ndarray


def answers(words: DataFrame, answer: Callable[[Asked], tuple[Callable[[np.ndarray], bytes], int]]) -> DataFrame:
    """(bucket, block, payload, total): ``answer`` sees a bucket's distinct words and returns a function that writes what a list of them gets, and a number that callers may sum over buckets.

    A bucket is 1/buckets of the corpus's distinct words, once per block; ``shared.buckets_for`` keeps its size.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        blocks, parts, lengths, weights, marks = table["block"].to_numpy(), [], [], [], []
        for blob in table["payload"].to_pylist():
            n, text, w, mark = unpack(blob)
            lengths.append(kernel.get_varints(n))
            weights.append(kernel.get_varints(w))
            parts.append(text)
            marks.append(mark)
        sizes = [len(n) for n in lengths]
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        coded = spans(np.frombuffer(b"".join(parts), np.uint8), offsets).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.bincount(code, np.concatenate(weights), minlength=len(coded.dictionary)).astype(np.int64)
        write, number = answer(Asked(coded.dictionary, code, total))
        cut = np.cumsum(sizes)[:-1]
        payload = [mark + write(c) for mark, c in zip(marks, np.split(code, cut), strict=True)]
        numbers = np.zeros(len(blocks), np.int64)
        numbers[0] = number
        return pa.table({"bucket": pa.array(np.full(len(blocks), key[0].as_py(), np.int32)), "block": blocks, "payload": pa.array(payload, pa.binary()), "total": numbers})

    return words.groupBy("bucket").applyInArrow(run, "bucket int, block long, payload binary, total long")


def sequence_rows(docs: DataFrame, tokens: Callable[[np.ndarray, np.ndarray], Tokens], buckets: int, texts: bool = False, size: int = BLOCK_BYTES) -> DataFrame:
    """(block, ids, counted, payload): one row per block with its documents' token sequences, and with their texts on demand."""
    kind = docs.schema[0].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows, data, offsets in _blocks(batches, size):
            t = tokens(data, offsets)
            counted = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            block = Block.of(t, buckets, counted)
            payload = pack(kernel.put_varints(block.index), kernel.put_varints(np.diff(t.first)), kernel.put_varints(block.sent), struct.pack("<Q", block.mark), *((data.tobytes(), kernel.put_varints(np.diff(offsets))) if texts else ()))
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([rows.column(0).to_pylist()], pa.list_(rows.schema.field(0).type)), pa.array([counted.tolist()], pa.list_(pa.bool_())), binary([payload])], ["block", "ids", "counted", "payload"])

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("counted", T.ArrayType(T.BooleanType())), T.StructField("payload", T.BinaryType())])
    return docs.mapInArrow(run, schema)


binary = kernel.binary


@dataclass
class Met:
    """A block with its answers: for each answer in order, and for each token its answer's number.

    ``texts`` has the texts and their lengths if the sequences do, ``further``
    the payloads of the further replies by bucket.
    """

    ids: pa.Array
    counted: np.ndarray
    first: np.ndarray
    answer: np.ndarray
    replies: list[bytes]
    texts: list[bytes]
    further: list[bytes]


def reassemble(sequences: DataFrame, replies: DataFrame, finish: Callable[[Met], list[pa.Array]], schema: T.StructType, further: DataFrame | None = None) -> DataFrame:
    """Brings answers and sequences of a block together; ``finish`` makes its documents' rows.

    ``further``: (bucket, block, payload) of another exchange over the same blocks.
    """
    both = sequences.withColumn("bucket", F.lit(-1)).unionByName(replies.drop("total"), allowMissingColumns=True)
    if further is not None:
        both = both.unionByName(further.withColumn("bucket", F.col("bucket") + FURTHER), allowMissingColumns=True)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket = table["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        if bucket[order[0]] != -1:
            raise RuntimeError("answers for a block without its sequences")
        blobs = table["payload"].to_pylist()
        index, lengths, sent, mark, *texts = unpack(blobs[order[0]])
        parts = [blobs[k] for k in order[1:] if bucket[k] < FURTHER]
        more = [blobs[k] for k in order[1:] if bucket[k] >= FURTHER]
        if any(p[:8] != mark for p in parts):
            raise RuntimeError("a block's words differ between two readings of the input; checkpoint the input first")
        sent = kernel.get_varints(sent)
        answer = np.empty(len(sent), np.int64)
        answer[sent] = np.arange(len(sent))
        row = table.slice(int(order[0]), 1)
        first = np.concatenate([[0], np.cumsum(kernel.get_varints(lengths))])
        met = Met(row["ids"].combine_chunks().flatten(), np.array(row["counted"][0].as_py(), bool), first, answer[kernel.get_varints(index)], [p[8:] for p in parts], texts, more)
        return pa.Table.from_arrays(finish(met), schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    return both.groupBy("block").applyInArrow(run, schema)
