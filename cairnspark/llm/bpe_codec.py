"""Operator 9, byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens are exploded with their positions (``exchange``: a block's sequence
of word numbers), each distinct word of the corpus is encoded once, its ids are
joined back, and every text is reassembled by position.  Decoding joins the
table of token bytes, whose size is the vocabulary's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange, kernel, pretokens, vocabulary
from .shared import buckets_for, whole_texts


def _tokens(data: np.ndarray, offsets: np.ndarray) -> exchange.Tokens:
    starts, _, strange = pretokens.split(data, offsets)
    if len(strange):
        starts = _resplit(data, offsets, starts, strange)
    return exchange.Tokens(exchange.spans(data, np.append(starts, len(data)).astype(np.int64)), np.searchsorted(starts, offsets))


def _resplit(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Texts with code points of unknown class are split by the pattern itself."""
    import public_tokenizers
    import regex

    split = regex.compile(public_tokenizers.PATTERN)
    inside = np.isin(np.searchsorted(offsets, starts, "right") - 1, docs)
    more = []
    for d in docs.tolist():
        at = int(offsets[d])
        for m in split.finditer(data[at : offsets[d + 1]].tobytes().decode()):
            more.append(at)
            at += len(m.group().encode())
    return np.sort(np.concatenate([starts[~inside], np.array(more, np.int64)]))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(id, ids array<int>): the token ids of every whole text under the ranks at ``path``.

    A null text counts as empty and has no ids.  Every input row gives one
    row, whatever its id; repeated and null ids, further columns and empty
    tables need no care.  Long texts make blocks of their own.
    """
    ranks = vocabulary.read_ranks(path)
    buckets = buckets or buckets_for(docs)
    rows = whole_texts(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(False).alias("counted"))

    def answer(asked: exchange.Asked):
        merge = vocabulary.merger(ranks)
        ids = [merge(w) for w in asked.words.to_pylist()]
        sizes = np.fromiter((len(x) for x in ids), np.int64, len(ids))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.fromiter((i for x in ids for i in x), np.int64, int(offsets[-1]))

        def write(code: np.ndarray) -> bytes:
            n = sizes[code]
            at = np.concatenate([[0], np.cumsum(n)])
            return exchange.pack(kernel.put_varints(n), kernel.put_varints(flat[np.repeat(offsets[code] - at[:-1], n) + np.arange(at[-1])]))

        return write, len(ids)

    def finish(met: exchange.Met) -> list[pa.Array]:
        parts = [exchange.unpack(r) for r in met.replies]
        sizes = np.concatenate([kernel.get_varints(p[0]) if p else np.zeros(0, np.int64) for p in parts] or [np.zeros(0, np.int64)])
        flat = np.concatenate([kernel.get_varints(p[1]) for p in parts] or [np.zeros(0, np.int64)])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        n = sizes[met.answer]
        at = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(offsets[met.answer] - at[:-1], n) + np.arange(at[-1])].astype(np.int32)
        return [met.ids, pa.ListArray.from_arrays(pa.array(at[met.first].astype(np.int32)), pa.array(ids))]

    schema = T.StructType([T.StructField("id", rows.schema[0].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    replies = exchange.answers(exchange.word_rows(rows, _tokens, buckets), answer)
    out = exchange.reassemble(exchange.sequence_rows(rows, _tokens, buckets), replies, finish, schema)
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary): the bytes of the ids.  The token table has the vocabulary's size and goes with the function; null ids give null, an unknown id is an error."""
    table = sorted(vocabulary.read_ranks(path).items(), key=lambda x: x[1])
    names = encoded.columns
    if "decoded" in names:
        raise ValueError("the input has a column named decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = table[-1][1] + 1
        lengths = np.full(most, -1)
        lengths[[i for _, i in table]] = [len(b) for b, _ in table]
        begin = np.zeros(most, np.int64)
        begin[[i for _, i in table]] = np.cumsum([0, *(len(b) for b, _ in table)])[:-1]
        text = np.frombuffer(b"".join(b for b, _ in table), np.uint8)
        for batch in batches:
            column = batch.column(names.index(ids_col))
            flat = column.flatten().to_numpy(zero_copy_only=False)
            n = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
            first = np.concatenate([[0], np.cumsum(n)])
            parts = []
            for i, j in kernel.steps(first, 1 << 20):
                ids = flat[first[i] : first[j]]
                size = lengths[ids]
                if len(ids) and size.min() < 0:
                    raise ValueError("an id is not in the vocabulary")
                data, at = kernel.take_spans(text, begin[ids], begin[ids] + size)
                cut = at[first[i : j + 1] - first[i]]
                parts += [data[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            missing = column.is_null().to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if m else p for m, p in zip(missing, parts, strict=True)], pa.binary())], [*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))
