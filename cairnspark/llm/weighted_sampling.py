"""Operator 4, document fingerprints by consistent weighted sampling.

A text's terms are its pairs of neighbouring words, weighted by how often they
occur.  For each sample, gamma variates of a term and the logarithm of its
weight give a value; the term of the least value, with its quantised weight,
is the sample.  Two texts take the same sample with a probability equal to
their generalised Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .shared import whole_texts

SAMPLES = 64
#: Rows of the table of variates; a term takes the row of its hash, and terms that share a row are told apart by their hashes.
ROWS = 1 << 15
SEED = 20240601
#: Terms in one vectorised step.
STEP_TERMS = 1 << 15


@cache
def _variates() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """r and ln c (gamma of shape 2), beta (uniform), and the ordered value of a term of weight 1."""
    random = np.random.default_rng(SEED)
    shape = (ROWS, SAMPLES)
    r = random.gamma(2.0, 1.0, shape).astype(np.float32)
    log_c = np.log(random.gamma(2.0, 1.0, shape)).astype(np.float32)
    beta = random.random(shape, np.float32)
    return r, log_c, beta, _ordered(log_c + r * beta - r)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Floats as integers of the same order, in the upper 32 bits."""
    bits = x.astype(np.float32).view(np.int32)
    return np.where(bits < 0, np.int64(-(1 << 31)) - bits.astype(np.int64), bits.astype(np.int64)) << 32


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, weight, bounds by document): distinct pairs of words; a text of one word has that word."""
    words = kernel.Words(data, offsets)
    h = words.hashes()
    pairs, bounds = kernel.gram_hashes(h, words.first, 2)
    single = np.flatnonzero(words.counts == 1)
    terms = np.concatenate([pairs, h[words.first[single]]])
    doc = np.concatenate([np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), single])
    order = np.lexsort([terms, doc])
    terms, doc = terms[order], doc[order]
    new = kernel.first_of_equal(terms) | kernel.first_of_equal(doc)
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(terms)))
    return terms[at], weight, np.searchsorted(doc[at], np.arange(len(offsets)))


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SAMPLES numbers of 16 bits for each text; a text without words has zeros, which no other has."""
    terms, weight, bounds = _terms(data, offsets)
    r, log_c, beta, plain = _variates()
    out = np.zeros((len(offsets) - 1, SAMPLES), np.uint16)
    columns = np.arange(SAMPLES)
    for i, j in kernel.steps(bounds, STEP_TERMS):
        a, b = bounds[i], bounds[j]
        best = np.full((j - i, SAMPLES), np.iinfo(np.int64).max)
        for x in range(a, b, STEP_TERMS * 4):  # a long text takes several rounds
            y = min(x + STEP_TERMS * 4, b)
            row = (terms[x:y] % np.uint64(ROWS)).astype(np.int64)
            value = plain[row]
            more = np.flatnonzero(weight[x:y] > 1)
            if len(more):
                q = row[more]
                t = np.floor(np.log(weight[x:y][more]).astype(np.float32)[:, None] / r[q] + beta[q])
                value[more] = _ordered(log_c[q] - r[q] * (t - beta[q]) - r[q])
            value += np.arange(x - a, y - a)[:, None]
            first = np.maximum(bounds[i:j], x) - x
            full = np.flatnonzero(np.minimum(bounds[i + 1 : j + 1], y) - x > first)
            if len(full):
                best[full] = np.minimum(best[full], np.minimum.reduceat(value, first[full], axis=0))
        full = np.flatnonzero(bounds[i + 1 : j + 1] > bounds[i:j])
        at = a + (best[full] & 0xFFFFFFFF)
        row = (terms[at] % np.uint64(ROWS)).astype(np.int64)
        t = np.floor(np.log(weight[at]).astype(np.float32) / r[row, columns] + beta[row, columns]).astype(np.int64).astype(np.uint64)
        sample = kernel.mix(terms[at] + t * np.uint64(0x9E3779B97F4A7C15) + columns.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        out[i + full] = (sample % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal samples, row by row."""
    return (a == b).mean(1)


def _signatures_of(texts: list[str]) -> np.ndarray:
    data, offsets = kernel.buffers(pa.array(texts, pa.large_string()))
    return np.concatenate([signatures(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in kernel.steps(offsets, 1 << 20)])


def _hex(signature: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in signature.astype(">u2")]


def fingerprint(docs: DataFrame, *, text_col: str = "text", out_col: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of every whole text (hex, 4 digits a sample); null counts as empty, other columns stay."""
    names = docs.columns
    if out_col in names:
        raise ValueError(f"the input has a column named {out_col}")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or "" for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_hex(_signatures_of(texts)) if texts else [], pa.string())], [*names, out_col])

    return whole_texts(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.StringType())]))


def in_sequence(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(bucket, guest, id, text): documents by descending id in ranges, each range followed by a guest, the document after its last.

    Ranges come from quantiles of the ids, so there is no single sorted
    partition; their upper bounds are ids, and those documents are the guests.
    Null ids come after all others; equal ids follow in the order of their texts.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = whole_texts(docs).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bounds = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n + 1)], 20 * n)).first()[0] or []
    upper = np.unique(np.array(bounds, np.int64))
    k = max(len(upper), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            empty = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(0).to_numpy()
            bucket = np.where(empty, 0, np.minimum(np.searchsorted(upper, ids), k - 1))
            edge = np.flatnonzero(~empty & np.isin(ids, upper))
            take = np.concatenate([np.arange(len(ids)), edge])
            to = np.concatenate([bucket, (bucket[edge] + 1) % k])
            guest = np.arange(len(take)) >= len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(guest), *(c.take(pa.array(take)) for c in batch.columns)], ["bucket", "guest", "id", "text"])

    dealt = rows.mapInArrow(run, "bucket int, guest boolean, id long, text string")
    return dealt.repartitionById(k, "bucket").sortWithinPartitions("bucket", "guest", F.col("id").desc_nulls_last(), "text")


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edit, whose last half is replaced by as much of the next document.

    Returns (id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).  A null text counts as empty.  Every input row
    gives one row; the next of a table's only document is itself.  If all ids
    are null, the first by text follows the last.  Further columns are ignored.
    """
    rows = in_sequence(docs, id_col=id_col, text_col=text_col, partitions=partitions)

    def out(held: list[tuple], marks: np.ndarray) -> pa.RecordBatch | None:
        use = [i for i in range(len(held) - 1) if held[i][0] == held[i + 1][0] and not held[i][1]]
        if not use:
            return None
        texts = [held[i][3] for i in use]
        after = [held[i + 1][3] for i in use]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after, strict=True)]
        edit_marks = _signatures_of(edited)
        own, following = marks[use], marks[[i + 1 for i in use]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([held[i][2] for i in use], pa.int64()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(_hex(own)),
                pa.array(_hex(edit_marks)),
                pa.array(likeness(own, edit_marks)),
                pa.array(likeness(own, following)),
            ],
            ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        marks = np.zeros((0, SAMPLES), np.uint16)
        begin: tuple | None = None  # the first row of the bucket, for a bucket without a guest
        begin_mark = None

        def close() -> pa.RecordBatch | None:
            if held and not held[-1][1]:
                return out([held[-1], (held[-1][0], True, *begin[2:])], np.vstack([marks[-1:], begin_mark]))
            return None

        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                for bucket, rows in _by_bucket(list(zip(*(c.to_pylist() for c in batch.slice(i, 512).columns), strict=True))):
                    new = _signatures_of([x[3] for x in rows])
                    if held and held[-1][0] != bucket:
                        if last := close():
                            yield last
                        held, marks = [], marks[:0]
                    if not held:
                        begin, begin_mark = rows[0], new[:1]
                    held, marks = held + rows, np.vstack([marks, new])
                    if found := out(held, marks):
                        yield found
                    held, marks = held[-1:], marks[-1:]
        if last := close():
            yield last

    done = rows.mapInArrow(run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return done.withColumnRenamed("id", id_col)


def _by_bucket(rows: list[tuple]) -> Iterator[tuple[int, list[tuple]]]:
    i = 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j][0] == rows[i][0]:
            j += 1
        yield rows[i][0], rows[i:j]
        i = j
