"""Operator 6, quality classifier by Bradley-Terry pairwise ranking.

Labelled documents give preference pairs (a good one over a bad one); logistic
loss on differences of features learns one weight per feature, and a document's
score is the weighted sum.  The threshold is the score quantile at the share of
bad labels among the training rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel
from .shared import whole_texts

#: Labelled rows that training takes at most: those of the smallest hashes of their ids.
TRAIN_ROWS = 20_000
#: Preference pairs for each training row of the rarer label.
PAIRS_EACH = 16
#: The score at the quantile threshold.
CUT = 0.3

FEATURES = ("log_words", "word_length", "upper", "digit", "mark", "white", "wide", "sentence_end", "odd_end", "shouted", "bare", "distinct", "most_common", "distinct_pairs", "lines")

_UPPER, _LOWER, _DIGIT, _WHITE, _WIDE = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = _WIDE[128:] = True
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_MARK = ~(_UPPER | _LOWER | _DIGIT | _WHITE | _WIDE)
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".,;:?'\")]"]] = True


def _per_doc(sorted_keys: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, most repeats of one) of each document; a key's upper half is its document."""
    if not len(sorted_keys):
        return np.zeros(docs), np.zeros(docs)
    at = np.flatnonzero(kernel.first_of_equal(sorted_keys))
    doc = (sorted_keys[at] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(docs)
    np.maximum.at(most, doc, np.diff(np.append(at, len(sorted_keys))))
    return np.bincount(doc, minlength=docs).astype(float), most


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros."""
    words = kernel.Words(data, offsets)
    n = words.counts
    docs = len(n)

    def share(flag: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag)])
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(of, 1)

    size = np.diff(offsets)
    last = data[words.ends - 1]
    inside = np.concatenate([[0], np.cumsum(_LOWER[data] | _WIDE[data])]), np.concatenate([[0], np.cumsum(_UPPER[data])])
    small, large = (x[words.ends] - x[words.starts] for x in inside)
    doc = words.doc.astype(np.uint64) << np.uint64(40)
    h = words.hashes()
    keys = np.sort(doc | (h >> np.uint64(24)))
    distinct, most = _per_doc(keys, docs)
    pairs, bounds = kernel.gram_hashes(h, words.first, 2)
    pair_doc = np.repeat(np.arange(docs), np.diff(bounds)).astype(np.uint64) << np.uint64(40)
    distinct_pairs, _ = _per_doc(np.sort(pair_doc | (pairs >> np.uint64(24))), docs)
    columns = [
        np.log1p(n),
        np.minimum((size - share(_WHITE[data], offsets, 1)) / np.maximum(n, 1), 40) / 10,
        share(_UPPER[data], offsets, size),
        share(_DIGIT[data], offsets, size),
        share(_MARK[data], offsets, size),
        share(_WHITE[data], offsets, size),
        share(_WIDE[data], offsets, size),
        share(_END[last], words.first, n),
        share(_MARK[last] & ~_END[last], words.first, n),
        share((large > 1) & (small == 0), words.first, n),
        share((large == 0) & (small == 0), words.first, n),
        distinct / np.maximum(n, 1),
        most / np.maximum(n, 1),
        distinct_pairs / np.maximum(n - 1, 1),
        share(data == 10, offsets, n) * 10,
    ]
    return np.column_stack(columns) if docs else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    """Weights for standardised features, and the threshold among raw scores."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.scale) @ self.weight
        return 1 / (1 + np.exp(-np.clip(raw - self.threshold + np.log(CUT / (1 - CUT)), -60, 60)))


def fit(x: np.ndarray, label: np.ndarray, *, ridge: float = 1e-3, rounds: int = 60) -> Model:
    """Newton's method on the logistic loss of differences; with labels of one kind only, every score is the cut."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(bad):
        k = x.shape[1]
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-9] = 1
    z = np.clip((x - mean) / scale, -8, 8)
    n = PAIRS_EACH * min(len(good), len(bad))
    step = np.arange(n)
    difference = z[good[(step * 7919 + step // len(good)) % len(good)]] - z[bad[(step * 104729 + step // len(bad)) % len(bad)]]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ (p - 1) / n + ridge * w
        curve = (difference * (p * (1 - p))[:, None]).T @ difference / n + ridge * np.eye(len(w))
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    raw = np.sort(((x - mean) / scale) @ w)
    k = len(bad)
    return Model(mean, scale, w, float((raw[k - 1] + raw[k]) / 2))


def train(docs: DataFrame, labels: DataFrame, *, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Learns from at most ``rows`` labelled documents; of repeated labels the lower counts, null ids and null labels don't."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(rows)
    texts = whole_texts(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.withColumnRenamed(id_col, "id")), "id").select("label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), _listed(batch.column(1))], ["label", "x"])

    found = texts.mapInArrow(run, "label int, x array<double>").toArrow()
    x = found["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES))
    order = np.lexsort([found["label"].to_numpy(), *x.T])  # the same whatever order the rows came in
    return fit(x[order], found["label"].to_numpy()[order])


def _matrix(column: pa.Array) -> np.ndarray:
    data, offsets = kernel.buffers(column)
    parts = [features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in kernel.steps(offsets, 2 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _listed(column: pa.Array) -> pa.Array:
    x = _matrix(column)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))


def classify(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Adds the score (0 to 1; CUT or more: predicted good) to every row, from its whole text alone.

    A null text counts as empty.  Rows are independent, so null and repeated
    ids are no concern; all columns stay, and a clash with ``score_col`` is an
    error.  An empty table stays empty.
    """
    names = docs.columns
    if score_col in names:
        raise ValueError(f"the input has a column named {score_col}")
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(_matrix(batch.column(at))))], [*names, score_col])

    return whole_texts(docs).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds
