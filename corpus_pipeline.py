"""From raw documents to token ids: five stages, each over all that the one before kept.

Stages take null and empty texts, null and repeated ids, repeated rows, empty
tables, and further columns of any name, which all but the last stage keep.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnspark.llm import bpe_codec, decontamination, jaccard_join, pii, quality, shared

#: Words of a shingle and the least similarity, in per cent, of near duplicates.
SHINGLE, NEAR = 5, 80
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spare(docs: DataFrame, name: str) -> str:
    """A name that no column of the table has."""
    while name in docs.columns:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of documents at hand.

    Every row is judged by its own text, a null one as empty; a score at the cut
    is accepted.  Labels that are null, or of no document, teach nothing; without
    any, all scores are at the cut and every row stays.
    """
    score = _spare(docs, "_quality")
    model = quality.train(docs, _table(spark, sf_dir, "labels"), label_col="quality")
    return quality.classify(docs, model, score_col=score).where(F.col(score) >= quality.CUT).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id, null being the largest; of rows equal in id and text one.

    Rows of one id with different texts, and rows without an id, are documents of their own; texts without words, or
    null, are copies of nothing.  Of rows equal in id and text any one stays, whatever their further columns.
    """
    key = _spare(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    found = jaccard_join.linked(keyed.select(key, "text"), width=SHINGLE, link=NEAR, id_col=key).select(key, "component_id").distinct()
    members = keyed.select(key, "doc_id").distinct().join(found, key)
    first = members.groupBy("component_id").agg(F.min_by(key, F.struct(F.isnull("doc_id"), "doc_id", key)).alias(key)).select(key)
    return keyed.dropDuplicates([key]).join(first, key, "left_semi").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; of rows with equal or null ids only those that have one go.

    Null and empty texts have no window and stay; rows equal in id and text go or stay together.
    """
    found = decontamination.contaminated(docs, _table(spark, sf_dir, "benchmark"), mark_col="mark")
    leaks = found.where(F.size("spans") > 0).select("doc_id", "mark").distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (decontamination.text_mark(F.col("d.text")) == F.col("l.mark"))
    return docs.alias("d").join(leaks.alias("l"), same, "left_anti")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; ``n_chars``, where there is one, follows.

    Every row stays; a text without personal data, a null or empty one among them, stays as it is.
    """
    spans = _spare(docs, "_spans")
    found = pii.with_spans(docs, out_col=spans)
    text = pii.redacted(F.col("text"), F.col(spans))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.withColumn("text", text).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) of every row: token ids, and the text that they decode to; a null text counts as empty."""
    coded = bpe_codec.decode(bpe_codec.encode(docs, VOCABULARY), VOCABULARY)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("PII", redact),
    ("byte-level BPE encoding and decoding", encode),
]

#: A trained classifier, bootstrapped patterns and token merges are not expressible in SQL; the tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written as Parquet in the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{shared.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
