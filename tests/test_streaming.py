from pyspark.sql import functions as F

from cairnspark.operators import ledgers, similarity
from cairnspark.streaming import deduplication


def test_chunks_arrive_once(spark, tmp_path):
    first = spark.createDataFrame([(1, b"a" * 10), (2, b"b" * 10)], "ord long, bytes binary")
    second = spark.createDataFrame([(3, b"a" * 10), (4, b"c" * 5)], "ord long, bytes binary")
    first.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(first.schema).parquet(str(tmp_path / "in"))
    query = deduplication.new_chunks(stream, 5).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        assert spark.table("arrived").count() == 2
        second.write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
        assert spark.table("arrived").count() == 3
    finally:
        query.stop()


def test_late_chunks_are_forgotten_with_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, b"abc"), (2, b"abc")], "ord long, bytes binary").withColumn("ts", F.timestamp_seconds(F.col("ord")))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = deduplication.new_chunks(stream, 5, ts="ts").writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        query.processAllAvailable()
        assert spark.table("timed").count() == 1
    finally:
        query.stop()


def test_exponents_and_edits():
    assert ledgers.exponent_form(1.0) == "1.000000000000e0" and ledgers.exponent_form(-1.5e-7) == "-1.500000000000e-7"
    assert similarity.edit(b"abcabc", b"abc") == (3, 0, b"") and similarity.edit(b"", b"x") == (0, 0, b"x")
    assert similarity.edit(b"start middle end", b"start other end") == (6, 4, b"other")


def test_a_patch_chain_that_never_ends_is_an_error(spark):
    import pytest

    loop = spark.createDataFrame([(1, 2, b"x"), (2, 1, b"y")], "ord long, base long, payload binary")
    with pytest.raises(ValueError):
        ledgers.resolved(loop)
