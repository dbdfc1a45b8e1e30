import secrets

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cairnspark.sources import objects as O


@pytest.mark.parametrize("name", ["/etc/x", "a/../b", ".."])
def test_unsafe_names_are_refused(spark, name):
    rows = spark.createDataFrame([(b"a/b\0" + name.encode() + b"\0",)], "bytes binary")
    with pytest.raises(PySparkException, match="unsafe path"):
        O.selection(rows).collect()


def test_lists_without_names(spark):
    rows = spark.createDataFrame([(b"",), (b"\0\0",), (None,)], "bytes binary")
    assert O.selection(rows).collect() == []


@pytest.mark.parametrize("manifest, problem", [([("a", 1, "x")], "extra"), ([("a", 1, "x"), ("b", 2, "z")], "hash"), ([("a", 1, "x"), ("b", 3, "y")], "size"), ([("a", 1, "x"), ("b", 2, "y"), ("c", 1, "x")], "missing")])
def test_manifest_that_disagrees(spark, manifest, problem):
    schema = "path string, bytes long, sha256 string"
    found = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], schema)
    listed = spark.createDataFrame(manifest, schema)
    assert [r.problem for r in O.manifest_problems(found, listed).collect()] == [problem]
    with pytest.raises(PySparkException, match=problem):
        O.verified(found, listed).collect()
    assert O.verified(found, found).count() == 2


def test_files_are_written_once(spark, tmp_path):
    path = f"file:{tmp_path}/r/a.dxf"
    O.write_file(spark, path, b"0\nEOF\n")
    with pytest.raises(Exception, match="already exists"):
        O.write_file(spark, path, b"")
    assert [bytes(r.bytes) for r in O.files(spark, f"file:{tmp_path}/r").collect()] == [b"0\nEOF\n"]


def test_a_table_that_changes_is_not_published(spark, tmp_path):
    path = f"file:{tmp_path}/t"

    def drawn(batches):
        for batch in batches:
            yield batch.assign(id=[secrets.randbits(40) for _ in batch.id])

    with pytest.raises(RuntimeError, match="differs"):
        O.publish(spark.range(100).mapInPandas(drawn, "id long"), path, F.col("id"))
    assert list(tmp_path.iterdir()) == []
    O.publish(spark.range(0), path, F.col("id"))
    assert spark.read.parquet(path).count() == 0
    with pytest.raises(FileExistsError):
        O.publish(spark.range(1), path, F.col("id"))
