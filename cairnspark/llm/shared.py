"""What several operators need of the session."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where that setting is absent, as in tests, a folder of this machine is set.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Spark's setting by which the shuffle files of a query go when it ends.
_FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read from there: lineage ends, and lost executors cost nothing.

    The shuffle files that it took go at once, as nothing reads them again; else
    they stay on the executors' disks until the driver collects its garbage.
    """
    shared_folder(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get(_FILES_GO, None)
    conf.set(_FILES_GO, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan of its own, made under the setting
    finally:
        conf.unset(_FILES_GO) if before is None else conf.set(_FILES_GO, before)


def whole_texts(df: DataFrame, rows: int = 1500) -> DataFrame:
    """The same table, with the session's Arrow batches cut to ``rows``: a row carries a whole text.

    A batch size that the user has set stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(rows))
    return df


#: Bytes of input for each range of a hash exchange.
BUCKET_BYTES = 64 << 20


def buckets_for(df: DataFrame) -> int:
    """Ranges of a hash exchange over a table: as many as shuffle partitions, and more where its sources are large, so that a range keeps its size.

    Sizes are the optimiser's for the leaves of the plan; a leaf of unknown size counts nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 50)
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), known // BUCKET_BYTES)
