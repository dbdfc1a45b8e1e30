"""Sources and sinks of objects: tables, file trees, manifests, packed streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expressions import utf8

MANIFEST = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("family", T.StringType()), ("split", T.StringType()), ("variant", T.StringType()), ("relation", T.StringType()), ("bytes", T.LongType()), ("sha256", T.StringType()), ("base", T.StringType()), ("byte_equal_to_base", T.StringType()), ("entities", T.IntegerType()), ("edited_values", T.IntegerType()), ("expect", T.StringType()))])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """objects(ord, family, lang, bytes, n_bytes): the documents in order of their ids."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("family"), "lang", utf8("text").alias("bytes")).withColumn("n_bytes", F.octet_length("bytes").cast("long"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("family"), utf8("html").alias("bytes")).withColumn("n_bytes", F.octet_length("bytes").cast("long"))


def files(spark: SparkSession, folder: str, extension: str | None = None, any_case: bool = True) -> DataFrame:
    """objects(path, bytes, n_bytes) of a file tree; hidden files are left out by the source itself.

    Order is that of the paths; ``with_order`` numbers them.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    if extension is not None:
        name = F.lower("path") if any_case else F.col("path")
        found = found.where(name.endswith(extension))
    return found.select("path", F.col("content").alias("bytes"), F.col("length").alias("n_bytes"))


def corpus(spark: SparkSession, folder: str, names: list[str], extension: str) -> DataFrame:
    """objects(path, bytes, n_bytes): the files of a fixed list of relative names, and all of an extension."""
    found = files(spark, folder)
    return found.where(F.substring_index("path", folder.rstrip("/").rsplit("/", 1)[-1] + "/", -1).isin(names) | F.col("path").endswith(extension))


def with_order(df: DataFrame, by: str, prefix: int = 2) -> DataFrame:
    """Adds ``ord``, the place in the order of a unique string column.

    Rows are numbered within groups of equal prefixes (take a longer one where
    paths share their beginning), and groups are counted up in order: the only
    unpartitioned window is over the groups.
    """
    group = F.col("_group")
    rows = df.withColumn("_group", F.substring(by, 1, prefix))
    before = F.sum("count").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("_group").count().select("_group", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_group").orderBy(by)) - 1
    return rows.withColumn("_within", within).join(counts, "_group").withColumn("ord", F.col("_before") + F.col("_within")).drop("_group", "_within", "_before")


def selection(data: DataFrame, column: str = "bytes") -> DataFrame:
    """Paths of a NUL-separated list; absolute ones and those that climb are refused."""
    path = F.explode(F.split(F.decode(column, "UTF-8"), "\0"))
    listed = data.select(path.alias("path")).where("path <> ''")
    bad = F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), "..")
    return listed.withColumn("path", F.when(bad, F.raise_error(F.concat(F.lit("unsafe path: "), "path"))).otherwise(F.col("path")))


def csv_manifest(spark: SparkSession, path: str, split: str | None = None, separator: str = ",") -> DataFrame:
    """Manifest rows of a CSV or TSV file, by header, in order of their paths."""
    rows = spark.read.csv(path, header=True, schema=MANIFEST, sep=separator)
    return (rows.where(F.col("split") == split) if split else rows).orderBy("path")


def json_manifest(spark: SparkSession, path: str, rows: str = "files", lines: bool = False) -> DataFrame:
    """The rows nested in JSON manifests: one to a file, or one to a line."""
    return spark.read.json(path, multiLine=not lines).select(F.explode(rows).alias("row")).select("row.*")


def _met(found: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    both = found.select(key, F.col("bytes").alias("f_bytes"), F.col("sha256").alias("f_sha")).join(manifest.select(key, F.col("bytes").alias("m_bytes"), F.col("sha256").alias("m_sha")), key, "full_outer")
    problem = F.when(F.col("f_sha").isNull(), "missing").when(F.col("m_sha").isNull(), "extra").when(F.col("f_bytes") != F.col("m_bytes"), "size").when(F.col("f_sha") != F.col("m_sha"), "hash")
    return both.withColumn("problem", problem)


def manifest_problems(found: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """(path, problem): names missing, extra or repeated, and drift of size or hash."""
    twice = manifest.groupBy(key).count().where("count > 1").select(key, F.lit("repeated").alias("problem"))
    return _met(found, manifest, key).where("problem is not null").select(key, "problem").unionByName(twice)


def verified(found: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """(path, bytes, sha256) of what agrees with its manifest; the first disagreement ends the job."""
    wrong = F.raise_error(F.concat_ws(": ", "problem", key))
    return _met(found, manifest, key).select(key, F.col("m_bytes").alias("bytes"), F.when(F.col("problem").isNotNull(), wrong).otherwise(F.col("m_sha")).alias("sha256"))


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """One file, synced; refuses an existing one."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(data))
        out.hsync()
    finally:
        out.close()


def publish(df: DataFrame, path: str, mark: Column) -> None:
    """Writes beside the target, validates what was written by its rows and the sum of ``mark``, and renames; refuses an existing target."""
    spark = df.sparkSession
    target, staged = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged"))
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        raise FileExistsError(path)
    df.write.mode("errorifexists").parquet(staged.toString())
    sums = lambda rows: rows.agg(F.count("*"), F.sum(mark.cast("decimal(38,0)"))).first()
    if sums(df) != sums(spark.read.parquet(staged.toString())):
        system.delete(staged, True)
        raise RuntimeError(f"what was written for {path} differs from its input")
    if not system.rename(staged, target):
        raise FileExistsError(path)


def write_once(df: DataFrame, path: str) -> None:
    """Refuses an existing target; the commit protocol publishes whole results only."""
    df.write.mode("errorifexists").parquet(path)


def write_shares(shares: DataFrame, path: str) -> None:
    """Shares by zone and node: losing a node is losing a partition."""
    shares.write.mode("errorifexists").partitionBy("zone", "node").parquet(path)


def to_markdown(df: DataFrame) -> str:
    """A small report as a markdown table."""
    rows = [df.columns, ["---"] * len(df.columns), *([str(v) for v in r] for r in df.collect())]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def report(df: DataFrame, form: str) -> DataFrame:
    """(line_no, line) of a report as ``markdown``, ``tsv`` or ``json``, in the order of its first column; for reports of few rows."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    markdown = lambda values: F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))
    row = {"markdown": markdown(cells), "tsv": F.concat_ws("\t", *cells), "json": F.to_json(F.struct(*df.columns))}[form]
    names, rules = [F.lit(c) for c in df.columns], [F.lit("---")] * len(df.columns)
    heads = {"markdown": [markdown(names), markdown(rules)], "tsv": [F.concat_ws("\t", *names)], "json": []}[form]
    rows = df.select((F.row_number().over(Window.orderBy(df.columns[0])) + len(heads) - 1).cast("long").alias("line_no"), row.alias("line"))
    for k, head in enumerate(heads):
        rows = rows.unionByName(df.sparkSession.range(1).select(F.lit(k).cast("long").alias("line_no"), head.alias("line")))
    return rows
