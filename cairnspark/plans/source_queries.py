"""Queries on sources and sinks: what is written in the shared folder is read back and compared."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import utf8
from ..session import shared_folder
from ..sources import objects as O
from .catalogue import query

#: Objects of a list or nested manifest.
LISTED = 100


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


_TREE = "t AS (SELECT concat('r', n_regionkey, '/', CASE WHEN n_nationkey % 7 = 3 THEN '.' ELSE '' END, replace(n_name, ' ', '_'), CASE n_nationkey % 5 WHEN 0 THEN '.dxf' WHEN 1 THEN '.pdf' WHEN 2 THEN '.PDF' WHEN 3 THEN '.rs' ELSE '.txt' END) AS path, octet_length(encode(n_name)) AS n, n_nationkey % 7 = 3 AS hidden FROM nation), s AS (SELECT 'dxf' AS scan, path, n FROM t WHERE path LIKE '%.dxf' AND NOT hidden UNION ALL SELECT 'pdf', path, n FROM t WHERE lower(path) LIKE '%.pdf' AND NOT hidden UNION ALL SELECT 'all', path, n FROM t WHERE NOT hidden UNION ALL SELECT 'corpus', path, n FROM t WHERE NOT hidden AND (path LIKE '%.rs' OR path IN ('r0/ALGERIA.dxf', 'r1/CANADA.rs', 'r9/none.txt')))"


@query(f"WITH {_TREE} SELECT scan, path, CAST(n AS BIGINT) AS n_bytes, row_number() OVER (PARTITION BY scan ORDER BY path) - 1 AS ord FROM s")
def scanned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-01, 02, 03, 04, 11: a tree of a file per nation, by extension, by extension in any case, whole, and by a list and an extension."""
    folder = _folder(spark)
    endings = (".dxf", ".pdf", ".PDF", ".rs", ".txt")
    for r in O.table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name").collect():
        name = ("." if r.n_nationkey % 7 == 3 else "") + r.n_name.replace(" ", "_") + endings[r.n_nationkey % 5]
        O.write_file(spark, f"{folder}/r{r.n_regionkey}/{name}", r.n_name.encode())
    scans = {
        "dxf": O.files(spark, folder, ".dxf", any_case=False),
        "pdf": O.files(spark, folder, ".pdf"),
        "all": O.files(spark, folder),
        "corpus": O.corpus(spark, folder, ["r0/ALGERIA.dxf", "r1/CANADA.rs", "r9/none.txt"], ".rs"),
    }
    out = None
    for scan, found in scans.items():
        named = found.select(F.lit(scan).alias("scan"), F.substring_index("path", folder.rsplit("/", 1)[-1] + "/", -1).alias("path"), F.col("n_bytes").cast("long").alias("n_bytes"))
        rows = O.with_order(named, "path").select("scan", "path", "n_bytes", F.col("ord").cast("long").alias("ord"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.concat("doc_id", F.lit(".txt")))
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("dev")
    return O.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), split.alias("split"), F.octet_length(utf8("text")).cast("long").alias("bytes"), F.sha2(utf8("text"), 256).alias("sha256"))


_LISTED = "m AS (SELECT doc_id, concat(coalesce(source, 'none'), '/', doc_id, '.txt') AS path, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'dev' END AS split, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS bytes, sha256(encode(coalesce(text, ''))) AS sha256 FROM documents)"


@query(f"WITH {_LISTED} SELECT form, path, bytes, sha256 FROM m, (SELECT unnest(['csv', 'tsv', 'json']) AS form) WHERE form = 'json' OR split = 'dev'")
def manifest_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-08, 09, 10: manifests of all documents as CSV, TSV and nested JSON, read back by split, the last held against the documents."""
    folder, rows = _folder(spark), _listed(spark, sf_dir)
    full = rows.select(*(F.col(c.name) if c.name in rows.columns else F.lit(None).cast(c.dataType).alias(c.name) for c in O.MANIFEST))
    full.write.csv(f"{folder}/csv", header=True)
    full.write.csv(f"{folder}/tsv", header=True, sep="\t")
    nested = rows.groupBy(F.floor(F.col("doc_id") / LISTED).alias("part")).agg(F.collect_list(F.struct("path", "bytes", "sha256")).alias("files"))
    nested.write.json(f"{folder}/json")
    read = {
        "csv": O.csv_manifest(spark, f"{folder}/csv", "dev"),
        "tsv": O.csv_manifest(spark, f"{folder}/tsv", "dev", "\t"),
        "json": O.verified(rows, O.json_manifest(spark, f"{folder}/json", lines=True)),
    }
    out = None
    for form, found in read.items():
        part = found.select(F.lit(form).alias("form"), "path", "bytes", "sha256")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {_LISTED} SELECT path FROM m")
def selection_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-05: names out of NUL-separated lists."""
    lists = _listed(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / LISTED).alias("part")).agg(F.encode(F.array_join(F.collect_list("path"), "\0"), "UTF-8").alias("bytes"))
    return O.selection(lists)


@query(f"WITH {_LISTED} SELECT path, bytes, sha256, true AS refused FROM m")
def published_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-11, 13: a table staged, validated and renamed; a second one of its name is refused by both sinks."""
    folder, rows = _folder(spark), _listed(spark, sf_dir).select("path", "bytes", "sha256")
    O.publish(rows, folder, F.xxhash64("path", "bytes", "sha256"))
    refused = 0
    for again in (lambda: O.publish(rows, folder, F.lit(0)), lambda: O.write_once(rows, folder)):
        try:
            again()
        except (FileExistsError, AnalysisException):
            refused += 1
    return spark.read.parquet(folder).withColumn("refused", F.lit(refused == 2))


@query("WITH p AS (SELECT s % 3 AS zone, (doc_id + s // 3) % 6 AS node, sha256(concat(doc_id, ':', s)) AS mark FROM documents, range(0, 6) t(s)) SELECT CAST(zone AS INTEGER) AS zone, CAST(node AS INTEGER) AS node, count(*) AS n_shares, min(mark) AS least FROM p WHERE NOT (zone = 1 AND node = 2) GROUP BY ALL")
def shares_by_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-12: shares written by zone and node; a lost node is a partition that is not read."""
    folder = _folder(spark)
    shares = O.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("s"))
    zone, node = F.pmod("s", F.lit(3)), F.pmod(F.col("doc_id") + F.floor(F.col("s") / 3), F.lit(6))
    O.write_shares(shares.select(zone.cast("int").alias("zone"), node.cast("int").alias("node"), F.sha2(F.concat_ws(":", "doc_id", "s"), 256).alias("mark")), folder)
    left = spark.read.parquet(folder).where("not (zone = 1 and node = 2)")
    return left.groupBy("zone", "node").agg(F.count("*").alias("n_shares"), F.min("mark").alias("least"))


@query("WITH r AS (SELECT coalesce(lang, 'none') AS lang, count(*) AS files, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS bytes FROM documents GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY lang) AS k FROM r) SELECT 'markdown' AS form, k + 1 AS line_no, concat('| ', lang, ' | ', files, ' | ', bytes, ' |') AS line FROM n UNION ALL SELECT 'tsv', k, concat(lang, chr(9), files, chr(9), bytes) FROM n UNION ALL SELECT 'json', k - 1, concat('{\"lang\":\"', lang, '\",\"files\":', files, ',\"bytes\":', bytes, '}') FROM n UNION ALL SELECT * FROM (VALUES ('markdown', 0, '| lang | files | bytes |'), ('markdown', 1, '| --- | --- | --- |'), ('tsv', 0, concat('lang', chr(9), 'files', chr(9), 'bytes')))")
def report_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-14: a rollup as markdown, TSV and JSON."""
    docs = O.documents(spark, sf_dir).groupBy(F.coalesce("lang", F.lit("none")).alias("lang")).agg(F.count("*").alias("files"), F.sum("n_bytes").alias("bytes"))
    out = None
    for form in ("markdown", "tsv", "json"):
        lines = O.report(docs, form).select(F.lit(form).alias("form"), "line_no", "line")
        out = lines if out is None else out.unionByName(lines)
    return out
