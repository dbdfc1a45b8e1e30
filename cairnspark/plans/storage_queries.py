"""Queries on chunks, duplicates, gates, stripes and their accounts.  OP numbers are those of the survey."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import storage as S
from ..sources import objects as O
from .catalogue import query

CHUNK = 4096
_DOCS = "docs AS (SELECT doc_id AS ord, source AS family, lang, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents)"
_CHUNKS = f"chunks AS (SELECT ord, family, i AS chunk_no, b[i * {CHUNK} + 1 : least((i + 1) * {CHUNK}, n)] AS c FROM docs, range(0, (n + {CHUNK - 1}) // {CHUNK}) t(i))"
_VAR = "(({n} // 1048576) * 1572864 + (({n} - ({n} // 1048576) * 1048576 + 3) // 4) * 6)"


def _protected(n: str) -> str:
    catalog = f"(21 + (({n} + 1048575) // 1048576) * 240)"
    return f"({_VAR.format(n=n)} + {_VAR.format(n=catalog)} + ((({catalog} + 1048575) // 1048576) * 240 + 32) * 6)"


@query(f"WITH {_DOCS}, {_CHUNKS}, f AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY ord, chunk_no) AS k FROM chunks) SELECT family, count(*) AS n_chunks, CAST(sum(octet_length(c)) AS BIGINT) AS n_bytes, count(*) FILTER (k = 1) AS n_first, CAST(coalesce(sum(octet_length(c)) FILTER (k = 1), 0) AS BIGINT) AS first_bytes FROM f GROUP BY family")
def chunk_dedup_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-136, 35, 54, 96: fixed chunks, each counted where it is first seen."""
    rows = S.chunks(O.documents(spark, sf_dir).select("ord", "family", "bytes"), CHUNK).drop("chunk")
    seen = S.first_seen(rows, "sha256", "ord", "chunk_no")
    is_first = (F.col("first.ord") == F.col("ord")) & (F.col("first.chunk_no") == F.col("chunk_no"))
    return seen.groupBy("family").agg(F.count("*").alias("n_chunks"), F.sum("len").cast("long").alias("n_bytes"), F.count_if(is_first).alias("n_first"), F.sum(F.when(is_first, F.col("len")).otherwise(0)).cast("long").alias("first_bytes"))


@query("SELECT doc_id AS ord, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_ord FROM documents")
def file_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-36, 44: every object's earliest equal."""
    rows = O.documents(spark, sf_dir).select("ord", F.sha2("bytes", 256).alias("sha256"))
    return S.first_seen(rows, "sha256", "ord").select("ord", F.col("first.ord").alias("first_ord"))


@query(f"WITH {_DOCS}, {_CHUNKS}, g AS (SELECT c, min(ord * 1048576 + chunk_no) AS place FROM chunks GROUP BY c), o AS (SELECT c, row_number() OVER (ORDER BY place) - 1 AS object_id FROM g) SELECT ord, CAST(chunk_no AS INTEGER) AS chunk_no, object_id FROM chunks JOIN o USING (c)")
def first_seen_object_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-73: dense numbers of chunks in the order of their first appearance."""
    rows = S.chunks(O.documents(spark, sf_dir).select("ord", "bytes"), CHUNK).select("ord", "chunk_no", "sha256")
    new = rows.groupBy("sha256").agg(F.min(F.struct("ord", "chunk_no")).alias("first"))
    per = new.groupBy(F.col("first.ord").alias("ord")).count()
    numbered = S.running_total(per, "ord", "count", "before")
    within = F.row_number().over(Window.partitionBy("first.ord").orderBy("first.chunk_no")) - 1
    ids = new.withColumn("within", within).join(numbered.withColumnRenamed("ord", "o"), F.col("first.ord") == F.col("o")).select("sha256", (F.col("before") + F.col("within")).alias("object_id"))
    return rows.join(ids, "sha256").select("ord", "chunk_no", "object_id")


@query(f"WITH {_DOCS} SELECT ord, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(sum(n) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pack_offset FROM docs")
def pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-72, 15: places in one packed stream."""
    return S.running_total(O.documents(spark, sf_dir).select("ord", "n_bytes"), "ord", "n_bytes", "pack_offset")


@query(f"WITH {_DOCS}, p AS (SELECT ord, n, coalesce(sum(n) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM docs), e AS (SELECT ord, s, least(a + n, (s + 1) * 65536) - greatest(a, s * 65536) AS x FROM p, range(CAST(a // 65536 AS BIGINT), CAST((a + n - 1) // 65536 AS BIGINT) + 1) t(s) WHERE n > 0) SELECT s AS stripe_no, count(*) AS n_objects, CAST(sum(x) AS BIGINT) AS n_bytes, min(ord) AS first_ord, max(ord) AS last_ord FROM e GROUP BY s")
def stripe_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-84: stripes of 64 KiB over the packed stream, across objects."""
    each = S.striped(O.documents(spark, sf_dir).select("ord", "n_bytes"), 64 * X.KIB)
    return each.groupBy("stripe_no").agg(F.count("*").alias("n_objects"), F.sum("bytes_in").cast("long").alias("n_bytes"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"))


_BYTES = "x AS (SELECT ord, n, substr(hex(b), 2 * i + 1, 2) AS v FROM docs, range(0, n) t(i)), h AS (SELECT ord, n, v, count(*) AS k FROM x GROUP BY ALL), e AS (SELECT ord, -sum(k / n * log2(k / n)) AS e FROM h GROUP BY ord)"


@query(f"WITH {_DOCS}, {_BYTES} SELECT ord, round(coalesce(e, 0), 6) + 0 AS entropy FROM docs LEFT JOIN e USING (ord)")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-53, 100: Shannon entropy of every object's bytes."""
    return O.documents(spark, sf_dir).select("ord", F.round(S.entropy("bytes"), 6).alias("entropy"))


@query(f"WITH {_DOCS}, {_BYTES}, z AS (SELECT family, coalesce(e, 0) AS e FROM docs LEFT JOIN e USING (ord)) SELECT family, round(min(e), 6) AS low, round(max(e), 6) AS high, count(*) FILTER (isnan(e)) AS n_odd FROM z GROUP BY family")
def entropy_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-56: least and greatest, and how many aren't finite."""
    rows = O.documents(spark, sf_dir).select("family", S.entropy("bytes").alias("e"))
    return rows.groupBy("family").agg(F.round(F.min("e"), 6).alias("low"), F.round(F.max("e"), 6).alias("high"), F.count_if(F.isnan("e")).alias("n_odd"))


@query(f"WITH {_DOCS}, s AS (SELECT ord, b[1:8192] AS b, least(n, 8192) AS n FROM docs), x AS (SELECT ord, n, substr(hex(b), 2 * i + 1, 2) AS v FROM s, range(0, n) t(i)), h AS (SELECT ord, n, v, count(*) AS k FROM x GROUP BY ALL), e AS (SELECT ord, -sum(k / n * log2(k / n)) AS e FROM h GROUP BY ord) SELECT ord, round(coalesce(e, 0), 6) + 0 AS entropy, coalesce(e, 0) < 6.4 AS try_zstd FROM docs LEFT JOIN e USING (ord)")
def entropy_gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-103, 20: the gate on every object's beginning (its texts are all of low entropy)."""
    g = O.documents(spark, sf_dir).select("ord", S.gate("bytes").alias("g"))
    return g.select("ord", F.round("g.entropy", 6).alias("entropy"), "g.try_zstd")


_VECTORS = "v AS (SELECT vec_id, string_agg(lpad(to_hex(CAST(floor((x + 1) * 128) AS BIGINT) & 255), 2, '0'), '' ORDER BY i) AS h, count(*) AS n FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY vec_id)"


@query(f"WITH {_VECTORS}, l AS (SELECT unnest([1, 2, 4, 8, 16, 32]) AS lag), m AS (SELECT vec_id, lag, sum(CASE WHEN substr(h, 2 * i + 1, 2) = substr(h, 2 * (i + lag) + 1, 2) THEN 1 ELSE 0 END) AS same, n - lag AS pairs FROM v, l, range(0, n - lag) t(i) GROUP BY vec_id, lag, n), f AS (SELECT vec_id, min(lag) AS lag FROM m WHERE pairs >= 16 AND same >= 0.05 * pairs GROUP BY vec_id) SELECT vec_id, CAST(lag AS INTEGER) AS lag FROM v LEFT JOIN f USING (vec_id)")
def periodic_lag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-102: the first lag at which the bytes of quantised vectors repeat."""
    @F.pandas_udf("int")
    def lag(column: pd.Series) -> pd.Series:
        return column.map(lambda h: S.lag_of(bytes.fromhex(h), (1, 2, 4, 8, 16, 32), 0.05, 16)).astype("Int32")

    byte = lambda x: F.lpad(F.hex(F.floor((x.cast("double") + 1) * 128).cast("long").bitwiseAND(255)), 2, "0")
    rows = O.table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform("embedding", byte), "").alias("h"))
    return rows.select("vec_id", lag("h").alias("lag"))


@query(f"WITH {_DOCS} SELECT ord, CAST(n AS BIGINT) AS n_bytes, CAST(((n + 1048575) // 1048576) * 1572864 AS BIGINT) AS fixed_bytes, CAST({_VAR.format(n='n')} AS BIGINT) AS variable_bytes FROM docs")
def coded_bytes_fixed_vs_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-119, 120: stored bytes of either layout, in closed form."""
    n = F.col("n_bytes")
    return O.documents(spark, sf_dir).select("ord", "n_bytes", X.fixed_coded(n).alias("fixed_bytes"), X.variable_coded(n).alias("variable_bytes"))


@query(f"WITH {_DOCS} SELECT coalesce(family, 'all') AS family, count(*) AS n_files, CAST(sum(n) AS BIGINT) AS n_bytes, CAST(sum({_protected('n')}) AS BIGINT) AS protected_bytes, CAST(sum(n // 1048576) AS BIGINT) AS full_stripes, count(*) FILTER (n % 1048576 > 0) AS tails FROM docs GROUP BY ROLLUP (family)")
def protected_bytes_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-54, 60, 69, 121: what is stored for every family, and a total row."""
    n = F.col("n_bytes")
    rows = O.documents(spark, sf_dir).select("family", "n_bytes").withColumn("p", X.protected(n))
    out = rows.rollup("family").agg(F.count("*").alias("n_files"), F.sum("n_bytes").cast("long").alias("n_bytes"), F.sum("p").cast("long").alias("protected_bytes"), F.sum(F.floor(n / X.MIB)).cast("long").alias("full_stripes"), F.count_if(n % X.MIB > 0).alias("tails"))
    return out.withColumn("family", F.coalesce("family", F.lit("all")))


@query("WITH d AS (SELECT source, count(*) AS f, count(DISTINCT text) AS u FROM documents GROUP BY source) SELECT source, (3 * (f * 232 + u * 36 + f * 8 + f * 8 + u) + 1) // 2 AS modeled_bytes FROM d")
def modeled_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-122: the older model's charges."""
    d = O.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("f"), F.count_distinct("text").alias("u"))
    f, u = F.col("f"), F.col("u")
    return d.select("source", X.modeled_metadata(f, u, f, f, F.lit(0)).alias("modeled_bytes"))


_SHARES = "s AS (SELECT ord, n, (n + 3) // 4 AS w, rpad(hex(b), CAST(8 * ((n + 3) // 4) AS INTEGER), '0') AS h FROM docs)"


@query(f"WITH {_DOCS}, {_SHARES} SELECT ord, CAST(w AS BIGINT) AS share_len, " + ", ".join(f"sha256(unhex(substr(h, {i} * 2 * w + 1, 2 * w))) AS share_{i}" for i in range(4)) + " FROM s")
def shard_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-142: hashes of the four data shares of each object as one stripe."""
    rows = O.documents(spark, sf_dir).select("ord", X.ceil_div(F.col("n_bytes"), 4).alias("share_len"), S.coded_shares("bytes").alias("shares"))
    return rows.select("ord", "share_len", *(F.sha2(F.get("shares", F.lit(i)), 256).alias(f"share_{i}") for i in range(4)))


_BYTE = lambda i: f"CAST('0x' || substr(h, {i} * 2 * w + 2 * j + 1, 2) AS INTEGER)"
_DOUBLE = lambda x: f"xor({x} << 1, CASE WHEN {x} >= 128 THEN 285 ELSE 0 END)"


@query(f"WITH {_DOCS}, {_SHARES}, x AS (SELECT ord, w, j, {', '.join(f'{_BYTE(i)} AS d{i}' for i in range(4))} FROM s, range(0, w) t(j)), y AS (SELECT *, {_DOUBLE('d1')} AS m1, xor({_DOUBLE('d2')}, d2) AS m2, {_DOUBLE('d3')} AS e3 FROM x), z AS (SELECT ord, w, j, xor(xor(d0, d1), xor(d2, d3)) AS p, xor(xor(d0, m1), xor(m2, {_DOUBLE('e3')})) AS q FROM y), g AS (SELECT ord, string_agg(printf('%02x', p), '' ORDER BY j) AS p, string_agg(printf('%02x', q), '' ORDER BY j) AS q FROM z GROUP BY ord) SELECT ord, sha256(unhex(coalesce(p, ''))) AS p_sha256, sha256(unhex(coalesce(q, ''))) AS q_sha256 FROM docs LEFT JOIN g USING (ord)")
def parity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-123, 145: the plain and the weighted parity of every object."""
    rows = O.documents(spark, sf_dir).select("ord", S.coded_shares("bytes").alias("shares"))
    return rows.select("ord", F.sha2(F.get("shares", F.lit(4)), 256).alias("p_sha256"), F.sha2(F.get("shares", F.lit(5)), 256).alias("q_sha256"))


@query("SELECT source AS family, count(*) AS n_stripes, count(*) * 21 AS n_patterns, count(*) * 21 AS n_exact FROM documents GROUP BY source")
def loss_patterns_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-51, 142, 143, 148: every loss of one or two of six shares restores the bytes."""
    rows = O.documents(spark, sf_dir).select("family", S.recoveries("bytes").alias("r"))
    return rows.groupBy("family").agg(F.count("*").alias("n_stripes"), F.sum("r.patterns").cast("long").alias("n_patterns"), F.sum("r.exact").cast("long").alias("n_exact"))


@query("SELECT source AS family, count(*) AS n_stripes, count(*) * 35 AS n_patterns, count(*) * 35 AS n_exact FROM documents GROUP BY source")
def triple_loss_43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-52, 147: every loss of three of seven shares restores the bytes."""
    rows = O.documents(spark, sf_dir).select("family", S.recoveries("bytes", 4, 3, least=3).alias("r"))
    return rows.groupBy("family").agg(F.count("*").alias("n_stripes"), F.sum("r.patterns").cast("long").alias("n_patterns"), F.sum("r.exact").cast("long").alias("n_exact"))


@query("SELECT page_id AS ord, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n_bytes, sha256(encode(coalesce(html, ''))) AS sha256 FROM pages")
def repair_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-143, 144, 146, 178: shares in long form, one dropped and one damaged, restored."""
    pages = O.pages(spark, sf_dir).select("ord", "n_bytes", S.coded_shares("bytes").alias("shares"))
    each = pages.select(F.col("ord").alias("id"), F.col("n_bytes").alias("length"), F.posexplode("shares").alias("share_no", "share")).withColumn("sha256", F.sha2("share", 256))
    lost, hit = F.col("id") % 6, (F.col("id") + 2) % 6
    damaged = each.where(F.col("share_no") != lost).withColumn("share", F.when(F.col("share_no") == hit, F.concat("share", F.lit(b"!"))).otherwise(F.col("share")))
    whole = S.repaired(damaged)
    return whole.select(F.col("id").alias("ord"), F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("sha256"))


@query("SELECT p.policy, count(*) AS n_objects, CAST(sum(octet_length(encode(coalesce(html, '')))) AS BIGINT) AS input_bytes, count(*) AS n_exact FROM pages, (SELECT unnest(['start-8K', 'start-16K', 'middle-8K', 'always']) AS policy) p GROUP BY p.policy")
def gate_policy_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-55, 138, 139, 141: each policy's choices, decoded to the input again."""
    pages = O.pages(spark, sf_dir).select("ord", "bytes", "n_bytes")
    tallies = []
    for policy in S.POLICIES:
        rows = pages.select("bytes", "n_bytes", S.choose("bytes", policy).alias("c"))
        exact = S.decoded("encoding", "payload") == F.col("bytes")
        tallies.append(rows.select("bytes", "n_bytes", "c.encoding", "c.payload").select("n_bytes", exact.alias("exact")).groupBy(F.lit(policy).alias("policy")).agg(F.count("*").alias("n_objects"), F.sum("n_bytes").cast("long").alias("input_bytes"), F.count_if("exact").alias("n_exact")))
    out = tallies[0]
    for t in tallies[1:]:
        out = out.unionByName(t)
    return out


@query()
def selected_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-55, 138: bytes after selection and coding, by family; sizes depend on the codec's version."""
    rows = O.documents(spark, sf_dir).select("family", "n_bytes", S.choose("bytes").alias("c"))
    size = F.octet_length("c.payload").cast("long")
    return rows.groupBy("family").agg(F.count("*").alias("n_files"), F.sum("n_bytes").cast("long").alias("input_bytes"), F.sum(size).cast("long").alias("selected_bytes"), F.sum(X.variable_coded(size)).cast("long").alias("coded_bytes"), F.count_if(F.col("c.encoding") == "zstd").alias("n_zstd"), F.count_if("c.skipped").alias("n_skipped"))


@query(f"WITH {_DOCS} SELECT ord, sha256(b) AS sha256, true AS exact FROM docs")
def restored_from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-34, 42, 140: chunks stored once, compressed, and every object rebuilt from its references."""
    docs = O.documents(spark, sf_dir).select("ord", "bytes")
    rows = S.chunks(docs, CHUNK)
    stored = rows.groupBy("sha256").agg(F.first("chunk").alias("chunk")).select("sha256", S.choose("chunk").alias("c")).select("sha256", "c.encoding", "c.payload").select("sha256", S.decoded("encoding", "payload").alias("chunk"))
    whole = S.rebuilt(rows.select("ord", "chunk_no", "sha256"), stored, "ord", "chunk_no", "sha256")
    marks = docs.select("ord", F.sha2("bytes", 256).alias("mark")).join(whole, "ord", "left").withColumn("sha256", F.sha2(F.coalesce("bytes", F.lit(b"")), 256))
    return marks.select("ord", "sha256", (F.col("sha256") == F.col("mark")).alias("exact"))


@query(f"WITH {_DOCS} SELECT ord, CAST(n AS BIGINT) AS n_bytes, true AS covered, true AS sizes_hold FROM docs")
def content_chunks_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-137: content-defined chunks cover each object once, within the bounds of size."""
    docs = O.documents(spark, sf_dir)
    each = S.content_chunks(docs, 1024, 4096, 16384)
    last = each.groupBy("ord").agg(F.max("chunk_no").alias("last"))
    held = each.join(last, "ord").groupBy("ord").agg(F.sum("len").cast("long").alias("total"), F.max(F.col("off") + F.col("len")).cast("long").alias("end"), F.bool_and((F.col("len") <= 16384) & ((F.col("len") >= 1024) | (F.col("chunk_no") == F.col("last")))).alias("sizes_hold"))
    held = docs.select("ord", "n_bytes").join(held, "ord", "left").fillna(0, ["total", "end"]).fillna(True, ["sizes_hold"])
    return held.select("ord", "n_bytes", ((F.col("total") == F.col("n_bytes")) & (F.col("end") == F.col("n_bytes"))).alias("covered"), "sizes_hold")


@query(f"WITH {_DOCS} SELECT ord, sha256(unhex('{''.join(f'{b ^ 0x5C:02x}' for b in b'key for tests'.ljust(64, bytes(1)))}') || unhex(sha256(unhex('{''.join(f'{b ^ 0x36:02x}' for b in b'key for tests'.ljust(64, bytes(1)))}') || b))) AS tag FROM docs")
def hmac_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-97, 98: an authentication tag of every object."""
    return O.documents(spark, sf_dir).select("ord", X.hmac_sha256(b"key for tests", F.col("bytes")).alias("tag"))


@query(f"WITH {_DOCS} SELECT ord, sha256(b[101:160]) AS middle, CAST(octet_length(b[101:160]) AS INTEGER) AS n FROM docs")
def ranged_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-06: sixty bytes from offset one hundred."""
    part = X.ranged(F.col("bytes"), 100, 60)
    return O.documents(spark, sf_dir).select("ord", F.sha2(part, 256).alias("middle"), F.octet_length(part).alias("n"))


@query(f"WITH {_DOCS} SELECT ord, n BETWEEN 1 AND 1048576 AND w = (n + 3) // 4 AS valid, starts_with(hex(b), '4175746F434144') OR instr(decode(b), chr(0)) > 0 AS binary_drawing FROM (SELECT *, (n + 3) // 4 AS w FROM docs)")
def manifest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-21, 22: stripe manifests that hold, and texts that can't be ASCII drawings."""
    n = F.col("n_bytes")
    rows = O.documents(spark, sf_dir).withColumn("share_len", X.ceil_div(n, 4))
    return rows.select("ord", (n.between(1, X.MIB) & (F.col("share_len") == F.ceil(n / 4))).alias("valid"), (F.hex("bytes").startswith("4175746F434144") | (F.instr(F.decode("bytes", "UTF-8"), "\0") > 0)).alias("binary_drawing"))
