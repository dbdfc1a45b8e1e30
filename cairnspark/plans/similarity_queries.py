"""Queries on candidate bases, set differences and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from ..functions import expressions as X
from ..operators import similarity as M
from ..sources import objects as O
from .catalogue import query

_LINES = "l AS (SELECT doc_id AS ord, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"
_DOCS = "docs AS (SELECT doc_id AS ord, source AS family, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents)"


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, family, sha256, features): the documents with their lines' marks, in order."""
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line: X.mark(line))
    return O.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("source").alias("family"), F.sha2(X.utf8("text"), 256).alias("sha256"), F.sort_array(lines).alias("features"))


def _texts(marked: DataFrame, k: int = M.TRIES) -> M.Texts:
    return M.texts(marked.select("ord", "features"), k)


def _sketched(texts: M.Texts) -> DataFrame:
    """The earlier documents that share most distinct lines; ties to the earliest."""
    return M.nearest(texts.once(), sized=False, latest=False)


def _keyed(texts: M.Texts) -> DataFrame:
    """The earlier documents that share most occurrences of lines for their size; ties to the latest."""
    return M.nearest(texts, sized=True, latest=True)


def _lines(spark: SparkSession, sf_dir: str) -> M.Texts:
    return _texts(session.written(_marked(spark, sf_dir).select("ord", "features")))


@query(f"WITH {_LINES}, f AS (SELECT DISTINCT * FROM l), s AS (SELECT a.ord, b.ord AS base, count(*) AS shared FROM f a JOIN f b ON a.line = b.line AND b.ord < a.ord GROUP BY ALL) SELECT ord, base, shared, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY shared DESC, base) AS rank FROM s) WHERE rank <= 3")
def feature_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-38, 75, 90: the three earlier documents that share most lines; ties to the earliest."""
    return _sketched(_lines(spark, sf_dir)).select("ord", "base", "shared", "rank")


@query(f"WITH {_LINES}, c AS (SELECT ord, line, count(*) AS n FROM l GROUP BY ALL), z AS (SELECT ord, sum(n) AS size FROM c GROUP BY ord), s AS (SELECT a.ord, b.ord AS base, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.line = b.line AND b.ord < a.ord GROUP BY ALL), r AS (SELECT s.*, shared / greatest(1, least(x.size, y.size)) AS ratio FROM s JOIN z x ON x.ord = s.ord JOIN z y ON y.ord = s.base) SELECT ord, base, CAST(shared AS BIGINT) AS shared, round(ratio, 6) AS ratio, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY ratio DESC, shared DESC, base DESC) AS rank FROM r) WHERE rank <= 3")
def overlap_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-39, 71, 76: shared occurrences over the smaller side; ties to the latest."""
    return _keyed(_lines(spark, sf_dir)).select("ord", "base", "shared", F.round("ratio", 6).alias("ratio"), "rank")


@query("WITH u AS (SELECT min(doc_id) AS ord FROM documents GROUP BY text), f AS (SELECT source, min(doc_id) AS base FROM documents JOIN u ON u.ord = doc_id GROUP BY source) SELECT doc_id AS ord, CASE WHEN base < doc_id THEN base END AS base FROM documents JOIN f USING (source)")
def first_in_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-37, 115: the named base."""
    rows = O.documents(spark, sf_dir).select("ord", "family", F.sha2("bytes", 256).alias("sha256"))
    return M.first_of_family(rows)


@query(f"WITH {_DOCS}, s AS (SELECT ord, slot, b[p + 1 : p + 64] AS c FROM (SELECT ord, b, unnest([0, 1, 2]) AS slot, unnest([0, greatest(n - 64, 0) // 2, greatest(n - 64, 0)]) AS p FROM docs)), a AS (SELECT ord, slot, substr(sha256(c), 1, 16) AS anchor FROM s), h AS (SELECT DISTINCT ord AS base, anchor FROM a), m AS (SELECT a.ord, slot, base, row_number() OVER (PARTITION BY a.ord, slot ORDER BY base DESC) AS k FROM a JOIN h ON h.anchor = a.anchor AND base < a.ord), d AS (SELECT ord, base, min(slot * 1000000 + k) AS place FROM m WHERE k <= 8 GROUP BY ALL), r AS (SELECT ord, base, row_number() OVER (PARTITION BY ord ORDER BY place) AS place FROM d) SELECT ord, base, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8")
def anchor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-40, 99: the newest earlier documents with the same bytes at the head, the middle or the tail."""
    return M.newest_by_anchor(O.documents(spark, sf_dir).select("ord", X.anchors(F.col("bytes")).alias("anchors")))


_GAINS = {"none": M.LEAST_GAIN, "name": M.LEAST_NAME_GAIN, "sketch": M.LEAST_GAIN, "key": M.LEAST_GAIN, "name+key": M.LEAST_GAIN, "hybrid": M.LEAST_GAIN}


def _named(marked: DataFrame) -> DataFrame:
    """(ord, base): the named base of the documents that have one."""
    rows = marked.select("ord", "family", "sha256")
    return M.first_of_family(rows, first=session.written(M.bases_of_families(rows))).where("base is not null")


def _proposals(spark: SparkSession, sf_dir: str, *arms: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The documents, and (ord, base, rank) of the arms asked for; each ranking that they need is made and written once, others not at all."""
    docs = O.documents(spark, sf_dir).select("ord", "family", "bytes")
    marked, out = _marked(spark, sf_dir), {}
    if {"none", "name", "name+key", "hybrid"} & set(arms):
        marked = session.written(marked)
        named = session.written(_named(marked).select("ord", "base", F.lit(1).alias("rank")))
        out |= {"none": named.limit(0), "name": named}
    else:
        marked = session.written(marked.select("ord", "features"))
    texts = _texts(marked)
    if "sketch" in arms:
        out["sketch"] = session.written(_sketched(texts).select("ord", "base", "rank"))
    if {"key", "name+key", "hybrid"} & set(arms):
        keyed = out["key"] = session.written(_keyed(texts).select("ord", "base", "rank"))
    if "name+key" in arms:
        out["name+key"] = M.in_turn(named, keyed)
    if "hybrid" in arms:
        out["hybrid"] = M.in_turn(named, keyed.where("rank = 1"))
    return docs, {arm: out[arm] for arm in arms}


_KEYS = f"{_LINES}, c AS (SELECT ord, line, count(*) AS n FROM l GROUP BY ALL), z AS (SELECT ord, sum(n) AS size FROM c GROUP BY ord), s AS (SELECT a.ord, b.ord AS base, sum(least(a.n, b.n)) AS shared FROM c a JOIN c b ON a.line = b.line AND b.ord < a.ord GROUP BY ALL), r AS (SELECT s.*, shared / greatest(1, least(x.size, y.size)) AS ratio FROM s JOIN z x ON x.ord = s.ord JOIN z y ON y.ord = s.base), keys AS (SELECT ord, base, row_number() OVER (PARTITION BY ord ORDER BY ratio DESC, shared DESC, base DESC) AS rank FROM r QUALIFY rank <= 3)"
_NAMES = "u AS (SELECT min(doc_id) AS ord FROM documents GROUP BY text), f AS (SELECT source, min(doc_id) AS base FROM documents JOIN u ON u.ord = doc_id GROUP BY source), names AS (SELECT doc_id AS ord, base FROM documents JOIN f USING (source) WHERE base < doc_id)"
_CANDIDATES = f"{_KEYS}, {_NAMES}, p AS (SELECT 'name' AS arm, ord, base, 0 AS rank FROM names UNION ALL SELECT 'key', ord, base, rank FROM keys UNION ALL SELECT 'name+key', ord, base, 0 FROM names UNION ALL SELECT 'name+key', ord, base, rank FROM keys UNION ALL SELECT 'hybrid', ord, base, 0 FROM names UNION ALL SELECT 'hybrid', ord, base, rank FROM keys WHERE rank = 1), q AS (SELECT arm, ord, base, min(rank) AS rank FROM p GROUP BY ALL), candidates AS (SELECT arm, ord, base, CAST(row_number() OVER (PARTITION BY arm, ord ORDER BY rank) AS INTEGER) AS place FROM q)"


@query(f"WITH {_CANDIDATES} SELECT * FROM candidates")
def arm_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-91, 160, 161: the bases that each arm tries, in turn: by name, by keys, by both without repeats, by name and the best key."""
    _, arms = _proposals(spark, sf_dir, "name", "key", "name+key", "hybrid")
    out = None
    for arm, proposed in arms.items():
        rows = proposed.select(F.lit(arm).alias("arm"), "ord", "base", F.col("rank").alias("place"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"WITH {_CANDIDATES}, h AS (SELECT arm, ord, base FROM candidates WHERE place = 1), g AS (SELECT * FROM (VALUES ('name', 'key'), ('key', 'hybrid')) t(a, b)), x AS (SELECT g.a, g.b, doc_id AS ord, m.base AS one, n.base AS other FROM g CROSS JOIN documents LEFT JOIN h m ON m.arm = g.a AND m.ord = doc_id LEFT JOIN h n ON n.arm = g.b AND n.ord = doc_id) SELECT a AS arm, b AS other_arm, count(*) AS n_files, count(*) FILTER (one IS NOT NULL AND other IS NOT NULL) AS comparable, count(*) FILTER (one = other) AS same_base, count(*) FILTER (one <> other) AS different_base, count(*) FILTER (one IS NULL AND other IS NOT NULL) AS other_only FROM x GROUP BY ALL")
def arm_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-45: two arms' first choices, file by file."""
    marked = session.written(_marked(spark, sf_dir))
    named = _named(marked).groupBy("ord").agg(F.min("base").alias("name"))
    keyed = _keyed(_texts(marked, k=1)).select("ord", F.col("base").alias("key"))
    files = O.documents(spark, sf_dir).select("ord").join(named, "ord", "left").join(keyed, "ord", "left")
    # By name and the best key: the name comes first.
    return M.compared(files.withColumn("hybrid", F.coalesce("name", "key")), ("name", "key"), ("key", "hybrid"))


def _choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arm's choices; a pair that several arms propose is patched once."""
    docs, arms = _proposals(spark, sf_dir, *_GAINS)
    every = None
    for arm, proposed in arms.items():
        rows = proposed.select(F.lit(arm).alias("arm"), "ord", "base")
        every = rows if every is None else every.unionByName(rows)
    return M.choose_for_arms(docs, every, _GAINS)


@query()
def base_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-45, 61, 63, 77, 91, 160, 161, 163: what each way to propose bases saves."""
    return M.arm_summary(_choices(spark, sf_dir))


@query("SELECT arm, count(*) AS n_files, true AS exact FROM documents, (SELECT unnest(['none', 'name', 'sketch', 'key', 'name+key', 'hybrid']) AS arm) GROUP BY arm")
def base_arms_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-34, 163: every patch that was tried restores its target."""
    return _choices(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("n_files"), F.bool_and("exact").alias("exact"))


@query()
def proposal_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-62: where proposals end; the counts are disjoint and sum to the files."""
    docs, arms = _proposals(spark, sf_dir, "sketch")
    proposed = arms["sketch"]
    return M.funnel(M.choose_bases(docs, proposed, _GAINS["sketch"], bounded=True).withColumn("arm", F.lit("sketch")), proposed)


@query("WITH t AS (SELECT conv_id, turn, encode(coalesce(text, '')) AS b FROM conversations), p AS (SELECT conv_id, turn, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS a, b FROM t), q AS (SELECT *, octet_length(a) AS na, octet_length(b) AS nb FROM p WHERE a IS NOT NULL), f AS (SELECT *, coalesce((SELECT min(i) FROM range(0, least(na, nb)) r(i) WHERE a[i + 1 : i + 1] <> b[i + 1 : i + 1]), least(na, nb)) AS pre FROM q), g AS (SELECT *, coalesce((SELECT min(i) FROM range(0, least(na, nb) - pre) r(i) WHERE a[na - i : na - i] <> b[nb - i : nb - i]), least(na, nb) - pre) AS suf FROM f) SELECT conv_id, turn, CAST(pre AS INTEGER) AS prefix, CAST(suf AS INTEGER) AS suffix, CAST(nb - pre - suf AS INTEGER) AS middle, true AS exact FROM g")
def edit_prefix_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-104, 105: each turn as an edit of the turn before, and back."""
    turns = O.table(spark, sf_dir, "conversations").select("conv_id", "turn", X.utf8("text").alias("b"))
    pairs = turns.withColumn("a", F.lag("b").over(Window.partitionBy("conv_id").orderBy("turn"))).where("a is not null").withColumn("e", M.edits("a", "b"))
    again = F.concat(X.ranged(F.col("a"), 0, F.col("e.prefix")), F.col("e.middle"), X.ranged(F.col("a"), F.octet_length("a") - F.col("e.suffix"), F.col("e.suffix")))
    return pairs.select("conv_id", "turn", "e.prefix", "e.suffix", F.octet_length("e.middle").alias("middle"), (F.sha2(again, 256) == F.sha2("b", 256)).alias("exact"))


@query(f"WITH {_DOCS}, p AS (SELECT ord, b, n, lag(ord) OVER w AS base, lag(b) OVER w AS a FROM docs WINDOW w AS (PARTITION BY n ORDER BY ord)), d AS (SELECT ord, base, i, i - 1 - coalesce(lag(i) OVER (PARTITION BY ord ORDER BY i), -1) AS gap FROM p, range(0, n) r(i) WHERE base IS NOT NULL AND a[i + 1 : i + 1] <> b[i + 1 : i + 1]), s AS (SELECT ord, count(*) AS changed, sum(2 + CAST(gap >= 128 AS INTEGER) + CAST(gap >= 16384 AS INTEGER) + CAST(gap >= 2097152 AS INTEGER)) AS x FROM d GROUP BY ord) SELECT ord, base, CAST(coalesce(changed, 0) AS INTEGER) AS changed, CAST(12 + coalesce(x, 0) AS BIGINT) AS size, true AS exact FROM p LEFT JOIN s USING (ord) WHERE base IS NOT NULL")
def sparse_delta_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-106, 107, 108, 150: a document against the last one of its length."""
    docs = O.documents(spark, sf_dir).select("ord", "bytes", "n_bytes")
    same = Window.partitionBy("n_bytes").orderBy("ord")
    pairs = docs.withColumn("base", F.lag("ord").over(same)).withColumn("a", F.lag("bytes").over(same)).where("base is not null")
    return pairs.select("ord", "base", M.sparse_delta("a", "bytes").alias("d")).select("ord", "base", "d.changed", "d.size", "d.exact")


@query("SELECT coalesce(d.doc_id, l.doc_id) AS id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' ELSE 'both' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def manifest_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-28, 92: names of either side only."""
    d, l = (O.table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    both = d.withColumn("d", F.lit(1)).join(l.withColumn("l", F.lit(1)), "doc_id", "full_outer")
    return both.select(F.col("doc_id").alias("id"), F.when(F.col("l").isNull(), "missing").when(F.col("d").isNull(), "extra").otherwise("both").alias("state"))


@query("WITH w AS (SELECT doc_id, source, unnest(string_split(coalesce(text, ''), ' ')) AS word FROM documents), b AS (SELECT source, min(doc_id) AS base FROM documents GROUP BY source), c AS (SELECT w.doc_id, word, count(*) AS n FROM w GROUP BY ALL), x AS (SELECT c.doc_id, b.base, c.word, c.n FROM c JOIN documents d USING (doc_id) JOIN b ON b.source = d.source), y AS (SELECT d.doc_id, e.word, e.n FROM documents d JOIN b ON b.source = d.source JOIN c e ON e.doc_id = b.base), m AS (SELECT coalesce(x.doc_id, y.doc_id) AS doc_id, greatest(coalesce(x.n, 0) - coalesce(y.n, 0), 0) AS added, greatest(coalesce(y.n, 0) - coalesce(x.n, 0), 0) AS dropped FROM x FULL JOIN y ON x.doc_id = y.doc_id AND x.word = y.word) SELECT doc_id, CAST(sum(added) AS BIGINT) AS added, CAST(sum(dropped) AS BIGINT) AS dropped, sum(added) + sum(dropped) = 0 AS equal FROM m GROUP BY doc_id")
def multiset_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-30, 93, 94: words that a document has over its family's first, and the other way."""
    docs = O.table(spark, sf_dir, "documents")
    counts = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    base = docs.groupBy("source").agg(F.min("doc_id").alias("base"))
    of = docs.select("doc_id", "source").join(base, "source").select("doc_id", "base")
    theirs = of.join(counts.select(F.col("doc_id").alias("base"), "word", F.col("n").alias("m")), "base").select("doc_id", "word", "m")
    both = counts.join(theirs, ["doc_id", "word"], "full_outer").fillna(0, ["n", "m"])
    plus = lambda a, b: F.sum(F.greatest(F.col(a) - F.col(b), F.lit(0))).cast("long")
    return both.groupBy("doc_id").agg(plus("n", "m").alias("added"), plus("m", "n").alias("dropped")).withColumn("equal", F.col("added") + F.col("dropped") == 0)


@query("SELECT page_id, CASE WHEN url LIKE '%/archive/%' THEN 'archive' WHEN url LIKE '%.html' THEN 'page' ELSE coalesce(nullif(regexp_extract(regexp_replace(url, '^.*/', ''), '^[0-9.]+'), ''), 'other') END AS family FROM pages")
def family_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-116: families by parts of the name, then by its leading number."""
    name = F.regexp_replace("url", "^.*/", "")
    number = F.nullif(F.regexp_extract(name, "^[0-9.]+", 0), F.lit(""))
    return O.table(spark, sf_dir, "pages").select("page_id", F.when(F.contains("url", F.lit("/archive/")), "archive").when(F.col("url").endswith(".html"), "page").otherwise(F.coalesce(number, F.lit("other"))).alias("family"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, CAST(l_tax * 100 AS INTEGER) AS t FROM lineitem")
def key_value_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-117: a line of key=value pairs into columns."""
    line = F.concat(F.lit("q="), F.col("l_quantity").cast("int"), F.lit(",t="), F.round(F.col("l_tax") * 100).cast("int"))
    pairs = O.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.str_to_map(line, F.lit(","), F.lit("=")).alias("m"))
    return pairs.select("l_orderkey", "l_linenumber", F.col("m.q").cast("int").alias("q"), F.col("m.t").cast("int").alias("t"))
