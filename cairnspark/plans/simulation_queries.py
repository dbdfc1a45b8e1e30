"""Queries on placements, failures, routes, zero-sum entries and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import simulation as P
from ..operators import storage as S
from ..sources import objects as O
from .catalogue import query
from .drawing_queries import _exponent

_PLACED = "p AS (SELECT doc_id AS id, s AS share_no, (s // 2 + doc_id % 3) % 3 AS zone, ((s // 2 + doc_id % 3) % 3) * 6 + (doc_id * 7 + s % 2 * (1 + doc_id % 5)) % 6 AS node FROM documents, range(0, 6) t(s))"
_MASKS = "k AS (SELECT id, bit_or(1 << node) AS mask FROM p GROUP BY id)"
_EDGES = "e AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c}, {r}), ('{b}', '{a}', {c}, {r})" for a, b, c, r in P.LINKS) + ") t(a, b, cost, mib_s))"
_PATHS = "w AS (SELECT 'replacement' AS node, 0 AS cost, CAST('replacement' AS VARCHAR) AS path UNION ALL SELECT e.b, w.cost + e.cost, w.path || '>' || e.b FROM w JOIN e ON e.a = w.node WHERE NOT contains('>' || w.path || '>', '>' || e.b || '>'))"


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.placed_in_turn(_ids(spark, sf_dir))


@query(f"WITH {_PLACED}, {_MASKS} SELECT CAST(count(*) FILTER (bit_count(mask & 5) > 0) AS BIGINT) AS degraded, CAST(count(*) FILTER (bit_count(mask & 5) > 2) AS BIGINT) AS unrecoverable FROM k")
def placement_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-65, 134: two nodes down."""
    return P.health(_placed(spark, sf_dir), 0b101)


@query(f"WITH {_PLACED}, {_MASKS}, m AS (SELECT mask, count(*) AS n FROM k GROUP BY mask), f AS (SELECT i AS failed, bit_count(CAST(i AS BIGINT)) AS size FROM range(0, 262144) t(i) WHERE bit_count(CAST(i AS BIGINT)) BETWEEN 1 AND 4), l AS (SELECT size, failed, coalesce(sum(n), 0) AS lost FROM f LEFT JOIN m ON bit_count(failed & mask) > 2 GROUP BY ALL) SELECT CAST(size AS INTEGER) AS size, count(*) AS sets, count(*) FILTER (lost > 0) AS sets_with_loss, CAST(max(lost) AS BIGINT) AS worst FROM l GROUP BY size")
def failed_node_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-50, 67: every set of up to four failed nodes."""
    return P.failure_spectrum(_placed(spark, sf_dir))


@query(f"WITH {_PLACED} SELECT CAST(node AS INTEGER) AS node, count(DISTINCT id) AS n_files, count(DISTINCT id % 64) AS n_owners FROM p GROUP BY node")
def owner_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-66: files and owners that a node's loss would touch."""
    return _placed(spark, sf_dir).groupBy("node").agg(F.count_distinct("id").alias("n_files"), F.count_distinct(F.col("id") % 64).alias("n_owners"))


def _left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.lose(_placed(spark, sf_dir), spark.createDataFrame([(0,), (1,), (7,)], "node int"))


@query(f"WITH {_PLACED}, c AS (SELECT id, count(*) FILTER (node IN (0, 1, 7)) AS missing FROM p GROUP BY id) SELECT CAST(missing AS INTEGER) AS missing, count(*) AS n_ids, count(DISTINCT id % 64) AS n_owners FROM c GROUP BY missing")
def missing_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-49, 64, 176: shares gone after three nodes are lost."""
    return P.missing_histogram(_placed(spark, sf_dir), _left(spark, sf_dir))


@query(f"WITH {_PLACED}, c AS (SELECT id, count(*) FILTER (node IN (0, 1, 7)) AS g FROM p GROUP BY id) SELECT count(*) FILTER (g > 0) AS n_repairs, CAST(coalesce(sum(CASE WHEN g BETWEEN 1 AND 2 THEN 4096 END), 0) AS BIGINT) AS read_bytes, CAST(coalesce(sum(CASE WHEN g BETWEEN 1 AND 2 THEN g * 1024 END), 0) AS BIGINT) AS written_bytes, count(*) FILTER (g > 2) AS n_lost FROM c")
def repair_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-178, 180: what repair reads and writes."""
    plan = P.repair_plan(_placed(spark, sf_dir), _left(spark, sf_dir), 1024)
    return plan.agg(F.count("*").alias("n_repairs"), F.coalesce(F.sum("read_bytes"), F.lit(0)).cast("long").alias("read_bytes"), F.coalesce(F.sum("written_bytes"), F.lit(0)).cast("long").alias("written_bytes"), F.count_if(~F.col("possible")).alias("n_lost"))


_WORD = 1 << 64


def _seeded(shares: int) -> str:
    """SQL of the seeded placement: the finaliser over wide integers, the first two nodes of a zone, and a third for share 6."""
    step = lambda x, k, m: f"(xor({x}, {x} >> {k}) * CAST('{m}' AS UHUGEINT)) % CAST('{_WORD}' AS UHUGEINT)"
    wide = lambda c, m: f"(CAST({c} AS UHUGEINT) * CAST('{m}' AS UHUGEINT)) % CAST('{_WORD}' AS UHUGEINT)"
    return (
        f"s AS (SELECT doc_id AS id, s AS share_no, ((CASE WHEN s < 6 THEN s // 2 ELSE 0 END) + doc_id % 3) % 3 AS zone FROM documents, range(0, {shares}) t(s)),"
        f" x0 AS (SELECT *, xor(xor({wide('id', P.GOLDEN)}, {wide('zone', P.MIX_A)}), CAST('{P.SEED}' AS UHUGEINT)) AS x FROM s),"
        f" x1 AS (SELECT id, share_no, zone, {step('x', 30, P.MIX_A)} AS x FROM x0), x2 AS (SELECT id, share_no, zone, {step('x', 27, P.MIX_B)} AS x FROM x1), x3 AS (SELECT id, share_no, zone, xor(x, x >> 31) AS x FROM x2),"
        " x4 AS (SELECT *, CAST(x % 6 AS INTEGER) AS a, CAST((x >> 32) % 5 AS INTEGER) AS b0, CAST((x >> 48) % 4 AS INTEGER) AS c FROM x3), x5 AS (SELECT *, b0 + CAST(b0 >= a AS INTEGER) AS b FROM x4)"
        " SELECT id, CAST(share_no AS INTEGER) AS share_no, CAST(zone AS INTEGER) AS zone, CAST(zone * 6 + CASE WHEN share_no = 6 THEN list_filter([0, 1, 2, 3, 4, 5], lambda z: z <> a AND z <> b)[c + 1] WHEN share_no % 2 = 0 THEN a ELSE b END AS INTEGER) AS node FROM x5"
    )


@query(f"WITH {_seeded(6)}")
def zone_aware_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-32, 126, 173: seeded placement, two shares to a zone, on distinct nodes."""
    return P.placement(_ids(spark, sf_dir))


@query(f"WITH {_seeded(7)}")
def seven_share_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-174: three, two and two."""
    return P.placement(_ids(spark, sf_dir), 7)


_DRAWS = "f AS (SELECT * FROM (VALUES " + ", ".join(map(str, P.churn_draws(8))) + ") t(round, increment, tick, down_mask))"


@query(f"WITH {_PLACED}, {_MASKS}, {_DRAWS}, m AS (SELECT f.*, k.id, bit_count(k.mask & f.down_mask) AS gone FROM f JOIN k ON k.mask & f.down_mask <> 0) SELECT f.round, f.increment, f.tick, CAST(f.down_mask AS BIGINT) AS down_mask, count(m.id) AS degraded, count(DISTINCT m.id % 64) AS affected_owners, count(*) FILTER (gone > 2) AS unrecoverable FROM f LEFT JOIN m ON m.round = f.round AND m.increment = f.increment GROUP BY ALL")
def churn_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-66, 135, 181: seeded failures over eight rounds, each repaired before the next."""
    return P.churn(_placed(spark, sf_dir), 8)


@query("SELECT n_nationkey AS id, 4096 AS n_bytes, true AS script FROM nation")
def generated_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-17, 175: seeded script files."""
    made = P.scripts(O.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id")), 4096)
    return made.select(F.col("id").cast("int").alias("id"), F.octet_length("bytes").alias("n_bytes"), F.decode("bytes", "UTF-8").startswith("#!/bin/sh").alias("script"))


@query(f"WITH RECURSIVE {_EDGES}, {_PATHS} SELECT node, CAST(min(cost) AS BIGINT) AS cost, arg_min(path, (cost, path)) AS path FROM w GROUP BY node")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-46, 166, 169: cheapest paths of the fixed scenario."""
    return P.shortest_paths(P.links(spark), "replacement")


_ROUTES = [("direct", ["replacement", "us-west"]), ("relay", ["replacement", "relay-us", "us-west"]), ("gap", ["replacement", "relay-us", "ap-east"]), ("loop", ["replacement", "relay-us", "replacement"]), ("long", ["us-east", "replacement", "relay-ap", "ap-east"])]


@query(f"WITH {_EDGES}, r AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {nodes})" for n, nodes in _ROUTES) + ") t(route, nodes)), p AS (SELECT route, nodes[i] AS a, nodes[i + 1] AS b FROM r, range(1, len(nodes)) t(i)), m AS (SELECT p.route, sum(cost) AS cost, min(mib_s) AS slowest, count(*) FILTER (cost IS NULL) AS gaps FROM p LEFT JOIN e USING (a, b) GROUP BY p.route), g AS (SELECT m.*, gaps = 0 AND len(list_distinct(nodes)) = len(nodes) AS valid FROM m JOIN r USING (route)) SELECT route, CAST(CASE WHEN valid THEN cost END AS BIGINT) AS cost, CAST(CASE WHEN valid THEN slowest END AS DOUBLE) AS slowest, valid, coalesce(valid AND cost = (SELECT min(cost) FROM g WHERE valid), false) AS best FROM g")
def route_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-47, 83, 95, 167, 168: routes checked and costed, and the cheapest."""
    rows = P.routed(spark.createDataFrame(_ROUTES, "route string, nodes array<string>"), P.links(spark))
    least = rows.where("valid").agg(F.min("cost").alias("least"))
    return rows.join(F.broadcast(least)).select("route", "cost", "slowest", "valid", F.coalesce(F.col("valid") & (F.col("cost") == F.col("least")), F.lit(False)).alias("best"))


_LOSSES = [("one", [0]), ("two", [1, 5]), ("three", [0, 2, 4])]


@query(f"WITH RECURSIVE {_EDGES}, {_PATHS}, b AS (SELECT node, min(cost) AS cost, arg_min(path, (cost, path)) AS path FROM w GROUP BY node), n AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {r})" for i, (n, r) in enumerate(P.HELPERS)) + ") t(i, name, rate)), l AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {x})" for n, x in _LOSSES) + ") t(scenario, off)), c AS (SELECT scenario, policy, i, name, row_number() OVER (PARTITION BY scenario, policy ORDER BY CASE policy WHEN 'availability' THEN i WHEN 'bandwidth' THEN -rate ELSE b.cost END, i) AS k FROM l, n, (SELECT unnest(['availability', 'bandwidth', 'cost']) AS policy) q, b WHERE b.node = n.name AND NOT list_contains(off, i)) SELECT scenario, policy, string_agg(name, ',' ORDER BY k) AS helpers, count(*) = 4 AS enough FROM c WHERE k <= 4 GROUP BY scenario, policy")
def helper_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-86, 170: four helpers for each loss under each policy."""
    nodes = spark.createDataFrame([(i, n, r) for i, (n, r) in enumerate(P.HELPERS)], "i int, name string, rate double")
    losses = spark.createDataFrame(_LOSSES, "scenario string, off array<int>")
    policies = spark.createDataFrame([("availability",), ("bandwidth",), ("cost",)], "policy string")
    paths = P.shortest_paths(P.links(spark), "replacement").select(F.col("node").alias("name"), "cost")
    rank = F.when(F.col("policy") == "availability", F.col("i").cast("double")).when(F.col("policy") == "bandwidth", -F.col("rate")).otherwise(F.col("cost").cast("double"))
    offered = nodes.join(paths, "name").join(F.broadcast(losses), ~F.array_contains("off", F.col("i"))).join(F.broadcast(policies))
    chosen = offered.withColumn("k", F.row_number().over(Window.partitionBy("scenario", "policy").orderBy(rank, "i"))).where("k <= 4")
    return chosen.groupBy("scenario", "policy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]), ",").alias("helpers"), (F.count("*") == 4).alias("enough"))


@query("WITH t AS (SELECT o_orderkey AS id, l_linenumber AS i, 10.0 + l_linenumber * 3 + l_quantity / (1 + l_discount * 100) AS ms FROM orders JOIN lineitem ON l_orderkey = o_orderkey), k AS (SELECT id, ms, row_number() OVER (PARTITION BY id ORDER BY ms) AS r FROM t) SELECT id, round(greatest(ms, 1000.0 / 25), 6) AS ms FROM k WHERE r = 4")
def rebuild_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-87, 132, 133: the fourth fastest of an order's lines as helpers, under the inbound limit."""
    ms = F.lit(10.0) + F.col("l_linenumber") * 3 + F.col("l_quantity") / (1 + F.col("l_discount") * 100)
    lines = O.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), ms.alias("ms"))
    sorted_ms = F.sort_array(F.collect_list("ms"))
    return lines.groupBy("id").agg(F.get(sorted_ms, F.lit(3)).alias("ms")).where("ms is not null").select("id", F.round(F.greatest("ms", F.lit(1000.0 / P.INBOUND)), 6).alias("ms"))


_ENTRIES = "v AS (SELECT l_orderkey AS id, list(CAST(l_quantity AS BIGINT) - 25 ORDER BY l_linenumber) AS v FROM lineitem GROUP BY l_orderkey)"


@query(f"WITH {_ENTRIES}, z AS (SELECT id, list_sum(list_transform(v, lambda x: CASE WHEN abs(x) >= 256 THEN 2 ELSE 1 END)) AS size FROM v WHERE list_sum(v) = 0) SELECT id AS entry_id, CAST(size AS INTEGER) AS size, (size, id) = (SELECT (size, id) FROM z ORDER BY size, id LIMIT 1) AS \"primary\" FROM z")
def zero_sum_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-78, 125, 172: orders whose quantities' deviations sum to zero, and the cheapest."""
    one = F.struct("l_linenumber", (F.col("l_quantity").cast("long") - 25).alias("x"))
    v = O.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("entry_id")).agg(F.array_sort(F.collect_list(one)).alias("p")).select("entry_id", F.col("p.x").alias("v"))
    return P.zero_sum(v).select("entry_id", "size", "primary")


_TERMS = "t AS (SELECT l_orderkey AS id, ascii(l_returnflag) AS flag, l_linenumber % 3 AS line, round(l_quantity - 25, 2) AS c FROM lineitem), s AS (SELECT id, flag, line, sum(c) AS c FROM t GROUP BY ALL)"


@query(f"WITH {_TERMS} SELECT id AS entity_id, CAST(count(*) FILTER (abs(c) >= 1e-9) AS INTEGER) AS n_terms, sha256(coalesce(string_agg('coeff:' || {_exponent('c')} || '|exp:[' || flag || ', ' || line || ']', ';' ORDER BY flag, line) FILTER (abs(c) >= 1e-9), '')) AS key FROM s GROUP BY id")
def canonical_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-151: like terms of an order summed, cancelled ones dropped, the rest in canonical form."""
    exponents = F.array(F.ascii("l_returnflag").cast("long"), (F.col("l_linenumber") % 3).cast("long"))
    terms = O.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entity_id"), exponents.alias("exponents"), F.round(F.col("l_quantity") - 25, 2).alias("coefficient"))
    return P.canonical(terms).select("entity_id", "n_terms", "key")


@query("WITH p AS (SELECT c_nationkey AS g, c_acctbal AS x, c_acctbal / 2 + c_custkey % 100 AS y FROM customer), m AS (SELECT g, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY g) SELECT p.g AS nation, round(min(x), 6) AS x0, round(max(x), 6) AS x1, round(min(y), 6) AS y0, round(max(y), 6) AS y1, round(any_value(cx), 4) AS cx, round(any_value(cy), 4) AS cy, round(sqrt(avg((x - cx) * (x - cx) + (y - cy) * (y - cy))), 4) AS scale FROM p JOIN m USING (g) GROUP BY p.g")
def extents_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-127, 128: extents, centre and scale of groups of points."""
    p = O.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("x"), (F.col("c_acctbal") / 2 + F.col("c_custkey") % 100).alias("y"))
    m = p.groupBy("nation").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = (F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2
    r = lambda c, n, k=6: F.round(c, k).alias(n)
    return p.join(F.broadcast(m), "nation").groupBy("nation").agg(r(F.min("x"), "x0"), r(F.max("x"), "x1"), r(F.min("y"), "y0"), r(F.max("y"), "y1"), r(F.first("cx"), "cx", 4), r(F.first("cy"), "cy", 4), r(F.sqrt(F.avg(d)), "scale", 4))


@query("SELECT p_partkey, CAST(p_retailprice AS VARCHAR) = printf('%.2f', p_retailprice) AS same_spelling, try_cast(printf('%.3f', p_retailprice) AS DOUBLE) = p_retailprice AS same_number, (p_size BETWEEN 10 AND 18 OR p_size BETWEEN 20 AND 28 OR p_size BETWEEN 30 AND 38 OR p_size BETWEEN 40 AND 48 OR p_size BETWEEN 50 AND 58) AS geometry_code, p_size BETWEEN 10 AND 59 AS numeric_code FROM part")
def number_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-24 to 27, 114: spellings against values, and codes in ranges."""
    price = F.col("p_retailprice")
    code = F.col("p_size")
    return O.table(spark, sf_dir, "part").select("p_partkey", (price.cast("string") == F.format_string("%.2f", price)).alias("same_spelling"), (X.finite(F.format_string("%.3f", price)) == price).alias("same_number"), X.in_ranges(code, [(10, 18), (20, 28), (30, 38), (40, 48), (50, 58)]).alias("geometry_code"), X.in_ranges(code, [(10, 59)]).alias("numeric_code"))


@query("WITH s AS (SELECT event_type, list_sort(list(round(value, 6))) AS v FROM events GROUP BY event_type) SELECT event_type, v[len(v) // 2 + 1] AS median, v[len(v) * 95 // 100 + 1] AS p95 FROM s")
def median_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-57, 58: the upper median and the 95th of a hundred, by place.

    Places come from counts and ranks, not from a collected list.
    """
    events = O.table(spark, sf_dir, "events").select("event_type", F.round("value", 6).alias("v"))
    times = events.groupBy("event_type", "v").count()
    upto = F.sum("count").over(Window.partitionBy("event_type").orderBy("v"))
    total = events.groupBy("event_type").agg(F.count("*").alias("n"))
    placed = times.withColumn("upto", upto).join(F.broadcast(total), "event_type")
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    return placed.groupBy("event_type").agg(at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * 95 / 100)).alias("p95"))


@query("WITH d AS (SELECT o_orderkey AS id, o_totalprice AS a, sum(l_extendedprice) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL) SELECT count(*) FILTER (a < b - 1e-6) AS wins, count(*) FILTER (abs(a - b) <= 1e-6) AS ties, count(*) FILTER (a > b + 1e-6) AS losses FROM d")
def win_tie_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-58: comparison with a tolerance."""
    b = O.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("b"))
    d = O.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("a")).join(b, "o_orderkey")
    gap = F.col("a") - F.col("b")
    return d.agg(F.count_if(gap < -1e-6).alias("wins"), F.count_if(F.abs(gap) <= 1e-6).alias("ties"), F.count_if(gap > 1e-6).alias("losses"))


_VAR = "(({n} // 1048576) * 1572864 + (({n} - ({n} // 1048576) * 1048576 + 3) // 4) * 6)"


@query(f"WITH d AS (SELECT doc_id AS ord, sum(octet_length(encode(coalesce(text, '')))) OVER (ORDER BY doc_id) AS t FROM documents), p AS (SELECT ord, {_VAR.format(n='t')} AS c FROM d) SELECT ord, CAST(c AS BIGINT) AS cumulative, CAST(c - coalesce(lag(c) OVER (ORDER BY ord), 0) AS BIGINT) AS increment FROM p")
def prefix_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-74: what each file adds to the coded size of all before it."""
    docs = S.running_total(O.documents(spark, sf_dir).select("ord", "n_bytes"), "ord", "n_bytes", "before")
    upto = X.variable_coded(F.col("before") + F.col("n_bytes"))
    return docs.select("ord", upto.alias("cumulative"), (upto - X.variable_coded(F.col("before"))).alias("increment"))


@query("SELECT lang, coalesce(source, 'all') AS source, count(*) AS n, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS n_bytes, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang))")
def variant_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OP-59, 60, 70: sums by variant with subtotals."""
    docs = O.table(spark, sf_dir, "documents").select("lang", "source", "n_chars", F.octet_length(X.utf8("text")).alias("b"))
    out = docs.rollup("lang", "source").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.sum("b").cast("long").alias("n_bytes"), F.sum("n_chars").cast("long").alias("n_chars"))
    return out.where("g < 3").select("lang", F.coalesce("source", F.lit("all")).alias("source"), "n", "n_bytes", "n_chars")
