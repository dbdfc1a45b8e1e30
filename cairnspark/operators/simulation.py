"""Placement of shares, losses and repairs, routes, and zero-sum entries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import exponent_text
from ..session import written

#: Three zones of six nodes; fixed values.
ZONES, PER_ZONE = 3, 6
NODES = ZONES * PER_ZONE
_U = np.uint64
#: Constants of the 64-bit finaliser and of the placement's seeds; fixed values.
GOLDEN, MIX_A, MIX_B, SEED = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x123456789ABCDEF0


def finalised(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser; products wrap."""
    x = (x ^ (x >> _U(30))) * _U(MIX_A)
    x = (x ^ (x >> _U(27))) * _U(MIX_B)
    return x ^ (x >> _U(31))


def xorshift(state: np.ndarray) -> np.ndarray:
    """One step of the xorshift generator with shifts 13, 7, 17."""
    state = state ^ (state << _U(13))
    state = state ^ (state >> _U(7))
    return state ^ (state << _U(17))


def zone_nodes(ids: np.ndarray, zone: int, count: int) -> np.ndarray:
    """``count`` (2 or 3) distinct nodes of a zone for each id."""
    x = finalised((ids.astype(_U) * _U(GOLDEN)) ^ _U(zone * MIX_A % (1 << 64)) ^ _U(SEED))
    first = x % _U(PER_ZONE)
    second = (x >> _U(32)) % _U(PER_ZONE - 1)
    second += second >= first
    picked = [first, second]
    if count == 3:
        rest = np.array([[k for k in range(PER_ZONE) if k not in (a, b)] for a, b in zip(first, second, strict=True)]).reshape(-1, PER_ZONE - 2)
        picked.append(rest[np.arange(len(ids)), ((x >> _U(48)) % _U(PER_ZONE - 2)).astype(np.int64)].astype(_U))
    return np.stack(picked, 1).astype(np.int64) + zone * PER_ZONE


def placement(ids: DataFrame, shares: int = 6) -> DataFrame:
    """(id, share_no, zone, node): six shares two to a zone, or seven with three in one; which zone leads turns with the id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            x = rows["id"].to_numpy()
            three = [zone_nodes(x, z, 3 if shares == 7 else 2) for z in range(ZONES)]
            for share in range(shares):
                turn = share // 2 if share < 6 else 0
                zone = (turn + x % ZONES) % ZONES
                slot = share % 2 if share < 6 else 2
                node = np.choose(zone, [t[:, slot] for t in three])
                yield pd.DataFrame({"id": x, "share_no": share, "zone": zone, "node": node})

    return ids.select("id").mapInPandas(run, "id long, share_no int, zone int, node int")


def placed_in_turn(ids: DataFrame) -> DataFrame:
    """(id, share_no, zone, node) by a rule in plain arithmetic, for plans that must stay in the JVM."""
    share = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("share_no")
    zone = (F.floor(F.col("share_no") / 2) + F.col("id") % ZONES) % ZONES
    slot = (F.col("id") * 7 + F.col("share_no") % 2 * (1 + F.col("id") % 5)) % PER_ZONE
    return ids.select("id", share).select("id", "share_no", zone.cast("int").alias("zone"), (zone * PER_ZONE + slot).cast("int").alias("node"))


def masks(placements: DataFrame) -> DataFrame:
    """(mask, n): bits of the nodes that hold an id's shares, and how many ids have that mask; at most as many rows as node sets, whatever the ids."""
    one = placements.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, node)")).alias("mask"))
    return one.groupBy("mask").agg(F.count("*").alias("n"))


def node_sets(spark: SparkSession, sizes: tuple[int, ...] = (1, 2, 3, 4), nodes: int = NODES) -> DataFrame:
    """(failed, size): every set of so many nodes, as bits."""
    return spark.range(1 << nodes).select(F.col("id").alias("failed"), F.bit_count("id").alias("size")).where(F.col("size").isin(*sizes))


def failure_spectrum(placements: DataFrame, spare: int = 2, sizes: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    """Per number of failed nodes: sets, sets that lose something, and the most ids that one loses.

    Ids are counted by their mask of nodes first, so the product is of two
    bounded tables: node sets, and the distinct masks of C(18, 6) at most.
    """
    held = masks(placements)
    sets = node_sets(placements.sparkSession, sizes)
    lost = sets.join(F.broadcast(held), F.bit_count(F.col("failed").bitwiseAND(F.col("mask"))) > spare, "left").groupBy("size", "failed").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lost"))
    return lost.groupBy("size").agg(F.count("*").alias("sets"), F.count_if(F.col("lost") > 0).alias("sets_with_loss"), F.max("lost").cast("long").alias("worst"))


def health(placements: DataFrame, down: int, spare: int = 2) -> DataFrame:
    """(degraded, unrecoverable): ids that miss shares, and those that miss too many."""
    missing = F.bit_count(F.col("mask").bitwiseAND(F.lit(down)))
    held = masks(placements)
    return held.agg(F.coalesce(F.sum(F.when(missing > 0, F.col("n"))), F.lit(0)).cast("long").alias("degraded"), F.coalesce(F.sum(F.when(missing > spare, F.col("n"))), F.lit(0)).cast("long").alias("unrecoverable"))


def lose(placements: DataFrame, nodes: DataFrame) -> DataFrame:
    """What is left after the loss of the nodes of a table."""
    return placements.join(F.broadcast(nodes.select("node").distinct().limit(NODES)), "node", "left_anti")


def missing_histogram(placements: DataFrame, left: DataFrame, total: int = 6, owners: int = 64) -> DataFrame:
    """(missing, n_ids, n_owners): how many shares are gone, and whose."""
    have = left.groupBy("id").agg(F.count("*").alias("have"))
    each = placements.select("id").distinct().join(have, "id", "left").select("id", (total - F.coalesce("have", F.lit(0))).cast("int").alias("missing"))
    return each.groupBy("missing").agg(F.count("*").alias("n_ids"), F.count_distinct(F.col("id") % owners).alias("n_owners"))


def repair_plan(placements: DataFrame, left: DataFrame, share_len: int, needed: int = 4) -> DataFrame:
    """Per id with missing shares: the survivors that are read, the shares written, and their bytes."""
    gone = placements.join(left.select("id", "share_no"), ["id", "share_no"], "left_anti").groupBy("id").agg(F.array_sort(F.collect_list("share_no")).alias("rebuilt"))
    have = left.groupBy("id").agg(F.array_sort(F.collect_list("share_no")).alias("have"))
    both = gone.join(have, "id", "left")
    enough = F.coalesce(F.size("have"), F.lit(0)) >= needed
    return both.select("id", "rebuilt", F.when(enough, F.slice("have", 1, needed)).alias("survivors"), F.when(enough, F.lit(needed * share_len)).otherwise(0).cast("long").alias("read_bytes"), F.when(enough, F.size("rebuilt") * share_len).otherwise(0).cast("long").alias("written_bytes"), enough.alias("possible"))


def reconcile(parked: DataFrame, present: DataFrame, key: tuple[str, ...] = ("id", "share_no")) -> DataFrame:
    """A node's return: parked shares that are present already are dropped, absent ones move back, different ones are an error."""
    both = parked.alias("p").join(present.select(*key, F.col("sha256").alias("now")).alias("n"), list(key), "left")
    state = F.when(F.col("now").isNull(), "moved").when(F.col("now") == F.col("sha256"), "dropped").otherwise(F.raise_error(F.lit("a parked share differs from the present one")))
    return both.select(*key, state.alias("state"))


#: The seed of the churn's draws; a fixed value.
CHURN_SEED = 0x6D1D2E3F40516273


def churn_draws(rounds: int, seed: int = CHURN_SEED) -> list[tuple[int, int, int, int]]:
    """(round, increment, tick, down_mask): one or two distinct nodes fail in each round, one to five ticks apart."""
    if not 1 <= rounds <= 32:
        raise ValueError("from 1 to 32 rounds")
    state, tick, out = np.array([seed], _U), 0, []

    def draw(below: int) -> int:
        nonlocal state
        state = xorshift(state)
        return int(state[0] % _U(below))

    for k in range(1, rounds + 1):
        down = 0
        for increment in range(1, 2 + draw(2)):
            tick += 1 + draw(5)
            while down >> (node := draw(NODES)) & 1:
                pass
            down |= 1 << node
            out.append((k, increment, tick, down))
    return out


def churn(placements: DataFrame, rounds: int, seed: int = CHURN_SEED, owners: int = 64) -> DataFrame:
    """(round, increment, tick, down_mask, degraded, affected_owners, unrecoverable) after each seeded failure; all is repaired before the next round.

    Draws are at most 64 rows; ids are counted by their node masks and owners first.
    """
    failures = placements.sparkSession.createDataFrame(churn_draws(rounds, seed), "round int, increment int, tick int, down_mask long")
    one = placements.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, node)")).alias("mask"))
    held = one.groupBy("mask", (F.col("id") % owners).alias("owner")).agg(F.count("*").alias("n"))
    missing = F.bit_count(F.col("mask").bitwiseAND(F.col("down_mask")))
    met = held.join(F.broadcast(failures), missing > 0, "right")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return met.groupBy("round", "increment", "tick", "down_mask").agg(total(missing > 0).alias("degraded"), F.count_distinct("owner").alias("affected_owners"), total(missing > 2).alias("unrecoverable"))


def scripts(ids: DataFrame, size: int) -> DataFrame:
    """(id, bytes): script files of seeded hexadecimal comment lines, ``size`` bytes each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i in rows["id"]:
                words = -(-size // 16)
                state, drawn = np.array([i + 1], _U) * _U(GOLDEN), []
                for _ in range(words):
                    state = xorshift(state)
                    drawn.append(f"{int(state[0]):016x}")
                text = "".join(drawn)
                body = "#!/bin/sh\n" + "".join(f"# {text[k : k + 64]}\n" for k in range(0, len(text), 64))
                out.append((i, body[: size - 1].encode() + b"\n"))
            yield pd.DataFrame(out, columns=["id", "bytes"])

    return ids.select("id").mapInPandas(run, "id long, bytes binary")


# Routes.

#: The fixed scenario's links: ends, cost and latency, MiB/s; and its nodes with their advertised rates.
LINKS = [
    ("replacement", "us-east", 35, 40.0),
    ("replacement", "us-west", 105, 25.0),
    ("replacement", "eu-west", 145, 20.0),
    ("replacement", "eu-central", 120, 20.0),
    ("replacement", "ap-south", 225, 15.0),
    ("replacement", "ap-east", 185, 20.0),
    ("replacement", "relay-us", 10, 100.0),
    ("relay-us", "us-west", 25, 50.0),
    ("replacement", "relay-eu", 55, 70.0),
    ("relay-eu", "eu-west", 25, 30.0),
    ("relay-eu", "eu-central", 30, 30.0),
    ("replacement", "relay-ap", 130, 30.0),
    ("relay-ap", "ap-south", 55, 15.0),
    ("relay-ap", "ap-east", 40, 20.0),
]
HELPERS = [("us-east", 40.0), ("us-west", 80.0), ("eu-west", 60.0), ("eu-central", 50.0), ("ap-south", 90.0), ("ap-east", 100.0)]
INBOUND = 25.0


def links(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    """(a, b, cost, mib_s), both directions; of repeated links the last counts."""
    given = LINKS if rows is None else rows
    if any(r[2] <= 0 for r in given):
        raise ValueError("a link's cost must be positive")
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(given)], "a string, b string, cost long, mib_s double, seq int")
    both = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "cost", "mib_s", "seq"))
    return both.groupBy("a", "b").agg(F.max_by(F.struct("cost", "mib_s"), "seq").alias("x")).select("a", "b", "x.cost", "x.mib_s")


def shortest_paths(edges: DataFrame, source: str) -> DataFrame:
    """(node, cost, path): the cheapest path from a source to every node; ties to the least path as text.

    Each round relaxes all nodes at once and is written; a node keeps one path,
    so rounds don't multiply.  Costs are positive, so rounds end, after the
    longest of the cheapest paths, when none gets better.
    """
    best = edges.sparkSession.createDataFrame([(source, 0, source)], "node string, cost long, path string")
    while True:
        step = best.join(edges.select("a", "b", F.col("cost").alias("more")), F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("cost") + F.col("more")).alias("cost"), F.concat("path", F.lit(">"), "b").alias("path"))
        again = written(best.unionByName(step).groupBy("node").agg(F.min(F.struct("cost", "path")).alias("x")).select("node", "x.cost", "x.path"))
        if again.join(best, ["node", "cost", "path"], "left_anti").isEmpty():
            return again
        best = again


def routed(routes: DataFrame, edges: DataFrame) -> DataFrame:
    """(route, cost, slowest, valid) of routes (route, nodes): sums over neighbouring pairs; invalid if a link is missing, a node repeats, or there are fewer than two."""
    pairs = routes.select("route", F.explode_outer(F.zip_with(F.slice("nodes", 1, F.greatest(F.size("nodes") - 1, F.lit(0))), F.slice("nodes", 2, F.greatest(F.size("nodes") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("p")).select("route", "p.a", "p.b")
    met = pairs.join(edges, ["a", "b"], "left").groupBy("route").agg(F.sum("cost").alias("cost"), F.min("mib_s").alias("slowest"), F.count_if(F.col("cost").isNull()).alias("gaps"))
    good = (F.col("gaps") == 0) & (F.size(F.array_distinct("nodes")) == F.size("nodes")) & (F.size("nodes") >= 2)
    return routes.join(met, "route").select("route", F.when(good, F.col("cost")).alias("cost"), F.when(good, F.col("slowest")).alias("slowest"), good.alias("valid"))


def zero_sum(entries: DataFrame, target: int = 0, values: str = "v", order: str = "entry_id") -> DataFrame:
    """Entries (entry_id, v) that sum to the target, with their bytes, and whether each is the first of the cheapest."""
    total = F.aggregate(values, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(38,0)")).cast("decimal(38,0)"))
    size = F.aggregate(values, F.lit(0), lambda a, x: a + _magnitude(x))
    kept = entries.where(total == target).withColumn("size", size)
    best = kept.agg(F.min(F.struct("size", order)).alias("best"))
    return kept.join(F.broadcast(best)).withColumn("primary", F.col(order) == F.col(f"best.{order}")).drop("best")


def _magnitude(x: Column) -> Column:
    n = F.abs(x.cast("decimal(38,0)"))
    out = F.lit(1)
    for k in range(1, 8):
        out = out + F.when(n >= (1 << (8 * k)), 1).otherwise(0)
    return out


def canonical(terms: DataFrame, places: int = 9) -> DataFrame:
    """(entity_id, terms, key) of (entity_id, exponents, coefficient): like terms are summed, those below 1e-9 go, the rest are ordered by their exponents and hashed."""
    same = terms.groupBy("entity_id").agg(F.count_distinct(F.size("exponents")).alias("sizes"))
    checked = terms.join(same, "entity_id").withColumn("exponents", F.when(F.col("sizes") == 1, F.col("exponents")).otherwise(F.raise_error(F.lit("terms of mixed dimensions"))))
    summed = checked.groupBy("entity_id", "exponents").agg(F.sum("coefficient").alias("coefficient")).where(F.abs("coefficient") >= 10.0**-places)
    form = F.concat(F.lit("coeff:"), exponent_text(F.col("coefficient")), F.lit("|exp:["), F.array_join(F.col("exponents").cast("array<string>"), ", "), F.lit("]"))
    listed = summed.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("exponents", form.alias("form")))).alias("terms"))
    joined = terms.select("entity_id").distinct().join(listed, "entity_id", "left")
    text = F.coalesce(F.array_join("terms.form", ";"), F.lit(""))
    return joined.select("entity_id", F.coalesce(F.size("terms"), F.lit(0)).alias("n_terms"), F.sha2(text, 256).alias("key"))
