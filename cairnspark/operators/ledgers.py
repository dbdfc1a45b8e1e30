"""Whole-corpus arms and ledgers, recovered streams, patch chains, and variants of the entropy formula."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions import field
from ..session import written
from . import drawings, similarity, storage

#: Charges of the control ledger; fixed values: an object's header, a file, a reference, an index entry.
OBJECT_HEADER, FILE_RECORD, REFERENCE, INDEX = 8 + 32 + 1 + 4 + 8, 8 + 32 + 4, 4, 36
#: Limits on what is decoded; fixed values.
MOST_OBJECTS, MOST_REFERENCES, MOST_OBJECT_BYTES, MOST_KEY = 1_000_000, 10_000_000, 64 << 20, 1024
ARMS = ("P", "A1", "A2", "C1")
exponent_form = X.exponent_form


def pieces(objects: DataFrame, arm: str, size: int) -> DataFrame:
    """(ord, pos, chunk): an arm's parts of every object: whole (P), fixed chunks (A1), fixed chunks of the normalised form (A2), content-defined chunks (C1)."""
    rows = objects.select("ord", "bytes").where(F.octet_length("bytes") > 0)
    if arm == "P":
        return rows.select("ord", F.lit(0).alias("pos"), F.col("bytes").alias("chunk"))
    if arm == "A2":
        rows = drawings.normalised(rows).select("ord", F.col("normalised").alias("bytes"))
    if arm in ("A1", "A2"):
        return storage.chunks(rows, size).select("ord", F.col("chunk_no").alias("pos"), "chunk")
    cuts = storage.content_chunks(rows, size // 4, size, size * 4)
    return cuts.join(rows, "ord").select("ord", F.col("chunk_no").alias("pos"), X.ranged(F.col("bytes"), F.col("off"), F.col("len")).alias("chunk"))


def control(objects: DataFrame, arm: str, compress: bool, size: int = 4096) -> DataFrame:
    """One row: an arm's references, stored objects, packed and protected bytes; P stores every object, the others each distinct piece once."""
    parts = pieces(objects, arm, size).withColumn("key", F.concat_ws(":", F.when(F.lit(arm == "P"), F.col("ord")), F.sha2("chunk", 256)))
    used = parts.agg(F.count("*").alias("n_references"), F.count_distinct("ord").alias("n_files"))
    stored = parts.groupBy("key").agg(F.first("chunk").alias("chunk"))
    size_of = storage.choose("chunk") if compress else F.struct(F.col("chunk").alias("payload"))
    held = stored.select(size_of.alias("c")).agg(F.count("*").alias("n_objects"), F.sum(F.octet_length("c.payload")).cast("long").alias("packed_bytes"))
    ledger = F.col("packed_bytes") + F.col("n_objects") * (OBJECT_HEADER + INDEX) + F.col("n_files") * FILE_RECORD + F.col("n_references") * REFERENCE
    return used.join(F.broadcast(held)).select(F.lit(arm).alias("arm"), F.lit("Z" if compress else "N").alias("mode"), "n_files", "n_references", "n_objects", "packed_bytes", ledger.alias("ledger_bytes"), X.protected(ledger).alias("protected_bytes"))


def controls(objects: DataFrame, size: int = 4096, modes: tuple[bool, ...] = (False, True)) -> DataFrame:
    out = None
    for arm in ARMS:
        for mode in modes:
            row = control(objects, arm, mode, size)
            out = row if out is None else out.unionByName(row)
    return out


def recovered_stream(objects: DataFrame, stripe: int = X.MIB, lost: tuple[int, ...] = (0, 1)) -> DataFrame:
    """(ord, bytes): every object cut from the packed stream as it is after the loss of shares of every stripe.

    Stripes gather the parts of objects that reach into them, are coded, lose
    shares, are restored, and hand the parts back; a group is one stripe.
    """
    placed = storage.running_total(objects.where(F.octet_length("bytes") > 0).select("ord", "bytes", F.octet_length("bytes").cast("long").alias("n")), "ord", "n", "at")
    number = F.explode(F.sequence(F.floor(F.col("at") / stripe), F.floor((F.col("at") + F.col("n") - 1) / stripe))).alias("stripe")
    each = placed.select("ord", "bytes", "n", "at", number)
    begin, end = F.greatest("at", F.col("stripe") * stripe), F.least(F.col("at") + F.col("n"), (F.col("stripe") + 1) * stripe)
    parts = each.select("stripe", "ord", begin.alias("begin"), X.ranged(F.col("bytes"), begin - F.col("at"), end - begin).alias("part"))
    whole = parts.groupBy("stripe").agg(F.array_sort(F.collect_list(F.struct("begin", "ord", "part"))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                data = b"".join(p["part"] for p in r.parts)
                left = [None if i in lost else s for i, s in enumerate(field.encode(data))]
                again, at = field.reconstruct(left, len(data)), 0
                for p in r.parts:
                    out.append((p["ord"], p["begin"], again[at : at + len(p["part"])]))
                    at += len(p["part"])
            yield pd.DataFrame(out, columns=["ord", "begin", "part"])

    back = whole.mapInPandas(run, "ord long, begin long, part binary").groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("begin", "part"))).alias("parts"))
    whole = back.select("ord", X.joined(F.col("parts.part")).alias("bytes"))
    # An empty object reaches into no stripe.
    return objects.select("ord").join(whole, "ord", "left").select("ord", F.coalesce("bytes", F.lit(b"")).alias("bytes"))


def framed(objects: DataFrame) -> DataFrame:
    """(frame): each object after its length in eight little-endian bytes."""
    size = F.unhex(F.lpad(F.hex(F.octet_length("bytes").cast("long")), 16, "0"))
    return objects.select("ord", F.concat(*(F.substring(size, k, 1) for k in range(8, 0, -1)), "bytes").alias("frame"))


def unframed(streams: DataFrame, column: str = "stream") -> DataFrame:
    """(stream_id, pos, bytes) of streams of length-framed objects; one that ends within an object, or holds too large a one, is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                data, at, pos = getattr(r, column), 0, 0
                while at < len(data):
                    (n,) = struct.unpack_from("<Q", data, at)
                    if n > MOST_OBJECT_BYTES or at + 8 + n > len(data):
                        raise ValueError("a frame is too long")
                    out.append((r.stream_id, pos, data[at + 8 : at + 8 + n]))
                    at, pos = at + 8 + n, pos + 1
            yield pd.DataFrame(out, columns=["stream_id", "pos", "bytes"])

    return streams.select("stream_id", column).mapInPandas(run, "stream_id long, pos int, bytes binary")


def within_limits(ledger: DataFrame) -> DataFrame:
    """(problem) of a ledger (n_objects, n_references, largest, longest_key): which decode limits it breaks."""
    checks = ((F.col("n_objects") > MOST_OBJECTS, "objects"), (F.col("n_references") > MOST_REFERENCES, "references"), (F.col("largest") > MOST_OBJECT_BYTES, "object size"), (F.col("longest_key") > MOST_KEY, "key"))
    return ledger.select(F.explode(F.array_compact(F.array(*(F.when(c, n) for c, n in checks)))).alias("problem"))


def resolved(choices: DataFrame) -> DataFrame:
    """(ord, bytes) from (ord, base, payload): a null base is the file itself, else a patch on it; a base may be a patch too.

    One join a level, written before the next: files whose base was restored last
    are restored, until none is left.  Levels that restore nothing while files
    are left mean a missing base or a ring, which is an error.
    """
    fresh = written(choices.where("base is null").select("ord", F.col("payload").alias("bytes")))
    done, left = fresh, written(choices.where("base is not null"))
    while not left.isEmpty():
        ready = left.join(fresh.select(F.col("ord").alias("base"), F.col("bytes").alias("base_bytes")), "base")
        fresh = written(ready.select("ord", similarity.unpatch("base_bytes", "payload").alias("bytes")))
        if fresh.isEmpty():
            raise ValueError("patches whose base is missing, or that lean on one another")
        done = done.unionByName(fresh)
        left = written(left.join(fresh.select("ord"), "ord", "left_anti"))
    return done


def entropies(data: str) -> Column:
    """struct(exact, naive, clamped): the entropy; what 0 * log 0 makes of it over all 256 values; and with every probability raised to a floor."""

    @F.pandas_udf("exact double, naive double, clamped double")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for d in column:
            p = np.bincount(np.frombuffer(d, np.uint8), minlength=256) / max(len(d), 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                naive = float(-(p * np.log2(p)).sum())
            q = np.maximum(p, 1e-12)
            rows.append((storage.entropy_of(d), naive, float(-(q * np.log2(q)).sum())))
        return pd.DataFrame(rows, columns=["exact", "naive", "clamped"])

    return run(data)


def corpora(spark: SparkSession, size: int = 16_384) -> DataFrame:
    """(ord, name, bytes): seeded random bytes, log lines, a repeated block, and a random head with a tail of zeros."""
    rng = np.random.default_rng(7)
    block = rng.bytes(4096)
    logs = "".join(f"2024-01-{i % 28 + 1:02d}T00:00:{i % 60:02d}Z INFO worker={i % 8} request={i} status=200\n" for i in range(size // 40))
    rows = [("random", rng.bytes(size)), ("logs", logs.encode()[:size]), ("periodic", (block * (size // 4096 + 1))[:size]), ("late zeros", rng.bytes(8192) + bytes(max(size - 8192, 0)))]
    return spark.createDataFrame([(i, n, b) for i, (n, b) in enumerate(rows)], "ord long, name string, bytes binary")


def randomised_routes(spark: SparkSession, topologies: int = 1000, seed: int = 11) -> DataFrame:
    """(topology, policy, ms, vs_cost): four helpers of seven in seeded topologies, by three policies; the model's time for a stripe, and its ratio to that of the cheapest path's choice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for t in rows["id"]:
                rng = np.random.default_rng([seed, int(t)])
                rate, cost, pipe = rng.integers(20, 120, 7), rng.integers(5, 200, 7), rng.integers(10, 80, 7)
                order = {"availability": range(7), "bandwidth": np.argsort(-rate, kind="stable"), "cost": np.argsort(cost, kind="stable")}
                time = {k: max(float(cost[i]) + 250.0 / min(rate[i], pipe[i]) for i in list(v)[:4]) for k, v in order.items()}
                out += [(int(t), k, max(ms, 40.0), max(ms, 40.0) / max(time["cost"], 40.0)) for k, ms in time.items()]
            yield pd.DataFrame(out, columns=["topology", "policy", "ms", "vs_cost"])

    return spark.range(topologies).mapInPandas(run, "topology long, policy string, ms double, vs_cost double")
