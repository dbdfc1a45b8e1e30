"""Chunks, exact duplicates, packed streams, the compression gate, erasure-coded stripes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import field
from ..functions.expressions import MIB, joined, ranged

#: The gate's settings; fixed values.
THRESHOLD, SAMPLE, LAGS, FRACTION, LEAST_PAIRS = 6.4, 8192, (1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 6144, 7168, 7680), 0.05, 512
LEVEL = 3


def validate_gate(threshold: float = THRESHOLD, sample: int = SAMPLE, lags: tuple[int, ...] = LAGS, fraction: float = FRACTION) -> None:
    if not 0 <= threshold <= 8 or sample < 2 or not 0 < fraction <= 1 or not lags or any(lag <= 0 for lag in lags):
        raise ValueError("the gate's settings are out of range")


def chunks(objects: DataFrame, size: int, data: str = "bytes") -> DataFrame:
    """Fixed-size chunks of every object: chunk_no, off, len, chunk, sha256; an empty object has none."""
    n = F.octet_length(data)
    number = F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")))
    kept = [c for c in objects.columns if c != data]
    cut = objects.where(n > 0).select(*kept, data, number.alias("chunk_no"))
    chunk = ranged(F.col(data), F.col("chunk_no") * size, size)
    return cut.select(*kept, "chunk_no", (F.col("chunk_no") * size).alias("off"), chunk.alias("chunk")).withColumn("len", F.octet_length("chunk")).withColumn("sha256", F.sha2("chunk", 256))


def first_seen(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``first``: the least (order...) of the rows with the same key.

    The least is a partial aggregate, so a key that very many rows share costs
    one row per task; the join back can split its rows.
    """
    least = rows.groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    return rows.join(least, key)


def running_total(rows: DataFrame, order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over rows with a smaller ``order`` (integers, unique).

    Sums within blocks of the order are partitioned by block; only the blocks'
    totals go through one window.
    """
    rows = rows.withColumn("_block", F.floor(F.col(order) / block))
    totals = rows.groupBy("_block").agg(F.sum(value).alias("_total"))
    before = totals.select("_block", F.coalesce(F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_within", within).join(before, "_block").withColumn(out, F.col("_before") + F.col("_within")).drop("_block", "_before", "_within")


def rebuilt(references: DataFrame, stored: DataFrame, owner: str, position: str, key: str, chunk: str = "chunk") -> DataFrame:
    """(owner, bytes): every object joined from its references in order."""
    parts = references.select(owner, position, key).join(stored.select(key, chunk), key)
    ordered = F.array_sort(F.collect_list(F.struct(position, chunk)))
    return parts.groupBy(owner).agg(ordered.alias("parts")).select(owner, joined(F.col(f"parts.{chunk}")).alias("bytes"))


def _histogram(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


def entropy_of(data: bytes) -> float:
    """Shannon entropy in bits per byte; of nothing, 0."""
    counts = _histogram(data)
    p = counts[counts > 0] / max(len(data), 1)
    return float(-(p * np.log2(p)).sum()) + 0.0


def lag_of(data: bytes, lags: tuple[int, ...] = LAGS, fraction: float = FRACTION, pairs: int = LEAST_PAIRS) -> int | None:
    """The first listed lag at which a sufficient share of bytes repeats."""
    a = np.frombuffer(data, np.uint8)
    for lag in lags:
        n = len(a) - lag
        if n >= pairs and n > 0 and np.count_nonzero(a[:n] == a[lag:]) >= fraction * n:
            return lag
    return None


def entropy(data: str) -> Column:
    @F.pandas_udf("double")
    def run(column: pd.Series) -> pd.Series:
        return column.map(entropy_of)

    return run(data)


def gate(data: str, threshold: float = THRESHOLD, sample: int = SAMPLE, lags: tuple[int, ...] = LAGS, fraction: float = FRACTION, offset: int = 0) -> Column:
    """struct(entropy, lag, try_zstd) from one sample: low entropy passes, else a periodic lag must be found."""
    validate_gate(threshold, sample, lags, fraction)

    @F.pandas_udf("entropy double, lag int, try_zstd boolean")
    def run(column: pd.Series) -> pd.DataFrame:
        rows = []
        for data in column:
            if offset > max(len(data) - min(sample, len(data)), 0):
                raise ValueError("the sample's offset exceeds the chunk")
            part = data[offset : offset + sample]
            h = entropy_of(part)
            lag = None if h < threshold else lag_of(part, lags, fraction)
            rows.append((h, lag, h < threshold or lag is not None))
        return pd.DataFrame(rows, columns=["entropy", "lag", "try_zstd"]).astype({"lag": "Int32"})

    return run(data)


#: Named policies: where the gate takes its sample, and how long; none tries always.
POLICIES: dict[str, tuple[str, int] | None] = {"start-8K": ("start", 8192), "start-16K": ("start", 16384), "middle-8K": ("middle", 8192), "always": None}


def choose(data: str, policy: str = "start-8K", threshold: float = THRESHOLD) -> Column:
    """struct(encoding, payload, skipped, rejected_len): the compressed form if the gate lets it be tried, it decodes exactly, and it is smaller."""
    place = POLICIES[policy]

    @F.pandas_udf("encoding string, payload binary, skipped boolean, rejected_len int")
    def run(column: pd.Series) -> pd.DataFrame:
        pack, unpack, rows = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor(), []
        for data in column:
            if place is not None:
                size = min(place[1], len(data))
                at = 0 if place[0] == "start" else (len(data) - size) // 2
                part = data[at : at + size]
                if entropy_of(part) >= threshold and lag_of(part) is None:
                    rows.append(("raw", data, True, None))
                    continue
            packed = pack.compress(data)
            if unpack.decompress(packed, max_output_size=max(len(data), 1)) != data:
                raise ValueError("a compressed chunk doesn't decode to itself")
            small = len(packed) < len(data)
            rows.append(("zstd" if small else "raw", packed if small else data, False, len(data) if small else len(packed)))
        return pd.DataFrame(rows, columns=["encoding", "payload", "skipped", "rejected_len"]).astype({"rejected_len": "Int32"})

    return run(data)


def decoded(encoding: str, payload: str) -> Column:
    @F.pandas_udf("binary")
    def run(kinds: pd.Series, payloads: pd.Series) -> pd.Series:
        unpack = zstandard.ZstdDecompressor()
        return pd.Series([unpack.decompress(p) if k == "zstd" else p for k, p in zip(kinds, payloads, strict=True)])

    return run(encoding, payload)


def coded_shares(data: str, k: int = 4, m: int = 2, share: int | None = None) -> Column:
    """All k + m shares of a stripe as an array of binaries."""

    @F.pandas_udf("array<binary>")
    def run(column: pd.Series) -> pd.Series:
        return column.map(lambda d: field.encode(d, k, m, share))

    return run(data)


def recoveries(data: str, k: int = 4, m: int = 2, least: int = 1, share: int | None = None) -> Column:
    """struct(patterns, exact): how many losses of ``least`` to m shares there are, and how many restore the bytes.

    The data's hash is checked after each recovery; all of a stripe's patterns
    run in one call.  ``repaired`` checks the shares of stored stripes as well.
    """

    @F.pandas_udf("patterns int, exact int")
    def run(column: pd.Series) -> pd.DataFrame:
        patterns, rows = field.loss_patterns(k + m, m, least), []
        for data in column:
            shares = field.encode(data, k, m, share)
            whole, exact = hashlib.sha256(data).digest(), 0
            for lost in patterns:
                left = [None if i in lost else s for i, s in enumerate(shares)]
                exact += hashlib.sha256(field.reconstruct(left, len(data), k, m)).digest() == whole
            rows.append((len(patterns), exact))
        return pd.DataFrame(rows, columns=["patterns", "exact"])

    return run(data)


def repaired(shares: DataFrame, k: int = 4, m: int = 2) -> DataFrame:
    """(id, bytes) from long-form shares (id, share_no, share, sha256, length): a wrong hash counts as a loss.

    A group is one stripe's shares, at most k + m rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples():
                left: list[bytes | None] = [None] * (k + m)
                for s in r.shares:
                    if hashlib.sha256(s["share"]).hexdigest() == s["sha256"]:
                        left[s["share_no"]] = s["share"]
                out.append((r.id, field.reconstruct(left, r.length, k, m)))
            yield pd.DataFrame(out, columns=["id", "bytes"])

    grouped = shares.groupBy("id").agg(F.collect_list(F.struct("share_no", "share", "sha256")).alias("shares"), F.max("length").alias("length"))
    return grouped.mapInPandas(run, f"id {shares.schema['id'].dataType.simpleString()}, bytes binary")


def striped(objects: DataFrame, size: int = MIB, order: str = "ord", length: str = "n_bytes") -> DataFrame:
    """(order, stripe_no, bytes_in): the stripes of one packed stream that each object reaches into."""
    placed = running_total(objects.where(F.col(length) > 0), order, length, "at")
    last = F.floor((F.col("at") + F.col(length) - 1) / size)
    each = placed.select(order, "at", length, F.explode(F.sequence(F.floor(F.col("at") / size), last)).alias("stripe_no"))
    begin, end = F.greatest("at", F.col("stripe_no") * size), F.least(F.col("at") + F.col(length), (F.col("stripe_no") + 1) * size)
    return each.select(order, "stripe_no", (end - begin).alias("bytes_in"))


def content_chunks(objects: DataFrame, least: int = 4096, average: int = 16384, most: int = 65536, data: str = "bytes") -> DataFrame:
    """Content-defined chunks by a gear hash with normalised cuts: (ord, chunk_no, off, len, sha256).

    Before the average size a cut needs two more zero bits than after it.  Cuts
    depend on the 32 bytes before them and on the last cut.
    """
    bits = average.bit_length() - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gear = np.random.default_rng(20240501).integers(0, 1 << 32, 256, np.uint32)
        strict, loose = np.uint32((1 << (bits + 1)) - 1) << np.uint32(31 - bits), np.uint32((1 << (bits - 1)) - 1) << np.uint32(33 - bits)
        for rows in batches:
            out = []
            for r in rows.itertuples():
                raw = getattr(r, data)
                values = gear[np.frombuffer(raw, np.uint8)]
                h = np.zeros(len(values), np.uint32)
                for k in range(min(32, len(values))):  # the hash of 32 bytes, each shifted by its distance
                    h[k:] += values[: len(values) - k] << np.uint32(k)
                hard, soft = np.flatnonzero((h & strict) == 0), np.flatnonzero((h & loose) == 0)
                at = number = 0
                while at < len(raw):
                    end = min(at + most, len(raw))
                    i = np.searchsorted(hard, at + least - 1)
                    if i < len(hard) and hard[i] < min(at + average, end):
                        end = int(hard[i]) + 1
                    else:
                        i = np.searchsorted(soft, at + average - 1)
                        if i < len(soft) and soft[i] < end:
                            end = int(soft[i]) + 1
                    out.append((r.ord, number, at, end - at, hashlib.sha256(raw[at:end]).hexdigest()))
                    at, number = end, number + 1
            yield pd.DataFrame(out, columns=["ord", "chunk_no", "off", "len", "sha256"])

    return objects.select("ord", data).mapInPandas(run, "ord long, chunk_no int, off long, len int, sha256 string")
