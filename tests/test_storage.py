import hashlib
import hmac
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairnspark.functions import expressions as X
from cairnspark.functions import field
from cairnspark.operators import storage as S
from cairnspark.sources import objects as O

BOUNDARIES = [1, 2, 3, 4, 5, 10 << 10, (256 << 10) - 1, 256 << 10, (256 << 10) + 1]


def slow_product(a, b):
    out = 0
    while b:
        out ^= a if b & 1 else 0
        a = a << 1 ^ (0x11D if a & 128 else 0)
        b >>= 1
    return out


def test_products_and_inverses():
    values = np.arange(256, dtype=np.uint8)
    for a in (0, 1, 2, 3, 29, 255):
        assert field.multiply(a, values).tolist() == [slow_product(a, int(b)) for b in values]
    assert all(slow_product(a, field.inverse(a)) == 1 for a in range(1, 256))


@pytest.mark.parametrize("n", BOUNDARIES)
def test_all_losses_of_two(n):
    data = bytes(i * 41 % 256 for i in range(n))
    shares = field.encode(data)
    assert len(shares) == 6 and {len(s) for s in shares} == {-(-n // 4)}
    patterns = field.loss_patterns(6, 2) if n <= 10 << 10 else [(0,), (0, 1), (3, 5), (4, 5)]
    for lost in patterns:
        assert field.reconstruct([None if i in lost else s for i, s in enumerate(shares)], n) == data
    with pytest.raises(ValueError):
        field.reconstruct([None, None, None, *shares[3:]], n)


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=300), st.sets(st.integers(0, 6), max_size=3))
def test_three_parities(data, lost):
    shares = field.encode(data, 4, 3)
    assert field.reconstruct([None if i in lost else s for i, s in enumerate(shares)], len(data), 4, 3) == data


def test_closed_forms(spark):
    row = spark.createDataFrame([(505_079, 17_486_356)], "a long, b long").select(X.variable_coded(F.col("a")), X.fixed_coded(F.col("a")), X.variable_coded(F.col("b")), X.protected(F.col("b"))).first()
    assert tuple(row) == (757_620, 1_572_864, 26_229_534, 26_237_322)
    dev = spark.range(1).select(X.modeled_metadata(F.lit(3), F.lit(84), F.lit(103), F.lit(44), F.lit(0))).first()[0]
    assert dev == 7_470


def test_scalars(spark):
    data = b"what do ya want for nothing?"
    assert spark.range(1).select(X.hmac_sha256(b"Jefe", F.lit(data))).first()[0] == hmac.new(b"Jefe", data, hashlib.sha256).hexdigest()
    values = [0, 1, -1, 255, 256, -256, (1 << 31), -(1 << 63), (1 << 63) - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    want = [8 if v == -(1 << 63) else max(1, (abs(v).bit_length() + 7) // 8) for v in values]
    assert [r[0] for r in df.select(X.magnitude_bytes(F.col("v"))).collect()] == want
    assert [r[0] for r in spark.createDataFrame([(0,), (127,), (128,), (1 << 14,)], "v long").select(X.varint_length(F.col("v"))).collect()] == [1, 1, 2, 3]
    assert [r[0] for r in spark.createDataFrame([("1e3",), ("nan",), ("x",), ("inf",)], "s string").select(X.finite(F.col("s"))).collect()] == [1000.0, None, None, None]
    byte = spark.range(256).select("id", *(X.times(F.col("id").cast("int"), k).alias(f"k{k}") for k in (1, 2, 3, 4)))
    assert all(r[f"k{k}"] == slow_product(k, r.id) for r in byte.collect() for k in (1, 2, 3, 4))


def test_gate():
    assert S.entropy_of(b"") == 0 and S.entropy_of(b"aaaa") == 0 and abs(S.entropy_of(bytes(range(256))) - 8) < 1e-12
    block = random.Random(1).randbytes(4096)
    assert S.lag_of(block * 3, (4096,)) == 4096
    assert S.lag_of(random.Random(2).randbytes(8192)) is None
    with pytest.raises(ValueError):
        S.validate_gate(fraction=0)


def test_choices_restore(spark):
    rows = [(0, b""), (1, b"a" * 5000), (2, random.Random(3).randbytes(9000)), (3, bytes(range(256)) * 40)]
    df = spark.createDataFrame(rows, "ord long, bytes binary")
    got = {r.ord: r for r in df.select("ord", "bytes", S.choose("bytes").alias("c")).select("ord", "bytes", "c.*").withColumn("again", S.decoded("encoding", "payload")).collect()}
    assert all(bytes(r["again"]) == bytes(r["bytes"]) for r in got.values())
    assert got[2].skipped and got[2].encoding == "raw" and got[1].encoding == "zstd" and not got[3].skipped


def test_damaged_share_is_a_loss(spark):
    data = b"some bytes of a stripe"
    rows = [(1, i, s if i != 2 else b"x" + s[1:], hashlib.sha256(s).hexdigest(), len(data)) for i, s in enumerate(field.encode(data))]
    df = spark.createDataFrame(rows, "id long, share_no int, share binary, sha256 string, length int")
    assert bytes(S.repaired(df).first().bytes) == data


def test_order_and_totals(spark):
    df = spark.createDataFrame([(f"{c}/{i:02d}", i) for c in "ab" for i in range(5)], "path string, n long")
    assert [r.ord for r in O.with_order(df, "path").orderBy("path").collect()] == list(range(10))
    sums = S.running_total(spark.createDataFrame([(i * 3000, i) for i in range(9)], "ord long, n long"), "ord", "n", "before")
    assert [r.before for r in sums.orderBy("ord").collect()] == [sum(range(i)) for i in range(9)]


def test_sources(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "a.DXF").write_bytes(b"one")
    (tmp_path / "x" / "y" / "b.dxf").write_bytes(b"two")
    (tmp_path / "x" / ".hidden.dxf").write_bytes(b"three")
    assert sorted(bytes(r.bytes) for r in O.files(spark, str(tmp_path / "x"), ".dxf").collect()) == [b"one", b"two"]
    (tmp_path / "m.csv").write_text("path,family,split,variant,relation,bytes,sha256,base,byte_equal_to_base,entities,edited_values,expect\nb,f,dev,v,r,3,h,,,1,0,s\na,f,test,v,r,3,h,,,1,0,s\n")
    assert [r.path for r in O.csv_manifest(spark, str(tmp_path / "m.csv"), "dev").collect()] == ["b"]
    (tmp_path / "m.json").write_text('{"files": [{"path": "a", "bytes": 1}, {"path": "b", "bytes": 2}]}')
    assert O.json_manifest(spark, str(tmp_path / "m.json")).count() == 2
    found = spark.createDataFrame([("a", 1, "h"), ("c", 1, "h"), ("d", 2, "h")], "path string, bytes long, sha256 string")
    manifest = spark.createDataFrame([("a", 1, "x"), ("b", 1, "h"), ("d", 3, "h"), ("d", 3, "h")], "path string, bytes long, sha256 string")
    assert {tuple(r) for r in O.manifest_problems(found, manifest).collect()} == {("a", "hash"), ("b", "missing"), ("c", "extra"), ("d", "size"), ("d", "repeated")}
    listed = spark.createDataFrame([(b"a/b\0c",)], "bytes binary")
    assert sorted(r.path for r in O.selection(listed).collect()) == ["a/b", "c"]
    with pytest.raises(Exception):
        O.selection(spark.createDataFrame([(b"../b",)], "bytes binary")).collect()
    shares = spark.createDataFrame([(1, 0, 0, 3)], "id long, share_no int, zone int, node int")
    O.write_shares(shares, str(tmp_path / "shares"))
    with pytest.raises(Exception):
        O.write_once(shares, str(tmp_path / "shares"))


def test_churn_draws_against_plain_integers():
    from cairnspark.operators import simulation as P

    state, word = P.CHURN_SEED, (1 << 64) - 1

    def draw(below):
        nonlocal state
        state ^= (state << 13) & word
        state ^= state >> 7
        state ^= (state << 17) & word
        return state % below

    want, tick = [], 0
    for k in range(1, 33):
        down = 0
        for i in range(1 + draw(2)):
            tick += 1 + draw(5)
            node = draw(18)
            while down >> node & 1:
                node = draw(18)
            down |= 1 << node
            want.append((k, i + 1, tick, down))
    assert P.churn_draws(32) == want
    assert {bin(d).count("1") for *_, d in want} == {1, 2}
    with pytest.raises(ValueError):
        P.churn_draws(33)


def test_paths_of_any_length(spark):
    from cairnspark.operators import simulation as P

    chain = [(f"n{i:02d}", f"n{i + 1:02d}", 1, 1.0) for i in range(14)] + [("n00", "n14", 99, 1.0)]
    best = {r.node: (r.cost, r.path) for r in P.shortest_paths(P.links(spark, chain), "n00").collect()}
    assert best["n14"] == (14, ">".join(f"n{i:02d}" for i in range(15))) and len(best) == 15


def test_chains_of_any_length(spark):
    from cairnspark.operators import ledgers as L
    from cairnspark.operators import similarity as M
    from pyspark.sql import functions as F

    texts = [b"start of a text " * 20 + bytes([65 + i]) * i for i in range(20)]
    pairs = spark.createDataFrame([(i, i - 1 if i else None, texts[i - 1] if i else b"", t) for i, t in enumerate(texts)], "ord long, base long, b binary, t binary")
    choices = pairs.select("ord", "base", F.when(F.col("base").isNull(), F.col("t")).otherwise(M.patch("b", "t")).alias("payload"))
    assert {r.ord: bytes(r.bytes) for r in L.resolved(choices).collect()} == dict(enumerate(texts))
    with pytest.raises(ValueError):
        L.resolved(choices.where("ord <> 3")).collect()
