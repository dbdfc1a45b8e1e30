"""Every query with SQL gives the same rows in both engines."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    found = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    order = [found.columns.index(c) for c in columns]
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)
    assert ours == theirs


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["selected_bytes", "base_arms", "proposal_funnel", "entity_store_counts", "control_arms_compressed"])
def test_rows_only(spark, name):
    rows = __spark_entry__.queries()[name](spark, SF).collect()
    assert rows
    if name == "proposal_funnel":
        assert all(r.proposed == r.accepted + r.too_small and r.n_files == r.proposed + r.unproposed for r in rows)
    if name == "entity_store_counts":
        r = rows[0]
        assert r.total_bytes == r.literal_bytes + r.middle_bytes + r.item_bytes + r.header_bytes
    if name == "selected_bytes":
        assert all(r.selected_bytes <= r.input_bytes for r in rows)
    if name == "control_arms_compressed":
        assert {(r.arm, r.mode) for r in rows} == {(a, m) for a in ("P", "A1", "A2", "C1") for m in "NZ"}
        size = {(r.arm, r.mode): r.packed_bytes for r in rows}
        assert all(size[a, "Z"] <= size[a, "N"] for a in ("P", "A1", "A2", "C1")) and size["A1", "N"] <= size["P", "N"]
