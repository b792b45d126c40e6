"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tablewright import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (str, bool)) or hasattr(v, "year"):
            return str(v)
        return round(float(v), 6) if hasattr(v, "__float__") else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_sql(spark, sf, db, name):
    got, want = Q.QUERIES[name](spark, sf).toPandas(), db.execute(Q.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_unique_rounds_is_unique(spark, sf):
    got = Q.QUERIES["gen_unique_rounds"](spark, sf).toPandas()
    assert len(got) == 1200 and got.code.is_unique and got.code.between(0, 2999).all()


def test_unique_redraws_where_values_are_scarce(spark, tmp_path):
    """900,000 rows for a million values: eight rounds don't settle all of them, and the SQL gives those that they do."""
    spark.range(900_000).toDF("o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = Q.QUERIES["gen_unique_redraws"](spark, str(tmp_path)).toPandas().sort_values("id", ignore_index=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = con.execute(Q.SQL["gen_unique_redraws"] + " ORDER BY id").df()
    assert 800_000 < len(got) < 900_000 and got.code.is_unique and got.equals(want.astype(got.dtypes))


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "n_orders" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())


WHOLE = ["fk_orphans_whole", "subset_self_reference_whole", "gen_fk_composite_whole", "gen_fk_pinned_whole"]


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables_are_read(spark, name):
    larger = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{larger}/{t}.parquet'")
    got = Q.QUERIES[name](spark, larger).toPandas()
    assert rows(got) == rows(con.execute(Q.SQL[name]).df())
    parts = set(pd.read_parquet(f"{larger}/part.parquet").p_partkey)
    if name == "fk_orphans_whole":
        assert (got.orphans > 0).all()
    elif name == "subset_self_reference_whole":
        tree, new = {5}, {5}
        while new:
            new = {p for p in parts if p // 3 in new and p > 0} - tree
            tree |= new
        assert set(got.id) == tree | {1, 0} and max(got.id) > 400
    else:
        assert len(got) == 2000 and set(got.a + 40 * got.b) <= parts and (got.a + 40 * got.b).max() >= 200
