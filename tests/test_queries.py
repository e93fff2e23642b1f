"""Every engine query against its SQL on the smallest tables, and the plans that matter at scale."""

import duckdb
import pytest

from tests.conftest import DATA
from tidewake import file_queries, operator_queries, queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(rows, order):
    def value(x):
        return round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    cur = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    names = sorted(columns)
    assert plain([tuple(r) for r in df.collect()], [df.columns.index(c) for c in names]) == plain(cur.fetchall(), [columns.index(c) for c in names])


def text_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = text_of(queries.zonal_stats(spark, DATA))
    assert "ReadSchema: struct<l_suppkey:bigint,l_discount:double>" in plan


def test_no_nested_loops_where_keys_exist(spark):
    for name in ("asof_interp", "land_join", "field_trilinear", "nearest_step", "case_assembly"):
        plan = text_of(queries.QUERIES[name](spark, DATA))
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, name


def test_a_fix_meets_the_cloud_as_one_row(spark):
    """A step's particles are one row beside the fixes; nothing is grouped by fix again, and twins keep their rows."""
    from tidewake.operators import tracks

    cloud = spark.range(3 * 11).selectExpr("cast(id / 11 as int) as step", "cast(id % 11 as int) as k", "72 + id % 11 * 0.01D as lon", "18 + cast(id / 11 as int) * 0.01D as lat")
    fixes = spark.createDataFrame([(1, float(t), 72.0, 18.0, t) for t in (-5, 0, 1, 50, 100, 150, 200, 201)] + [(2, 60.0, 72.1, 18.01, 9)] * 2, "mmsi long, ts_epoch double, lon double, lat double, seq int")
    got = tracks.with_cloud(fixes, cloud, 0.0, 200.0, 100.0)
    assert got.columns == [*fixes.columns, "st_km"]
    rows = got.collect()
    assert len(rows) == 10 and [r["st_km"] is None for r in sorted(rows, key=lambda r: r["ts_epoch"])] == [True] + 8 * [False] + [True]
    from tidewake.functions.geo import metres_per_degree_at

    for r in (r for r in rows if r["st_km"] is not None):
        mx, my = metres_per_degree_at(18.0 if r["mmsi"] == 1 else 18.01)
        away = sorted((((72 + k * 0.01 - r["lon"]) * mx) ** 2 + ((18 + r["ts_epoch"] / 100 * 0.01 - r["lat"]) * my) ** 2) ** 0.5 / 1000 for k in range(11))
        assert abs(r["st_km"] - away[1]) < 1e-6
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "keys=[__a" in plan and "keys=[mmsi" not in plan
