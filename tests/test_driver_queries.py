"""Every registered query of the engine against its oracle SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from graphweft import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool) or isinstance(v, str):
        return v
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return round(float(v), 6) if hasattr(v, "__float__") else v


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_against_oracle(spark, con, name):
    df = Q.queries()[name](spark, DIR)
    want = con.execute(Q.oracles()[name])
    columns = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(columns)
    key = lambda r: repr(r)
    got = sorted(([plain(r[c]) for c in columns] for r in df.collect()), key=key)
    assert got == sorted(([plain(v) for v in r] for r in want.fetchall()), key=key)


def test_plans_prune_and_push(spark):
    plan = Q.engine(spark, DIR).explain(Q.PREFIXES + Q.CATALOG["hybrid_filter"][0])
    assert "PushedFilters" in plan and "LessThan(value,20.0)" in plan and "GreaterThan(ts," in plan
    assert "c_acctbal" not in plan and plan.count("customer.parquet") <= 2  # the series node is read in the customer's scan


def test_series_of_one_table_need_no_self_join(spark):
    df = Q.queries()["hybrid_group_count"](spark, DIR)
    text = df._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation") == 3
