"""Every registered query of the annotation engine against its SQL at the smallest scale, where the tables are there."""

import math
import os

import duckdb
import pytest

from skygrid.plans.queries import ORACLE_SQL, QUERIES, entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def rows_of(df):
    fix = lambda v: None if v is None or v != v else round(float(v), 7) if isinstance(v, float) else str(v)
    return sorted((tuple(map(fix, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry(spark):
    assert entry(spark, SF).count() > 0
    assert not math.isnan(entry(spark, SF).first().area)
