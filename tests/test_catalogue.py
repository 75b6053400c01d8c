"""The registered queries against their SQL on the smallest tables, where these are there."""

import glob
import os

import duckdb
import pytest

from weftline.plans import catalogue
from weftline.plans.oracles import SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def values(frame):
    frame = frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None)
    return sorted(str([float(x) if isinstance(x, float) else x for x in row]) for row in frame.values.tolist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, db, name):
    got, want = catalogue.NAMES[name](spark, FOLDER).toPandas(), db.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert values(got) == values(want)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert catalogue.flagship(spark, FOLDER).count() > 0
