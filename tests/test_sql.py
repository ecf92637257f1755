"""Every core query gives what its SQL gives in another engine."""

import glob
import math
import os

import duckdb
import pytest

from karst.plans import PLANS, SQL

FOLDER = os.environ.get("KARST_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if hasattr(value, "as_integer_ratio") and not isinstance(value, (int, bool)):
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, engine, name):
    df = PLANS[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    answer = engine.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in answer.fetchall()) == got


def test_every_plan_runs(spark):
    for name in set(PLANS) - set(SQL):
        assert PLANS[name](spark, FOLDER).count() >= 0
