"""Queries that have SQL give what it gives in another engine."""

import glob
import os

import duckdb
import pytest

from karst.llm import multiselect, queries

FOLDER = os.environ.get("KARST_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    df = queries.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
    answer = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns and sorted(tuple(str(r[names.index(c)]) for c in columns) for r in answer.fetchall()) == got


def test_registered_percentiles_are_selected_and_not_sorted():
    assert multiselect.FINISH <= 32
