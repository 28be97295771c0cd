"""Every query with SQL against DuckDB, on the driver's smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from sievelake.plans import all_queries, all_sql

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    assert not isinstance(v, (datetime.date, datetime.datetime)), "dates compare as text"
    return str(v)


@pytest.mark.parametrize("name", sorted(all_sql()))
def test_query_equals_sql(spark, duck, name):
    df = all_queries()[name](spark, DIR)
    columns = sorted(df.columns)
    r = duck.execute(all_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    expected = sorted(([plain(row[names.index(c)]) for c in columns] for row in r.fetchall()), key=str)
    assert sorted(([plain(row[c]) for c in columns] for row in df.collect()), key=str) == expected


@pytest.mark.parametrize("name", sorted(set(all_queries()) - set(all_sql())))
def test_query_runs(spark, name):
    assert all_queries()[name](spark, DIR).count() > 0


def test_names_need_no_session():
    """The driver reads the names before it starts Spark."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent.parent
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40"], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
