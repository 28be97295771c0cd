"""Queries against their SQL on small tables of the cases that decide between two results."""

import datetime

import duckdb
import pytest

from sievelake.plans import all_queries, all_sql


@pytest.fixture
def differs(spark, tmp_path):
    """Rows that only the query gives, and rows that only its SQL gives."""

    def run(name, **tables):
        duck = duckdb.connect()
        for table, (rows, schema) in tables.items():
            path = f"{tmp_path}/{table}.parquet"
            spark.createDataFrame(rows, schema).write.parquet(path, mode="overwrite")
            duck.execute(f"create or replace view {table} as select * from read_parquet('{path}/*.parquet')")
        got = all_queries()[name](spark, str(tmp_path))
        columns = ", ".join(f'"{c}"' for c in got.columns)
        theirs = duck.execute(f"select {columns} from ({all_sql()[name]})").fetchall()
        ours = [tuple(r) for r in got.collect()]
        assert ours and theirs
        return sorted(set(ours) - set(theirs), key=str), sorted(set(theirs) - set(ours), key=str), len(ours) - len(theirs)

    return run


ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
_DAY = datetime.datetime(2001, 7, 1)


def test_scores_are_not_rounded_before_cents(differs):
    """1.015 is a little less than that as a double: 101 cents, not 102. All half cents, with and without penalties and the cap."""
    rows = [(k, 1 + k % 30, "OFP"[k % 3], 200.0 + 400 * (k // 2), _DAY, "5-LOW" if k % 2 else "1-URGENT") for k in range(2000)]
    assert differs("decide_actions", orders=(rows, ORDERS)) == ([], [], 0)


def test_equally_long_terms_go_by_the_taxonomy(differs):
    """In "the of the of" the pair that is named first goes first, wherever it stands: one pair and two words are left, not two pairs."""
    texts = ["the of the of", "of the of the", "la de la de la", "de la de la de", "the the the and the", "the of the the of", "die der der das der", "und the and the", "the of, the of the. of the\nof the of", ""]
    rows = [(k, text) for k, text in enumerate(texts)] + [(90, None), (1, "the of the"), (None, "of the of")]
    assert differs("text_skills", documents=(rows, "doc_id long, text string")) == ([], [], 0)
