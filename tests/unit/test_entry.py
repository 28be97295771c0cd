"""The driver's entry points."""

import os

import pytest

import __spark_entry__ as entry

pytestmark = pytest.mark.skipif(not os.path.isdir(entry.SF_DIR), reason="no tables")


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["skill", "mentions", "must_mentions", "weighted_demand"] and df.count() > 0
