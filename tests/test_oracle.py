"""Every registered query of the reference's operators against its DuckDB twin
(sf0.001). The driver runs the same at sf0.01."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as entry  # noqa: E402
from tasklens.plans.catalog import ORACLE as ORACLES  # noqa: E402
from tasklens.plans.catalog import QUERIES  # noqa: E402
from check_oracle import compare  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

def test_every_query_has_an_oracle():
    assert set(ORACLES) == set(QUERIES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck_small, name):
    info = compare(spark, duck_small, name, QUERIES[name], ORACLES.get(name), SF_SMALL)
    assert info["ok"] in (True, None), info
    assert info["rows"] > 0


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 7
    assert df.columns[:3] == ["taskIndex", "count", "avg_serviceTime"]
    assert len(df.columns) == 24
