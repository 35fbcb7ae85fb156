"""Driver contract: entry() smoke test and every registered query against
its DuckDB oracle (or a row check when the query has none) at sf0.001."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from tests.conftest import SF_SMALL  # noqa: E402

# the training-data queries have their tests in tests/llm
NAMES = sorted(n for n in E.queries() if not n.startswith("op") and n != "pipeline")


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10 and df.columns == ["side", "rank", "job_posting_id", "final_score"]


def test_registry_consistent():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 95


@pytest.fixture(scope="module")
def con():
    from oracle_check import duck
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    from oracle_check import compare
    status, msg = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF_SMALL)
    assert status in ("OK", "ROWS"), msg
