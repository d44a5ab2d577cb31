"""The operators that SQL can express, against DuckDB on the smallest tables."""

import pytest

from fleetlens.llm.oracle import ORACLE
from fleetlens.llm.queries import QUERIES
from tests.compare import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(llm_spark, sf_dir, name):
    assert differences(QUERIES[name](llm_spark, sf_dir), connect(sf_dir), ORACLE[name]) == []


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
