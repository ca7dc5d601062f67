"""Every registered query against its SQL oracle, whole results, on the small tables."""

import compare
import pytest
from __spark_entry__ import SMALL, entry, oracle_sql, queries

JOBS, ORACLES = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(JOBS))
def test_query(spark, name):
    ok, message = compare.check(spark, name, JOBS[name], ORACLES.get(name), SMALL)
    assert ok, message


def test_entry_has_rows(spark):
    assert entry(spark).columns == ["app_id", "day", "score"]


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(JOBS)
