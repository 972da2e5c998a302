"""Every registered query against its SQL, on whole tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from roomtide.plans import oracle
from roomtide.plans import queries as registered
from tests.compare import TESTDATA, differences


def test_every_query_has_an_oracle():
    assert set(registered.ALL) == set(oracle.SQL)
    assert set(registered.ALL) <= set(queries())
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(registered.ALL))
def test_query_matches_sql(spark, name):
    assert differences(spark, f"{TESTDATA}/sf0.01", name) is None


def test_entry_runs(spark):
    assert entry(spark).count() == 15
