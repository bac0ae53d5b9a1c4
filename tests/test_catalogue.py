"""Every catalogue query against its SQL."""

from __future__ import annotations

import pytest

from fathomer.plans.catalogue import QUERIES
from fathomer.plans.catalogue_sql import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, spark, sf, oracle):
    mine, theirs = oracle(QUERIES[name], ORACLE_SQL[name], spark, sf)
    assert mine == theirs


def test_every_sql_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry_gives_ten_rows(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
