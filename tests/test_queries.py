"""Every registered query with SQL gives the SQL's rows on the smallest tables; the others run."""

import pytest
from compare import assert_same

from txrisk import catalog

WITHOUT = sorted(set(catalog.QUERIES) - set(catalog.ORACLES))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, small, duck, name):
    assert_same(catalog.QUERIES[name](spark, small), duck.sql(catalog.ORACLES[name]))


@pytest.mark.parametrize("name", WITHOUT)
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(WITHOUT) < 0.15 * len(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 1 and "net" in out.columns
