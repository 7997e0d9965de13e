"""Every registered query of the library against its SQL; those without SQL have stable, non-empty results."""

import pytest

from millrace import queries
from tests.oracle import assert_same

NO_SQL = sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), queries.ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", NO_SQL)
def test_without_sql(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
