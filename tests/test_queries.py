"""Every registered query against its SQL twin."""

import pytest
from sql_twins import same

from postloom import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_same_as_sql(spark, duck, sf_dir, name):
    same(core.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(core.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLES)))
def test_gives_rows(spark, sf_dir, name):
    assert core.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
