"""Every registered query against its SQL in another engine, on the smallest tables."""

import pytest

from fixmine import catalog
from tests.compare import connect, plain

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sql, name):
    ours = catalog.QUERIES[name](spark, FOLDER).toPandas()
    if name not in catalog.ORACLES:
        assert len(ours) > 0
        return
    ours, theirs = plain(ours), plain(sql.execute(catalog.ORACLES[name]).df())
    assert list(ours.columns) == list(theirs.columns)
    assert ours.equals(theirs), ours.merge(theirs, how="outer", indicator=True).query("_merge != 'both'").head().to_string()


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
