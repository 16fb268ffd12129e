import __spark_entry__
import pytest
from oracle import assert_same, connection

from meridia.plans.registry import ORACLE_SQL, QUERIES


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_contract_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir).toPandas()
    if name in ORACLE_SQL:
        assert_same(found, connection(sf_dir).execute(ORACLE_SQL[name]).df())
    else:
        assert len(found)
