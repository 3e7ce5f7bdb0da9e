import pytest

import __spark_entry__ as entry
from checks.compare import difference, duck
from checks.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
NAMES = sorted(QUERIES)


def test_every_query_has_its_sql():
    assert [n for n in NAMES if n not in entry.oracle_sql()] == []


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_its_sql(spark, connection, name):
    assert difference(entry.queries()[name](spark, SF_DIR), connection, entry.oracle_sql()[name]) is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns[:3] == ["order_number", "product_key", "customer_key"]
    assert result.count() > 0
