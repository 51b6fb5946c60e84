"""Every registered query against its SQL, and the driver contract."""

import pytest
from compare import differences, duck

import __spark_entry__ as entry_points
from odqa_spark.catalog import queries

QUERIES = {q.__name__: entry_points.queries()[q.__name__] for q in queries.ALL}
ORACLES = entry_points.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf), duck(sf), ORACLES[name]) is None


def test_contract(spark):
    assert set(ORACLES) >= set(QUERIES)
    df = entry_points.entry(spark)
    assert df.count() == 1 and "exact_match" in df.columns
