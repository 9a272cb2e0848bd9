"""Every query with an oracle, on the smallest tables."""

import pytest
from oracle_check import compare, connect

from blockloom.workload.oracle import ORACLE
from blockloom.workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == {"train_eval", "predict_blocks", "extract_stream"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_oracle(spark, duck, name):
    assert compare(spark, duck, SF, name, QUERIES[name], ORACLE[name]) is None


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0 and "position_ratio" in df.columns
    assert entry.queries().keys() >= QUERIES.keys() and entry.oracle_sql().items() >= ORACLE.items()
