import pytest

from strandwork.plans import source_queries  # noqa: F401 -- registers its queries
from strandwork.plans.queries import ORACLE, QUERIES

from .oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_is_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert name not in ORACLE or compare(df, con, ORACLE[name]) is None
