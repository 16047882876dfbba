import pytest

from strandwork.llm.queries import ORACLE, QUERIES

from ..oracle import compare, connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_is_its_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) is None
