import pytest

from quillchain.llm import registry
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], "/root/testdata/sf0.001")
