import pytest

import oracle
from stranda.plans import registry


@pytest.mark.parametrize("name", registry.queries())
def test_query_equals_its_sql(spark, name):
    assert oracle.compare(spark, registry.queries()[name], registry.oracles()[name], "/root/testdata/sf0.001") == ""
