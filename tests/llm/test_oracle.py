import pytest

from roomtide.llm import oracle
from tests.compare import differences


@pytest.mark.parametrize("name", oracle.SQL)
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, name, sf):
    assert differences(spark, f"/root/testdata/{sf}", name) is None
