import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import DATA, both

from sieveline.llm import queries


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    found, expected = both(spark, queries.queries()[name], queries.oracle_sql()[name])
    assert found == expected
