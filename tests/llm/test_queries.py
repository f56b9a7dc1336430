import pytest

import __spark_entry__ as entry_points
from colscope.llm import queries
from tests.oracle import connect, difference


@pytest.mark.parametrize("name", sorted(n for n, s in queries.SQL.items() if s))
def test_same_as_sql(name, spark, sf_dir):
    assert difference(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.SQL[name]) is None


def test_all_are_registered():
    known = entry_points.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in known) == 1
    assert "pipeline" in known
