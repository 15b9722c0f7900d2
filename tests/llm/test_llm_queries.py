"""Every query of this folder on the smallest tables, against its SQL where there is some."""

import pytest
from compare import rows
from conftest import SF_DIR

from lexigraph.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR).toPandas()
    assert len(found) > 0
    if name in ORACLES:
        expected = duck.execute(ORACLES[name]).fetchdf()
        assert sorted(found.columns) == sorted(expected.columns) and rows(found) == rows(expected)
