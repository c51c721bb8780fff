"""Every query with SQL agrees with DuckDB on the smallest tables; the others run; none is empty."""

import pytest

import oracle_check
from webstrata import catalog
from webstrata.plans import load_all

load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle_check.views(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    if name in catalog.ORACLES:
        assert oracle_check.compare(spark, duck, name, catalog.QUERIES[name], catalog.ORACLES[name], SF) == ""
        assert duck.execute(f"SELECT count(*) FROM ({catalog.ORACLES[name]})").fetchone()[0] > 0  # an empty answer shows nothing
    else:
        assert len(catalog.QUERIES[name](spark, SF).toPandas()) > 0
