"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import check_oracles as co
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return co.connect(SF)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    status, _n, _s, _d, detail = co.compare(spark, duck, SF, name)
    assert status in ("ok", "rows"), f"{status} {detail}"


def test_entry_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
