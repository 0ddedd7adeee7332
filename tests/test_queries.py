"""Every registered query on the small tables, against its SQL where it has one."""

import pytest

from compare import differences, duck
from meterline.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_same_rows_as_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF), con, SQL[name]) == []


@pytest.mark.parametrize(
    "name", ["partial_autocorrelation", "difference_order", "tree_inference"]
)
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
