"""Every registered query with SQL, on the smallest tables, against that SQL."""

import os

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
ORACLE = entry.oracle_sql()
# Run on the same 500 vectors at every small scale, and checked against numpy elsewhere.
SLOW = {"f10_f13_f14_ensemble", "f22_s15_j13_sweep_dbscan", "f22_s15_sweep_hdbscan",
        "f22_s15_sweep_kmeans", "f6_inertia_curve", "f7_kmeans", "f9_hdbscan"}


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query(spark, con, name):
    note, _, ok = check.compare(spark, con, SF, name, entry.queries()[name], ORACLE.get(name))
    assert ok, note


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0].n >= rows[-1].n


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(entry.queries())
