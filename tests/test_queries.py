"""Every core query beside its SQL on the smallest tables, and the driver contract."""

import os

import pytest

import __spark_entry__ as entry
from tenetry.plans import catalogue
from tests.compare import DATA, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, name):
    _, n, same, both = compare(spark, name, "sf0.001")
    assert same is not False, both
    if name not in ("contradictions", "contradiction_winners", "reconcile", "split_claims"):
        assert n > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
