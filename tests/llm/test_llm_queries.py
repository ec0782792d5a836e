"""Queries p1 to p10 beside their SQL."""

import os

import pytest

from tenetry.llm import queries
from tests.compare import DATA, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    _, n, same, both = compare(spark, name, "sf0.001")
    assert same is not False, both
    assert n > 0 or name in ("p7_found", "p9_found")
