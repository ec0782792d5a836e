"""Texts are packed once; a vector search moves its queries and what it found, whatever the number of blocks."""

import pytest

from tenetry.operators import retrieval
from tests.test_term_blocks import rows_shuffled, tables  # noqa: F401 - a fixture

NAMES = ("QUERIES_PER_BLOCK", "DOCUMENTS_PER_BLOCK", "QUERIES_AT_ONCE", "DOCUMENTS_AT_ONCE", "SLICE")


def found(df, queries, within, embedder=retrieval.embed):
    return {(r["query_id"], r["rank"]): (r["id"], round(r["similarity"], 8), r["score"]) for r in retrieval.vector_retrieve(df, queries, 3, within, embedder=embedder).collect()}


@pytest.mark.parametrize("within", (False, True))
def test_blocks_give_the_same(spark, tables, monkeypatch, within):  # noqa: F811
    df, queries = tables[0].limit(500), tables[1].limit(60)
    want = found(df, queries, within, lambda *x: retrieval.embed(*x))
    assert found(df, queries, within) == want and len(want) > 100
    for name, n in zip(NAMES, (13, 97, 13, 31, 5)):
        monkeypatch.setattr(retrieval, name, n)
    assert found(df, queries, within) == want


def test_rows_of_many_blocks(spark, tables, monkeypatch):  # noqa: F811
    df, queries = tables
    for name, n in zip(NAMES[:3], (20, 100, 20)):
        monkeypatch.setattr(retrieval, name, n)
    before = rows_shuffled(spark)
    assert len(retrieval.vector_retrieve(df, queries.limit(400), within=True).collect()) == 2000
    n = rows_shuffled(spark) - before
    assert n < 50_000, n
