"""Queries that SQL can express, on whole tables."""

from __future__ import annotations

import pytest

from weftline.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(name, spark, duck, sf_dir):
    got = queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    relation = duck.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})")
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(relation.fetchall())
