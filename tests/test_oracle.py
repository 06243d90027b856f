"""Every registered query of the engine against its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal

import pytest

from weftline.plans.queries import QUERIES, SQL


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return f"{float(value):.9g}"
    return value.isoformat() if isinstance(value, datetime.datetime) else value


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = duck.sql(SQL[name])
    assert sorted(relation.columns) == columns
    want = sorted((tuple(plain(dict(zip(relation.columns, r, strict=True))[c]) for c in columns) for r in relation.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_registers_all(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(SQL) <= set(__spark_entry__.oracle_sql())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
