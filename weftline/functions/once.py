"""Expressions that are used more than once and shall be evaluated once.

The optimizer puts a column's expression wherever the column is used; chains of such columns grow with a power
of their length.  A lambda variable and a generated row both hold a value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def evaluated(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with these columns computed here and not again above."""
    held = F.explode(F.array(F.struct(*columns))).alias("_held")
    others = [c for c in df.columns if c not in columns]
    return df.select(*others, held).select(*others, *[F.col(f"_held.{c}").alias(c) for c in columns])
