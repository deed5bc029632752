"""Expensive columns that are filtered on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``withColumns`` for expressions that a later filter refers to.

    A filter on a projected column is pushed below the projection with the whole expression
    copied into it, once per mention, so an expensive text expression would run many times.
    A filter on the output of a generator stays above it. The outer form of the generator
    matters: from the plain form, the optimizer infers a filter on the input.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline_outer(F.array(row)))


def explode_present(df: DataFrame, array: Column | str, name: str, keep: list) -> DataFrame:
    """``keep`` and one row per element of an array column, without the inferred filter."""
    rows = df.select(*keep, F.explode_outer(array).alias(name))
    return rows.where(F.col(name).isNotNull())
