"""Turning computed arrays into rows.

A plain explode of a computed array makes Spark infer a "not empty" filter, which it pushes down and thereby
computes the array once more. The outer forms avoid that; the single null row of an empty array is dropped here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfolded(df: DataFrame, structs: Column, never_null: str, *keep: str | Column) -> DataFrame:
    """One row per struct, its fields as columns; ``never_null`` names a field that is always set."""
    return df.select(*keep, F.inline_outer(structs)).where(F.col(never_null).isNotNull())


def unfolded_values(df: DataFrame, values: Column, name: str, *keep: str | Column) -> DataFrame:
    """One row per non-null array element."""
    return df.select(*keep, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def numbered(df: DataFrame, values: Column, position: str, name: str, *keep: str | Column) -> DataFrame:
    """One row per element with its zero-based position."""
    return df.select(*keep, F.posexplode_outer(values).alias(position, name)).where(F.col(position).isNotNull())
