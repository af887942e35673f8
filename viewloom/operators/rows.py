"""Filters and explodes that do not repeat the work below them.

Catalyst adds ``size(array) > 0`` under an inner explode and pushes filters
through projections; both copy the expression that made the column, down to the
scan.  For a column read from a table that is welcome, for one computed from
hashes or regular expressions it doubles the cost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    df: DataFrame, array: Column | str, value: str, keep: Sequence[str | Column], position: str = "_position"
) -> DataFrame:
    """``keep`` columns, ``position`` if named, and one row per element; empty and NULL arrays give none."""
    exploded = df.select(*keep, F.posexplode_outer(array).alias(position, value)).where(F.col(position).isNotNull())
    return exploded.drop("_position")


def keep_rows(df: DataFrame, condition: Column) -> DataFrame:
    """``where`` that stays above computed columns."""
    kept = F.explode(F.when(condition, F.array(F.lit(True))))
    return df.select(*df.columns, kept.alias("_kept")).drop("_kept")
