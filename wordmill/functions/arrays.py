"""Unnesting of array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unnest(df: DataFrame, keep: list[str | Column], items: Column, name: str = "token") -> DataFrame:
    """One row per array element.

    The outer generator plus a filter on its output is used on purpose: for the inner one the optimizer
    infers size and null filters on the array, which would tokenise each text three times.
    """
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def unnest_with_position(
    df: DataFrame, keep: list[str | Column], items: Column, name: str = "token", pos: str = "pos"
) -> DataFrame:
    """One row per array element with its 0-based position."""
    return df.select(*keep, F.posexplode_outer(items).alias(pos, name)).where(F.col(pos).isNotNull())
