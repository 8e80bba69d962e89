"""Evaluation control for costly per-row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``value`` as a column that later filters and projections do not evaluate again.

    The optimizer copies a projected expression into every filter that uses it. Behind a generator
    of exactly one element it stays where it is.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
