"""Exact duplicate handling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys, order: str = "seq") -> DataFrame:
    """First row of each key; null keys form a group.

    The first row is all that is asked of the window, so Spark drops the others of a key in every task before the
    shuffle: a key that holds a third of all rows sends one row per task.
    """
    place = free_column(df, "place")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn(place, first).filter(F.col(place) == 1).drop(place)


def free_column(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    name = f"__{stem}"
    while name in df.columns:
        name = f"_{name}"
    return name


def dedup_opty_price(df: DataFrame) -> DataFrame:
    """First row per opportunity and total price."""
    return first_per_key(df, ["opty", "total_price"])
