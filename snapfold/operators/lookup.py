"""Carry hand-entered columns forward from the previous tracking table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapfold.functions import scalars as x
from snapfold.operators.skew import lookup_join


def last_and_first(last, first, order: str = "seq") -> list[Column]:
    """Aggregates: ``last`` columns of the last row and ``first`` columns of the first row.

    Whole structs are taken, so a blank cell in the deciding row wins over a filled cell
    elsewhere.
    """
    picks = []
    if last:
        picks.append(F.max_by(F.struct(*[F.col(f"`{c}`") for c in last]), order).alias("last"))
    if first:
        picks.append(F.min_by(F.struct(*[F.col(f"`{c}`") for c in first]), order).alias("first"))
    return picks


def last_first(master: DataFrame, last, first, keys=("key",), order: str = "seq") -> DataFrame:
    """One row per key; the aggregate has partial results and serves all looked-up columns."""
    return master.groupBy(*keys).agg(*last_and_first(last, first, order))


def carry_forward_last(pipe: DataFrame, master: DataFrame, columns) -> DataFrame:
    """Each column's text from the last row with the same key, else empty text."""
    joined = lookup_join(pipe, last_first(master, columns, ()), ["key"])
    values = {c: x.clean_text(F.col("last")[c]) for c in columns}
    return joined.withColumns(values).drop("last")


def _is_number(found: DataFrame, side: str, column: str) -> bool:
    return isinstance(found.schema[side].dataType[column].dataType, T.NumericType)


def carried_qty(found: DataFrame) -> Column:
    """Estimated quantity from looked-up structs.

    The last row's entry counts; if it is blank or a formula, the quantity of the first row
    does, where 0 means no value. Keys without a row give null.
    """
    fallback = F.when(F.col("first.qty") != 0, x.not_nan("first.qty"))
    if _is_number(found, "last", "est_qty"):
        return F.coalesce(x.not_nan("last.est_qty"), fallback)
    entry = x.clean_text("last.est_qty")
    return (
        F.when(F.col("last").isNull(), F.lit(None).cast("double"))
        .when((entry == "") | x.is_formula(entry), fallback)
        .otherwise(x.sanitize_numeric(entry))
    )


def carried_revenue(found: DataFrame) -> Column:
    """Previous revenue from looked-up structs; 0 means no value.

    A numeric revenue column is one this library computed, which counts as a formula.
    """
    total = x.number_or("first.total_price")
    if _is_number(found, "last", "revenue"):
        return F.when(F.col("last").isNotNull() & (total != 0), total)
    entry = x.clean_text("last.revenue")
    typed = x.not_nan("first.est_qty") if _is_number(found, "first", "est_qty") else x.manual_number("first.est_qty")
    product = F.coalesce(typed, F.lit(0.0)) * x.number_or("first.sales_price")
    value = F.when(x.is_formula(entry), total).otherwise(product)
    return F.when((entry != "") & (value != 0), value)


LAST_COLUMNS = ("est_qty", "revenue", "quarter_invoice", "forecast", "next_step")
FIRST_COLUMNS = ("qty", "sales_price", "total_price", "est_qty")


def carry_forward_qty(pipe: DataFrame, master: DataFrame) -> DataFrame:
    found = last_first(master, ("est_qty",), ("qty",))
    joined = lookup_join(pipe, found, ["key"])
    return joined.withColumn("est_qty", carried_qty(found)).drop("last", "first")


def carry_forward_revenue(pipe: DataFrame, master: DataFrame) -> DataFrame:
    found = last_first(master, ("revenue",), ("total_price", "sales_price", "est_qty"))
    joined = lookup_join(pipe, found, ["key"])
    return joined.withColumn("revenue_carried", carried_revenue(found)).drop("last", "first")


def carry_forward_manual(pipe: DataFrame, found: DataFrame, extra=(), hot: DataFrame | None = None) -> DataFrame:
    """All manual columns in one join; ``found`` comes from :func:`last_first`.

    ``extra`` names further columns of ``found`` that travel along, such as note weeks.
    The revenue of the tracking table is always quantity times price; the carried figure is
    kept beside it. ``hot`` may name the hot keys when the caller finds them more cheaply.
    """
    joined = lookup_join(pipe, found, ["key"], hot).withColumn("est_qty", carried_qty(found))
    return joined.select(
        *[F.col(f"`{c}`") for c in pipe.columns],
        "est_qty",
        carried_revenue(found).alias("revenue_carried"),
        (F.col("est_qty") * F.col("sales_price")).alias("revenue"),
        x.quarter_invoice("closed", "last.quarter_invoice").alias("quarter_invoice"),
        x.forecast_category("stage", "last.forecast", "win_rate").alias("forecast"),
        x.clean_text("last.next_step").alias("next_step"),
        *[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in extra],
    )
