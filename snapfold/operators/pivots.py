"""Pivot figures, filter groups and column profiles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapfold import schema
from snapfold.functions import scalars as x

# States of a filter item.
SHOW_CHECKED = "SHOW+check"
SHOW_UNCHECKED = "SHOW-uncheck"
HIDDEN = "hide"


@dataclass(frozen=True)
class FilterGroup:
    """One filter: the field, the values it may offer and the values that are checked."""

    field: str
    allowed: tuple[str, ...] = ()
    selected: tuple[str, ...] = ()
    tabs: tuple[str, ...] = field(default=("By Sales",))

    @property
    def visible(self) -> tuple[str, ...]:
        return self.selected or self.allowed

    @property
    def invalid(self) -> tuple[str, ...]:
        """Checked values that are not allowed."""
        return tuple(sorted(set(self.selected) - set(self.allowed))) if self.allowed else ()

    @property
    def status(self) -> str:
        if not self.visible:
            return "skipped: nothing set"
        return "skipped: selection not allowed" if self.invalid else "applied"


def filter_groups(settings: dict[int, FilterGroup]) -> list[tuple[int, FilterGroup]]:
    """Groups 1, 2, ... up to the first gap; group 1 must be there."""
    if 1 not in settings:
        raise ValueError("filter group 1 is not set")
    found = []
    number = 1
    while number in settings:
        found.append((number, settings[number]))
        number += 1
    return found


def resolve_field(df: DataFrame, name: str) -> str:
    """Column whose first line equals ``name``, regardless of case and outer white space."""
    wanted = name.strip().lower()
    for column in df.columns:
        if column.split("\n")[0].strip().lower() == wanted:
            return column
    raise ValueError(f"no column is named {name!r}")


def _item(column: str) -> Column:
    """Value of a filter item; a blank item is empty text."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def pivot_filter_states(df: DataFrame, group: FilterGroup) -> DataFrame:
    """State of every distinct value of the group's field."""
    item = F.col("item")
    offered = item.isin(*group.allowed) if group.allowed else F.lit(True)
    state = (
        F.when(item.isin(*group.visible), SHOW_CHECKED).when(offered, SHOW_UNCHECKED).otherwise(HIDDEN)
    )
    items = df.select(_item(resolve_field(df, group.field)).alias("item")).distinct()
    return items.withColumn("state", state)


def is_visible(df: DataFrame, group: FilterGroup) -> Column:
    return _item(resolve_field(df, group.field)).isin(*group.visible)


def pivot_filter_apply(df: DataFrame, group: FilterGroup) -> DataFrame:
    """Rows whose value is visible."""
    return df.filter(is_visible(df, group))


def pivot_filter_validate(df: DataFrame, settings: dict[int, FilterGroup]) -> DataFrame:
    """One row per group: is it applied, what is wrong with it, how many rows does it show.

    All groups are counted in a single pass over the data.
    """
    groups = filter_groups(settings)
    counts = df.agg(*[
        F.count(F.when(is_visible(df, g), 1)).alias(f"n{i}")
        if g.status == "applied" else F.lit(0).cast("long").alias(f"n{i}")
        for i, g in groups
    ], F.count("*").alias("n_all"))
    lines = [
        F.struct(
            F.lit(i).alias("group_no"),
            F.lit(g.field).alias("field"),
            F.lit(g.status).alias("status"),
            F.lit(",".join(g.invalid)).alias("invalid"),
            F.col(f"n{i}").alias("n_visible"),
            F.col("n_all").alias("n_rows"),
        )
        for i, g in groups
    ]
    return counts.select(F.inline(F.array(*lines)))


def pivot_invalid_selection(df: DataFrame, group: FilterGroup) -> DataFrame:
    """Configured values that cannot work: not allowed, or not in the data.

    The data is filtered to the configured values before it is made distinct, so what is
    compared is never longer than the configuration.
    """
    spark = df.sparkSession
    values = T.StructType([T.StructField("item", T.StringType())])
    present = df.select(_item(resolve_field(df, group.field)).alias("item"))
    present = present.filter(F.col("item").isin(*group.visible)).distinct()
    visible = spark.createDataFrame([(v,) for v in sorted(set(group.visible))], values)
    absent = visible.join(present, "item", "left_anti").withColumn("problem", F.lit("not in data"))
    if not group.invalid:
        return absent
    refused = spark.createDataFrame([(v,) for v in group.invalid], values)
    return absent.unionByName(refused.withColumn("problem", F.lit("not allowed")))


def stale_members(dimension: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Dimension rows no fact row uses; fact keys are made distinct before they meet."""
    return dimension.join(facts.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- profiles

_NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$"


def _kinds(name: str, kind: T.DataType) -> dict[str, Column]:
    c = F.col(f"`{name}`")
    no = F.lit(False)
    if isinstance(kind, T.NumericType):
        return {"blank": c.isNull(), "text": no, "number": c.isNotNull(), "date": no}
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return {"blank": c.isNull(), "text": no, "number": no, "date": c.isNotNull()}
    text = x.clean_text(c)
    blank, number, date = text == "", text.rlike(_NUMBER), text.rlike(_DATE)
    return {"blank": blank, "text": ~(blank | number | date), "number": number, "date": date}


def column_type_profile(df: DataFrame, columns=None) -> DataFrame:
    """Which kinds of values each column holds, and whether it mixes them. One pass."""
    names = list(columns or df.columns)
    flags = [
        F.coalesce(F.bool_or(test), F.lit(False)).alias(f"{kind}_{i}")
        for i, n in enumerate(names)
        for kind, test in _kinds(n, df.schema[n].dataType).items()
    ]
    found = df.agg(*flags)

    def line(i, name):
        has = {k: F.col(f"{k}_{i}") for k in ("blank", "text", "number", "date")}
        kinds = sum(has[k].cast("int") for k in ("text", "number", "date"))
        return F.struct(
            F.lit(name).alias("column_name"),
            *[has[k].alias(f"has_{k}") for k in has],
            (kinds > 1).alias("mixed"),
            (has["text"] & (has["number"] | has["date"])).alias("semi_mixed"),
        )

    return found.select(F.inline(F.array(*[line(i, n) for i, n in enumerate(names)])))


# ---------------------------------------------------------------- figures


def amount_by(df: DataFrame, *axes: str, measure: str = "total_price") -> DataFrame:
    """Sum of a money column over the given axes, long form."""
    return df.groupBy(*axes).agg(x.money_sum(measure).alias("amount"))


def amount_pivot(df: DataFrame, axis: str, series: str, labels, measure: str = "total_price") -> DataFrame:
    """Sums with one column per label, and the rest under ``other`` so that nothing is lost."""
    labels = list(labels)
    label = F.when(F.col(series).isin(*labels), F.col(series)).otherwise("other")
    sums = df.select(axis, label.alias("series"), x.money(measure).alias("m"))
    wide = sums.groupBy(axis).pivot("series", [*labels, "other"]).agg(F.sum("m"))
    return wide.select(axis, *[
        F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("double").alias(c) for c in [*labels, "other"]
    ])


def sales_by_quarter(df: DataFrame, quarters, measure: str = "total_price") -> DataFrame:
    return amount_pivot(df, "owner", "quarter_invoice", quarters, measure)


def sales_by_forecast(df: DataFrame, axis: str = "reseller", measure: str = "total_price") -> DataFrame:
    return amount_pivot(df, axis, "forecast", schema.FORECAST_LABELS, measure)


def quarter_labels(first_year: int, last_year: int) -> list[str]:
    return [f"Q{q}FY{y % 100:02d}" for y in range(first_year, last_year + 1) for q in (1, 2, 3, 4)]
