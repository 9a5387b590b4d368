"""Snapshot log and the normalised rolling view on it.

The log has one row per snapshot. ``seq`` gives the order of its rows.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapfold.config import Config
from snapfold.functions import scalars as x
from snapfold.functions.weeks import iso_week_of

LOG_FIELDS = ("date", "wk", "nb_opty", "sf_amount", "est_amount")


def tracking_totals(main: DataFrame) -> DataFrame:
    """Row count, sum of total prices and sum of estimated quantity times sales price."""
    return main.agg(
        F.count("*").alias("nb_opty"),
        x.money_sum("total_price").alias("sf_amount"),
        x.money_sum(x.to_number("est_qty") * F.col("sales_price")).alias("est_amount"),
    )


def log_row(totals: DataFrame, snapshot_time: datetime) -> DataFrame:
    """The log row of one snapshot, dated to the start of its day."""
    day = snapshot_time.replace(hour=0, minute=0, second=0, microsecond=0)
    return totals.select(
        x.timestamp(day).alias("date"),
        F.lit(iso_week_of(snapshot_time)).alias("wk"),
        "nb_opty", "sf_amount", "est_amount",
    )


def log_upsert(log: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """Every log row with the new row's key takes its values; without one it is appended.

    ``new`` is one row. It enters as one value, so that what it is derived from is computed once.
    """
    row = new.select(F.struct(*LOG_FIELDS).alias("row")).scalar()
    same = F.col(key) == row[key]
    replaced = log.select(*[F.when(same, row[c]).otherwise(F.col(c)).alias(c) for c in LOG_FIELDS], "seq")
    ends = log.agg(F.max("seq").alias("last"), F.count_if(same).alias("n_same"))
    appended = ends.filter((F.col("n_same") == 0) & row.isNotNull()).select(
        *[row[c].alias(c) for c in LOG_FIELDS], F.coalesce(F.col("last") + 1, F.lit(1).cast("long")).alias("seq"))
    return replaced.unionByName(appended)


def log_last_per_week(log: DataFrame, by_year: bool = False) -> DataFrame:
    """Last row of each week number; ``by_year`` keeps the years apart."""
    keys = ["wk", F.year("date").alias("year")] if by_year else ["wk"]
    rest = [c for c in log.columns if c != "wk"]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("last"))
    return last.select("wk", "last.*").select(*log.columns)


def rolling_tail(log: DataFrame, n: int) -> DataFrame:
    """The last ``n`` log rows: the length of the report, not a limit on the work."""
    return log.orderBy(F.col("seq").desc()).limit(n)


def rolling_view(log: DataFrame, config: Config = Config()) -> DataFrame:
    rows = log_last_per_week(log) if config.rolling_field == "wk" else log
    return rolling_tail(rows, config.rolling_window)


def _digits(amount: Column) -> Column:
    """Whole part as text. Doubles would print large amounts with an exponent."""
    return F.floor(x.money(amount)).try_cast("decimal(24,0)").cast("string")


def common_prefix_offset(low: Column, high: Column) -> Column:
    """Sum of the leading digits all amounts share, each at its place value.

    Padded to one width, amounts between ``low`` and ``high`` share exactly the digits
    those two share, so the extremes are all that has to be aggregated. The last whole
    digit is never taken off. Amounts below zero, or none above it, give 0.
    """
    top = _digits(high)
    width = F.length(top)
    bottom = F.lpad(_digits(low), width, "0")
    places = F.sequence(F.lit(1), F.greatest(width, F.lit(1)))
    differing = F.filter(places, lambda p: F.substring(top, p, F.lit(1)) != F.substring(bottom, p, F.lit(1)))
    shared = F.least(F.coalesce(F.get(differing, F.lit(0)) - 1, width), width - 1)
    kept = F.rpad(F.substring(top, F.lit(1), shared), width, "0")
    return F.when((low >= 0) & (high > 0) & (shared > 0), kept.cast("double")).otherwise(F.lit(0.0))


def amount_extent(log: DataFrame) -> DataFrame:
    """Smallest, largest and last snapshot amount, and the power of ten of the largest."""
    found = log.agg(
        F.min("sf_amount").alias("min_amount"),
        F.max("sf_amount").alias("max_amount"),
        F.max_by("sf_amount", "seq").alias("last_amount"),
    )
    magnitude = F.when(F.col("max_amount") >= 1, F.length(_digits(F.col("max_amount"))) - 1).otherwise(0)
    return found.withColumn("magnitude", magnitude)


def prefix_offset(log: DataFrame, column: str = "sf_amount") -> DataFrame:
    low, high = F.min(column), F.max(column)
    found = log.agg(low.alias("low"), high.alias("high"))
    return found.select("low", "high", common_prefix_offset(F.col("low"), F.col("high")).alias("offset"))


def trend_normalise(window: DataFrame, max_gap: float = Config.max_normalised_gap) -> DataFrame:
    """One row with the offsets both series of the trend are shown with.

    The estimate is shifted only when the shifted snapshot amounts would reach below it.
    A remaining gap above ``max_gap`` is closed: it is tested against the largest and
    corrected by the smallest estimate.
    """
    ends = window.agg(*[
        agg(c).alias(f"{name}_{short}")
        for c, short in (("sf_amount", "sf"), ("est_amount", "est"))
        for agg, name in ((F.min, "min"), (F.max, "max"))
    ])
    sf = common_prefix_offset(F.col("min_sf"), F.col("max_sf"))
    est = common_prefix_offset(F.col("min_est"), F.col("max_est"))
    staged = ends.withColumn("n0", sf).withColumn("shift_est", F.col("max_sf") - F.col("n0") < F.col("min_est"))
    staged = staged.withColumn("est_offset", F.when(F.col("shift_est"), est).otherwise(F.lit(0.0)))
    low = F.col("min_sf") - F.col("n0")
    too_far = low - (F.col("max_est") - F.col("est_offset")) > max_gap
    closing = low - (F.col("min_est") - F.col("est_offset")) - max_gap
    return staged.select(
        (F.col("n0") + F.when(too_far, closing).otherwise(F.lit(0.0))).alias("sf_offset"),
        "est_offset",
        F.coalesce(F.col("shift_est"), F.lit(False)).alias("est_shifted"),
    )


def trend_view(window: DataFrame, offsets: DataFrame) -> DataFrame:
    """Snapshot series minus their offsets, and the share of the estimate."""
    shift = offsets.select(F.struct("sf_offset", "est_offset").alias("o")).scalar()
    return window.select(
        "date",
        "nb_opty",
        (F.col("sf_amount") - shift["sf_offset"]).alias("sf_shown"),
        (F.col("est_amount") - shift["est_offset"]).alias("est_shown"),
        F.try_divide("est_amount", "sf_amount").alias("ratio"),
    )


def snapshot_trend(log: DataFrame) -> DataFrame:
    """Change of count and amount against the previous log row.

    Rows look back within their year; the first row of a year looks at the last row of the
    year before it. Only that list, one row per year, is ever ordered as a whole.
    """
    dated = log.withColumn("year", F.year("date"))
    fields = F.struct("nb_opty", "sf_amount")
    place = F.struct("date", "seq")
    ends = dated.groupBy("year").agg(F.max_by(fields, place).alias("end"))
    before = ends.select("year", F.lag("end").over(Window.orderBy("year")).alias("before"))
    within = F.lag(fields).over(Window.partitionBy("year").orderBy("date", "seq"))
    rows = dated.withColumn("within", within).join(before, "year")
    previous = F.coalesce(F.col("within"), F.col("before"))
    return rows.select(
        "date",
        "nb_opty",
        "sf_amount",
        (F.col("nb_opty") - previous["nb_opty"]).alias("nb_change"),
        (F.col("sf_amount") - previous["sf_amount"]).alias("sf_change"),
    )
