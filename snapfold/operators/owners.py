"""Owner by week counters, the two-year detail table and the drill-down figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from snapfold import schema
from snapfold.config import Config
from snapfold.functions import scalars as x
from snapfold.functions.weeks import current_week
from snapfold.operators.dedup import first_per_key


def _identified() -> Column:
    """Owner and opportunity are filled and the creation date is known."""
    return ~x.is_blank("owner") & ~x.is_blank("opty") & F.col("created").isNotNull()


def _excluded(config: Config) -> Column:
    names = config.excluded_tracking_owners
    return x.clean_text("owner").isin(*names) if names else F.lit(False)


def tracked_rows(df: DataFrame, as_of: datetime, config: Config = Config()) -> DataFrame:
    """Rows that count this year: identified, not excluded, created this year and not later."""
    # A closed range on the bare column reaches the scan; year(created) alone would not.
    this_year = F.col("created").between(x.timestamp(datetime(as_of.year, 1, 1)), x.timestamp(as_of))
    return df.filter(_identified() & ~_excluded(config) & this_year)


def owner_week_counts(df: DataFrame, as_of: datetime, config: Config = Config(),
                      approximate: bool = False) -> DataFrame:
    """Distinct opportunities per owner and ISO week of creation, current calendar year."""
    rows = _owner_weeks(df, as_of, config)
    return rows.groupBy("owner", "week").agg(F.approx_count_distinct("opty").alias("n")) if approximate else count_optys(rows)


def _owner_weeks(df: DataFrame, as_of: datetime, config: Config) -> DataFrame:
    return tracked_rows(df, as_of, config).select(
        x.strip("owner").alias("owner"),
        x.iso_week("created").alias("week"),
        x.strip("opty").alias("opty"),
    )


def owner_week_counts_by_run(df: DataFrame, run: str, as_of: str, config: Config = Config()) -> DataFrame:
    """As :func:`owner_week_counts` for many runs at once; the column ``as_of`` holds the time of each."""
    created, moment = F.col("created"), F.col(as_of)
    this_year = (created <= moment) & (F.year(created) == F.year(moment))
    rows = df.filter(_identified() & ~_excluded(config) & this_year).select(
        run, x.strip("owner").alias("owner"), x.iso_week("created").alias("week"), x.strip("opty").alias("opty"))
    return rows.groupBy(run, "owner", "week").agg(F.count_distinct("opty").alias("n"))


def owner_week_optys(df: DataFrame, as_of: datetime, config: Config = Config()) -> DataFrame:
    """The (owner, week, opportunity) that count, each once."""
    return _owner_weeks(df, as_of, config).distinct()


def count_optys(rows: DataFrame) -> DataFrame:
    return rows.groupBy("owner", "week").agg(F.count_distinct("opty").alias("n"))


def owner_week_rollup_stats(df: DataFrame, as_of: datetime, config: Config = Config()) -> DataFrame:
    """How many rows were left out and why; the first reason in the order below counts."""
    reason = (
        F.when(~_identified(), "incomplete")
        .when(_excluded(config), "excluded")
        .when(F.col("created") > x.timestamp(as_of), "future")
        .when(F.year("created") != as_of.year, "old_year")
        .otherwise("counted")
    )
    return df.select(reason.alias("reason")).agg(*[
        F.count(F.when(F.col("reason") == r, 1)).alias(f"n_{r}")
        for r in ("incomplete", "excluded", "future", "old_year", "counted")
    ])


def owner_max_merge(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Counters never fall and owners never leave: the larger count per owner and week.

    Long tables need no join for this; repeated owners in the stored table merge too.
    """
    both = stored.select("owner", "week", "n").unionByName(new.select("owner", "week", "n"))
    return both.groupBy("owner", "week").agg(F.max("n").alias("n"))


def owner_count_growth(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The counters that :func:`owner_max_merge` raises or adds, with their new values."""
    known = stored.groupBy("owner", "week").agg(F.max("n").alias("known"))
    both = new.select("owner", "week", "n").join(known, ["owner", "week"], "left")
    return both.filter(F.col("known").isNull() | (F.col("n") > F.col("known"))).drop("known")


def owner_tracking_wide(counts: DataFrame) -> DataFrame:
    """Counters as ``owner, W01..W53`` with 0 where nothing was counted."""
    weeks = list(schema.WEEKS)
    wide = counts.groupBy("owner").pivot("week", weeks).agg(F.max("n"))
    return wide.select("owner", *[
        F.coalesce(F.col(f"`{w}`"), F.lit(0)).alias(f"W{w:02d}") for w in weeks
    ])


def owner_tracking_load(wide: DataFrame, order: str = "seq") -> DataFrame:
    """Stored counters up to the first row without owner, as long rows.

    The end of the table is one aggregated value, so no ordered pass over the rows is
    needed. Cells that are no numbers count 0, decimals are cut off.
    """
    end = wide.filter(x.is_blank("owner")).agg(F.min(order).alias("stop")).scalar()
    kept = wide.filter(end.isNull() | (F.col(order) < end))
    cells = F.array(*[
        F.struct(
            F.lit(int(c[1:])).alias("week"),
            F.coalesce(x.to_number(f"`{c}`").cast("long"), F.lit(0).cast("long")).alias("n"),
        )
        for c in wide.columns if c[:1] == "W" and c[1:].isdigit()
    ])
    return kept.select("owner", F.inline(cells))


def detail_week_range(as_of: datetime, config: Config = Config()) -> tuple[int, int]:
    """First and last week of the detail table; it does not reach into the year before."""
    last = current_week(as_of, config.current_week)
    return max(1, last - config.detail_weeks + 1), last


def owner_details(df: DataFrame, as_of: datetime, config: Config = Config()) -> DataFrame:
    """One row per owner, year, week and opportunity for the same weeks of two years.

    The first row of the group (by ``seq``) gives customer and price. Sorting is left to
    the sink, which writes the table in order of owner, year and week.
    """
    first_week, last_week = detail_week_range(as_of, config)
    created = F.col("created")
    # One closed range covers both years, and leaves out what lies in the future.
    in_range = created.between(x.timestamp(datetime(as_of.year - 1, 1, 1)), x.timestamp(as_of))
    in_weeks = x.iso_week(created).between(first_week, last_week)
    rows = df.filter(_identified() & ~_excluded(config) & in_range & in_weeks).select(
        x.strip("owner").alias("owner"),
        x.strip("opty").alias("opty"),
        F.year(created).alias("year"),
        x.iso_week(created).alias("week_no"),
        x.clean_text("customer").alias("customer"),
        x.positive_or_null(x.number_or("total_price")).alias("price"),
        "seq",
    )
    first = first_per_key(rows, ["owner", "year", "week_no", "opty"])
    return first.select("owner", "opty", "customer", "price", "year", x.week_label("week_no").alias("week"))


def year_counts(details: DataFrame) -> DataFrame:
    return details.groupBy("year").agg(F.count("*").alias("n_rows"))


def yoy_week_pivot(details: DataFrame, as_of: datetime) -> DataFrame:
    """Per week the counts of this and last year with their running totals."""
    years = [as_of.year, as_of.year - 1]
    per_week = details.groupBy("week").pivot("year", years).agg(F.count(F.lit(1)))
    per_year = per_week.select("week", F.inline(F.array(*[
        F.struct(F.lit(y).alias("year"), F.coalesce(F.col(f"`{y}`"), F.lit(0)).alias("n"))
        for y in years
    ])))
    # 53 rows per year at most.
    running = Window.partitionBy("year").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return per_year.withColumn("running_total", F.sum("n").over(running))


# ---------------------------------------------------------------- drill-down


def owner_week_rows(df: DataFrame, as_of: datetime, owner: str | None = None,
                    week: int | None = None) -> DataFrame:
    """Rows of the current calendar year, of one owner and ISO week when given."""
    first, last = datetime(as_of.year, 1, 1), datetime(as_of.year + 1, 1, 1)
    this_year = (F.col("created") >= x.timestamp(first)) & (F.col("created") < x.timestamp(last))  # reaches the scan
    kept = df.filter(this_year).withColumn("week", x.iso_week("created"))
    if owner is not None:
        kept = kept.filter(F.col("owner") == owner)
    if week is not None:
        kept = kept.filter(F.col("week") == week)
    return kept


def opty_group_max(df: DataFrame, by=()) -> DataFrame:
    """Per opportunity: first known owner, customer and date, largest quantity and price."""
    def first_known(c):
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)

    return df.filter(F.col("opty").isNotNull()).groupBy(*by, "opty").agg(
        *[first_known(c) for c in ("owner", "customer", "created") if c not in by],
        F.max(x.to_number("qty")).alias("qty"),
        F.max(x.to_number("total_price")).alias("total_price"),
    )


def opty_duplicate_count(df: DataFrame, by=()) -> DataFrame:
    """Rows, distinct opportunities and their difference."""
    figures = df.groupBy(*by).agg(F.count("*").alias("n_rows"), F.count_distinct("opty").alias("n_unique"))
    return figures.withColumn("n_duplicate", F.col("n_rows") - F.col("n_unique"))


def owner_week_distribution(df: DataFrame, as_of: datetime, owner: str | None = None) -> DataFrame:
    """Rows per ISO week of the current year, for one owner or for each."""
    rows = owner_week_rows(df, as_of, owner)
    return rows.groupBy("owner", "week").agg(F.count("*").alias("n_rows")).orderBy("owner", "week")


def owner_list(df: DataFrame) -> DataFrame:
    return df.select("owner").filter(F.col("owner").isNotNull()).distinct().orderBy("owner")
