"""Row filters and column shaping of a raw snapshot."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapfold import schema
from snapfold.config import Config
from snapfold.functions import scalars as x

# ---------------------------------------------------------------- columns


def reorder_columns(df: DataFrame) -> DataFrame:
    """Move the columns at positions 10 and 11 in front of position 7."""
    c = df.columns
    return df.select(*[F.col(f"`{n}`") for n in (*c[:7], *c[10:12], *c[7:10], *c[12:])])


def rename_positional(df: DataFrame, names) -> DataFrame:
    """Give columns new names by position; the counts must agree."""
    names = list(names)
    if len(names) != len(df.columns):
        raise ValueError(f"{len(df.columns)} columns cannot take {len(names)} names")
    return df.toDF(*names)


def reindex_columns(df: DataFrame, columns, fill=None) -> DataFrame:
    """Exactly the given columns in the given order; absent ones hold ``fill``."""
    present = set(df.columns)
    return df.select(*[
        F.col(f"`{c}`") if c in present else F.lit(fill).cast("string").alias(c) for c in columns
    ])


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Drop columns without a header."""
    return df.select(*[
        F.col(f"`{c}`") for c in df.columns
        if c and c.strip() and not c.startswith("Unnamed:") and not re.fullmatch(r"_c\d+", c)
    ])


def upgrade_v1_v2(master: DataFrame, weeks: list[int]) -> DataFrame:
    """Add five empty note columns to a tracking table of the old width."""
    if len([c for c in master.columns if c != "seq"]) != schema.V1_COLUMN_COUNT:
        return master
    return master.withColumns({schema.week_column(w): F.lit("") for w in weeks})


def missing_columns(df: DataFrame, expected) -> list[str]:
    """Expected names a table lacks; answered from the schema, without a job."""
    return [c for c in expected if c not in set(df.columns)]


def required_columns(df: DataFrame, expected) -> DataFrame:
    """One row per expected column: is it there, and how many rows and values has it."""
    present = set(df.columns)
    counts = [
        (F.count(F.col(f"`{c}`")) if c in present else F.lit(0).cast("long")).alias(f"v{i}")
        for i, c in enumerate(expected)
    ]
    totals = df.agg(F.count("*").alias("rows"), *counts)
    report = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(c in present).alias("present"),
            F.col("rows").alias("n_rows"),
            F.col(f"v{i}").alias("n_values"),
        )
        for i, c in enumerate(expected)
    ]
    return totals.select(F.inline(F.array(*report)))


def require(df: DataFrame, expected) -> DataFrame:
    """Raise on an empty table, return the report otherwise."""
    if df.isEmpty():
        raise ValueError("table is empty")
    return required_columns(df, expected)


# ---------------------------------------------------------------- filters


def drop_footer_rows(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("owner"), F.lit("")).isin(*schema.FOOTER_OWNERS))


def drop_null_required(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["owner", "customer"])


def exclude_owners(df: DataFrame, owners) -> DataFrame:
    """Drop rows of the listed owners; an empty list keeps everything, and so does a row without owner.

    ``owners`` is a short list, or a table of any size with a column ``owner``, which no plan spells out: Spark joins it
    by the size it finds.
    """
    if isinstance(owners, DataFrame):
        return df.join(owners.select("owner").filter("owner is not null").distinct(), "owner", "left_anti").select(df.columns)
    owners = list(owners)
    return df.filter(~F.coalesce(F.col("owner"), F.lit("")).isin(*owners)) if owners else df


def is_generic(customer="customer") -> Column:
    prefix = F.startswith(F.col(customer), F.lit(schema.GENERIC_CUSTOMER_PREFIX))
    return F.coalesce(prefix, F.lit(False))


def drop_small_generic(df: DataFrame) -> DataFrame:
    """Placeholder customers count only with a total at or above the threshold."""
    small = F.col("total_price").isNull() | (F.col("total_price") < schema.GENERIC_MIN_TOTAL)
    return df.filter(~(is_generic() & small))


def drop_generic(df: DataFrame, customer="customer") -> DataFrame:
    return df.filter(~is_generic(customer))


def exclude_product_lines(df: DataFrame) -> DataFrame:
    """Blank product lines stay, as empty text."""
    line = F.coalesce(F.col("product_line"), F.lit(""))
    return df.withColumn("product_line", line).filter(~line.isin(*schema.EXCLUDED_PRODUCT_LINES))


def run_rate_subset(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deal_type") == schema.RUN_RATE_DEAL)


def closed_lost_subset(df: DataFrame) -> DataFrame:
    return df.filter(F.col("stage") == schema.STAGE_CLOSED_LOST)


def open_only(df: DataFrame) -> DataFrame:
    """Drop rejected and lost rows; rows without a stage stay."""
    stage = F.coalesce(F.col("stage"), F.lit(""))
    return df.filter(~stage.isin(schema.STAGE_REJECTED, schema.STAGE_CLOSED_LOST))


def with_key(df: DataFrame) -> DataFrame:
    """Blank opportunity and model become empty text; the key is both, joined."""
    blank = {c: F.coalesce(F.col(c), F.lit("")) for c in ("opty", "model")}
    return df.withColumns(blank).withColumn("key", x.composite_key("opty", "model"))


#: What may drop a row, in the order the filters of :func:`clean` look at it.
DROP_REASONS = ("footer", "incomplete", "excluded", "small_generic", "product_line")


def drop_reason(config: Config = Config()) -> Column:
    """The first filter of :func:`clean` that drops a row, null where it stays."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    excluded = text("owner").isin(*config.excluded_owners) if config.excluded_owners else F.lit(False)
    small = F.col("total_price").isNull() | (F.col("total_price") < schema.GENERIC_MIN_TOTAL)
    tests = (
        text("owner").isin(*schema.FOOTER_OWNERS),
        F.col("owner").isNull() | F.col("customer").isNull(),
        excluded,
        is_generic() & small,
        text("product_line").isin(*schema.EXCLUDED_PRODUCT_LINES),
    )
    return F.coalesce(*(F.when(test, reason) for reason, test in zip(DROP_REASONS, tests, strict=True)))


def clean(df: DataFrame, config: Config = Config(), excluded: DataFrame | None = None) -> DataFrame:
    """All row filters of the main update, then the key. ``excluded`` is a table of owners to leave out besides the short
    list of the settings."""
    steps = (
        drop_footer_rows,
        drop_null_required,
        lambda d: exclude_owners(d, config.excluded_owners),
        lambda d: d if excluded is None else exclude_owners(d, excluded),
        drop_small_generic,
        exclude_product_lines,
        with_key,
    )
    return reduce(lambda d, step: step(d), steps, df)
