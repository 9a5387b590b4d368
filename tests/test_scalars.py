from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapfold.functions import scalars as x
from snapfold.schema import FORECAST_LABELS as LABELS


def one(spark, column, **values):
    types = ", ".join(f"{k} {'double' if isinstance(v, float) else 'timestamp_ntz' if isinstance(v, datetime) else 'string'}"
                      for k, v in values.items())
    frame = spark.createDataFrame([tuple(values.values())], types) if values else spark.range(1)
    return frame.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text, number", [
    ("EUR 1,234.50", 1234.5), ("1 234,56", 123456.0), ("1-2", 0.0), ("", 0.0), (None, 0.0),
    ("-5", -5.0), (".", 0.0), ("1.2.3", 0.0), ("$ .5", 0.5),
])
def test_sanitize_numeric(spark, text, number):
    assert one(spark, x.sanitize_numeric("c"), c=text) == number


@pytest.mark.parametrize("text, moment", [
    ("2025-03-31", datetime(2025, 3, 31)), ("03/31/2025", datetime(2025, 3, 31)),
    ("3/1/2025", datetime(2025, 3, 1)), (" 2025-03-31 10:20:30 ", datetime(2025, 3, 31, 10, 20, 30)),
    ("31 Mar 2025", datetime(2025, 3, 31)), ("Mar 31, 2025", datetime(2025, 3, 31)),
    ("31/31/2025", None), ("soon", None), ("", None), (None, None), ("12:30", None), ("2025-03-31T10:20:30+02:00", None),
    ("10/11/2025 3:04 PM", datetime(2025, 10, 11, 15, 4)), ("1/2/2025 12:00:05 AM", datetime(2025, 1, 2, 0, 0, 5)),
])
def test_parse_dates(spark, text, moment):
    from snapfold.config import MONTH_FIRST_FORMATS
    assert one(spark, x.parse_dates("c", MONTH_FIRST_FORMATS), c=text) == moment


def test_day_first_is_an_explicit_choice(spark):
    from snapfold.config import DAY_FIRST_FORMATS, MONTH_FIRST_FORMATS
    assert one(spark, x.parse_dates("c", MONTH_FIRST_FORMATS), c="02/03/2025") == datetime(2025, 2, 3)
    assert one(spark, x.parse_dates("c", DAY_FIRST_FORMATS), c="02/03/2025") == datetime(2025, 3, 2)


@pytest.mark.parametrize("day, label", [
    (datetime(2025, 3, 31), "Q1FY25"), (datetime(2025, 4, 1), "Q2FY25"), (datetime(2025, 12, 31), "Q4FY25"),
    (datetime(2004, 7, 1), "Q3FY04"),
])
def test_fiscal_quarter(spark, day, label):
    assert one(spark, x.fiscal_quarter("d"), d=day) == label


def test_quarter_of_no_date(spark):
    assert one(spark, x.fiscal_quarter(F.lit(None).cast("timestamp_ntz"))) is None
    assert one(spark, x.quarter_invoice(F.lit(None).cast("timestamp_ntz"), F.lit(" old "))) == "old"


@pytest.mark.parametrize("old, kept", [
    ("Q2FY25", "Q2FY25"), ("about Q2FY25", "about Q2FY25"), ("", "Q3FY24"), ("soon", "Q3FY24"), (None, "Q3FY24"),
])
def test_quarter_preserve(spark, old, kept):
    assert one(spark, x.quarter_preserve("old", F.lit(datetime(2024, 8, 1)).cast("timestamp_ntz")), old=old) == kept


@pytest.mark.parametrize("rate, index", [
    ("0%", 0), ("1%", 0), ("17%", 0), ("18%", 1), ("50%", 2), ("100%", 5), ("150%", 5), ("-90%", 0), ("1e30%", 5),
])
def test_forecast_buckets(spark, rate, index):
    assert one(spark, x.forecast_category(F.lit("Open"), F.lit(""), "r"), r=rate) == LABELS[index]


@pytest.mark.parametrize("stage, old, rate, label", [
    ("CLOSED WON", LABELS[0], "0%", LABELS[5]),
    ("Open", LABELS[3], "0%", LABELS[3]),
    ("Open", "odd", "%", ""),
    ("Open", "odd", " % ", ""),
    ("Open", "odd", "high", "odd"),
    ("Open", "odd", "nan%", "odd"),
    ("Open", "odd", "Infinity", "odd"),
    ("Open", "odd", None, "odd"),
    (None, "", "50%", LABELS[2]),
])
def test_forecast_rules(spark, stage, old, rate, label):
    assert one(spark, x.forecast_category("s", "o", "r"), s=stage, o=old, r=rate) == label


@pytest.mark.parametrize("text, family", [
    ("Windows 11-Pro", "Windows "), ("-Pro", "-Pro"), ("Chrome\n11\n", "Chrome"), ("Mac\r", "Mac"),
    ("Pro academic\n*x-1", "Pro academic"), ("*academic", "*academic"), (None, ""), ("1-2", ""),
])
def test_os_family(spark, text, family):
    assert one(spark, x.os_family("c"), c=text) == family


def test_os_family_keeping_ones(spark):
    assert one(spark, x.os_family("c", strip_ones=False), c="Windows 11-Pro") == "Windows 11"


def test_small_helpers(spark):
    assert one(spark, x.strip("c"), c=" \t a b\n\r") == "a b"
    assert one(spark, x.clean_text("c"), c=None) == ""
    assert one(spark, x.composite_key("a", "b"), a=None, b="m") == "m"
    assert one(spark, x.week_label(F.lit(7))) == "W07"
    assert one(spark, x.month_name(F.lit(datetime(2025, 5, 1)).cast("timestamp_ntz"))) == "May"
    assert one(spark, x.first_line_match("c", "quarter INVOICE "), c="Quarter Invoice\nFacturation") is True
    assert one(spark, x.first_line_match("c", "quarter"), c=None) is False
    assert one(spark, x.not_nan("d"), d=float("nan")) is None
    assert one(spark, x.positive_or_null("d"), d=-1.0) is None
    assert one(spark, x.manual_number("c"), c="=Q5*I5") is None


def test_sums_ignore_nan_and_start_at_zero(spark):
    frame = spark.createDataFrame([(1.5,), (float("nan"),), (None,)], "v double")
    assert frame.agg(x.money_sum("v").alias("s")).first()["s"] == 1.5
    assert frame.limit(0).agg(x.money_sum("v").alias("s")).first()["s"] == 0.0


def test_numbers_stay_as_they_are(spark):
    df = spark.createDataFrame([(1.6e8, -3, "1.6e8")], "d double, i int, t string")
    got = df.select(x.sanitize_numeric("d"), x.sanitize_numeric("i"), x.sanitize_numeric("t")).first()
    assert tuple(got) == (1.6e8, -3.0, 1.68)


def test_amounts_that_do_not_fit_are_counted(spark):
    df = spark.createDataFrame([(1e21,), (float("inf"),), (2.5,), (None,), (float("nan"),)], "a double")
    got = df.agg(x.money_sum("a"), x.money_misfits("a")).first()
    assert tuple(got) == (2.5, 2)
