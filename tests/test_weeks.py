from datetime import datetime, timedelta

from pyspark.sql import functions as F

from snapfold.functions import weeks as w


def test_window_wraps_at_new_year():
    assert w.week_window(datetime(2023, 1, 4)) == [51, 52, 1, 2, 3]      # after a 52-week year
    assert w.week_window(datetime(2021, 1, 6)) == [52, 53, 1, 2, 3]      # after a 53-week year
    assert w.week_window(datetime(2020, 12, 30)) == [51, 52, 53, 1, 2]
    assert w.week_window(datetime(2024, 12, 20)) == [49, 50, 51, 52, 1]


def test_override_wraps_with_the_calendar_year_of_the_run():
    assert w.week_window(datetime(2021, 5, 1), 52) == [50, 51, 52, 1, 2]
    assert w.week_window(datetime(2020, 5, 1), 52) == [50, 51, 52, 53, 1]


def test_iso_window_steps_weeks():
    assert w.week_window(datetime(2021, 1, 1), iso=True) == [51, 52, 53, 1, 2]
    assert w.week_window(datetime(2021, 1, 1)) == [51, 52, 1, 2, 3]


def test_shift():
    names = [f"Week {i}" for i in range(37, 42)]
    assert w.detect_week_shift(names, 41) == 2
    assert w.week_shift(2, 51) == 3
    assert w.week_shift(51, 2) == -3
    assert w.detect_week_shift(names[:2], 41) == 0
    assert w.detect_week_shift(["Week a", "Week b", "Week c"], 41) == 0


def test_columns_agree_with_plain_values(spark):
    days = [datetime(1999, 12, 1) + timedelta(days=i) for i in range(0, 8100)]
    frame = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
    got = frame.select("d", *[w.week_window_expr("d", o).alias(f"w{o + 2}") for o in w.WINDOW_OFFSETS]).collect()
    assert all(list(r[1:]) == w.week_window(r["d"]) for r in got)
    pairs = spark.range(1, 54).select(F.col("id").cast("int").alias("a")).crossJoin(
        spark.range(1, 54).select(F.col("id").cast("int").alias("b")))
    got = pairs.select("a", "b", w.week_shift_expr("a", "b").alias("s")).collect()
    assert all(r["s"] == w.week_shift(r["a"], r["b"]) for r in got)
