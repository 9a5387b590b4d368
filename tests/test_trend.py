from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import rows
from snapfold import schema
from snapfold.config import Config
from snapfold.functions.weeks import iso_week_of
from snapfold.operators import trend


def log(spark, *pairs, start=datetime(2025, 1, 1), step=7):
    records = []
    for i, (sf, est) in enumerate(pairs):
        day = start + timedelta(days=step * i)
        records.append((day, iso_week_of(day), 10 + i, float(sf), float(est), i + 1))
    return spark.createDataFrame(records, schema.LOG_SCHEMA)


def offset(spark, *amounts):
    return trend.prefix_offset(log(spark, *[(a, 1) for a in amounts])).first()["offset"]


def test_shared_digits(spark):
    assert offset(spark, 16_234_567, 16_987_654) == 16_000_000
    assert offset(spark, 16_234_567, 26_000_000) == 0
    assert offset(spark, 123, 123) == 120
    assert offset(spark, 9_999, 10_000) == 0
    assert offset(spark, 0, 0) == 0
    assert offset(spark, -5, 10) == 0
    assert offset(spark, 7, 7) == 0


def digits_by_hand(amounts):
    """Place by place over the texts of all amounts."""
    width = len(str(max(amounts)))
    texts = [str(a).zfill(width) for a in amounts]
    total = 0
    for place in range(width - 1):
        seen = {t[place] for t in texts}
        if len(seen) > 1:
            break
        total += int(seen.pop()) * 10 ** (width - 1 - place)
    return total


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 900), min_size=1, max_size=5), st.integers(0, 10**9))
def test_shared_digits_against_texts(spark, parts, base):
    amounts = [base + p for p in parts]
    frame = spark.createDataFrame([(float(min(amounts)), float(max(amounts)))], "low double, high double")
    got = frame.select(trend.common_prefix_offset(F.col("low"), F.col("high")).alias("o")).first()["o"]
    assert got == digits_by_hand(amounts)


def test_extent(spark):
    got = trend.amount_extent(log(spark, (5, 1), (1234, 1), (60, 1))).first().asDict()
    assert got == {"min_amount": 5.0, "max_amount": 1234.0, "last_amount": 60.0, "magnitude": 3}
    assert trend.amount_extent(log(spark, (0, 1))).first()["magnitude"] == 0


def test_normalise(spark):
    near = trend.trend_normalise(log(spark, (16_200_000, 5_000_000), (16_900_000, 6_000_000))).first()
    # 900,000 < 5,000,000: the estimate is shifted too, but its digits 5 and 6 differ.
    assert (near["sf_offset"], near["est_offset"], near["est_shifted"]) == (16_000_000.0, 0.0, True)
    far = trend.trend_normalise(log(spark, (50_000_000, 1_000_000), (90_000_000, 2_000_000)), 10_000_000.0).first()
    # 50M - 2M is above the limit: 50M - 1M - 10M is taken off.
    assert (far["sf_offset"], far["est_offset"], far["est_shifted"]) == (39_000_000.0, 0.0, False)


def test_view_divides_safely(spark):
    window = log(spark, (0, 5), (10, 5))
    got = trend.trend_view(window, trend.trend_normalise(window)).orderBy("date").collect()
    assert [r["ratio"] for r in got] == [None, 0.5]


def new_row(spark, day, n):
    totals = spark.createDataFrame([(n, 1.0, 2.0)], "nb_opty long, sf_amount double, est_amount double")
    return trend.log_row(totals, day)


def test_log_upsert(spark):
    stored = log(spark, (1, 1), (2, 2))
    same = trend.log_upsert(stored, new_row(spark, datetime(2025, 1, 8, 17), 99))
    assert [(r["nb_opty"], r["seq"]) for r in same.orderBy("seq").collect()] == [(10, 1), (99, 2)]
    other = trend.log_upsert(stored, new_row(spark, datetime(2025, 3, 1), 99))
    assert [(r["nb_opty"], r["seq"]) for r in other.orderBy("seq").collect()] == [(10, 1), (11, 2), (99, 3)]
    again = trend.log_upsert(other, new_row(spark, datetime(2025, 3, 1), 99))
    assert rows(again) == rows(other)
    first = trend.log_upsert(stored.limit(0), new_row(spark, datetime(2025, 3, 1), 99))
    assert [(r["nb_opty"], r["seq"]) for r in first.collect()] == [(99, 1)]


def test_log_upsert_by_week_replaces_every_year(spark):
    stored = log(spark, (1, 1), (2, 2), step=364)
    got = trend.log_upsert(stored, new_row(spark, datetime(2025, 1, 1), 99), "wk")
    assert [r["nb_opty"] for r in got.collect()] == [99, 99]


def test_rolling(spark):
    stored = log(spark, *[(i, i) for i in range(120)])
    tail = trend.rolling_view(stored, Config(rolling_window=5))
    assert sorted(r["seq"] for r in tail.collect()) == [116, 117, 118, 119, 120]
    days = [datetime(2025, 1, 1) + timedelta(days=7 * i) for i in range(120)]
    assert trend.log_last_per_week(stored).count() == len({iso_week_of(d) for d in days})
    assert trend.log_last_per_week(stored, by_year=True).count() == len({(d.year, iso_week_of(d)) for d in days})
    by_week = trend.rolling_view(stored, Config(rolling_field="wk", rolling_window=3))
    assert sorted(r["seq"] for r in by_week.collect()) == [118, 119, 120]


def test_change_against_the_row_before(spark):
    stored = log(spark, *[(i * i, 1) for i in range(130)])
    got = trend.snapshot_trend(stored).orderBy("date").collect()
    assert [r["sf_change"] for r in got] == [None] + [float(2 * i - 1) for i in range(1, 130)]


def test_log_upsert_computes_the_new_row_once(spark):
    rows_read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        rows_read.add(1)
        return v

    main = spark.range(10).select(F.lit(2.0).alias("est_qty"), F.lit(3.0).alias("sales_price"),
                                  counted(F.col("id").cast("double")).alias("total_price"))
    stored = log(spark, (1, 1), (2, 2))
    new = trend.log_row(trend.tracking_totals(main), datetime(2025, 3, 1))
    got = trend.log_upsert(stored, new).orderBy("seq").collect()
    assert [(r["nb_opty"], r["sf_amount"], r["seq"]) for r in got][2:] == [(10, 45.0, 3)]
    assert rows_read.value == 10
    # outside its value the new row is not in the plan, so nothing depends on equal parts being found and shared
    assert "Join" not in trend.log_upsert(stored, new)._jdf.queryExecution().optimizedPlan().toString()
