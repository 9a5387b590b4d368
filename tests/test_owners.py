from datetime import datetime

import pytest

from conftest import rows
from snapfold import schema
from snapfold.config import Config
from snapfold.operators import owners
from snapfold.plans import reports

NOW = datetime(2025, 6, 15, 12)
COLUMNS = "owner string, opty string, created timestamp_ntz, customer string, qty double, total_price double, seq int"


def frame(spark, *records):
    full = [(o, n, d, c, q, p, i) for i, (o, n, d, c, q, p) in enumerate(records)]
    return spark.createDataFrame(full, COLUMNS)


def row(owner="A", opty="O1", created=datetime(2025, 6, 10), customer="C", qty=1.0, price=1.0):
    return owner, opty, created, customer, qty, price


def test_counts_are_distinct_and_of_this_year(spark):
    df = frame(spark, row(), row(), row(opty=" O1 "), row(opty="O2"), row(created=datetime(2025, 6, 15, 13), opty="F"),
               row(created=datetime(2024, 6, 10), opty="P"), row(owner=" "), row(opty=None), row(created=None),
               row(owner="X"))
    for parts in (1, 5):
        got = owners.owner_week_counts(df.repartition(parts), NOW, Config(excluded_tracking_owners=("X",)))
        assert rows(got) == [("A", 24, 2)]
    assert rows(owners.owner_week_counts(df, NOW, approximate=True))[0][:2] == ("A", 24)


def test_calendar_year_is_paired_with_the_iso_week(spark):
    df = frame(spark, row(created=datetime(2000, 1, 1)))
    assert rows(owners.owner_week_counts(df, datetime(2000, 2, 1))) == [("A", 52, 1)]


def test_reasons_in_order(spark):
    df = frame(spark, row(), row(owner="X", created=datetime(2026, 1, 1)), row(created=datetime(2026, 1, 1)),
               row(created=datetime(2024, 1, 1)), row(owner=None))
    got = owners.owner_week_rollup_stats(df, NOW, Config(excluded_tracking_owners=("X",))).first().asDict()
    assert got == {"n_incomplete": 1, "n_excluded": 1, "n_future": 1, "n_old_year": 1, "n_counted": 1}


def counts(spark, *records):
    return spark.createDataFrame(list(records), schema.OWNER_WEEK_SCHEMA)


def test_counters_never_fall(spark):
    stored = counts(spark, ("A", 1, 5), ("B", 1, 2), ("GONE", 1, 3), ("A", 1, 4))
    new = counts(spark, ("A", 1, 3), ("B", 1, 4), ("NEW", 2, 1))
    merged = owners.owner_max_merge(stored, new)
    assert rows(merged) == [("A", 1, 5), ("B", 1, 4), ("GONE", 1, 3), ("NEW", 2, 1)]
    assert rows(owners.owner_max_merge(merged, new)) == rows(merged)


def test_tracking_load_stops_at_a_blank_owner(spark):
    wide = spark.createDataFrame([("A", "3.9", None, 1), ("B", "x", "-2.5", 2), (" ", "9", "9", 3), ("C", "9", "9", 4)],
                                 "owner string, W01 string, W02 string, seq int")
    assert rows(owners.owner_tracking_load(wide)) == [("A", 1, 3), ("A", 2, 0), ("B", 1, 0), ("B", 2, -2)]
    assert len(rows(owners.owner_tracking_load(wide.filter("seq <> 3")))) == 6
    back = owners.owner_tracking_wide(counts(spark, ("A", 53, 7)))
    assert back.columns[0] == "owner" and len(back.columns) == 54 and back.first()["W53"] == 7 and back.first()["W01"] == 0


def test_details(spark):
    assert owners.detail_week_range(datetime(2025, 1, 15)) == (1, 3)
    assert owners.detail_week_range(NOW) == (12, 24)
    df = frame(spark, row(price=None), row(price=9.0), row(opty="O2", price=-1.0), row(created=datetime(2024, 6, 12)),
               row(created=datetime(2025, 1, 2), opty="early"), row(created=datetime(2025, 6, 16), opty="future"),
               row(created=datetime(2023, 6, 12), opty="old"))
    expected = [("A", "O1", "C", None, 2024, "W24"), ("A", "O1", "C", None, 2025, "W24"), ("A", "O2", "C", None, 2025, "W24")]
    got = owners.owner_details(df, NOW)
    assert [(r[0], r[1], r[2], r[4], r[5]) for r in rows(got)] == sorted((r[0], r[1], r[2], r[4], r[5]) for r in expected)
    prices = {(r["opty"], r["year"]): r["price"] for r in got.collect()}
    assert prices == {("O1", 2025): None, ("O1", 2024): 1.0, ("O2", 2025): None}
    assert rows(owners.year_counts(got)) == [(2024, 1), (2025, 2)]
    assert rows(owners.yoy_week_pivot(got, NOW)) == [("W24", 2024, 1, 1), ("W24", 2025, 2, 2)]


def test_opportunities_fold_to_their_largest_values(spark):
    df = frame(spark, row(owner=None, customer=None, qty=1.0, price=10.0), row(owner="first", qty=3.0, price=5.0),
               row(owner="second"), row(opty=None))
    got = owners.opty_group_max(df).collect()
    assert len(got) == 1
    assert (got[0]["owner"], got[0]["customer"], got[0]["qty"], got[0]["total_price"]) == ("first", "C", 3.0, 10.0)
    assert owners.opty_duplicate_count(df).first().asDict() == {"n_rows": 4, "n_unique": 1, "n_duplicate": 3}


def test_drill_down(spark):
    df = frame(spark, row(), row(created=datetime(2025, 6, 14), opty="O2"), row(created=datetime(2025, 12, 1), opty="F"),
               row(owner="B"), row(created=datetime(2024, 6, 10)))
    parts = reports.drill_down(df, NOW, "A", 24)
    assert sorted(r["opty"] for r in parts["opportunities"].collect()) == ["O1", "O2"]
    assert [tuple(r) for r in parts["distribution"].collect()] == [("A", 24, 2), ("A", 49, 1)]
    assert [r[0] for r in parts["owners"].collect()] == ["A", "B"]
    everything = reports.owner_week_report(df, NOW)
    assert {r["opty"]: r["is_future"] for r in everything.collect()}["F"] is True


@pytest.mark.parametrize("partitions", [1, 7])
def test_result_does_not_depend_on_partitions(spark, partitions):
    df = frame(spark, *[row(opty=f"O{i % 7}", price=float(i)) for i in range(40)]).repartition(partitions)
    prices = {r["opty"]: r["price"] for r in owners.owner_details(df, NOW).collect()}
    assert prices == {"O0": None, **{f"O{i}": float(i) for i in range(1, 7)}}
