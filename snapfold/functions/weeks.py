"""Week arithmetic, once for plain values (column names of a run) and once for columns."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapfold.functions.scalars import _col

WINDOW_OFFSETS = (-2, -1, 0, 1, 2)


def iso_week_of(moment: date | datetime) -> int:
    return moment.isocalendar()[1]


def last_iso_week(year: int) -> int:
    """28 December always lies in the last ISO week of its year."""
    return date(year, 12, 28).isocalendar()[1]


def current_week(as_of: datetime, override: int | None = None) -> int:
    return iso_week_of(as_of) if override is None else override


def week_window(as_of: datetime, override: int | None = None, iso: bool = False) -> list[int]:
    """Current week with two weeks on either side.

    By default numbers wrap at the last ISO week of the calendar year of ``as_of`` (or of
    the year before), also when the week itself is overridden. ``iso=True`` steps whole
    weeks on the ISO calendar instead, which differs around New Year of long years.
    """
    if iso and override is None:
        return [iso_week_of(as_of + timedelta(weeks=o)) for o in WINDOW_OFFSETS]
    centre = current_week(as_of, override)
    last, last_before = last_iso_week(as_of.year), last_iso_week(as_of.year - 1)
    weeks = []
    for week in (centre + o for o in WINDOW_OFFSETS):
        if week < 1:
            week += last_before
        elif week > last:
            week -= last
        weeks.append(week)
    return weeks


def week_shift(current: int, centre: int) -> int:
    """Signed distance between two week numbers, taking the short way around the year."""
    gap = current - centre
    return gap - 52 if gap > 26 else gap + 52 if gap < -26 else gap


def detect_week_shift(week_column_names: list[str], current: int) -> int:
    """Shift between the middle of five note columns and the current week."""
    if len(week_column_names) < 3:
        return 0
    label = week_column_names[2].removeprefix("Week ").strip()
    return week_shift(current, int(label)) if label.isdigit() else 0


def week_window_expr(d, offset: int) -> Column:
    """Column form of one position of :func:`week_window`."""
    d = _col(d)
    week = F.weekofyear(d) + offset

    def last_week(year):
        return F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))

    last = last_week(F.year(d))
    return (
        F.when(week < 1, week + last_week(F.year(d) - 1))
        .when(week > last, week - last)
        .otherwise(week)
    )


def week_shift_expr(current, centre) -> Column:
    gap = _col(current) - _col(centre)
    return F.when(gap > 26, gap - 52).when(gap < -26, gap + 52).otherwise(gap)
