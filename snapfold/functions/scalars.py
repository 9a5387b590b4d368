"""Column helpers. All are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

import re
from datetime import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from snapfold.schema import FORECAST_LABELS, QUARTER_PATTERN, STAGE_CLOSED_WON

BLANKS = " \t\n\r\x0b\x0c"
#: ISO layouts, tried before the configured ones, and layouts with a 12-hour clock, tried after them.
ISO_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
)
HALF_DAY_FORMATS = ("M/d/yyyy h:mm a", "M/d/yyyy h:mm:ss a")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def timestamp(moment: datetime) -> Column:
    """A literal without time zone, so that comparisons do not depend on the session's zone."""
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def strip(c) -> Column:
    """Remove white space of every kind at both ends (``trim`` alone removes spaces)."""
    return F.btrim(_col(c), F.lit(BLANKS))


def clean_text(c, default: str = "") -> Column:
    return F.coalesce(strip(_col(c).cast("string")), F.lit(default))


def is_blank(c) -> Column:
    """As ``clean_text(c) == ""``, but what follows the first character that is not white space is not looked at."""
    return F.coalesce(F.ltrim(_col(c).cast("string"), F.lit(BLANKS)), F.lit("")) == ""


def not_nan(c) -> Column:
    """NaN becomes null: a single NaN would otherwise poison sums and win every max."""
    return F.when(~F.isnan(_col(c)), _col(c))


def to_number(c) -> Column:
    """Plain coercion: text that is not a number becomes null."""
    return not_nan(_col(c).try_cast("double"))


def sanitize_numeric(c, default: float | None = 0.0) -> Column:
    """Number out of formatted text: drop all but digits, point and minus, then parse. Numbers stay as they are."""
    number = F.typeof(_col(c)).rlike("^(tinyint|smallint|int|bigint|float|double|decimal)")
    kept = F.regexp_replace(_col(c).cast("string"), r"[^0-9.\-]", "")
    value = F.when(number, not_nan(_col(c).try_cast("double"))).otherwise(kept.try_cast("double"))
    return F.coalesce(value, F.lit(default).cast("double"))


def number_or(c, default: float = 0.0) -> Column:
    """Numeric column with nulls and NaN replaced."""
    return F.coalesce(not_nan(c), F.lit(default))


def is_formula(c) -> Column:
    return F.startswith(_col(c), F.lit("="))


def manual_number(c) -> Column:
    """A hand-entered number; formula text is no hand-entered value and gives null."""
    text = clean_text(c)
    return F.when(~is_formula(text), sanitize_numeric(text))


def money(c) -> Column:
    """Fixed point, so that sums do not depend on how rows are spread over tasks.

    An amount that is infinite or does not fit is null here; :func:`money_misfits` counts them.
    """
    return not_nan(_col(c).cast("double")).try_cast("decimal(24,4)")


def money_misfits(c) -> Column:
    """Number of amounts that :func:`money` cannot hold."""
    return F.count_if(not_nan(_col(c).cast("double")).isNotNull() & money(c).isNull())


def money_sum(c) -> Column:
    """Sum of a money column; an empty sum is 0, as users of spreadsheets expect."""
    return F.coalesce(F.sum(money(c)), F.lit(0)).cast("double")


def _marks(layout: str) -> list[str]:
    """Characters that every text of a date layout holds, as far as they are plain to see."""
    if set(layout) & set("[]{}#"):
        return []
    return sorted(set(re.sub(r"'[^']*'", "", layout)) & set("-/:., "))


def parse_dates(c, formats) -> Column:
    """Text in mixed layouts -> timestamp; ISO first, then the given formats; else null.

    A layout is tried where the text holds its marks: a try that fails costs far more than one that is left out.
    """
    text = strip(_col(c).cast("string"))
    tries = []
    for layout in (*ISO_FORMATS, *formats, *HALF_DAY_FORMATS):
        parsed = F.try_to_timestamp(text, F.lit(layout)).cast("timestamp_ntz")
        marked = [F.contains(text, F.lit(m)) for m in _marks(layout)]
        tries.append(F.when(reduce(Column.__and__, marked), parsed) if marked else parsed)
    return F.coalesce(*tries)


def fiscal_quarter(d) -> Column:
    """Calendar quarter as ``Q1FY25``."""
    d = _col(d)
    year = F.lpad((F.year(d) % 100).cast("string"), 2, "0")
    return F.concat(F.lit("Q"), F.quarter(d).cast("string"), F.lit("FY"), year)


def quarter_invoice(closed, old) -> Column:
    """The close date decides; without one the previous value stays."""
    return F.coalesce(fiscal_quarter(closed), clean_text(old))


def quarter_preserve(old, d) -> Column:
    """Keep a previous value that holds a quarter label, otherwise compute one."""
    old = _col(old)
    return F.when(old.rlike(QUARTER_PATTERN), old).otherwise(F.coalesce(fiscal_quarter(d), old))


def forecast_category(stage, old, win_rate) -> Column:
    """Won stage, else a valid previous label, else the bucket of the win rate."""
    labels = F.array(*[F.lit(x) for x in FORECAST_LABELS])
    old = clean_text(old)
    percent = F.replace(_col(win_rate), F.lit("%"), F.lit(""))
    rate = percent.try_cast("double")
    # Not true for null, NaN (which sorts above infinity) and the infinities themselves.
    usable = F.abs(rate) < F.lit(float("inf"))
    # Clamped before the cast: a huge rate must not overflow, a negative one means the first label.
    bucket = F.least(
        F.greatest((rate - 1) / F.lit(100 / len(FORECAST_LABELS)), F.lit(0.0)),
        F.lit(float(len(FORECAST_LABELS) - 1)),
    ).cast("int")
    return (
        F.when(F.lower(F.coalesce(_col(stage), F.lit(""))) == STAGE_CLOSED_WON, F.lit(FORECAST_LABELS[-1]))
        .when(old.isin(*FORECAST_LABELS), old)
        .when(strip(percent) == "", F.lit(""))
        .when(usable, F.element_at(labels, bucket + 1))
        .otherwise(old)
    )


def os_family(c, strip_ones: bool = True) -> Column:
    """Name of an operating system without its edition.

    Text before the first dash, without line ends. ``strip_ones`` also removes trailing
    ``1`` characters, which shortens ``Windows 11``; it is what established reports show.
    """
    text = F.coalesce(_col(c).cast("string"), F.lit(""))
    head = F.split_part(text, F.lit("-"), F.lit(1))
    head_clean = F.rtrim(F.rtrim(head, F.lit("\n1" if strip_ones else "\n")), F.lit("\r"))
    family = F.when(head != "", head_clean).otherwise(text)
    star = F.split_part(family, F.lit("*"), F.lit(1))
    star_clean = F.rtrim(F.rtrim(star, F.lit("\n")), F.lit("\r"))
    return F.when(F.contains(family, F.lit("academic")) & (star != ""), star_clean).otherwise(family)


def composite_key(*parts) -> Column:
    """Parts joined without separator; missing parts count as empty text."""
    return F.concat(*[F.coalesce(_col(p), F.lit("")) for p in parts])


def iso_week(d) -> Column:
    return F.weekofyear(_col(d))


def week_label(week) -> Column:
    """``W07`` for week 7."""
    return F.concat(F.lit("W"), F.lpad(_col(week).cast("string"), 2, "0"))


def month_name(d) -> Column:
    return F.date_format(_col(d), "MMMM")


def positive_or_null(c) -> Column:
    return F.when(_col(c) > 0, _col(c))


def is_future(created, as_of: datetime) -> Column:
    return F.coalesce(_col(created) > timestamp(as_of), F.lit(False))


def first_line(c) -> Column:
    """Text before the first line end, stripped and in lower case."""
    return F.lower(strip(F.split_part(_col(c), F.lit("\n"), F.lit(1))))


def first_line_match(c, needle: str) -> Column:
    return F.coalesce(first_line(c) == needle.strip().lower(), F.lit(False))
