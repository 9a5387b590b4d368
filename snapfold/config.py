"""Settings of one run. Everything that depends on the clock is passed separately as ``as_of``."""

from __future__ import annotations

from dataclasses import dataclass

# Date layouts tried in order after ISO text. Month comes first;
# pass DAY_FIRST_FORMATS for exports written the other way round.
MONTH_FIRST_FORMATS = ("M/d/yyyy", "M/d/yyyy H:mm:ss", "d MMM yyyy", "MMM d, yyyy")
DAY_FIRST_FORMATS = ("d/M/yyyy", "d/M/yyyy H:mm:ss", "d MMM yyyy", "MMM d, yyyy")


@dataclass(frozen=True)
class Config:
    """Knobs of the update; the defaults are those users of the tool are used to."""

    header_fallback: int = 0
    header_scan_rows: int = 30
    date_formats: tuple[str, ...] = MONTH_FIRST_FORMATS
    # A record whose number or date cannot be read is taken with an empty cell, and reported; True sets it aside.
    reject_unreadable: bool = False
    # A run stops at a file of which a larger share of records is set aside.
    max_rejected_share: float = 0.5

    excluded_owners: tuple[str, ...] = ()
    excluded_tracking_owners: tuple[str, ...] = ()
    detail_weeks: int = 13
    current_week: int | None = None

    log_key: str = "date"
    rolling_field: str = "date"
    rolling_window: int = 31
    max_normalised_gap: float = 10_000_000.0

    # False repeats the established arithmetic on week numbers, which wraps with the
    # calendar year of the run; True steps seven days at a time on the ISO calendar.
    iso_week_window: bool = False

    def __post_init__(self):
        if self.log_key not in ("date", "wk"):
            raise ValueError(f"log_key must be 'date' or 'wk', not {self.log_key!r}")
        if self.rolling_field not in ("date", "wk"):
            raise ValueError(f"rolling_field must be 'date' or 'wk', not {self.rolling_field!r}")
        if self.rolling_window < 1 or self.detail_weeks < 1:
            raise ValueError("rolling_window and detail_weeks must be at least 1")
        if not 0 <= self.max_rejected_share <= 1:
            raise ValueError("max_rejected_share must lie between 0 and 1")
        if self.current_week is not None and not 1 <= self.current_week <= 53:
            raise ValueError("current_week must lie between 1 and 53")
