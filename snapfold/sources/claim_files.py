"""Claim files: one per distributor and month, each with its own header names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.functions import scalars as x
from snapfold.operators.claims import ClaimProfile, claims_ingest
from snapfold.sources import exports
from snapfold.sources.records import read_records

# Fixed value: order of a profile's columns.
_DATE, _QUOTE, _QTY, _VALUE, _PART = range(5)


def month_glob(template: str, year: int) -> str:
    """Pattern of the twelve monthly files of a template with ``{y2}`` and ``{w2}``."""
    months = "{" + ",".join(f"{m:02d}" for m in range(1, 13)) + "}"
    return template.format(y2=f"{year % 100:02d}", w2=months)


def read_claim_files(spark: SparkSession, folder: str, template: str, year: int, profile: ClaimProfile,
                     date_formats, separator: str = ",") -> DataFrame:
    """Typed claims of one distributor under its own column names; absent months are skipped."""
    records = read_records(spark, folder, month_glob(template, year), separator)
    rows = exports.rows_below_header(records, separator=separator, header_at=profile.skip)

    def cell(name):
        place = F.array_position("header", F.lit(name)).cast("int")
        text = x.strip(F.when(place > 0, F.get("cells", place - 1)))
        return F.when(text != "", text)

    typed = {
        i: x.parse_dates(cell(c), date_formats) if i == _DATE
        else x.sanitize_numeric(cell(c), None) if i in (_QTY, _VALUE)
        else cell(c)
        for i, c in enumerate(profile.columns)
    }
    return rows.select(
        *[typed[i].alias(c) for i, c in enumerate(profile.columns)],
        F.struct("snapshot_time", "file", "line_no").alias("seq"),
    )


def load_claims(spark: SparkSession, folder: str, year: int, profiles: list[ClaimProfile], date_formats,
                separator: str = ",") -> DataFrame:
    """Claims of all distributors; a profile's ``path`` is its file template."""
    return claims_ingest([
        (p, read_claim_files(spark, folder, p.path, year, p, date_formats, separator)) for p in profiles
    ])
