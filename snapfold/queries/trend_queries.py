"""Totals, snapshot log and trend."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from snapfold import bindings as b
from snapfold.operators import clean, lookup, trend
from snapfold.queries.registry import money_sql, query

# A month the log holds, and one it does not.
_STORED_MONTH = datetime(2001, 6, 1)
_NEXT_SNAPSHOT = datetime(2001, 8, 15, 10, 30)

_TOTALS = f"""SELECT count(*) AS nb_opty, {money_sql('total_price')} AS sf_amount,
  {money_sql('qty * sales_price')} AS est_amount FROM cleaned WHERE stage NOT IN ('Rejected', 'Closed Lost')"""


def _window(spark, sf_dir):
    return trend.rolling_tail(b.log(spark, sf_dir), 31)


def _totals(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "owner", "opty", "model", "customer", "qty", "sales_price", "total_price",
                  "product_line", "stage")
    return trend.tracking_totals(clean.open_only(clean.clean(rows)).withColumn("est_qty", F.col("qty")))


@query(f"""SELECT count(*) AS nb_opty, {money_sql('total_price')} AS sf_amount,
  {money_sql('est_qty * sales_price')} AS est_amount FROM main""")
def tracking_totals(spark, sf_dir):
    columns = ("owner", "opty", "model", "customer", "total_price", "sales_price", "product_line", "stage", "seq")
    rows = clean.open_only(clean.clean(b.opps(spark, sf_dir, *columns)))
    return trend.tracking_totals(lookup.carry_forward_qty(rows, b.master(spark, sf_dir, "qty")))


def _upsert_sql(key, date, wk):
    same = f"l.{key} = n.{key}"
    return f"""
      WITH n AS (SELECT TIMESTAMP '{date}' AS date, {wk} AS wk, * FROM ({_TOTALS}))
      SELECT CASE WHEN {same} THEN n.date ELSE l.date END AS date, CASE WHEN {same} THEN n.wk ELSE l.wk END AS wk,
        CASE WHEN {same} THEN n.nb_opty ELSE l.nb_opty END AS nb_opty,
        CASE WHEN {same} THEN n.sf_amount ELSE l.sf_amount END AS sf_amount,
        CASE WHEN {same} THEN n.est_amount ELSE l.est_amount END AS est_amount FROM log l, n
      UNION ALL SELECT * FROM n WHERE {key} NOT IN (SELECT {key} FROM log)"""


@query(_upsert_sql("date", "2001-06-01", 22))
def log_upsert(spark, sf_dir):
    """A day the log holds: its row is replaced."""
    new = trend.log_row(_totals(spark, sf_dir), _STORED_MONTH)
    return trend.log_upsert(b.log(spark, sf_dir), new).drop("seq")


@query(_upsert_sql("date", "2001-08-15", 33))
def log_upsert_append(spark, sf_dir):
    new = trend.log_row(_totals(spark, sf_dir), _NEXT_SNAPSHOT)
    return trend.log_upsert(b.log(spark, sf_dir), new).drop("seq")


@query(_upsert_sql("wk", "2001-06-01", 22))
def log_upsert_by_week(spark, sf_dir):
    """Week numbers carry no year: all rows of the week are replaced."""
    new = trend.log_row(_totals(spark, sf_dir), _STORED_MONTH)
    return trend.log_upsert(b.log(spark, sf_dir), new, "wk").drop("seq")


@query("""SELECT date, wk, nb_opty, sf_amount, est_amount FROM (SELECT *, row_number() OVER
  (PARTITION BY wk ORDER BY date DESC) AS rn FROM log) WHERE rn = 1""")
def log_last_per_week(spark, sf_dir):
    return trend.log_last_per_week(b.log(spark, sf_dir)).drop("seq")


@query("SELECT date, wk, nb_opty, sf_amount, est_amount FROM rolling")
def rolling_tail(spark, sf_dir):
    return _window(spark, sf_dir).drop("seq")


# Digit by digit: a place counts while every amount shows the same digit there.
_PREFIX = """(SELECT coalesce(sum(CAST(digit AS DOUBLE) * pow(10, width - place)), 0.0) FROM (
    SELECT place, width, min(digit) AS digit, bool_and(same) AS kept FROM (
      SELECT p.place, w.width, substr(lpad(CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR), CAST(w.width AS INT), '0'), p.place, 1) AS digit,
        d.n = 1 AS same
      FROM {t}, (SELECT length(CAST(CAST(floor(max({c})) AS BIGINT) AS VARCHAR)) AS width FROM {t}) w,
        (SELECT unnest(generate_series(1, 18)) AS place) p,
        LATERAL (SELECT count(DISTINCT left(lpad(CAST(CAST(floor({c}) AS BIGINT) AS VARCHAR), CAST(w.width AS INT), '0'),
          CAST(p.place AS INT))) AS n FROM {t}) d
      WHERE p.place < w.width) GROUP BY place, width) WHERE kept)"""


def prefix_sql(column, table="rolling"):
    return _PREFIX.format(c=column, t=table)


@query(f"""SELECT min(sf_amount) AS low, max(sf_amount) AS high, {prefix_sql('sf_amount')} AS "offset" FROM rolling""")
def common_prefix_offset(spark, sf_dir):
    return trend.prefix_offset(_window(spark, sf_dir))


_LOG_SHIFTED = "SELECT date, 160000000 + sf_amount / 10 AS sf_amount, est_amount FROM log"


@query(f"""WITH shifted AS ({_LOG_SHIFTED})
  SELECT min(sf_amount) AS low, max(sf_amount) AS high, {prefix_sql('sf_amount', 'shifted')} AS "offset" FROM shifted""")
def common_prefix_offset_large(spark, sf_dir):
    """Amounts that share leading digits, large enough to print with an exponent."""
    shifted = b.log(spark, sf_dir).withColumn("sf_amount", F.lit(160000000) + F.col("sf_amount") / 10)
    return trend.prefix_offset(shifted)


@query("""SELECT min(sf_amount) AS min_amount, max(sf_amount) AS max_amount, arg_max(sf_amount, date) AS last_amount,
  CAST(floor(log10(max(sf_amount))) AS INT) AS magnitude FROM rolling""")
def amount_extent(spark, sf_dir):
    return trend.amount_extent(_window(spark, sf_dir))


def _offsets_sql(table, limit):
    return f"""
    SELECT n0 + CASE WHEN (min_sf - n0) - (max_est - ne) > {limit}
        THEN (min_sf - n0) - (min_est - ne) - {limit} ELSE 0 END AS sf_offset, ne AS est_offset, flag AS est_shifted
    FROM (SELECT *, max_sf - n0 < min_est AS flag, CASE WHEN max_sf - n0 < min_est THEN e0 ELSE 0.0 END AS ne FROM (
      SELECT min(sf_amount) AS min_sf, max(sf_amount) AS max_sf, min(est_amount) AS min_est, max(est_amount) AS max_est,
        {prefix_sql('sf_amount', table)} AS n0, {prefix_sql('est_amount', table)} AS e0 FROM {table}))"""


@query(_offsets_sql("rolling", "10000000.0"))
def trend_normalise(spark, sf_dir):
    return trend.trend_normalise(_window(spark, sf_dir))


@query(f"WITH shifted AS ({_LOG_SHIFTED}) {_offsets_sql('shifted', '1000.0')}")
def trend_normalise_gap(spark, sf_dir):
    """Shared digits, and a small permitted gap that has to be closed."""
    shifted = b.log(spark, sf_dir).withColumn("sf_amount", F.lit(160000000) + F.col("sf_amount") / 10)
    return trend.trend_normalise(shifted, 1000.0)


@query(f"""SELECT date, nb_opty, round(sf_amount - sf_offset, 2) AS sf_shown, round(est_amount - est_offset, 2)
  AS est_shown, round(est_amount / nullif(sf_amount, 0), 8) AS ratio
  FROM rolling, ({_offsets_sql('rolling', '10000000.0')})""")
def trend_view(spark, sf_dir):
    window = _window(spark, sf_dir)
    shown = trend.trend_view(window, trend.trend_normalise(window))
    return shown.withColumns({
        "sf_shown": F.round("sf_shown", 2), "est_shown": F.round("est_shown", 2), "ratio": F.round("ratio", 8)})


@query("""SELECT date, nb_opty, sf_amount, nb_opty - lag(nb_opty) OVER (ORDER BY date) AS nb_change,
  round(sf_amount - lag(sf_amount) OVER (ORDER BY date), 2) AS sf_change FROM log""")
def snapshot_trend(spark, sf_dir):
    return trend.snapshot_trend(b.log(spark, sf_dir)).withColumn("sf_change", F.round("sf_change", 2))
