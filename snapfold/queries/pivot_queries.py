"""Pivot filters, profiles and figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapfold import bindings as b
from snapfold import schema
from snapfold.functions import scalars as x
from snapfold.operators import pivots
from snapfold.operators.pivots import FilterGroup
from snapfold.plans import reports
from snapfold.queries.registry import forecast_sql, money_sql, quarter_sql, query

GROUP = FilterGroup("Product_Line", allowed=("NX", "NB", ""), selected=("NX",))
SETTINGS = {
    1: GROUP,
    2: FilterGroup("stage", allowed=("Negotiation", "Closed Won")),
    3: FilterGroup("deal_type", allowed=("Project",), selected=("Project", "Trial")),
    4: FilterGroup("reseller"),
    5: FilterGroup("deal_type", selected=("Run Rate Deal",)),
    7: FilterGroup("stage", selected=("Rejected",)),
}

_STATE = """CASE WHEN item = 'NX' THEN 'SHOW+check' WHEN item IN ('NB', '') THEN 'SHOW-uncheck' ELSE 'hide' END"""


@query(f"SELECT item, {_STATE} AS state FROM (SELECT DISTINCT coalesce(product_line, '') AS item FROM opps)")
def pivot_filter_states(spark, sf_dir):
    return pivots.pivot_filter_states(b.opps(spark, sf_dir, "product_line"), GROUP)


@query("SELECT opty, part_number, product_line, total_price FROM opps WHERE product_line = 'NX'")
def pivot_filter_apply(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "opty", "part_number", "product_line", "total_price")
    return pivots.pivot_filter_apply(rows, GROUP)


@query("""
  SELECT 1 AS group_no, 'Product_Line' AS field, 'applied' AS status, '' AS invalid,
    count(*) FILTER (product_line = 'NX') AS n_visible, count(*) AS n_rows FROM opps
  UNION ALL SELECT 2, 'stage', 'applied', '', count(*) FILTER (stage IN ('Negotiation', 'Closed Won')), count(*) FROM opps
  UNION ALL SELECT 3, 'deal_type', 'skipped: selection not allowed', 'Trial', 0, count(*) FROM opps
  UNION ALL SELECT 4, 'reseller', 'skipped: nothing set', '', 0, count(*) FROM opps
  UNION ALL SELECT 5, 'deal_type', 'applied', '', count(*) FILTER (deal_type = 'Run Rate Deal'), count(*) FROM opps""")
def pivot_filter_validate(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "product_line", "stage", "deal_type", "reseller")
    return pivots.pivot_filter_validate(rows, SETTINGS)


@query("""SELECT v.item, 'not in data' AS problem FROM (VALUES ('NX'), ('ZZ'), ('MR')) v(item)
  WHERE v.item NOT IN (SELECT coalesce(product_line, '') FROM opps)
  UNION ALL SELECT 'MR', 'not allowed'""")
def pivot_invalid_selection(spark, sf_dir):
    group = FilterGroup("product_line", allowed=("NX", "ZZ", "NB"), selected=("NX", "ZZ", "MR"))
    return pivots.pivot_invalid_selection(b.opps(spark, sf_dir, "product_line"), group)


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '2001-01-01')""")
def stale_members(spark, sf_dir):
    """Customers without an opportunity this year."""
    facts = b.opps(spark, sf_dir, "created", also=("o_custkey",)).filter(F.year("created") >= b.AS_OF.year)
    customers = b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    found = pivots.stale_members(customers, facts, "o_custkey")
    return found.withColumnRenamed("o_custkey", "c_custkey")


_MIXED = """CASE l_linenumber WHEN 1 THEN CAST(created AS VARCHAR) WHEN 2 THEN ' 12.5 ' WHEN 3 THEN '' ELSE opty END"""


def _profile_sql(name, expr):
    number = r"'^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
    date = r"'^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?$'"
    return f"""SELECT '{name}' AS column_name, has_blank, has_text, has_number, has_date,
        CAST(has_text AS INT) + CAST(has_number AS INT) + CAST(has_date AS INT) > 1 AS mixed,
        has_text AND (has_number OR has_date) AS semi_mixed
      FROM (SELECT bool_or(v = '') AS has_blank,
        bool_or(v <> '' AND NOT regexp_matches(v, {number}) AND NOT regexp_matches(v, {date})) AS has_text,
        bool_or(regexp_matches(v, {number})) AS has_number, bool_or(regexp_matches(v, {date})) AS has_date
        FROM (SELECT coalesce(trim(CAST({expr} AS VARCHAR)), '') AS v FROM opps))"""


@query(" UNION ALL ".join(_profile_sql(n, e) for n, e in (
    ("opty", "opty"), ("part_number", "part_number"), ("product_line", "product_line"), ("win_rate", "win_rate"),
    ("total_price", "total_price"), ("created", "created"), ("remark", _MIXED))))
def column_type_profile(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "opty", "part_number", "product_line", "win_rate", "total_price", "created",
                  also=("l_linenumber",))
    line = F.col("l_linenumber")
    remark = (F.when(line == 1, F.col("created").cast("string")).when(line == 2, " 12.5 ").when(line == 3, "")
              .otherwise(F.col("opty")))
    return pivots.column_type_profile(rows.withColumn("remark", remark).drop("l_linenumber"))


def _sum_when(column, label, alias):
    return f"""CAST(coalesce(sum(CASE WHEN {column} = '{label}' THEN CAST(total_price AS DECIMAL(24,4)) END), 0)
      AS DOUBLE) AS "{alias}\""""


_QUARTERS = pivots.quarter_labels(1995, 2001)


@query("SELECT owner, " + ",\n".join(_sum_when("q", label, label) for label in _QUARTERS) + f""",
  CAST(coalesce(sum(CASE WHEN q NOT IN ({", ".join(f"'{v}'" for v in _QUARTERS)})
    THEN CAST(total_price AS DECIMAL(24,4)) END), 0) AS DOUBLE) AS other
  FROM (SELECT owner, total_price, {quarter_sql('closed')} AS q FROM opps) GROUP BY owner""")
def sales_by_quarter(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "owner", "closed", "total_price")
    rows = rows.withColumn("quarter_invoice", x.fiscal_quarter("closed"))
    return pivots.sales_by_quarter(rows, _QUARTERS)


@query("SELECT reseller, " + ",\n".join(_sum_when("f", label, label) for label in schema.FORECAST_LABELS) + f""",
  CAST(coalesce(sum(CASE WHEN f IS NULL OR f = '' THEN CAST(total_price AS DECIMAL(24,4)) END), 0) AS DOUBLE) AS other
  FROM (SELECT reseller, total_price, {forecast_sql('stage', "''", 'win_rate')} AS f FROM opps) GROUP BY reseller""")
def sales_by_forecast(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "reseller", "stage", "win_rate", "total_price")
    rows = rows.withColumn("forecast", x.forecast_category("stage", F.lit(""), "win_rate"))
    return pivots.sales_by_forecast(rows)


@query(f"""SELECT owner, {money_sql('total_price')} AS amount, 1 AS group_no FROM opps
    WHERE product_line = 'NX' GROUP BY owner
  UNION ALL SELECT owner, {money_sql('total_price')}, 2 FROM opps
    WHERE stage IN ('Negotiation', 'Closed Won') GROUP BY owner
  UNION ALL SELECT owner, {money_sql('total_price')}, 5 FROM opps WHERE deal_type = 'Run Rate Deal' GROUP BY owner""")
def pivot_filter_job(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "owner", "product_line", "stage", "deal_type", "reseller", "total_price")
    return reports.pivot_filter_job(rows, SETTINGS)
