"""Owner counters, details and drill-down figures."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from snapfold import bindings as b
from snapfold.config import Config
from snapfold.operators import clean, owners
from snapfold.plans import reports
from snapfold.queries.registry import query

_EXCLUDED = ("Supplier#000000003", "Supplier#000000007")
_COUNT_COLUMNS = ("owner", "created", "opty", "customer", "total_price", "product_line", "stage", "model")


def _open_rows(spark, sf_dir, *extra):
    return clean.open_only(clean.clean(b.opps(spark, sf_dir, *_COUNT_COLUMNS, *extra)))


def _counts_sql(year, as_of):
    return f"""SELECT owner, weekofyear(created) AS week, count(DISTINCT opty) AS n FROM cleaned
      WHERE stage NOT IN ('Rejected', 'Closed Lost') AND created <= TIMESTAMP '{as_of}' AND year(created) = {year}
      GROUP BY ALL"""


@query(_counts_sql(2001, "2001-06-15"))
def owner_week_counts(spark, sf_dir):
    return owners.owner_week_counts(_open_rows(spark, sf_dir), b.AS_OF)


@query(_counts_sql(2000, "2000-06-15"))
def owner_week_counts_new_year(spark, sf_dir):
    """A year whose first days lie in week 52 of the year before."""
    return owners.owner_week_counts(_open_rows(spark, sf_dir), b.AS_OF_NEW_YEAR)


@query("""SELECT count(*) FILTER (opty IS NULL) AS n_incomplete,
  count(*) FILTER (owner IN ('Supplier#000000003', 'Supplier#000000007')) AS n_excluded,
  count(*) FILTER (owner NOT IN ('Supplier#000000003', 'Supplier#000000007') AND created > TIMESTAMP '2001-06-15')
    AS n_future,
  count(*) FILTER (owner NOT IN ('Supplier#000000003', 'Supplier#000000007') AND year(created) < 2001) AS n_old_year,
  count(*) FILTER (owner NOT IN ('Supplier#000000003', 'Supplier#000000007') AND year(created) = 2001
    AND created <= TIMESTAMP '2001-06-15') AS n_counted FROM opps""")
def owner_week_rollup_stats(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "owner", "created", "opty")
    return owners.owner_week_rollup_stats(rows, b.AS_OF, Config(excluded_tracking_owners=_EXCLUDED))


@query(f"""SELECT coalesce(o.owner, c.owner) AS owner, coalesce(o.week, c.week) AS week,
  greatest(coalesce(o.n, 0), coalesce(c.n, 0)) AS n
  FROM otrack o FULL JOIN ({_counts_sql(2001, "2001-06-15")}) c ON o.owner = c.owner AND o.week = c.week""")
def owner_max_merge(spark, sf_dir):
    new = owners.owner_week_counts(_open_rows(spark, sf_dir), b.AS_OF)
    return owners.owner_max_merge(b.stored_counts(spark, sf_dir), new)


_WEEKS = ", ".join(f'coalesce(max(CASE WHEN week = {w} THEN n END), 0) AS "W{w:02d}"' for w in range(1, 54))


@query(f"SELECT owner, {_WEEKS} FROM otrack GROUP BY owner")
def owner_tracking_wide(spark, sf_dir):
    return owners.owner_tracking_wide(b.stored_counts(spark, sf_dir))


@query("""
  WITH stored AS (SELECT o_orderkey, CASE WHEN o_orderkey >= (SELECT max(o_orderkey) * 0.9 FROM orders)
      AND o_orderstatus = 'P' THEN '  ' ELSE o_orderpriority END AS owner,
      CASE o_orderstatus WHEN 'F' THEN CAST(o_custkey AS VARCHAR) || '.7' WHEN 'O' THEN '-' || o_custkey || '.2'
        ELSE 'none' END AS w1, CAST(o_custkey AS VARCHAR) AS w2 FROM orders),
  kept AS (SELECT * FROM stored WHERE o_orderkey < (SELECT min(o_orderkey) FROM stored WHERE trim(owner) = ''))
  SELECT owner, 1 AS week, coalesce(CAST(trunc(try_cast(w1 AS DOUBLE)) AS BIGINT), 0) AS n FROM kept
  UNION ALL SELECT owner, 2, coalesce(CAST(trunc(try_cast(w2 AS DOUBLE)) AS BIGINT), 0) FROM kept""")
def owner_tracking_load(spark, sf_dir):
    """Stored counters written from orders, with a blank owner near the end of the table."""
    orders = b.table(spark, sf_dir, "orders")
    late = orders.agg(F.max("o_orderkey") * 0.9).scalar()
    key = F.col("o_custkey").cast("string")
    stored = orders.select(
        F.col("o_orderkey").alias("seq"),
        F.when((F.col("o_orderkey") >= late) & (F.col("o_orderstatus") == "P"), "  ")
        .otherwise(F.col("o_orderpriority")).alias("owner"),
        F.when(F.col("o_orderstatus") == "F", F.concat(key, F.lit(".7")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("-"), key, F.lit(".2")))
        .otherwise("none").alias("W01"),
        key.alias("W02"),
    )
    return owners.owner_tracking_load(stored)


@query("SELECT owner, opty, customer, price, year, week FROM details")
def owner_details(spark, sf_dir):
    return owners.owner_details(_open_rows(spark, sf_dir, "seq"), b.AS_OF)


@query("SELECT year, count(*) AS n_rows FROM details GROUP BY year")
def year_counts(spark, sf_dir):
    return owners.year_counts(owners.owner_details(_open_rows(spark, sf_dir, "seq"), b.AS_OF))


@query("""
  WITH grid AS (SELECT DISTINCT d.week, y.year FROM details d, (VALUES (2000), (2001)) y(year)),
  counted AS (SELECT g.week, g.year, count(d.opty) AS n FROM grid g
    LEFT JOIN details d ON d.week = g.week AND d.year = g.year GROUP BY ALL)
  SELECT week, year, n, CAST(sum(n) OVER (PARTITION BY year ORDER BY week) AS BIGINT) AS running_total FROM counted""")
def yoy_week_pivot(spark, sf_dir):
    return owners.yoy_week_pivot(owners.owner_details(_open_rows(spark, sf_dir, "seq"), b.AS_OF), b.AS_OF)


# ---------------------------------------------------------------- drill-down


@query("""SELECT owner, opty, created, weekofyear(created) AS week FROM opps
  WHERE year(created) = 2001 AND weekofyear(created) = 10""")
def owner_week_rows(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "owner", "opty", "created")
    return owners.owner_week_rows(rows, b.AS_OF, week=10)



@query("""SELECT opty, arg_min(owner, seq) AS owner, arg_min(customer, seq) AS customer,
  arg_min(created, seq) AS created, max(qty) AS qty, max(total_price) AS total_price FROM opps GROUP BY opty""")
def opty_group_max(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "opty", "owner", "customer", "created", "qty", "total_price", "seq")
    return owners.opty_group_max(rows)


@query("""SELECT owner, count(*) AS n_rows, count(DISTINCT opty) AS n_unique,
  count(*) - count(DISTINCT opty) AS n_duplicate FROM opps GROUP BY owner""")
def opty_duplicate_count(spark, sf_dir):
    return owners.opty_duplicate_count(b.opps(spark, sf_dir, "owner", "opty"), ["owner"])


@query("""SELECT owner, weekofyear(created) AS week, count(*) AS n_rows FROM opps WHERE year(created) = 2001
  GROUP BY ALL""")
def owner_week_distribution(spark, sf_dir):
    return owners.owner_week_distribution(b.opps(spark, sf_dir, "owner", "created"), b.AS_OF)


@query("SELECT DISTINCT owner FROM opps")
def owner_list(spark, sf_dir):
    return owners.owner_list(b.opps(spark, sf_dir, "owner"))


@query("""SELECT owner, weekofyear(created) AS week, opty, arg_min(customer, seq) AS customer,
  arg_min(created, seq) AS created, max(qty) AS qty, max(total_price) AS total_price,
  arg_min(created, seq) > TIMESTAMP '2001-06-15' AS is_future
  FROM opps WHERE year(created) = 2001 GROUP BY 1, 2, 3""")
def owner_week_report(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "opty", "owner", "customer", "created", "qty", "total_price", "seq")
    return reports.owner_week_report(rows, b.AS_OF)


@query("""SELECT owner, opty, customer, price, year, week FROM (
  SELECT owner, opty, customer, CASE WHEN total_price > 0 THEN total_price END AS price, year(created) AS year,
    'W' || lpad(CAST(weekofyear(created) AS VARCHAR), 2, '0') AS week,
    row_number() OVER (PARTITION BY owner, year(created), weekofyear(created), opty ORDER BY seq) AS rn
  FROM cleaned WHERE stage NOT IN ('Rejected', 'Closed Lost') AND year(created) IN (1999, 2000)
    AND created <= TIMESTAMP '2000-01-20' AND weekofyear(created) BETWEEN 1 AND 3) WHERE rn = 1""")
def owner_details_january(spark, sf_dir):
    """A run in week 3: the window does not reach into the year before."""
    return owners.owner_details(_open_rows(spark, sf_dir, "seq"), datetime(2000, 1, 20))
