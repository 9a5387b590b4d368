"""Carry-forward look-ups of opportunities in the previous tracking table."""

from __future__ import annotations

from snapfold import bindings as b
from snapfold.operators import clean, dedup, lookup
from snapfold.queries.registry import number_sql, query, strip_sql


def _pipe(spark, sf_dir, *columns):
    return clean.with_key(b.opps(spark, sf_dir, "opty", "model", "part_number", "seq", *columns))


@query(f"""SELECT o.opty, o.part_number, coalesce({strip_sql('l.next_step')}, '') AS next_step,
  coalesce({strip_sql('l.forecast')}, '') AS forecast
  FROM opps o LEFT JOIN master_last l ON o.opty || o.model = l.key""")
def carry_forward_last(spark, sf_dir):
    found = lookup.carry_forward_last(_pipe(spark, sf_dir), b.master(spark, sf_dir, "model"), ["next_step", "forecast"])
    return found.select("opty", "part_number", "next_step", "forecast")


@query(f"""SELECT o.opty, o.part_number, CASE WHEN l.key IS NULL THEN NULL
  WHEN {strip_sql('l.est_qty')} = '' OR starts_with({strip_sql('l.est_qty')}, '=') THEN nullif(f.qty, 0)
  ELSE {number_sql('l.est_qty')} END AS est_qty
  FROM opps o LEFT JOIN master_last l ON o.opty || o.model = l.key LEFT JOIN master_first f ON o.opty || o.model = f.key""")
def carry_forward_qty(spark, sf_dir):
    found = lookup.carry_forward_qty(_pipe(spark, sf_dir), b.master(spark, sf_dir, "qty"))
    return found.select("opty", "part_number", "est_qty")


@query(f"""SELECT o.opty, o.part_number, CASE WHEN coalesce(l.revenue, '') = '' THEN NULL
  WHEN starts_with(l.revenue, '=') THEN nullif(coalesce(f.total_price, 0), 0)
  ELSE nullif(CASE WHEN starts_with(f.est_qty, '=') THEN 0 ELSE {number_sql('f.est_qty')} END * f.sales_price, 0)
  END AS revenue_carried
  FROM opps o LEFT JOIN master_last l ON o.opty || o.model = l.key LEFT JOIN master_first f ON o.opty || o.model = f.key""")
def carry_forward_revenue(spark, sf_dir):
    found = lookup.carry_forward_revenue(_pipe(spark, sf_dir), b.master(spark, sf_dir, "total_price", "sales_price"))
    return found.select("opty", "part_number", "revenue_carried")


@query("""SELECT owner, opty, total_price, model, part_number FROM (SELECT *, row_number() OVER
  (PARTITION BY opty, total_price ORDER BY seq) AS rn FROM opps) WHERE rn = 1""")
def dedup_opty_price(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "owner", "opty", "total_price", "model", "part_number", "seq")
    return dedup.dedup_opty_price(rows).drop("seq")
