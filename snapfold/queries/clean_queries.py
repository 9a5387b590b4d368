"""Filters, projections and keys over the opportunity view."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapfold import bindings as b
from snapfold import schema
from snapfold.operators import clean
from snapfold.queries.registry import _CLEAN_FILTER, query

# Owners and customers with the gaps and footer texts of a raw export.
_DIRTY = """
    SELECT * EXCLUDE (owner, customer),
      CASE l_linenumber WHEN 7 THEN 'Total' WHEN 6 THEN NULL ELSE owner END AS owner,
      CASE WHEN l_linenumber = 5 AND l_returnflag = 'R' THEN NULL ELSE customer END AS customer
    FROM opps"""


def _dirty(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "owner", "customer", "opty", "part_number", "total_price",
                  also=("l_linenumber", "l_returnflag"))
    line = F.col("l_linenumber")
    lost = (line == 5) & (F.col("l_returnflag") == "R")
    return rows.withColumns({
        "owner": F.when(line == 7, "Total").when(line != 6, F.col("owner")),
        "customer": F.when(~lost, F.col("customer")),
    }).drop("l_linenumber", "l_returnflag")


_POSITIONS = [f"p{i:02d}" for i in range(len(schema.RAW_COLUMNS))]


@query("SELECT " + ", ".join(f"{c} AS {p}" for c, p in zip(schema.SOURCE_COLUMNS, _POSITIONS)) + " FROM opps")
def reorder_columns(spark, sf_dir):
    return clean.rename_positional(clean.reorder_columns(b.raw_opps(spark, sf_dir)), _POSITIONS)


@query("SELECT opty, owner, CAST(NULL AS VARCHAR) AS sector, customer, CAST(NULL AS VARCHAR) AS iqr FROM opps")
def reindex_columns(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "owner", "opty", "customer", "stage")
    return clean.reindex_columns(rows, ["opty", "owner", "sector", "customer", "iqr"])


@query("""SELECT owner, created, closed, stage, opty, reseller, customer, qty, sales_price, total_price, model,
  part_number, account, product_line, deal_type, win_rate, est_qty, revenue, quarter_invoice, forecast, next_step,
  '' AS "Week 22", '' AS "Week 23", '' AS "Week 24", '' AS "Week 25", '' AS "Week 26" FROM master""")
def upgrade_v1_v2(spark, sf_dir):
    old = b.master(spark, sf_dir, weeks=False).drop("key")
    return clean.upgrade_v1_v2(old, [22, 23, 24, 25, 26]).drop("seq")


@query("SELECT opty, model, coalesce(opty, '') || coalesce(model, '') AS key FROM opps")
def composite_key(spark, sf_dir):
    return clean.with_key(b.opps(spark, sf_dir, "opty", "model"))


@query("""SELECT 'owner' AS column_name, true AS present, count(*) AS n_rows, count(owner) AS n_values FROM opps
  UNION ALL SELECT 'total_price', true, count(*), count(total_price) FROM opps
  UNION ALL SELECT 'product_line', true, count(*), count(product_line) FROM opps
  UNION ALL SELECT 'quote', false, count(*), 0 FROM opps""")
def required_columns(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "owner", "total_price", "product_line")
    return clean.required_columns(rows, ["owner", "total_price", "product_line", "quote"])


@query(f"""SELECT owner, customer, opty, part_number, total_price FROM ({_DIRTY}) WHERE coalesce(owner, '') NOT IN
  ('Total', 'Confidential Information - Do Not Distribute',
   'Copyright © 2000-2023 salesforce.com, inc. All rights reserved.')""")
def drop_footer_rows(spark, sf_dir):
    return clean.drop_footer_rows(_dirty(spark, sf_dir))


@query(f"""SELECT owner, customer, opty, part_number, total_price FROM ({_DIRTY})
  WHERE owner IS NOT NULL AND customer IS NOT NULL""")
def drop_null_required(spark, sf_dir):
    return clean.drop_null_required(_dirty(spark, sf_dir))


@query(f"""SELECT owner, customer, opty, part_number, total_price FROM ({_DIRTY})
  WHERE owner IS NULL OR owner NOT IN ('Supplier#000000003', 'Supplier#000000007')""")
def exclude_owners(spark, sf_dir):
    return clean.exclude_owners(_dirty(spark, sf_dir), ["Supplier#000000003", "Supplier#000000007"])


@query("""SELECT opty, customer, total_price FROM opps
  WHERE NOT (customer LIKE 'Generic%' AND (total_price IS NULL OR total_price < 50000))""")
def drop_small_generic(spark, sf_dir):
    return clean.drop_small_generic(b.opps(spark, sf_dir, "opty", "customer", "total_price"))


@query("""SELECT opty, part_number, coalesce(product_line, '') AS product_line FROM opps
  WHERE product_line IS NULL OR product_line NOT IN ('LM', 'MS', 'MR')""")
def exclude_product_lines(spark, sf_dir):
    return clean.exclude_product_lines(b.opps(spark, sf_dir, "opty", "part_number", "product_line"))


@query("SELECT opty, part_number, deal_type, stage FROM opps WHERE deal_type = 'Run Rate Deal'")
def run_rate_subset(spark, sf_dir):
    return clean.run_rate_subset(b.opps(spark, sf_dir, "opty", "part_number", "deal_type", "stage"))


@query("SELECT opty, part_number, stage FROM opps WHERE stage = 'Closed Lost'")
def closed_lost_subset(spark, sf_dir):
    return clean.closed_lost_subset(b.opps(spark, sf_dir, "opty", "part_number", "stage"))


@query("SELECT opty, part_number, stage FROM opps WHERE stage IS NULL OR stage NOT IN ('Rejected', 'Closed Lost')")
def open_opportunities(spark, sf_dir):
    return clean.open_only(b.opps(spark, sf_dir, "opty", "part_number", "stage"))


@query(f"""SELECT owner, customer, opty, model, total_price, coalesce(product_line, '') AS product_line,
  stage, opty || model AS key FROM opps WHERE {_CLEAN_FILTER}""")
def clean_snapshot(spark, sf_dir):
    rows = b.opps(spark, sf_dir, "owner", "customer", "opty", "model", "total_price", "product_line", "stage")
    return clean.clean(rows)


@query("SELECT owner, customer, opty FROM opps WHERE owner NOT IN (SELECT s_name FROM supplier WHERE s_acctbal < 3000)")
def exclude_owner_table(spark, sf_dir):
    """Owners to leave out given as a table, which grows with the data."""
    owners = b.table(spark, sf_dir, "supplier").filter("s_acctbal < 3000").select(F.col("s_name").alias("owner"))
    return clean.exclude_owners(b.opps(spark, sf_dir, "owner", "customer", "opty"), owners)
