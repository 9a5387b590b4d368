"""Registry of queries and the common table expressions their check SQL is built from."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register ``f(spark, sf_dir)`` under its name, with the SQL that must give the same rows."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = with_tables(sql)
        return f

    return register


def same_rows_as(other: str):
    """Register ``f`` under its name, with the SQL of a query that is registered already."""

    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = ORACLES[other]
        return f

    return register


_LABELS = """CASE {i} WHEN 0 THEN 'LOST = Perdu' WHEN 1 THEN 'UNCOMMITED = Pas certain'
  WHEN 2 THEN 'UNCOMMITED UPSIDE = Certain à 50% du WIN' WHEN 3 THEN 'COMMIT AT RISK = Certain à 75% du WIN'
  WHEN 4 THEN 'COMMIT = Certain à 100% du WIN' WHEN 5 THEN 'WIN = Gagné' END"""


def label_sql(index: str) -> str:
    return _LABELS.format(i=index)


def strip_sql(c: str) -> str:
    return f"trim({c}, E' \\t\\n\\r')"


def number_sql(c: str) -> str:
    return f"coalesce(try_cast(regexp_replace({c}, '[^0-9.\\-]', '', 'g') AS DOUBLE), 0.0)"


def quarter_sql(d: str) -> str:
    return f"('Q' || quarter({d}) || 'FY' || lpad(CAST(year({d}) % 100 AS VARCHAR), 2, '0'))"


def money_sql(c: str) -> str:
    return f"CAST(coalesce(sum(CAST({c} AS DECIMAL(24,4))), 0) AS DOUBLE)"


def forecast_sql(stage: str, old: str, win_rate: str) -> str:
    rate = f"try_cast(replace({win_rate}, '%', '') AS DOUBLE)"
    bucket = f"CAST(trunc(least(greatest(({rate} - 1) / (100.0 / 6), 0), 5)) AS INT)"
    labels = ", ".join(f"'{v}'" for v in (
        "LOST = Perdu", "UNCOMMITED = Pas certain", "UNCOMMITED UPSIDE = Certain à 50% du WIN",
        "COMMIT AT RISK = Certain à 75% du WIN", "COMMIT = Certain à 100% du WIN", "WIN = Gagné"))
    return f"""CASE WHEN lower(coalesce({stage}, '')) = 'closed won' THEN 'WIN = Gagné'
      WHEN {old} IN ({labels}) THEN {old}
      WHEN trim(replace({win_rate}, '%', '')) = '' THEN ''
      WHEN {rate} IS NOT NULL THEN {label_sql(bucket)}
      ELSE {old} END"""


_MASTER_NOTES = ",\n    ".join(
    f"CASE WHEN (l_partkey + {w}) % 3 <> 0 THEN 'n' || l_linenumber || '-{w}' END AS n{w}"
    for w in (20, 21, 22, 23, 24))

_CLEAN_FILTER = """coalesce(owner, '') NOT IN ('Total', 'Confidential Information - Do Not Distribute',
      'Copyright © 2000-2023 salesforce.com, inc. All rights reserved.')
    AND owner IS NOT NULL AND customer IS NOT NULL
    AND NOT (customer LIKE 'Generic%' AND (total_price IS NULL OR total_price < 50000))
    AND coalesce(product_line, '') NOT IN ('LM', 'MS', 'MR')"""

# In dependency order; a query gets those its text names, directly or through another one.
TABLES: dict[str, str] = {
    "opps": """
    SELECT s_name AS owner, o_orderdate AS created, l_shipdate AS closed,
      CASE WHEN o_orderstatus = 'F' AND l_returnflag = 'R' THEN 'Closed Lost'
           WHEN o_orderstatus = 'F' AND l_returnflag = 'A' THEN 'Closed Won'
           WHEN o_orderstatus = 'F' AND l_returnflag = 'N' THEN 'Rejected'
           ELSE 'Negotiation' END AS stage,
      'OP' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS opty, n_name AS reseller,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'Generic ' || c_name ELSE c_name END AS customer,
      l_quantity AS qty, p_retailprice AS sales_price,
      CASE WHEN l_tax <> 0 THEN l_extendedprice END AS total_price,
      p_name AS model, CAST(p_partkey AS VARCHAR) AS part_number, c_mktsegment AS account,
      CASE p_type WHEN 'PROMO' THEN 'LM' WHEN 'SMALL' THEN 'MS' WHEN 'LARGE' THEN 'MR'
                  WHEN 'ECONOMY' THEN 'NX' WHEN 'STANDARD' THEN 'NB' END AS product_line,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'Run Rate Deal' ELSE 'Project' END AS deal_type,
      CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
           THEN CAST(CAST(round(l_discount * 1000) AS INT) AS VARCHAR) || '%' END AS win_rate,
      {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_quantity,
       'f': l_extendedprice, 'g': l_discount, 'h': l_tax, 'i': l_shipdate, 'j': l_returnflag,
       'k': l_linestatus} AS seq,
      p_name, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
      l_linestatus, l_discount, n_regionkey, c_mktsegment, p_brand, p_type
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
      JOIN part ON l_partkey = p_partkey""",
    "cleaned": f"""
    SELECT * EXCLUDE (product_line), coalesce(product_line, '') AS product_line, opty || model AS key
    FROM opps WHERE {_CLEAN_FILTER}""",
    "master": f"""
    SELECT *, opty || model AS key,
    CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '=Q5*I5' WHEN 2 THEN ' ' || (l_partkey % 50)
      ELSE 'EUR ' || (l_partkey % 7) || '.5' END AS est_qty,
    CASE (l_linenumber + l_partkey) % 3 WHEN 0 THEN '' WHEN 1 THEN '=Q5*I5' ELSE '100' END AS revenue,
    CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'soon' ELSE 'Q2FY99' END AS quarter_invoice,
    CASE WHEN l_suppkey % 8 = 6 THEN '' WHEN l_suppkey % 8 = 7 THEN 'unknown'
      ELSE {label_sql('l_suppkey % 6')} END AS forecast,
    CASE WHEN l_linenumber <> 3 THEN '  step ' || l_linenumber || E'\\n' END AS next_step,
    {_MASTER_NOTES}
    FROM opps WHERE created < TIMESTAMP '2000-07-01'""",
    "master_last": """
    SELECT * EXCLUDE (rn) FROM
      (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM master) WHERE rn = 1""",
    "master_first": """
    SELECT * EXCLUDE (rn) FROM
      (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS rn FROM master) WHERE rn = 1""",
    "notes": " UNION ALL ".join(
        f"SELECT key, opty, model, seq, {w} AS week, n{w} AS value FROM master WHERE n{w} IS NOT NULL"
        for w in (20, 21, 22, 23, 24)),
    "hist": """
    SELECT opty || model AS key, opty, model, weekofyear(closed) AS week, max(l_returnflag || l_linestatus) AS value
    FROM opps WHERE created < TIMESTAMP '2000-01-01' GROUP BY ALL""",
    "hist_new": """
    SELECT coalesce(n.key, h.key) AS key, coalesce(n.opty, h.opty) AS opty, coalesce(n.model, h.model) AS model,
      coalesce(n.week, h.week) AS week, coalesce(n.value, h.value) AS value
    FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key, week ORDER BY seq DESC) AS rn FROM notes)
          WHERE rn = 1) n
    FULL JOIN hist h ON n.key = h.key AND n.week = h.week""",
    "hist_window": """
    SELECT key, max(CASE WHEN week = 22 THEN value END) AS w22, max(CASE WHEN week = 23 THEN value END) AS w23,
      max(CASE WHEN week = 24 THEN value END) AS w24, max(CASE WHEN week = 25 THEN value END) AS w25,
      max(CASE WHEN week = 26 THEN value END) AS w26
    FROM hist_new GROUP BY key""",
    "otrack": """
    SELECT owner, weekofyear(created) AS week, count(DISTINCT opty) AS n FROM opps
    WHERE created <= TIMESTAMP '2001-03-31' AND year(created) = 2001 GROUP BY ALL
    UNION ALL SELECT 'Departed Owner', 5, 3""",
    "log": f"""
    SELECT date_trunc('month', created)::TIMESTAMP AS date, weekofyear(date_trunc('month', created)) AS wk,
      count(*) AS nb_opty, {money_sql('total_price')} AS sf_amount, {money_sql('qty * sales_price')} AS est_amount
    FROM opps GROUP BY 1, 2""",
    "raw_claims": """
    SELECT closed AS claim_date, CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE 'Q' END || l_orderkey AS quote,
      qty AS claim_qty, sales_price AS claim_val, part_number AS claim_pn,
      CASE WHEN n_regionkey IN (0, 1) THEN 'LAKE' WHEN n_regionkey IN (2, 3) THEN 'HILL'
           WHEN n_regionkey = 4 THEN 'PORT' END AS distri
    FROM opps WHERE l_returnflag = 'R'""",
    "claims": """
    SELECT *, claim_qty * claim_val AS total, monthname(claim_date) AS month FROM raw_claims
    WHERE starts_with(quote, 'Q') AND distri IS NOT NULL""",
    "claims_hist": "SELECT * FROM claims WHERE claim_date < TIMESTAMP '1999-01-01'",
    "main": f"""
    SELECT c.owner, c.created, c.closed, c.stage, c.opty, c.reseller, c.customer, c.qty, c.sales_price,
      c.total_price, c.model, c.part_number, c.account, c.product_line, c.deal_type, c.win_rate, c.seq, c.key,
      CASE WHEN l.key IS NULL THEN NULL
           WHEN {strip_sql('l.est_qty')} = '' OR starts_with({strip_sql('l.est_qty')}, '=') THEN nullif(f.qty, 0)
           ELSE {number_sql('l.est_qty')} END AS est_qty,
      {quarter_sql('c.closed')} AS quarter_invoice,
      {forecast_sql('c.stage', f"coalesce({strip_sql('l.forecast')}, '')", 'c.win_rate')} AS forecast,
      coalesce({strip_sql('l.next_step')}, '') AS next_step,
      CASE WHEN l.key IS NULL THEN '' ELSE coalesce(w.w22, '') END AS "Week 22",
      CASE WHEN l.key IS NULL THEN '' ELSE coalesce(w.w23, '') END AS "Week 23",
      CASE WHEN l.key IS NULL THEN '' ELSE coalesce(w.w24, '') END AS "Week 24",
      CASE WHEN l.key IS NULL THEN '' ELSE coalesce(w.w25, '') END AS "Week 25",
      CASE WHEN l.key IS NULL THEN '' ELSE coalesce(w.w26, '') END AS "Week 26"
    FROM cleaned c LEFT JOIN master_last l ON c.key = l.key LEFT JOIN master_first f ON c.key = f.key
      LEFT JOIN hist_window w ON c.key = w.key
    WHERE c.stage NOT IN ('Rejected', 'Closed Lost')""",
    "details": """
    SELECT owner, opty, customer, CASE WHEN total_price > 0 THEN total_price END AS price,
      year(created) AS year, 'W' || lpad(CAST(weekofyear(created) AS VARCHAR), 2, '0') AS week
    FROM (SELECT *, row_number() OVER (PARTITION BY owner, year(created), weekofyear(created), opty
                                       ORDER BY seq) AS rn
          FROM cleaned WHERE stage NOT IN ('Rejected', 'Closed Lost')
            AND year(created) IN (2000, 2001) AND created <= TIMESTAMP '2001-06-15'
            AND weekofyear(created) BETWEEN 12 AND 24)
    WHERE rn = 1""",
    "rolling": "SELECT * FROM log ORDER BY date DESC LIMIT 31",
}


def with_tables(body: str) -> str:
    """Prefix the shared tables a statement names."""
    def names_in(text):
        return {t for t in TABLES if re.search(rf"\b(?:FROM|JOIN)\s+\(?\s*{t}\b", text)}

    needed, queue = set(), names_in(body)
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue |= names_in(TABLES[name])
    parts = [f"{n} AS ({TABLES[n]})" for n in TABLES if n in needed]
    text = body.strip()
    if not parts:
        return text
    if text.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + text[5:]
    return "WITH " + ",\n".join(parts) + "\n" + text
