"""The CRM tables, derived from a star schema of orders.

Every table of this module is a lazy DataFrame over the given parquet files. The opportunity
view joins only the dimensions the requested columns need: each line item has exactly one
order, customer, supplier, nation and part, so leaving one of them out loses no row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold import schema
from snapfold.functions import scalars as x
from snapfold.operators import clean, owners
from snapfold.operators.claims import ClaimProfile

AS_OF = datetime(2001, 6, 15)
AS_OF_NEW_YEAR = datetime(2000, 6, 15)
AS_OF_STORED = datetime(2001, 3, 31)
MASTER_BEFORE = datetime(2000, 7, 1)
HISTORY_BEFORE = datetime(2000, 1, 1)
CLAIM_HISTORY_BEFORE = datetime(1999, 1, 1)
MASTER_WEEKS = [20, 21, 22, 23, 24]

SEQ_FIELDS = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus",
)


# Layout of the given tables; a declared schema spares reading file footers to find it.
_LAYOUTS = {
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_LAYOUTS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


# Column -> (expression, dimensions it needs)
_OPPS = {
    "owner": ("s_name", ("supplier",)),
    "created": ("o_orderdate", ("orders",)),
    "closed": ("l_shipdate", ()),
    "stage": (
        """CASE WHEN o_orderstatus = 'F' AND l_returnflag = 'R' THEN 'Closed Lost'
                WHEN o_orderstatus = 'F' AND l_returnflag = 'A' THEN 'Closed Won'
                WHEN o_orderstatus = 'F' AND l_returnflag = 'N' THEN 'Rejected'
                ELSE 'Negotiation' END""",
        ("orders",),
    ),
    "opty": ("concat('OP', lpad(string(l_orderkey), 10, '0'))", ()),
    "reseller": ("n_name", ("supplier", "nation")),
    "customer": ("if(c_mktsegment = 'BUILDING', concat('Generic ', c_name), c_name)", ("orders", "customer")),
    "qty": ("l_quantity", ()),
    "sales_price": ("p_retailprice", ("part",)),
    "total_price": ("CASE WHEN l_tax <> 0 THEN l_extendedprice END", ()),
    "model": ("p_name", ("part",)),
    "part_number": ("string(l_partkey)", ()),
    "account": ("c_mktsegment", ("orders", "customer")),
    "product_line": (
        """CASE p_type WHEN 'PROMO' THEN 'LM' WHEN 'SMALL' THEN 'MS' WHEN 'LARGE' THEN 'MR'
                WHEN 'ECONOMY' THEN 'NX' WHEN 'STANDARD' THEN 'NB' END""",
        ("part",),
    ),
    "deal_type": ("if(o_orderpriority = '1-URGENT', 'Run Rate Deal', 'Project')", ("orders",)),
    "win_rate": (
        """CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'
                THEN concat(string(int(round(l_discount * 1000))), '%') END""",
        ("orders",),
    ),
    "seq": (f"struct({', '.join(SEQ_FIELDS)})", ()),
}

# Arms of the star: the dimension that meets the line items, and one that extends it.
_ARMS = (
    ("orders", "l_orderkey = o_orderkey", "customer", "o_custkey = c_custkey"),
    ("supplier", "l_suppkey = s_suppkey", "nation", "s_nationkey = n_nationkey"),
    ("part", "l_partkey = p_partkey", None, None),
)

OPPS_COLUMNS = (*schema.SOURCE_COLUMNS, "seq")


def opps(spark: SparkSession, sf_dir: str, *columns: str, also: tuple[str, ...] = ()) -> DataFrame:
    """The opportunity view, restricted to ``columns``; ``also`` adds base-table columns."""
    wanted = columns or OPPS_COLUMNS
    needed = {d for c in wanted for d in _OPPS[c][1]}
    prefixes = {"o": "orders", "c": "customer", "s": "supplier", "n": "nation", "p": "part"}
    needed |= {prefixes[c[0]] for c in also if c[0] in prefixes}
    needed |= {"orders"} if "customer" in needed else set()
    needed |= {"supplier"} if "nation" in needed else set()
    rows = lineitem(spark, sf_dir)
    for name, link, outer, outer_link in _ARMS:
        if name in needed:
            arm = table(spark, sf_dir, name)
            if outer in needed:
                # The arm is completed first: the line items are not shuffled by nation or customer.
                arm = arm.join(table(spark, sf_dir, outer), F.expr(outer_link))
            rows = rows.join(arm, F.expr(link))
    return rows.selectExpr(*[f"{_OPPS[c][0]} AS {c}" for c in wanted], *also)


def raw_opps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunities in the column order of a raw export."""
    return opps(spark, sf_dir, *schema.RAW_COLUMNS)


def cleaned(spark: SparkSession, sf_dir: str, config=None) -> DataFrame:
    return clean.clean(opps(spark, sf_dir), *([config] if config else []))


# Hand-entered columns of the previous tracking table.
_MANUAL = {
    "est_qty": """CASE l_linenumber % 4 WHEN 0 THEN '' WHEN 1 THEN '=Q5*I5'
        WHEN 2 THEN concat(' ', l_partkey % 50) ELSE concat('EUR ', l_partkey % 7, '.5') END""",
    "revenue": "CASE (l_linenumber + l_partkey) % 3 WHEN 0 THEN '' WHEN 1 THEN '=Q5*I5' ELSE '100' END",
    "quarter_invoice": "CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'soon' ELSE 'Q2FY99' END",
    "forecast": f"""CASE l_suppkey % 8 WHEN 6 THEN '' WHEN 7 THEN 'unknown'
        ELSE element_at(array({', '.join(f"'{v}'" for v in schema.FORECAST_LABELS)}), int(l_suppkey % 6 + 1)) END""",
    "next_step": "CASE WHEN l_linenumber <> 3 THEN concat('  step ', l_linenumber, '\\n') END",
}


def _note(week: int) -> str:
    return f"CASE WHEN (l_partkey + {week}) % 3 <> 0 THEN concat('n', l_linenumber, '-{week}') END"


def master(spark: SparkSession, sf_dir: str, *columns: str, weeks: bool = True) -> DataFrame:
    """Previous tracking table: earlier opportunities with hand-entered columns.

    ``columns`` restricts the source columns beside opportunity, model, date and order.
    """
    wanted = tuple(dict.fromkeys(("opty", "model", "created", "seq", *columns))) if columns else OPPS_COLUMNS
    rows = opps(spark, sf_dir, *wanted, also=("l_linenumber", "l_partkey", "l_suppkey"))
    notes = {schema.week_column(w): _note(w) for w in MASTER_WEEKS} if weeks else {}
    earlier = rows.filter(F.col("created") < x.timestamp(MASTER_BEFORE)).selectExpr(
        *wanted, *[f"{e} AS `{c}`" for c, e in {**_MANUAL, **notes}.items()]
    )
    return clean.with_key(earlier)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored week archive, long form."""
    rows = opps(spark, sf_dir, "opty", "model", "created", "closed", also=("l_returnflag", "l_linestatus"))
    early = rows.filter(F.col("created") < x.timestamp(HISTORY_BEFORE))
    cells = early.select(
        x.composite_key("opty", "model").alias("key"), "opty", "model", x.iso_week("closed").alias("week"),
        F.concat("l_returnflag", "l_linestatus").alias("value"),
    )
    # dealt out by key once, which serves what is grouped, joined or written by key afterwards too
    return cells.repartition("key").groupBy("key", "opty", "model", "week").agg(F.max("value").alias("value"))


def stored_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner counters of an earlier run, and an owner who has left since."""
    rows = opps(spark, sf_dir, "owner", "created", "opty")
    counts = owners.owner_week_counts(rows, AS_OF_STORED)
    gone = spark.sql("SELECT 'Departed Owner' AS owner, 5 AS week, 3L AS n")
    return counts.unionByName(gone)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot log: one row per month of orders."""
    rows = opps(spark, sf_dir, "created", "total_price", "qty", "sales_price")
    month = F.date_trunc("month", "created").cast("timestamp_ntz")
    return rows.groupBy(month.alias("date")).agg(
        F.count("*").alias("nb_opty"),
        x.money_sum("total_price").alias("sf_amount"),
        x.money_sum(F.col("qty") * F.col("sales_price")).alias("est_amount"),
    ).select(
        "date", x.iso_week("date").alias("wk"), "nb_opty", "sf_amount", "est_amount",
        (F.year("date") * 12 + F.month("date")).cast("long").alias("seq"),
    )


# ---------------------------------------------------------------- claims

CLAIM_PROFILES = {
    "LAKE": (ClaimProfile("LAKE", ("day", "deal", "pieces", "rebate", "item")), (0, 1)),
    "HILL": (ClaimProfile("HILL", ("Shipped on", "Offer", "Units", "Credit each", "Article code")), (2, 3)),
    "PORT": (ClaimProfile("PORT", ("booked_at", "reference", "n", "unit_credit", "sku")), (4,)),
}


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned line items as claims; every seventh order lacks the leading letter."""
    rows = opps(spark, sf_dir, "closed", "qty", "sales_price", "part_number", "seq",
                also=("l_orderkey", "l_returnflag", "n_regionkey"))
    order = F.col("l_orderkey")
    prefix = F.when(order % 7 == 0, "").otherwise("Q")
    return rows.filter(F.col("l_returnflag") == "R").select(
        F.col("closed").alias("claim_date"),
        F.concat(prefix, order.cast("string")).alias("quote"),
        F.col("qty").alias("claim_qty"),
        F.col("sales_price").alias("claim_val"),
        F.col("part_number").alias("claim_pn"),
        "seq",
        "n_regionkey",
    )


def claim_sources(spark: SparkSession, sf_dir: str) -> list[tuple[ClaimProfile, DataFrame]]:
    """The claims of each distributor under that distributor's own column names."""
    rows = raw_claims(spark, sf_dir)
    return [
        (profile, rows.filter(F.col("n_regionkey").isin(*regions)).drop("n_regionkey").toDF(*profile.columns, "seq"))
        for profile, regions in CLAIM_PROFILES.values()
    ]


# ---------------------------------------------------------------- end-user follow-up


def os_text() -> Column:
    return F.expr("""CASE l_partkey % 7 WHEN 0 THEN concat('Windows 11-', p_brand) WHEN 1 THEN concat('-', p_brand)
        WHEN 2 THEN concat('Chrome OS\\n11\\n-', p_type) WHEN 3 THEN concat('Win Pro academic\\n*', p_brand)
        WHEN 4 THEN concat('*academic ', p_brand) WHEN 5 THEN concat(p_name, ' OS\\r') END""")


def enduser_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End-user export with 20 columns, and ``seq``."""
    rows = opps(spark, sf_dir, *OPPS_COLUMNS, also=(
        "l_orderkey", "l_partkey", "l_returnflag", "c_mktsegment", "p_brand", "p_type", "p_name"))
    return rows.withColumn("operating_system", os_text()).selectExpr(
        "opty", "concat('Q', l_orderkey) AS quote", "c_mktsegment AS sector", "operating_system AS os", "owner",
        "win_rate", "product_line AS bu", "created", "closed", "stage AS status", "customer",
        "reseller", "account AS distributor", "model", "qty AS volume", "part_number",
        "sales_price AS dealer_price", "total_price AS revenue",
        "CASE WHEN l_returnflag = 'R' THEN 'returned' END AS close_reason",
        "l_returnflag AS close_description", "seq",
    )


def followup_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous follow-up table: earlier opportunities with hand-entered columns."""
    rows = opps(spark, sf_dir, "opty", "part_number", "created", "seq", also=("l_linenumber", "l_suppkey"))
    manual = [
        f"CASE WHEN l_suppkey % {i + 2} <> 0 THEN concat('{c} ', l_linenumber) END AS {c}"
        for i, c in enumerate(schema.FOLLOWUP_MANUAL)
    ]
    period = "CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'soon' ELSE 'about Q2FY99' END"
    early = rows.filter(F.col("created") < x.timestamp(MASTER_BEFORE))
    return early.selectExpr(
        "opty", "part_number", "seq", *manual, f"{period} AS created_period", f"{period} AS invoice_period"
    )


# ---------------------------------------------------------------- text exports


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exports as lines of cells: each supplier is a file.

    A file starts with ``suppkey % 16`` lines of notices, then a header in one of two
    languages (none where there would be 15 notices), its opportunities, and a footer (none in every third file).
    """
    file = F.concat(F.lit("export-"), F.col("s_suppkey").cast("string"))
    notices = (F.col("s_suppkey") % 16).cast("int")
    labels = {k: F.array(*[F.lit(v) for v in (" " + schema.HEADER_LABELS[k][0], *schema.HEADER_LABELS[k][1:])])
              for k in schema.HEADER_LABELS}
    header = F.when(F.col("s_suppkey") % 2 == 0, labels["English"]).otherwise(labels["French"])
    suppliers = table(spark, sf_dir, "supplier")
    top = suppliers.select(file.alias("file"), F.explode(F.sequence(F.lit(1), notices + 1)).alias("line_no"),
                           notices.alias("notices"), header.alias("header"))
    top = top.select(
        "file",
        F.col("line_no").cast("long").alias("line_no"),
        F.when((F.col("line_no") > F.col("notices")) & (F.col("notices") != 15), F.col("header"))
        .otherwise(F.array(F.lit("Warning"), F.lit("Stage"), F.lit("first 15,000 rows"))).alias("cells"),
    )
    footer = suppliers.filter(F.col("s_suppkey") % 3 != 0).select(
        file.alias("file"), F.lit(1 << 60).alias("line_no"),
        F.array(F.lit(f" {schema.FOOTER_OWNERS[0]} "), F.lit("")).alias("cells"))
    line = lineitem(spark, sf_dir)
    body = line.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(
        file.alias("file"),
        (F.lit(100) + F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long").alias("line_no"),
        F.array("s_name", F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"),
                "l_returnflag").alias("cells"),
    )
    return top.unionByName(body).unionByName(footer)


def text_exports(spark: SparkSession, sf_dir: str, folder: str, compression: str = "gzip") -> str:
    """:func:`raw_lines` written as text, one file per supplier, with 60 columns and a line break in every note.

    Packed files take a small part of the disk that plain ones take; only plain ones (``none``) are read in splits.
    """
    text_lines(spark, sf_dir).write.option("compression", compression).partitionBy("file").text(folder)
    return folder


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of :func:`text_exports` as ``(file, value)``, those of a file in order."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    wide = F.lit(",".join(f'"Extra {k}"' for k in range(55)))
    is_header = F.array_contains(F.transform("cells", lambda c: x.strip(c)), F.lit(schema.HEADER_LABELS["English"][1])) | (
        F.array_contains("cells", F.lit(schema.HEADER_LABELS["French"][1])))
    note = F.concat(F.lit('a "note",\n'), F.col("line_no").cast("string"))
    # only the narrow cells are dealt out and sorted; a line gets its wide text where it is written
    placed = raw_lines(spark, sf_dir).repartition("file").sortWithinPartitions("file", "line_no")
    cells = F.transform("cells", quote)
    value = F.when(is_header, F.concat(cells, F.array(wide, quote(F.lit("Note"))))).when(
        F.col("line_no").between(100, (1 << 60) - 1), F.concat(cells, F.array(wide, quote(note)))).otherwise(cells)
    return placed.select("file", F.array_join(value, ",").alias("value"))


# The sixteen labels of a full export, by position of its columns.
EXPORT_LABELS = (
    *schema.HEADER_LABELS["English"], "Opportunity Number", "Indirect Account", "End Customer", "Estimated Total Price",
    "Sales Model Name", "Part Number", "Estimated Quantity", "Sales Price", "Account Name", "Product Line", "Deal Type",
    "Win Rate",
)


def opportunity_exports(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The opportunity view as exports, one file per supplier, with what goes wrong in such files.

    A file starts with ``suppkey % 5`` notices, the second of which breaks its line; every 7th has no header but the
    lines the fallback skips. By order number a fortieth of the records each: ends early, has a cell too many, has an
    unreadable date, an unreadable quantity, a line break inside the account. A blank line and a footer end the file.
    """
    rows = opps(spark, sf_dir, *schema.RAW_COLUMNS, also=("l_orderkey", "l_linenumber", "l_suppkey"))
    odd = lambda k: F.col("l_orderkey") % 40 == k
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in schema.RAW_COLUMNS}
    text |= {c: F.date_format(c, "M/d/yyyy") for c in schema.DATE_COLUMNS}
    text["created"] = F.when(odd(7), F.lit("some day")).otherwise(text["created"])
    text["qty"] = F.when(odd(9), F.lit("n/a")).otherwise(text["qty"])
    text["account"] = F.when(odd(11), F.concat(text["account"], F.lit('\nof "two" lines, '))).otherwise(text["account"])
    cells = F.array(*text.values())
    cells = F.when(odd(3), F.slice(cells, 1, 9)).when(odd(5), F.concat(cells, F.array(F.lit("beyond")))).otherwise(cells)
    body = rows.select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber") + 100).alias("place"), cells.alias("cells"))
    named = F.col("s_suppkey") % 7 != 0
    label = F.array(*(F.lit(v) for v in EXPORT_LABELS))
    skipped = F.array_repeat(F.array(F.lit("Warning"), F.lit("line\nbreak")), schema.HEADER_DEFAULT_SKIP + 1)
    notices = F.transform(
        F.filter(F.sequence(F.lit(0), (F.col("s_suppkey") % 5).cast("int")), lambda i: i > 0),
        lambda i: F.array(F.lit("Warning"), F.when(i == 2, F.lit("line\nbreak")).otherwise(F.lit("first rows"))))
    top = F.when(named, F.concat(notices, F.array(label))).otherwise(skipped)
    suppliers = table(spark, sf_dir, "supplier")
    head = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.posexplode(top).alias("place", "cells"))
    end = F.array(F.array(F.lit("")), F.array(F.lit(schema.FOOTER_OWNERS[0]), F.lit("")))
    foot = suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.posexplode(end).alias("place", "cells"))
    lines = head.unionByName(body).unionByName(foot.withColumn("place", F.col("place") + (1 << 60)))
    return _write_files(lines.withColumn("file", F.concat(F.lit("export-"), F.col("l_suppkey").cast("string"))), folder)


def _write_files(lines: DataFrame, folder: str) -> str:
    """Lines ``(file, place, cells)`` as quoted text, one file each in the order of ``place``; one blank cell is a blank line."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
    blank = (F.size("cells") == 1) & (F.get("cells", F.lit(0)) == "")
    value = F.when(blank, F.lit("")).otherwise(F.array_join(F.transform("cells", quote), ","))
    placed = lines.select("file", "place", value.alias("value")).repartition("file").sortWithinPartitions("file", "place")
    placed.drop("place").write.option("lineSep", "\n").partitionBy("file").text(folder)
    return folder


def enduser_files(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """:func:`enduser_export` as text, one file per owner: two notices, the header, the rows."""
    rows = enduser_export(spark, sf_dir)
    names = [name for _, name in schema.ENDUSER_LABELS]
    text = {n: F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names}
    text |= {n: F.date_format(n, "M/d/yyyy") for n in schema.ENDUSER_DATES}
    file = F.concat(F.lit("enduser-"), F.col("owner"))
    body = rows.select(file.alias("file"), F.xxhash64("seq").alias("place"), F.array(*text.values()).alias("cells"))
    label = F.array(*(F.lit(label) for label, _ in schema.ENDUSER_LABELS))
    top = F.array(F.array(F.lit("Filtered by"), F.lit("all")), F.array(F.lit("")), label)
    head = table(spark, sf_dir, "supplier").select(F.concat(F.lit("enduser-"), F.col("s_name")).alias("file"), F.posexplode(top).alias("place", "cells"))
    first = F.lit(-(1 << 63)).cast("long")
    return _write_files(head.withColumn("place", first + F.col("place")).unionByName(body), folder)
