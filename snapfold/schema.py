"""Table layouts and the fixed values results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values ---------------------------------------------------------------------

# Labels that identify a header line, one set per language of the export.
HEADER_LABELS = {
    "English": ("Opportunity Owner", "Created Date", "Close Date", "Stage"),
    "French": ("Propriétaire de l'opportunité", "Date de création", "Date de clôture", "Étape"),
}
HEADER_MIN_MATCHES = 2
HEADER_DEFAULT_SKIP = 12

# Owner cells of the lines an export ends with.
FOOTER_OWNERS = (
    "Total",
    "Confidential Information - Do Not Distribute",
    "Copyright © 2000-2023 salesforce.com, inc. All rights reserved.",
)

GENERIC_CUSTOMER_PREFIX = "Generic"
GENERIC_MIN_TOTAL = 50_000
EXCLUDED_PRODUCT_LINES = ("LM", "MS", "MR")

RUN_RATE_DEAL = "Run Rate Deal"
STAGE_CLOSED_LOST = "Closed Lost"
STAGE_REJECTED = "Rejected"
STAGE_CLOSED_WON = "closed won"

FORECAST_LABELS = (
    "LOST = Perdu",
    "UNCOMMITED = Pas certain",
    "UNCOMMITED UPSIDE = Certain à 50% du WIN",
    "COMMIT AT RISK = Certain à 75% du WIN",
    "COMMIT = Certain à 100% du WIN",
    "WIN = Gagné",
)

QUARTER_PATTERN = "Q[0-9]FY[0-9][0-9]"

V1_COLUMN_COUNT = 21
V2_COLUMN_COUNT = 26
WEEKS = tuple(range(1, 54))

# --- Export and tracking table --------------------------------------------------------

# Order of the columns in a raw export; two of them move left on load.
RAW_COLUMNS = (
    "owner", "created", "closed", "stage", "opty", "reseller", "customer",
    "total_price", "model", "part_number", "qty", "sales_price",
    "account", "product_line", "deal_type", "win_rate",
)

SOURCE_COLUMNS = (
    "owner", "created", "closed", "stage", "opty", "reseller", "customer",
    "qty", "sales_price", "total_price", "model", "part_number",
    "account", "product_line", "deal_type", "win_rate",
)

MANUAL_COLUMNS = ("est_qty", "revenue", "quarter_invoice", "forecast", "next_step")

DATE_COLUMNS = ("created", "closed")
NUMBER_COLUMNS = ("qty", "sales_price", "total_price")

HISTORY_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("opty", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("week", T.IntegerType()),
    T.StructField("value", T.StringType()),
])

OWNER_WEEK_SCHEMA = T.StructType([
    T.StructField("owner", T.StringType()),
    T.StructField("week", T.IntegerType()),
    T.StructField("n", T.LongType()),
])

LOG_SCHEMA = T.StructType([
    T.StructField("date", T.TimestampNTZType()),
    T.StructField("wk", T.IntegerType()),
    T.StructField("nb_opty", T.LongType()),
    T.StructField("sf_amount", T.DoubleType()),
    T.StructField("est_amount", T.DoubleType()),
    T.StructField("seq", T.LongType()),
])

CLAIM_COLUMNS = ("claim_date", "quote", "claim_qty", "claim_val", "claim_pn")

# --- End-user follow-up ---------------------------------------------------------------

# Header labels of the end-user export, in its order, each with the column it becomes.
ENDUSER_LABELS = (
    ("Opportunity Number", "opty"),
    ("Quote Number", "quote"),
    ("End Customer: Main Industry", "sector"),
    ("Product: Operating System", "os"),
    ("Opportunity Owner: Full Name", "owner"),
    ("Win Rate", "win_rate"),
    ("Product Line", "bu"),
    ("Created Date", "created"),
    ("Close Date", "closed"),
    ("Stage", "status"),
    ("End Customer: Account Name", "customer"),
    ("Indirect Account: Account Name", "reseller"),
    ("Account Name: Account Name", "distributor"),
    ("Product: Sales Model Name", "model"),
    ("Quantity", "volume"),
    ("Part Number", "part_number"),
    ("Requested Dealer Price", "dealer_price"),
    ("Total Price", "revenue"),
    ("Close Reason", "close_reason"),
    ("Close Description", "close_description"),
)
ENDUSER_DATES = ("created", "closed")
ENDUSER_NUMBERS = ("volume", "dealer_price", "revenue")

FOLLOWUP_MANUAL = (
    "activity", "iqr", "capacity_qty", "competitors", "comment", "next_step", "next_step_schedule",
)

# The columns of the follow-up in their order.
FOLLOWUP_COLUMNS = (
    "sector", "activity", "os", "owner", "win_rate", "bu", "created_period", "invoice_period",
    "status", "close_reason", "close_description", "customer", "opty", "iqr", "reseller",
    "distributor", "quote", "model", "part_number", "volume", "dealer_price", "revenue",
    "claim_qty", "claim_val", "claim_total", "capacity_qty", "competitors", "comment",
    "next_step", "next_step_schedule",
)


def week_column(week: int) -> str:
    """Column label of a note week in the tracking table."""
    return f"Week {week}"


def week_columns(columns) -> list[str]:
    """The note columns of a tracking table, in table order."""
    return [c for c in columns if c.startswith("Week ")]
