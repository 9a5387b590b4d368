"""What a run leaves in the store, read back: every sink is written and compared as it lies there."""

from __future__ import annotations

from pyspark.sql import functions as F

from snapfold import bindings as b
from snapfold.operators import history as weeks
from snapfold.plans import reports, update
from snapfold.queries import claim_queries, lookup_queries, plan_queries  # noqa: F401
from snapfold.queries.registry import query, same_rows_as
from snapfold.session import work_folder
from snapfold.sources import exports
from snapfold.sources.store import Store

_BEFORE = "before"


def _seeded(spark, sf_dir) -> Store:
    """A store that holds the earlier tracking table, archive, counters and log."""
    store = Store(spark, work_folder(spark, "store"))
    store.write("main", b.master(spark, sf_dir), _BEFORE)
    archive, counts = b.history(spark, sf_dir), b.stored_counts(spark, sf_dir)
    store.write_changes("history", archive, archive.limit(0), archive.limit(0), _BEFORE, None)
    store.write_changes("owner_counts", counts, counts.limit(0), counts.limit(0), _BEFORE, None)
    store.write("log", b.log(spark, sf_dir), _BEFORE)
    store.commit(_BEFORE)
    return store


def _run(spark, sf_dir) -> tuple[Store, str]:
    store = _seeded(spark, sf_dir)
    return store, update.run_update(store, b.opps(spark, sf_dir), b.AS_OF, b.AS_OF)


@same_rows_as("snapshot_update")
def stored_main(spark, sf_dir):
    store, version = _run(spark, sf_dir)
    return store.read("main", version).drop("seq", "key", "revenue_carried").withColumn("revenue", F.round("revenue", 4))


@query("""SELECT 'run_rate' AS name, opty, model, owner, stage FROM cleaned WHERE deal_type = 'Run Rate Deal'
  UNION ALL SELECT 'closed_lost', opty, model, owner, stage FROM cleaned WHERE stage = 'Closed Lost'""")
def stored_side_tables(spark, sf_dir):
    store, version = _run(spark, sf_dir)
    of = lambda name: store.read(name, version).select(F.lit(name).alias("name"), "opty", "model", "owner", "stage")
    return of("run_rate").unionByName(of("closed_lost"))


@same_rows_as("update_history")
def stored_history(spark, sf_dir):
    """The archive after a run that wrote what it changed: the full copy and the changes, put together."""
    store, version = _run(spark, sf_dir)
    return store.read("history", version)


@query("SELECT key, " + ", ".join(
    f"coalesce(max(CASE WHEN week = {i} THEN value END), '') AS \"W{i:02d}\"" for i in range(1, 54)
) + " FROM hist_new h WHERE EXISTS (SELECT 1 FROM main m WHERE m.key = h.key) GROUP BY key")
def stored_history_wide(spark, sf_dir):
    store, version = _run(spark, sf_dir)
    wide = store.write("history_wide", weeks.to_wide(store.read("history", version)).drop("opty", "model"), version)
    return wide


@same_rows_as("update_owner_counts")
def stored_owner_counts(spark, sf_dir):
    store, version = _run(spark, sf_dir)
    return store.read("owner_counts", version)


@same_rows_as("update_details")
def stored_details(spark, sf_dir):
    store, version = _run(spark, sf_dir)
    return store.read("details", version)


@query("""SELECT count(*) AS n_read, 0 AS n_footer, 0 AS n_incomplete, 0 AS n_excluded,
  count(*) FILTER (customer LIKE 'Generic%' AND (total_price IS NULL OR total_price < 50000)) AS n_small_generic,
  count(*) FILTER (NOT (customer LIKE 'Generic%' AND (total_price IS NULL OR total_price < 50000))
                   AND coalesce(product_line, '') IN ('LM', 'MS', 'MR')) AS n_product_line,
  count(*) FILTER (created > TIMESTAMP '2001-06-15') AS n_future, 0 AS n_unfit_total_price,
  (SELECT count(*) FROM cleaned WHERE stage NOT IN ('Rejected', 'Closed Lost')) AS n_tracked, 0 AS n_unfit_revenue FROM opps""")
def stored_run_counts(spark, sf_dir):
    """What the run counted on its own writes."""
    store, version = _run(spark, sf_dir)
    return store.read("counts", version)


@query("SELECT quote, claim_qty, claim_val, claim_pn, distri FROM claims_hist UNION ALL "
       "SELECT quote, claim_qty, claim_val, claim_pn, distri FROM claims c WHERE quote NOT IN (SELECT quote FROM claims_hist)")
def stored_claims(spark, sf_dir):
    """Two claim runs: the second adds the quotes that the first has not brought."""
    store = Store(spark, work_folder(spark, "claims"))
    sources = b.claim_sources(spark, sf_dir)
    early = [(p, df.filter(F.col(p.columns[0]) < F.lit(b.CLAIM_HISTORY_BEFORE).cast("timestamp_ntz"))) for p, df in sources]
    reports.run_claims(store, early, "1998")
    reports.run_claims(store, sources, "2001")
    return reports.claim_history(store, "2001").select("quote", "claim_qty", "claim_val", "claim_pn", "distri")


@same_rows_as("enduser_followup")
def enduser_job(spark, sf_dir):
    """End-user files, stored claims and the stored follow-up, folded into the next follow-up table."""
    folder = b.enduser_files(spark, sf_dir, work_folder(spark, "enduser-files"))
    claims = Store(spark, work_folder(spark, "claims"))
    reports.run_claims(claims, b.claim_sources(spark, sf_dir), "2001")
    store = Store(spark, work_folder(spark, "followup"))
    store.write("followup", b.followup_master(spark, sf_dir), _BEFORE)
    store.commit(_BEFORE)
    table = reports.run_enduser(store, folder, reports.claim_history(claims, "2001"), "2001",
                                excluded_owners=["Supplier#000000003"], glob="*.txt")
    return table.drop("seq")


@same_rows_as("dedup_opty_price")
def stored_dedup(spark, sf_dir):
    store = Store(spark, work_folder(spark, "dedup"))
    rows = b.opps(spark, sf_dir, "owner", "opty", "total_price", "model", "part_number", "seq")
    return reports.run_dedup(store, rows, "1").drop("seq")


@query("""SELECT 'export-' || s_suppkey AS file, true AS has_bytes, (SELECT count(*) FROM supplier) AS n_not_after_latest
  FROM supplier""")
def snapshot_files(spark, sf_dir):
    """The files of a folder in the listing, and how many of them the newest one follows or is."""
    folder = b.text_exports(spark, sf_dir, work_folder(spark, "text-exports"))
    listed, newest = exports.list_snapshots(spark, folder, "*.txt*"), exports.latest_snapshot(spark, folder, "*.txt*")
    place = F.struct("snapshot_time", "file")
    last = listed.filter(F.col("file") == newest).select(place.alias("last")).scalar()
    n = listed.agg(F.count_if(place <= last)).scalar()
    return listed.select(F.regexp_extract("file", "file=(export-[0-9]+)", 1).alias("file"),
                         (F.col("size") > 0).alias("has_bytes"), n.alias("n_not_after_latest"))
