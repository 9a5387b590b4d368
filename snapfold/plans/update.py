"""The main update: fold one snapshot into the tracking tables."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from snapfold import schema
from snapfold.config import Config
from snapfold.functions import scalars as x
from snapfold.functions.weeks import current_week, detect_week_shift, week_window
from snapfold.operators import clean, history, lookup, owners, trend
from snapfold.operators.skew import hot_hashes
from snapfold.sources.store import Store


@dataclass
class State:
    """What one run hands to the next."""

    main: DataFrame
    history: DataFrame
    owner_counts: DataFrame
    log: DataFrame


@dataclass
class Tracking:
    """The refreshed tracking table, the copies taken aside, and the extended archive."""

    main: DataFrame
    run_rate: DataFrame
    closed_lost: DataFrame
    history: DataFrame


@dataclass
class Summary:
    history: DataFrame
    owner_counts: DataFrame
    details: DataFrame
    log: DataFrame
    window: DataFrame
    offsets: DataFrame
    trend: DataFrame


def empty_state(spark: SparkSession, snapshot: DataFrame) -> State:
    """State before the first run, typed like the given snapshot."""
    blank = snapshot.limit(0).select(*schema.SOURCE_COLUMNS, "seq")
    manual = {c: F.lit("") for c in schema.MANUAL_COLUMNS}
    return State(
        main=clean.with_key(blank.withColumns(manual)),
        history=spark.createDataFrame([], schema.HISTORY_SCHEMA),
        owner_counts=spark.createDataFrame([], schema.OWNER_WEEK_SCHEMA),
        log=spark.createDataFrame([], schema.LOG_SCHEMA),
    )


def fold_state(state: State, hot: DataFrame | None = None) -> DataFrame:
    """Everything known per key: deciding rows of the tracking table and the merged notes.

    ``hot`` are the hot keys of the tracking table, where looking for them is cheap.
    """
    master = clean.with_key(state.main)
    last = (*lookup.LAST_COLUMNS, *schema.week_columns(master.columns))
    return history.fold_notes(state.history, master, *lookup.last_and_first(last, lookup.FIRST_COLUMNS), hot=hot)


def _found(folded: DataFrame, old: list[str], weeks: list[int], shift: int) -> tuple[DataFrame, list[str]]:
    """The rows to look keys up in, with the notes of the new window as columns.

    The notes come from the archive when the window has moved, else from the same position
    of the last row; rows without a key always keep their own.
    """
    moved = shift != 0 and len(old) >= len(weeks)
    by_week = F.map_from_entries("notes")
    columns = {}
    for i, w in enumerate(weeks):
        own = x.clean_text(F.col("last")[old[i]]) if i < len(old) else F.lit("")
        archived = x.clean_text(F.try_element_at(by_week, F.lit(w)))
        columns[schema.week_column(w)] = F.when(x.is_blank("key"), own).otherwise(archived) if moved else own
    known = folded.filter(F.col("last").isNotNull())
    return known.select("key", "last", "first", *[e.alias(c) for c, e in columns.items()]), list(columns)


def track(snapshot: DataFrame, state: State, as_of: datetime, config: Config = Config(),
          folded: DataFrame | None = None, hot: DataFrame | None = None) -> Tracking:
    """Clean the snapshot and carry hand-entered columns and notes forward.

    ``folded`` is the result of :func:`fold_state` when the caller has written it already,
    ``hot`` the hot keys of the snapshot when it has found them already.
    """
    rows = clean.clean(snapshot, config)
    if folded is None:
        # a key made anew has to be dealt out again: Spark splits skewed partitions of a join only where both sides are
        folded = fold_state(state).withColumn("key", F.concat("key", F.lit("")))
    weeks = week_window(as_of, config.current_week, config.iso_week_window)
    old = schema.week_columns(state.main.columns)
    shift = detect_week_shift(old, current_week(as_of, config.current_week))
    found, notes = _found(folded, old, weeks, shift)
    columns = (*schema.SOURCE_COLUMNS, "seq", "key")
    return Tracking(
        main=lookup.carry_forward_manual(clean.open_only(rows).select(*columns), found, notes, hot),
        run_rate=clean.run_rate_subset(rows),
        closed_lost=clean.closed_lost_subset(rows),
        history=history.archive_rows(folded),
    )


def summarise(main: DataFrame, archive: DataFrame, state: State, as_of: datetime, snapshot_time: datetime,
              config: Config = Config()) -> Summary:
    """Everything that is derived from the refreshed tracking table."""
    log = trend.log_upsert(state.log, trend.log_row(trend.tracking_totals(main), snapshot_time), config.log_key)
    window = trend.rolling_view(log, config)
    offsets = trend.trend_normalise(window, config.max_normalised_gap)
    return Summary(
        history=history.history_semi(archive, main),
        owner_counts=owners.owner_max_merge(state.owner_counts, owners.owner_week_counts(main, as_of, config)),
        details=owners.owner_details(main, as_of, config),
        log=log,
        window=window,
        offsets=offsets,
        trend=trend.trend_view(window, offsets),
    )


def version_name(snapshot_time: datetime, source: str = "") -> str:
    digest = hashlib.sha256(source.encode()).hexdigest()[:12]
    return snapshot_time.strftime("%Y%m%dT%H%M%S%f") + (f"-{digest}" if source else "")


def load_state(store: Store, snapshot: DataFrame, version: str | None) -> State:
    if version is None:
        return empty_state(store.spark, snapshot)
    return State(*[store.read(name, version) for name in ("main", "history", "owner_counts", "log")])


def run_update(store: Store, snapshot: DataFrame, as_of: datetime, snapshot_time: datetime,
               config: Config = Config(), source: str = "", excluded: DataFrame | None = None) -> str:
    """Fold one snapshot into the store and return the version written.

    What is known per key is written in buckets of the key and serves both the tracking table and the archive, neither of
    which shuffles it again; the tracking table in turn serves every later table. So each step starts from files in the
    shared folder. The archive and the counters are written as changes. What was read, dropped, late or unfit is
    counted on the writes themselves and stored as ``counts``. Running the same snapshot twice starts from the same earlier
    state and writes the same version.

    ``excluded`` is a table of owners to leave out, of any length; rows of the short list in ``config`` are counted
    apart, those of the table are what is missing between ``n_read``, the reasons and the cleaned rows.

    ``source`` (the file) tells snapshots of the same time apart. A snapshot older than the last one folded in is folded
    onto the latest state all the same: counters take the larger value and the log its own row, so nothing is lost.
    """
    version = version_name(snapshot_time, source)
    previous = store.latest(before=version)
    state = load_state(store, snapshot, previous)
    known = hot_hashes(clean.with_key(state.main), ["key"])  # reads two columns of a stored table
    folded = store.write_bucketed("folded", fold_state(state, known), version, "key")
    read, tracked = Observation("read"), Observation("tracked")
    rows = store.write("cleaned", clean.clean(_observed(snapshot, read, as_of, config), config, excluded), version)
    tracking = track(rows, state, as_of, config, folded, hot_hashes(rows, ["key"]))
    main = store.write("main", _observed_main(tracking.main, tracked), version)
    counts = read.get | tracked.get
    store.write("counts", store.spark.createDataFrame([tuple(counts.values())], ", ".join(f"{c} long" for c in counts)), version)
    store.write("run_rate", tracking.run_rate, version)
    store.write("closed_lost", tracking.closed_lost, version)
    summary = summarise(main, tracking.history, state, as_of, snapshot_time, config)
    store.write_changes(
        "history", summary.history, history.history_semi(history.archive_changes(folded), main),
        history.left_rows(state.history, main), version, previous,
    )
    grown = owners.owner_count_growth(state.owner_counts, owners.owner_week_counts(main, as_of, config))
    store.write_changes("owner_counts", summary.owner_counts, grown, grown.limit(0), version, previous)
    store.write("details", summary.details, version, sort_by=("owner", "year", "week"))
    log = store.write("log", summary.log, version)
    window = trend.rolling_view(log, config)
    offsets = store.write("offsets", trend.trend_normalise(window, config.max_normalised_gap), version)
    store.write("trend", trend.trend_view(window, offsets), version)
    store.commit(version, previous)
    return version


def _observed(snapshot: DataFrame, read: Observation, as_of: datetime, config: Config) -> DataFrame:
    """The snapshot, counted on its way to the cleaned table: rows read, rows dropped by the first reason, rows dated
    after the run, and total prices that do not fit and so are in no sum."""
    reason = clean.drop_reason(config)
    return snapshot.observe(
        read, F.count("*").alias("n_read"),
        *(F.count_if(reason == r).alias(f"n_{r}") for r in clean.DROP_REASONS),
        F.count_if(x.is_future("created", as_of)).alias("n_future"),
        x.money_misfits("total_price").alias("n_unfit_total_price"),
    )


def _observed_main(main: DataFrame, tracked: Observation) -> DataFrame:
    return main.observe(tracked, F.count("*").alias("n_tracked"), x.money_misfits("revenue").alias("n_unfit_revenue"))
