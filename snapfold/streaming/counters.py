"""Counters kept up by a stream, each batch at the cost of what it brings."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snapfold.config import Config
from snapfold.functions import scalars as x
from snapfold.operators import owners
from snapfold.sources.store import Store

# A state larger than memory, of which a batch writes only what it changes.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _large_state(spark: SparkSession) -> Iterator[None]:
    """Settings a new stream takes over when it starts; one that goes on keeps those of its checkpoint."""
    before = {k: spark.conf.get(k, None) for k in _STATE}
    for k, v in _STATE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_owner_counts(snapshots: DataFrame, store: Store, checkpoint: str, as_of: datetime,
                        config: Config = Config()) -> StreamingQuery:
    """Distinct opportunities per owner and week over all micro-batches, of which one snapshot may take several.

    Spark's state store holds the (owner, week, opportunity) seen so far, so a batch looks up and writes its own keys
    only. It adds a version with how much each counter grows (:func:`streamed_counts` adds them up); a batch that
    runs again writes the same version again.
    """
    first_seen = owners.owner_week_optys(snapshots, as_of, config)

    def add(batch: DataFrame, batch_id: int) -> None:
        version = f"{batch_id:012d}"
        store.write("owner_count_growth", batch.groupBy("owner", "week").agg(F.count("*").alias("n")), version)
        store.commit(version, store.latest(before=version))

    with _large_state(snapshots.sparkSession):
        return (
            first_seen.writeStream.foreachBatch(add)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def streamed_counts(store: Store) -> DataFrame:
    """Owner counters after the last batch of :func:`stream_owner_counts`."""
    return store.read_all("owner_count_growth").groupBy("owner", "week").agg(F.sum("n").alias("n"))


def stream_late_counts(rows: DataFrame, store: Store, checkpoint: str, as_of: datetime,
                       time: str = "created", by: tuple[str, ...] = ()) -> StreamingQuery:
    """Rows per ISO week of creation, those dated after ``as_of`` apart. State is per week."""
    counts = rows.groupBy(
        *by, x.iso_week(time).alias("week"), x.is_future(time, as_of).alias("is_future")
    ).agg(F.count("*").alias("n_rows"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        version = f"{batch_id:012d}"
        store.write("late_counts", batch, version)
        store.commit(version, store.latest(before=version))

    return (
        counts.writeStream.outputMode("complete").foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_week_counts(rows: DataFrame, store: Store, checkpoint: str, delay: timedelta,
                       time: str = "created", by: tuple[str, ...] = ()) -> StreamingQuery:
    """Rows per week of event time, final once the watermark has passed the week; rows that come later are counted apart.

    The watermark of a batch is the latest time of the batches before it, less ``delay``. A row whose week ends at or
    before it is late: it changes no published count and is not lost from sight either. Spark's own watermark drops such
    rows inside the aggregate and counts them after it has merged them, so the mark is kept with the versions instead.
    Rows without a time are counted as undated. Each batch is aggregated once, written, and folded with the weeks
    still open, which are all the state there is: weeks behind the watermark leave it as they are published.

    Tables of a version: ``arrived`` (by, week, status, n), ``closed`` (by, week, n), ``open`` (by, week, n), ``mark``.
    """
    ends = F.col("week") + F.expr("INTERVAL 7 DAYS")

    def fold(batch: DataFrame, batch_id: int) -> None:
        version = f"{batch_id:012d}"
        previous = store.latest(before=version)
        mark = store.read("mark", previous).first()["mark"] if previous else None
        late = F.lit(False) if mark is None else ends <= x.timestamp(mark - delay)
        status = F.when(F.col("week").isNull(), "undated").when(late, "late").otherwise("on time")
        # weeks start on Monday, as ISO weeks do
        weeks = batch.select(*by, F.date_trunc("week", time).cast("timestamp_ntz").alias("week"), F.col(time).alias("time"))
        counted = weeks.groupBy(*by, "week").agg(F.count("*").alias("n"), F.max("time").cast("timestamp_ntz").alias("latest"))
        arrived = store.write("arrived", counted.withColumn("status", status), version)
        latest = max((t for t in (mark, arrived.agg(F.max("latest")).first()[0]) if t is not None), default=None)
        known = arrived.filter("status = 'on time'").select(*by, "week", "n")
        if previous:
            known = known.unionByName(store.read("open", previous))
        merged = known.groupBy(*by, "week").agg(F.sum("n").alias("n"))
        passed = F.lit(False) if latest is None else ends <= x.timestamp(latest - delay)
        store.write("closed", merged.filter(passed), version)
        store.write("open", merged.filter(~passed), version)
        store.write("mark", store.spark.createDataFrame([(latest,)], "mark timestamp_ntz"), version)
        store.commit(version, previous)

    return (
        rows.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def week_totals(store: Store, by: tuple[str, ...] = ()) -> DataFrame:
    """After the last batch: per week the rows of each ``status`` - ``final``, ``open``, ``late`` or ``undated``."""
    version = store.latest()
    arrived = store.read_all("arrived").filter("status <> 'on time'")
    columns = lambda df, status: df.select(*by, "week", "n", status.alias("status"))
    whole = columns(store.read_all("closed"), F.lit("final"))
    whole = whole.unionByName(columns(store.read("open", version), F.lit("open"))).unionByName(columns(arrived, F.col("status")))
    return whole.groupBy(*by, "week", "status").agg(F.sum("n").alias("n"))
