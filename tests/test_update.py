import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from snapfold import schema
from snapfold.config import Config
from snapfold.operators import clean, history
from snapfold.plans import replay, reports, update
from snapfold.sources import store as store_module
from snapfold.sources.store import Store
from snapfold.streaming import counters
from snapfold.streaming import replay as stream_replay
from test_exports import record, write

FIRST, SECOND = datetime(2025, 6, 4), datetime(2025, 6, 18)


def snapshot(spark, *records):
    names = ("owner", "opty", "model", "stage", "total_price", "qty", "customer")
    types = "owner string, opty string, model string, stage string, total_price double, qty double, customer string, seq int"
    df = spark.createDataFrame([(*[r[n] for n in names], i) for i, r in enumerate(records)], types)
    filled = {
        "created": F.lit(datetime(2025, 6, 2)).cast("timestamp_ntz"), "closed": F.lit(datetime(2025, 9, 1)).cast("timestamp_ntz"),
        "reseller": F.lit("R"), "sales_price": F.lit(10.0), "part_number": F.lit("P"), "account": F.lit("a"),
        "product_line": F.lit("NB"), "deal_type": F.lit("Project"), "win_rate": F.lit("50%"),
    }
    return df.withColumns(filled).select(*schema.SOURCE_COLUMNS, "seq")


def row(opty="O1", owner="A", model="M", stage="Open", total=100.0, qty=2.0, customer="C"):
    return {"owner": owner, "opty": opty, "model": model, "stage": stage, "total_price": total, "qty": qty, "customer": customer}


def tables(store, version):
    names = ("main", "history", "owner_counts", "details", "log", "trend", "offsets", "run_rate", "closed_lost")
    return {n: rows(store.read(n, version)) for n in names}


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_first_run_and_second_run(spark, store):
    first = update.run_update(store, snapshot(spark, row(), row("O2", stage="Closed Lost"), row("O3", stage="Rejected")),
                              FIRST, FIRST)
    main = store.read("main", first)
    assert [r["opty"] for r in main.collect()] == ["O1"]
    assert [c for c in main.columns if c.startswith("Week ")] == [f"Week {w}" for w in range(21, 26)]
    assert (main.first()["quarter_invoice"], main.first()["forecast"]) == ("Q3FY25", schema.FORECAST_LABELS[2])
    assert [r["opty"] for r in store.read("closed_lost", first).collect()] == ["O2"]
    assert rows(store.read("owner_counts", first)) == [("A", 23, 1)]

    # Notes and quantities are entered by hand between the runs.
    edited = main.withColumns({"est_qty": F.lit("7"), "next_step": F.lit(" call "), "Week 23": F.lit("now"), "Week 21": F.lit("then")})
    state = update.State(edited, *[store.read(n, first) for n in ("history", "owner_counts", "log")])
    tracked = update.track(snapshot(spark, row(), row("O4")), state, SECOND)
    got = {r["opty"]: r for r in tracked.main.collect()}
    assert [c for c in tracked.main.columns if c.startswith("Week ")] == [f"Week {w}" for w in range(23, 28)]
    assert (got["O1"]["est_qty"], got["O1"]["revenue"], got["O1"]["next_step"]) == (7.0, 70.0, "call")
    assert (got["O1"]["Week 23"], got["O1"]["Week 24"], got["O4"]["Week 23"], got["O4"]["est_qty"]) == ("now", "", "", None)
    summary = update.summarise(tracked.main, tracked.history, state, SECOND, SECOND)
    assert rows(summary.history) == [("O1M", "O1", "M", 21, "then"), ("O1M", "O1", "M", 23, "now")]
    assert rows(summary.owner_counts) == [("A", 23, 2)]
    assert [(r["wk"], r["nb_opty"], r["sf_amount"], r["est_amount"]) for r in summary.log.orderBy("seq").collect()] == [
        (23, 1, 100.0, 0.0), (25, 2, 200.0, 70.0)]


def test_the_same_snapshot_twice_changes_nothing(spark, store):
    df = snapshot(spark, row(), row("O2"), row("O2", model="N"))
    update.run_update(store, df, FIRST, FIRST)
    version = update.run_update(store, df, SECOND, SECOND)
    before = tables(store, version)
    assert update.run_update(store, df, SECOND, SECOND) == version
    assert tables(store, version) == before
    assert store.latest() == version and store.latest(before=version) != version


def test_the_archive_is_written_as_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "FULL_EVERY", 5)
    store, rng = Store(spark, str(tmp_path / "store"), buckets=4), random.Random(2)
    keys, versions, sizes = [f"O{k}" for k in range(2_000)], [], []
    expected = {}
    for run in range(7):
        moment = FIRST + timedelta(minutes=run)
        previous = store.latest()
        kept = [k for k in keys if rng.random() < 0.99]
        noted = {k: f"note {run} {k}" for k in (kept if run == 0 else rng.sample(kept, 20))}
        expected = {k: noted.get(k, expected.get(k)) for k in kept if k in noted or k in expected}
        state = update.load_state(store, snapshot(spark), previous)
        notes = spark.createDataFrame([(k, k, "", 23, v) for k, v in noted.items()], schema.HISTORY_SCHEMA)
        stored = spark.createDataFrame([], schema.HISTORY_SCHEMA) if previous is None else state.history
        pipe = spark.createDataFrame([(k,) for k in kept], "key string")
        merged = stored.join(notes, ["key", "week"], "left_anti").unionByName(notes)
        version = update.version_name(moment)
        store.write_changes("history", history.history_semi(merged, pipe), notes, history.left_rows(stored, pipe), version, previous)
        store.write_changes("owner_counts", *[spark.createDataFrame([], schema.OWNER_WEEK_SCHEMA)] * 3, version, previous)
        store.write("main", state.main, version)
        store.write("log", state.log, version)
        store.commit(version, previous)
        versions.append(version)
        sizes.append(spark.read.parquet(str(tmp_path / "store" / "history" / f"version={version}")).count())
        keys = kept
        assert {r["key"]: r["value"] for r in store.read("history", version).collect()} == expected
    assert [len(store._chain("history", v)[0]) for v in versions] == [1, 2, 3, 4, 5, 1, 2]
    assert max(sizes[1:5]) < sizes[0] / 40 and sizes[5] > sizes[0] / 2
    # another session, and another number of buckets, read the same
    for v, n in ((versions[3], 4), (versions[6], 7)):
        again = Store(spark.newSession(), str(tmp_path / "store"), buckets=n)
        assert rows(again.read("history", v)) == rows(store.read("history", v))


def test_looking_up_the_state_shuffles_the_snapshot_only(spark, store):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        records = [row(f"O{i}") for i in range(300)]
        first = update.run_update(store, snapshot(spark, *records), FIRST, FIRST)
        state = update.load_state(store, snapshot(spark), first)
        folded = store.write_bucketed("folded", update.fold_state(state), "next", "key")
        cleaned = store.write("cleaned", clean.clean(snapshot(spark, *records)), "next")
        main = update.track(cleaned, state, SECOND, folded=folded).main
        plan = main._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(key") == 1 and "SortMergeJoin" in plan
        semi = history.history_semi(history.archive_rows(folded), store.read("main", first))
        assert semi._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # keys of main
        assert state.history.groupBy("key").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_run_counts_what_it_reads_and_drops(spark, store):
    records = [row(), row("O2", owner="Total"), row("O3", owner=None), row("O4", customer=None), row("O5", owner="X"),
               row("O6", customer="Generic A"), row("O7", total=1e30), row("O8", stage="Closed Lost")]
    version = update.run_update(store, snapshot(spark, *records), datetime(2025, 6, 1), FIRST, Config(excluded_owners=("X",)))
    assert store.read("counts", version).first().asDict() == {
        "n_read": 8, "n_footer": 1, "n_incomplete": 2, "n_excluded": 1, "n_small_generic": 1, "n_product_line": 0,
        "n_future": 8, "n_unfit_total_price": 1, "n_tracked": 2, "n_unfit_revenue": 0}


def test_snapshots_of_one_time_are_runs_of_their_own(spark, store):
    update.run_update(store, snapshot(spark, row()), FIRST, FIRST, source="a.csv")
    update.run_update(store, snapshot(spark, row("O2", owner="B")), FIRST, FIRST, source="b.csv")
    assert store.versions().count() == 2
    assert rows(store.read("owner_counts", store.latest())) == [("A", 23, 1), ("B", 23, 1)]


def test_a_late_snapshot_is_folded_onto_the_latest_state(spark, store):
    update.run_update(store, snapshot(spark, row(), row("O2")), SECOND, SECOND)
    late = snapshot(spark, row("O3", owner="B"))
    version = update.run_update(store, late, FIRST, FIRST)
    assert store.latest() == version
    assert rows(store.read("owner_counts", version)) == [("A", 23, 2), ("B", 23, 1)]
    assert [(r["date"], r["nb_opty"]) for r in store.read("log", version).orderBy("date").collect()] == [(FIRST, 1), (SECOND, 2)]
    before = tables(store, version)
    assert update.run_update(store, late, FIRST, FIRST) == version and tables(store, version) == before


def test_only_a_missing_list_of_runs_means_no_runs(spark, store, tmp_path):
    assert store.latest() is None
    store.commit("1")
    (tmp_path / "store" / "runs" / "part-torn.parquet").write_text("torn")
    with pytest.raises(Exception):
        store.latest()


def test_result_does_not_depend_on_order_or_partitions(spark):
    random.seed(3)
    records = [row(f"O{random.randrange(20)}", owner=random.choice("ABC"), model=random.choice("MN"), total=float(i))
               for i in range(200)]
    base = snapshot(spark, *records)
    state = update.empty_state(spark, base)
    first = update.track(base, state, FIRST).main.drop("revenue_carried")
    edited = first.withColumns({"est_qty": F.col("seq").cast("string"), "Week 22": F.concat(F.lit("n"), "seq")})
    results = []
    for parts in (1, 8):
        previous = update.State(edited.repartition(parts), state.history, state.owner_counts, state.log)
        results.append(rows(update.track(base.orderBy(F.rand(parts)).repartition(parts), previous, SECOND).main))
    assert results[0] == results[1]


def test_replay_chains_the_state(spark, store):
    older, newer = snapshot(spark, row(), row("O2")), snapshot(spark, row("O3"))
    both = older.withColumn("snapshot_time", F.lit(FIRST).cast("timestamp_ntz")).unionByName(
        newer.withColumn("snapshot_time", F.lit(SECOND).cast("timestamp_ntz")))
    version = replay.replay_snapshots(store, both)
    assert rows(store.read("owner_counts", version)) == [("A", 23, 2)]
    assert [r["nb_opty"] for r in store.read("log", version).orderBy("seq").collect()] == [2, 1]


@pytest.mark.parametrize("log_key", ["date", "wk"])
def test_a_replay_at_once_equals_the_runs_in_order(spark, store, log_key):
    rng, config = random.Random(7), Config(log_key=log_key)
    whole = None
    for hours in (0, 20, 24 * 8, 24 * 380):
        records = [row(f"O{i}", owner=rng.choice("AB"), model=rng.choice(["M", None]), total=rng.choice([10.0, None, 1e25]),
                       qty=rng.choice([None, 0.0, 2.0, 5.0]), stage=rng.choice(["Open", "Open", "Closed Lost"]))
                   for i in range(8) if rng.random() < 0.8 for _ in range(rng.randint(1, 2))]
        moment = FIRST + timedelta(hours=hours)
        one = snapshot(spark, *records).withColumn("snapshot_time", F.lit(moment).cast("timestamp_ntz"))
        whole = one if whole is None else whole.unionByName(one)
    whole = store.write("given", whole, "all")
    version = replay.replay_snapshots(store, whole, config)
    counters_, log = replay.replay_at_once(whole, config)
    assert rows(counters_) == rows(store.read("owner_counts", version))
    columns = ("date", "wk", "nb_opty", "sf_amount", "est_amount", "seq")
    assert rows(log.select(*columns)) == rows(store.read("log", version).select(*columns))
    assert any(r["est_amount"] for r in log.collect()) and store.read("history", version).count() == 0


def test_a_replay_at_once_never_deals_rows_out_by_snapshot(spark, store):
    one = snapshot(spark, row("O1")).withColumn("snapshot_time", F.lit(FIRST).cast("timestamp_ntz"))
    given = store.write("given", one, "all")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, -1)  # as for a table whose size Spark does not know to be small
    try:
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in replay.replay_at_once(given)]
    finally:
        spark.conf.set(limit, before)
    assert not any("SortMergeJoin [snapshot_time" in plan for plan in plans)
    assert all("BroadcastHashJoin [snapshot_time" in plan for plan in plans)


def test_stream_of_export_files(spark, store, tmp_path):
    folder = tmp_path / "exports"
    folder.mkdir()
    stamps = [int(datetime(2025, 6, d, 12).timestamp()) for d in (4, 11, 18)]
    for i, (stamp, n) in enumerate(zip(stamps, (3, 1, 2))):
        write(folder, f"{'cab'[i]}.csv", notices=i, mtime=stamp,
              records=[record(opty=f"O{k}", created="6/3/2025") for k in range(n)])
    checkpoint = str(tmp_path / "checkpoint")
    stream_replay.stream_exports(spark, str(folder), store, checkpoint).awaitTermination()
    version = store.latest()
    log = store.read("log", version).orderBy("seq").collect()
    assert [(r["date"].day, r["nb_opty"]) for r in log] == [(4, 3), (11, 1), (18, 2)]
    assert rows(store.read("owner_counts", version)) == [("A", 23, 3)]
    # The same files in a batch, each read by its own path, end in the same tables.
    other = Store(spark, str(tmp_path / "batch"))
    again = replay.run_exports(other, str(folder), "all")
    assert tables(other, again) == tables(store, version)
    # Nothing new: nothing changes. A new file is folded in on its own.
    stream_replay.stream_exports(spark, str(folder), store, checkpoint).awaitTermination()
    assert store.latest() == version
    write(folder, "0.csv", mtime=int(datetime(2025, 6, 25, 12).timestamp()), records=[record(created="6/3/2025")])
    stream_replay.stream_exports(spark, str(folder), store, checkpoint).awaitTermination()
    assert store.read("log", store.latest()).count() == 4


def test_streamed_counters(spark, store, tmp_path):
    folder = str(tmp_path / "rows")
    columns = "owner string, opty string, created timestamp_ntz"

    def add(*records):
        spark.createDataFrame(list(records), columns).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(columns).parquet(folder)
        counters.stream_owner_counts(stream, store, str(tmp_path / "c"), SECOND).awaitTermination()
        return rows(counters.streamed_counts(store))

    day = datetime(2025, 6, 3)
    add(("A", "O1", day), ("A", "O2", day), ("B", "O1", datetime(2025, 7, 1)))
    assert run() == [("A", 23, 2)]
    add(("A", "O1", day), ("B", "O9", day))
    assert run() == [("A", 23, 2), ("B", 23, 1)]
    for k in range(3):  # one snapshot in three files, one file a batch
        add(("C", f"O{k}", day))
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", 1).parquet(folder)
    counters.stream_owner_counts(stream, store, str(tmp_path / "c"), SECOND).awaitTermination()
    assert rows(counters.streamed_counts(store)) == [("A", 23, 2), ("B", 23, 1), ("C", 23, 3)]


def folder_bytes(path):
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


def test_a_batch_writes_what_it_brings_not_the_state(spark, store, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), tmp_path / "c"
    day = F.lit(datetime(2025, 6, 3)).cast("timestamp_ntz")
    columns = "owner string, opty string, created timestamp_ntz"

    def run(first, n):
        made = spark.range(first, first + n).select(F.concat(F.lit("A"), F.col("id") % 5).alias("owner"),
                                                    F.concat(F.lit("O"), F.sha2(F.col("id").cast("string"), 256)).alias("opty"), day.alias("created"))
        made.write.mode("append").parquet(folder)
        before = folder_bytes(checkpoint / "state") if checkpoint.exists() else 0
        stream = spark.readStream.schema(columns).parquet(folder)
        counters.stream_owner_counts(stream, store, str(checkpoint), SECOND).awaitTermination()
        return folder_bytes(checkpoint / "state") - before

    large = run(0, 40_000)
    small = [run(40_000 + 20 * k, 20) for k in range(4)]
    assert max(small) < large / 20
    assert rows(counters.streamed_counts(store)) == [(f"A{k}", 23, 8_016) for k in range(5)]


def test_late_rows_are_counted_and_weeks_close(spark, store, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "c")
    columns = "kind string, created timestamp_ntz"

    def run(*records):
        spark.createDataFrame(list(records), columns).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(columns).parquet(folder)
        counters.stream_week_counts(stream, store, checkpoint, timedelta(days=3), by=("kind",)).awaitTermination()

    monday = [datetime(2025, 6, 2), datetime(2025, 6, 9), datetime(2025, 6, 16)]
    run(("a", datetime(2025, 6, 3)), ("a", datetime(2025, 6, 4)), ("b", None))
    run(("a", datetime(2025, 6, 11, 23)), ("a", datetime(2025, 6, 5)))  # the mark is not past the first week yet
    assert rows(store.read("open", store.latest())) == [("a", monday[0], 3), ("a", monday[1], 1)]
    run(("a", datetime(2025, 6, 6)), ("b", datetime(2025, 6, 17)))  # still on time, then the week closes
    assert rows(store.read("closed", store.latest())) == [("a", monday[0], 4), ]
    run(("a", datetime(2025, 6, 7)), ("a", datetime(2025, 6, 8)), ("a", datetime(2025, 6, 18)))
    assert rows(counters.week_totals(store, ("kind",))) == sorted([
        ("a", monday[0], "final", 4), ("a", monday[0], "late", 2), ("a", monday[1], "open", 1), ("a", monday[2], "open", 1),
        ("b", monday[2], "open", 1), ("b", None, "undated", 1)], key=repr)
    assert {r["week"] for r in store.read("open", store.latest()).collect()} == set(monday[1:])


def test_rejects_are_stored_and_unreadable_files_change_nothing(spark, store, tmp_path):
    path = write(tmp_path, "a.csv", records=[record(), record(opty="O2"), record(opty="O3")[:4], record(opty="O4", created="soon")])
    version = replay.run_exports(store, path, "path")
    assert [(r["status"], r["reasons"]) for r in store.read("rejects", version).orderBy("line_no").collect()] == [
        ("rejected", ["too few cells"]), ("accepted", ["unreadable created"])]
    checks = store.read("checks", version).first()
    assert (checks["n_accepted"], checks["n_rejected"], checks["n_footer"]) == (3, 1, 1)
    assert store.read("counts", version).first()["n_read"] == 4  # with the footer, which the cleaning drops
    bad = write(tmp_path, "b.csv", records=[record()[:4], record()[:5], record()])
    with pytest.raises(ValueError, match="2 records rejected"):
        replay.run_exports(store, bad, "path")
    assert store.latest() == version


def test_enduser_files_become_the_followup(spark, store, tmp_path):
    labels = [label for label, _ in schema.ENDUSER_LABELS]

    def row_of(**values):
        return [values.get(name, "") for _, name in schema.ENDUSER_LABELS]

    def file(name, *records):
        (tmp_path / name).write_text("\n".join(",".join(f'"{c}"' for c in r) for r in [["notice"], labels, *records]) + "\n")
        return str(tmp_path / name)

    claims = spark.createDataFrame([("Q1", "P", 2.0, 5.0)], "quote string, claim_pn string, claim_qty double, claim_val double")
    first = dict(opty="O1", part_number="P", quote="Q1", customer="C", owner="A", created="6/3/2025", volume="4")
    one = reports.run_enduser(store, file("1.csv", row_of(**first)), claims, "1")
    assert (one.first()["claim_total"], one.first()["created_period"], one.first()["comment"]) == (10, "Q2FY25", "")
    store.write("followup", one.withColumn("comment", F.lit("typed in")), "1b")
    store.commit("1b", "1")
    two = reports.run_enduser(store, file("2.csv", row_of(**first), row_of(**first | {"opty": "O2"})), claims, "2")
    assert sorted((r["opty"], r["comment"], r["claim_qty"]) for r in two.collect()) == [("O1", "typed in", 2), ("O2", "", 2)]


def test_config_is_checked():
    with pytest.raises(ValueError):
        Config(log_key="day")
    with pytest.raises(ValueError):
        Config(current_week=54)
