"""What is known per key: as few and as narrow shuffles as the rows allow, with the same result."""

import re
from datetime import datetime

from pyspark.sql import functions as F

from conftest import rows
from snapfold import bindings as b
from snapfold.operators import history, lookup
from snapfold.operators.skew import hot_hashes


def _tables(spark):
    """Keys of one row, keys of several, and a key that holds every other row; some only in the archive."""
    n = F.col("id")
    key = F.when(n % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), (n % 701).cast("string")))
    master = spark.range(4_000).select(
        key.alias("opty"), F.lit("M").alias("model"), F.concat(key, F.lit("M")).alias("key"), n.alias("seq"),
        *(F.when(n % (k + 3) != 0, F.concat(F.lit(f"{k}-"), n.cast("string"))).alias(f"Week {k}") for k in range(20, 25)),
        n.cast("string").alias("est_qty"), n.cast("double").alias("qty"))
    archive = spark.range(900).select(
        F.concat(F.lit("k"), n.cast("string"), F.lit("M")).alias("key"), F.concat(F.lit("k"), n.cast("string")).alias("opty"),
        F.lit("M").alias("model"), F.lit(20).alias("week"), F.lit("old").alias("value"))
    return archive, master.repartition(8)


def _picks():
    return lookup.last_and_first(("est_qty", "Week 20"), ("qty",))


def _sorted_notes(folded):
    return rows(folded.withColumns({c: F.sort_array(c) for c in ("notes", "changed")}))


def _plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def test_a_hot_key_changes_how_rows_travel_not_what_they_say(spark):
    archive, master = _tables(spark)
    hot = hot_hashes(master, ["key"])
    assert len(hot.first()["hot"]) == 1
    with_hot = history.fold_notes(archive, master, *_picks(), hot=hot)
    assert _sorted_notes(with_hot) == _sorted_notes(history.fold_notes(archive, master, *_picks()))
    plan = _plan(with_hot)
    # rows of other keys are dealt out before anything is known of their key
    assert "REPARTITION_BY_COL" in plan


def test_what_is_folded_is_written_by_key_without_another_shuffle(spark):
    archive, master = _tables(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for hot in (None, hot_hashes(master, ["key"])):
        plan = _plan(history.fold_notes(archive, master, *_picks(), hot=hot).repartition(n, "key"))
        assert not re.search(r"hashpartitioning\([^)]*\), REPARTITION_BY_NUM", plan)


def test_the_stored_archive_is_dealt_out_once(spark, tmp_path):
    day = F.lit(datetime(1999, 3, 1)).cast("timestamp_ntz")
    n = F.col("id")
    given = {
        "lineitem": spark.range(40).select((n % 20).alias("l_orderkey"), (n % 5).alias("l_partkey"), day.alias("l_shipdate"),
                                           F.lit("R").alias("l_returnflag"), F.lit("F").alias("l_linestatus")),
        "orders": spark.range(20).select(n.alias("o_orderkey"), day.alias("o_orderdate")),
        "part": spark.range(5).select(n.alias("p_partkey"), F.concat(F.lit("p"), n.cast("string")).alias("p_name")),
    }
    for name, df in given.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    per_key = b.history(spark, str(tmp_path)).groupBy("key").agg(F.max("value").alias("value"))
    assert per_key.count() == 20
    plan = _plan(per_key)
    assert len(re.findall(r"hashpartitioning\((?:key|opty)#", plan)) == 1


def test_stored_tables_are_packed(spark, tmp_path):
    from snapfold.sources.store import Store

    store = Store(spark, str(tmp_path))
    store.write("a", spark.range(3), "1")
    store.write_bucketed("b", spark.range(3), "1", "id")
    assert list(tmp_path.glob("a/*/*.zstd.parquet")) and list(tmp_path.glob("b/*/*.zstd.parquet"))
    assert not list(tmp_path.glob("*/*/*.snappy*"))


def test_cells_are_met_in_order_and_do_not_hold_it(spark):
    """Rows of a key are sorted once; only ``also`` compares their order."""
    archive, master = _tables(spark)
    folded = history.fold_notes(archive, master, *_picks(), hot=hot_hashes(master, ["key"]))
    assert re.search(r"Sort \[key#\d+ ASC NULLS FIRST, seq#\d+L ASC NULLS FIRST\]", _plan(folded))


def test_rows_in_any_order_with_blanks_and_without_order(spark):
    layout = "opty string, model string, key string, seq long, `Week 20` string, `Week 21` string, est_qty string, qty double"
    given = [("a", "M", "aM", 3, " \t", "c", "3", 3.0), ("a", "M", "aM", 1, "x", None, "1", 1.0), ("a", "M", "aM", 2, "y", "b", None, 2.0),
             ("a", "M", "aM", None, "never", "never", "9", 9.0), ("b", "M", "bM", None, "never", "", "9", 9.0),
             ("", "", "", 5, "own", "", "5", 5.0), (None, None, None, 6, "own", "", "6", 6.0)]
    given += [("h", "M", "hM", k, f"h{k}" if k < 40 else "", None, str(k), float(k)) for k in range(10, 60)]
    master = spark.createDataFrame(given, layout).repartition(5)
    archive = spark.createDataFrame([("aM", "a", "M", 20, "y"), ("aM", "a", "M", 30, "old"), ("hM", "", "M", 21, "kept"),
                                     ("only", "o", "", 20, "z"),
                                     ("only", "o", "", None, "-"), ("bM", "b", "", None, "-")], "key string, opty string, model string, week int, value string")
    hot = hot_hashes(master, ["key"])
    assert len(hot.first()["hot"]) >= 1
    with_hot = _sorted_notes(history.fold_notes(archive, master, *_picks(), hot=hot))
    assert with_hot == _sorted_notes(history.fold_notes(archive, master, *_picks()))
    of = {r[0]: r for r in with_hot}
    notes = lambda k: [tuple(n) for n in of[k][3]]
    assert notes("aM") == [(20, "y"), (21, "c"), (30, "old")] and [tuple(n) for n in of["aM"][4]] == [(21, "c")]
    assert notes("hM") == [(20, "h39"), (21, "kept")] and of["hM"][1:3] == ("h", "M")
    assert notes("bM") == [] and of["bM"][5] is None and notes("") == [] and notes("only") == [(20, "z")]
    assert tuple(of["aM"][5]) == ("3", " \t") and tuple(of["aM"][6]) == (1.0,)


def test_lists_of_notes_are_gone_through_only_where_a_week_stands_in_both(spark):
    archive, master = _tables(spark)
    text = history.fold_notes(archive, master)._jdf.queryExecution().optimizedPlan().toString()
    assert "arrays_overlap" in text
