import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from snapfold.operators import lookup, skew

MASTER = ("key string, seq int, est_qty string, revenue string, quarter_invoice string, forecast string, "
          "next_step string, qty double, sales_price double, total_price double")


def master(spark, *records):
    names = [c.split()[0] for c in MASTER.split(", ")]
    blank = {"quarter_invoice": "", "forecast": "", "next_step": "", "est_qty": "", "revenue": "",
             "qty": None, "sales_price": None, "total_price": None}
    return spark.createDataFrame([tuple({**blank, **r}[n] for n in names) for r in records], MASTER)


def pipe(spark, *keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, seq int")


def test_the_last_row_wins_even_when_blank(spark):
    m = master(spark, {"key": "k", "seq": 1, "next_step": "x"}, {"key": "k", "seq": 2, "next_step": None},
               {"key": "j", "seq": 3, "next_step": " y\n"})
    found = lookup.carry_forward_last(pipe(spark, "k", "j", "new", None), m, ["next_step"])
    assert {r["key"]: r["next_step"] for r in found.collect()} == {"k": "", "j": "y", "new": "", None: ""}


@pytest.mark.parametrize("last, first_qty, expected", [
    ("=A1", 7.0, 7.0), ("", 7.0, 7.0), ("  ", 7.0, 7.0), (None, 7.0, 7.0), ("EUR 12", 7.0, 12.0), ("0", 7.0, 0.0),
    ("=A1", 0.0, None), ("", None, None), ("odd", 7.0, 0.0),
])
def test_quantity(spark, last, first_qty, expected):
    m = master(spark, {"key": "k", "seq": 1, "qty": first_qty, "est_qty": "99"},
               {"key": "k", "seq": 2, "qty": 5.0, "est_qty": last})
    assert lookup.carry_forward_qty(pipe(spark, "k"), m).first()["est_qty"] == expected
    assert lookup.carry_forward_qty(pipe(spark, "other"), m).first()["est_qty"] is None


def test_quantity_stored_as_number(spark):
    m = master(spark, {"key": "k", "seq": 1, "qty": 3.0}).withColumn("est_qty", F.lit(12345678.9))
    assert lookup.carry_forward_qty(pipe(spark, "k"), m).first()["est_qty"] == 12345678.9


@pytest.mark.parametrize("last, expected", [("", None), (None, None), ("=Q5*I5", 40.0), ("100", 6.0)])
def test_revenue(spark, last, expected):
    m = master(spark, {"key": "k", "seq": 1, "est_qty": "2", "sales_price": 3.0, "total_price": 40.0},
               {"key": "k", "seq": 2, "revenue": last, "est_qty": "5", "sales_price": 7.0, "total_price": 9.0})
    assert lookup.carry_forward_revenue(pipe(spark, "k"), m).first()["revenue_carried"] == expected


def test_hot_keys_are_found_and_spread(spark):
    random.seed(1)
    records = [("hot" if i % 3 == 0 else f"k{random.randrange(5000)}", i) for i in range(30_000)]
    left = spark.createDataFrame(records, "key string, seq int")
    right = left.select("key").distinct().withColumn("v", F.length("key"))
    hot = skew.hot_hashes(left, ["key"]).first()["hot"]
    assert list(hot) == [spark.range(1).select(F.xxhash64(F.lit("hot")).alias("h")).first()["h"]]
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.lookup_join(left, right, ["key"], skew.hot_hashes(left, ["key"]))
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert rows(joined) == rows(left.join(right, "key", "left"))
        assert max(sizes) < 30_000 / 6
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_key_of_a_thousandth_is_hot_where_partitions_are_many(spark):
    left = spark.range(200_000).select(F.when(F.col("id") % 1000 == 0, -1).otherwise(F.col("id")).alias("key"))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "20000")
    try:
        hot = skew.hot_hashes(left, ["key"]).first()["hot"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    key = spark.range(1).select(F.xxhash64(F.lit(-1).cast("long")).alias("h")).first()["h"]
    assert 20 <= hot[key] <= 25  # 20 shares of a partition


def test_hot_null_keys_do_not_match(spark):
    left = spark.createDataFrame([(None, i) for i in range(2000)] + [("a", 1)], "key string, seq int")
    right = spark.createDataFrame([("a", 1)], "key string, v int")
    joined = skew.lookup_join(left, right, ["key"])
    assert joined.count() == 2001 and joined.filter("v is not null").count() == 1


def test_plans_hold_no_cartesian_product_and_no_python(spark):
    left = spark.range(100).select(F.col("id").cast("string").alias("key"), "id")
    text = skew.lookup_join(left, left.select("key"), ["key"])._jdf.queryExecution().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text and "PythonUDF" not in text
