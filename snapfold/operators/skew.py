"""Joins and lookups that stay balanced when a few keys hold much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Counters of the sketch for each key that may be hot, and the shares of a partition that make a key hot.
_TRACKED_PER_KEY = 16
_HOT_SHARES = 4.0


def _shuffle_partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def hot_hashes(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row with a map: hash of a key that holds far more than a partition's share -> its share in partitions.

    A frequent-items sketch finds them in one pass with partial aggregation; its size follows the number of partitions,
    so a key is hot at the same multiple of a partition's share whatever that number is. It decides only how rows are
    spread, never what they are.
    """
    partitions = _shuffle_partitions(df)
    reported = max(16, -(-partitions // int(_HOT_SHARES)))  # no more keys than that can hold the share
    tracked = min(max(1024, _TRACKED_PER_KEY * reported), 1_000_000)
    sketch = df.select(F.xxhash64(*keys).alias("h")).agg(
        F.expr(f"approx_top_k(h, {reported}, {tracked})").alias("top"),
        F.count("*").alias("n"),
    )
    fair = F.col("n") / F.lit(partitions)
    limit = F.least(F.lit(_HOT_SHARES) * fair, F.col("n") * F.lit(0.1))
    hot = F.filter("top", lambda t: t["count"] > limit)
    shares = lambda t: F.ceil(t["count"] / fair).cast("int")
    return sketch.select(F.map_from_entries(F.transform(hot, lambda t: F.struct(t["item"], shares(t)))).alias("hot"))


def is_hot(hot: DataFrame, on: list[str]) -> Column:
    """Whether a row's key is one of :func:`hot_hashes`."""
    return F.coalesce(F.map_contains_key(hot.scalar(), F.xxhash64(*on)), F.lit(False))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    hot: DataFrame | None = None,
) -> DataFrame:
    """Left outer join to a ``right`` that has one row per key.

    Skewed partitions of ``left`` are split by Spark at run time, which takes no second look at the data; that needs both
    sides to be shuffled. Where ``right`` lies in buckets it is not, so a caller gives ``hot``, its hot keys: rows of
    those, of which there are no more than :func:`hot_hashes` reports, meet their few ``right`` rows by broadcast, and
    all others by key.
    """
    if hot is None:
        return left.join(right, on, "left")
    spread = left.filter(is_hot(hot, on)).join(F.broadcast(right.filter(is_hot(hot, on))), on, "left")
    return left.filter(~is_hot(hot, on)).join(right, on, "left").unionByName(spread)
