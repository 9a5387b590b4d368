"""Helpers the text operators share: Arrow column functions, written tables, look-ups that survive hot keys."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from snapfold.session import work_folder

#: Rows of a key that one task takes without being spread.
ROWS_PER_TASK = 100_000
#: Texts of an Arrow batch that are Python objects at a time.
SLICE_ROWS = 256
#: Keys that are spread over several tasks, at most.
MAX_HOT_KEYS = 1_000


def let_workers_import(spark: SparkSession) -> None:
    """Python workers of a local session find this package where the driver has it, whatever folder it was started in.

    On a cluster the package comes with ``--py-files`` or is installed; the entry then names a folder that is not there.
    """
    environment, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def text_function(make: Callable[[], Callable[[list], pa.Array]], returns: str) -> Callable[[str], Column]:
    """Column function over whole texts, fed to Python in Arrow batches.

    ``make`` runs once per task and gives a function from a list of UTF-8 bytes (None for null) to an Arrow
    array of the same length; it gets ``SLICE_ROWS`` texts at a time, so that only these exist as Python objects. The
    column counts as non-deterministic, so that a filter on it does not run it twice.
    """

    @F.arrow_udf(returns)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        convert = make()
        for batch in batches:
            parts = [batch.slice(k, SLICE_ROWS) for k in range(0, max(len(batch), 1), SLICE_ROWS)]
            yield pa.concat_arrays([convert(part.cast(pa.large_binary()).to_pylist()) for part in parts])

    let_workers_import(SparkSession.getActiveSession())
    function = run.asNondeterministic()
    return lambda text: function(F.col(text).cast("string"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    name, n = f"__{stem}", 0
    while name in taken:
        n += 1
        name = f"__{stem}{n}"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, and lost executors do not lose it."""
    spark = df.sparkSession
    let_workers_import(spark)
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_lookup(rows: DataFrame, values: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` inner join ``values`` (one row per key, with the key's number of rows in ``count``) on ``key``.

    Keys with far more rows than a task should take are dealt over several tasks and only their value row is
    repeated. The limit rises with the input, so at most ``MAX_HOT_KEYS`` keys are hot and can be broadcast. A row's place
    follows from its columns, so a task that runs again deals its rows as before.
    """
    total = values.agg(F.sum(count)).first()[0] or 0
    limit = max(ROWS_PER_TASK, total // MAX_HOT_KEYS)
    parts, salt = free_name(rows, "parts"), free_name(rows, "salt")
    share = F.ceil(F.col(count) / F.lit(limit)).cast("int")
    hot = F.broadcast(values.filter(F.col(count) > limit).select(key, share.alias(parts)))
    dealt = rows.join(hot, key, "left").withColumn(
        salt, F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col(parts)).cast("int"), F.lit(0))
    )
    repeated = values.withColumn(salt, F.explode(F.sequence(F.lit(0), F.greatest(share, F.lit(1)) - 1)))
    return dealt.join(repeated.drop(count), [key, salt]).drop(parts, salt)
