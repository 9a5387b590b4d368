"""Replay as a stream: every new export file is one micro-batch, folded into the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from snapfold.config import Config
from snapfold.plans.replay import fold_file
from snapfold.sources.records import file_name
from snapfold.sources.store import Store


def stream_exports(spark: SparkSession, path: str, store: Store, checkpoint: str, config: Config = Config(),
                   glob: str = "*", separator: str = ",") -> StreamingQuery:
    """Fold export files in order of their time; one file per micro-batch, which names the file to read in splits.

    A batch that runs again after a failure starts from the same earlier version and writes
    the same folders, so every file counts once.
    """
    arriving = spark.readStream.option("maxFilesPerTrigger", 1).option("pathGlobFilter", glob).text(path)
    files = arriving.select(
        F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("snapshot_time"),
        file_name().alias("file"),
    )

    def fold(batch: DataFrame, _batch_id: int) -> None:
        newest = batch.agg(F.max(F.struct("snapshot_time", "file")).alias("t")).first()["t"]
        if newest is not None:
            fold_file(store, newest["file"], newest["snapshot_time"], config, separator)

    return (
        files.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
