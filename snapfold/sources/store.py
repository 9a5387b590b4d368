"""Versioned tables of the tracking state.

Every run writes new folders and never touches what it reads. A run becomes visible when its
version is added to the list of runs, which happens last; a run that dies leaves folders
nobody reads, and running it again writes the same version anew.

Tables that a run changes only here and there are kept as changes: a version holds the rows it adds, replaces or takes
away, and a full copy is made again after :data:`FULL_EVERY` versions. Those tables, and what is looked up in them, lie in
hash buckets of their key, so that reading and joining them by key needs no shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Tables kept as changes: what they are bucketed by, and what tells their rows apart.
CHANGED_TABLES = {"history": ("key", ("key", "week")), "owner_counts": ("owner", ("owner", "week"))}
#: Versions of which one is a full copy.
FULL_EVERY = 16

_RUNS = "n long, version string, previous string"
_PARTS = "name string, version string, base string, buckets int, layout string"
_GONE = "gone"
#: Fixed value: written once and read by every later run, so smaller files are worth the time of packing them.
_COMPRESSION = "zstd"


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        """``buckets`` of bucketed tables, by default as many as the session has shuffle partitions. Where it differs from
        what a table has, the next version of that table is a full copy in the new number of buckets."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def _path(self, name: str, version: str) -> str:
        return f"{self.root}/{name}/version={version}"

    def _listed(self, name: str, layout: str) -> DataFrame:
        try:
            return self.spark.read.schema(layout).parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], layout)

    def versions(self) -> DataFrame:
        """Committed runs in order of ``n``: the version and the one it started from."""
        return self._listed("runs", _RUNS)

    def latest(self, before: str | None = None) -> str | None:
        """The version committed last; with ``before``, the one that a run of that version starts from."""
        runs = self.versions()
        if before is not None:
            own = runs.filter(F.col("version") == before).agg(F.max_by("previous", "n"), F.count("*")).first()
            if own[1]:
                return own[0]
        return runs.agg(F.max_by("version", "n").alias("v")).first()["v"]

    def commit(self, version: str, previous: str | None = None) -> None:
        """Make a version visible. Committing it again changes neither its place nor where it started from."""
        runs = self.versions().agg(F.max("n"), F.count_if(F.col("version") == version)).first()
        if not runs[1]:
            row = [((runs[0] or 0) + 1, version, previous)]
            self.spark.createDataFrame(row, _RUNS).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")

    # ------------------------------------------------------------ whole tables

    def write(self, name: str, df: DataFrame, version: str, sort_by=()) -> DataFrame:
        """Write one table of a version and return it as read back, with a short lineage."""
        out = df.repartitionByRange(*sort_by).sortWithinPartitions(*sort_by) if sort_by else df
        out.write.mode("overwrite").option("compression", _COMPRESSION).parquet(self._path(name, version))
        return self.spark.read.parquet(self._path(name, version))

    def read(self, name: str, version: str) -> DataFrame:
        """One table as it stands after a version."""
        if name in CHANGED_TABLES:
            return self._changed(name, version)
        return self.spark.read.parquet(self._path(name, version))

    def read_all(self, name: str, upto: str | None = None) -> DataFrame:
        """What all committed versions of a table hold together, up to ``upto`` where given: one table partitioned by version.

        For tables to which every version adds. Versions that were never committed are left out.
        """
        runs = self.versions()
        if upto is not None:
            place = runs.filter(F.col("version") == upto).agg(F.min("n")).scalar()
            runs = runs.filter(F.col("n") <= place)
        last = upto or self.latest()
        if last is None:
            raise LookupError(f"no version of {name} is committed")
        # the layout is given, so that version names stay text
        layout = self.read(name, last).schema.add("version", "string")
        whole = self.spark.read.schema(layout).parquet(f"{self.root}/{name}")
        return whole.join(runs.select("version"), "version", "left_semi").drop("version")

    # ------------------------------------------------------------ bucketed tables

    def _bucketed(self, table: str, layout: str, key: str, buckets: int, path: str, partitioned: str = "") -> str:
        """Tell the catalog of files in buckets; nothing is read or written."""
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({layout}) USING parquet OPTIONS (compression '{_COMPRESSION}') {partitioned} "
            f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        return table

    def _table(self, name: str, layout: str, key: str, buckets: int) -> str:
        """The catalog's name of one table over all version folders."""
        digest = hashlib.sha256(f"{self.root}|{buckets}|{layout}".encode()).hexdigest()[:16]
        path, parts = f"{self.root}/{name}", "PARTITIONED BY (version)"
        return self._bucketed(f"snapfold_{name}_{digest}", f"{layout}, version STRING", key, buckets, path, parts)

    def write_bucketed(self, name: str, df: DataFrame, version: str, key: str) -> DataFrame:
        """Write one table of a version in buckets of ``key`` and return it so that reading it by ``key`` needs no shuffle.

        For tables whose keys hold few rows each: all rows of a key share a file.
        """
        layout, folder = df.schema.toDDL(), self._path(name, version)
        target = self._bucketed(f"snapfold_new_{uuid.uuid4().hex}", layout, key, self.buckets, folder)
        try:
            df.repartition(self.buckets, key).write.mode("overwrite").insertInto(target)
        finally:
            self.spark.sql(f"DROP TABLE {target}")  # the files stay
        return self._parts_of(self._table(name, layout, key, self.buckets), [version]).drop("version")

    def _parts_of(self, table: str, versions: list[str]) -> DataFrame:
        self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")  # versions that other sessions have written
        self.spark.catalog.refreshTable(table)
        return self.spark.table(table).filter(F.col("version").isin(*versions))

    # ------------------------------------------------------------ tables kept as changes

    def _chain(self, name: str, version: str) -> tuple[list[str], int, StructType] | None:
        """The versions that make up a table, full copy first, its number of buckets and its layout."""
        parts = self._listed("parts", _PARTS).filter(F.col("name") == name).distinct()
        base = parts.filter(F.col("version") == version).select("base").limit(1)
        same = parts.join(base, "base").join(self.versions().select("version", "n"), "version", "left").collect()
        own = next((r for r in same if r.version == version), None)
        if own is None:
            return None
        # a run that is not committed yet comes after all that are
        before = [r for r in same if r.version != version and r.n is not None and (own.n is None or r.n < own.n)]
        return [*(r.version for r in sorted(before, key=lambda r: r.n)), version], own.buckets, StructType.fromDDL(own.layout)

    def write_changes(self, name: str, full: DataFrame, changes: DataFrame, gone: DataFrame, version: str,
                      previous: str | None) -> None:
        """The next version of a table in :data:`CHANGED_TABLES`: the rows that are new or different, and the ids that go.

        ``full`` is the whole new table, written instead where a full copy is due (none was made yet, the last one is
        :data:`FULL_EVERY` versions old, the number of buckets has changed); else it is not computed.
        """
        key, ids = CHANGED_TABLES[name]
        known = self._chain(name, previous) if previous else None
        if known is None or len(known[0]) >= FULL_EVERY or known[1] != self.buckets:
            base, rows = version, full.withColumn(_GONE, F.lit(False))
            layout = rows.schema
        else:
            base, layout = known[0][0], known[2]
            taken = gone.select(*ids, *(F.lit(None).cast(f.dataType).alias(f.name) for f in layout if f.name not in (*ids, _GONE)))
            rows = changes.withColumn(_GONE, F.lit(False)).unionByName(taken.withColumn(_GONE, F.lit(True)))
            rows = rows.select(layout.names)
        self.write_bucketed(name, rows, version, key)
        part = self.spark.createDataFrame([(name, version, base, self.buckets, layout.toDDL())], _PARTS)
        part.coalesce(1).write.mode("append").parquet(f"{self.root}/parts")

    def _changed(self, name: str, version: str) -> DataFrame:
        """A table in :data:`CHANGED_TABLES` as its full copy and the changes since make it; the last change of a row counts."""
        chain = self._chain(name, version)
        if chain is None:
            return self.spark.read.parquet(self._path(name, version))
        versions, buckets, layout = chain
        key, ids = CHANGED_TABLES[name]
        parts = self._parts_of(self._table(name, layout.toDDL(), key, buckets), versions)
        if len(versions) == 1:
            return parts.drop(_GONE, "version")
        place = F.element_at(F.create_map(*(F.lit(v) for k, name_ in enumerate(versions) for v in (name_, k))), F.col("version"))
        rest = [f.name for f in layout if f.name not in ids]
        last = parts.groupBy(*ids).agg(F.max_by(F.struct(*rest), place).alias("last"))
        return last.filter(~F.col(f"last.{_GONE}")).select(*(c if c in ids else f"last.{c}" for c in layout.names if c != _GONE))
