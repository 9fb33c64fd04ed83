"""Sorted runs, compaction, the sparse index, and versioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.functions.hashing import aligned
from tidelog.operators.log import WRITES, latest


def snapshot(log: DataFrame, rows: int) -> DataFrame:
    """Flushes: of each `rows` seq numbers a run with the last write of each key, tombstones too."""
    writes = log.where(F.col("op").isin(*WRITES)).withColumn("run", F.expr(f"seq div {rows}"))
    last = writes.groupBy("run", "key").agg(F.max_by(F.struct("op", "value"), "seq").alias("w"), F.max("seq").alias("seq"))
    return last.select("run", "key", "seq", "w.op", "w.value")


def write_runs(runs: DataFrame, path: str, shards: int | None = None) -> None:
    """Each run a folder, keys descending in its files; with shards also a folder of each shard."""
    from tidelog.functions.hashing import shard

    by = ["run"]
    if shards:
        runs, by = runs.withColumn("shard", shard(F.col("key"), shards)), ["shard", "run"]
    runs.repartition(*by).sortWithinPartitions(*by, F.desc("key")).write.partitionBy(*by).parquet(path)


def compact(runs: DataFrame) -> DataFrame:
    """Merges runs and base: of equal keys the newest stays, tombstones go."""
    newest = runs.groupBy("key").agg(F.max_by(F.struct("op", "value"), F.struct("run", "seq")).alias("w"))
    return newest.where("w.op = 'SET'").select("key", "w.value")


def recover(runs: DataFrame) -> DataFrame:
    """The state from runs that were never compacted, in the order of their numbers."""
    return latest(runs)


def record_bytes(key: Column, value: Column) -> Column:
    """A record's bytes in a run: header, key and value, padded to 8."""
    return aligned(8 + F.octet_length(key) + F.coalesce(F.octet_length(value), F.lit(0)))


def sparse_index(records: DataFrame, every: int = 1024, *keys: str) -> DataFrame:
    """Every so many records in descending key order: (rn, key), per group if there are keys."""
    if keys:
        numbered = records.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("key"))) - 1)
    else:
        from tidelog.operators.ranking import ranked

        numbered = ranked(records, [("key", False)], "rn")
    return numbered.where(F.col("rn") % every == 0).select(*keys, "rn", "key")


def sort_for_reads(records: DataFrame) -> DataFrame:
    """The records dealt into ranges of keys, descending in each: a file of the written table is one range or a part of it."""
    return records.repartitionByRange(F.desc("key")).sortWithinPartitions(F.desc("key"))


def file_index(spark: SparkSession, path: str, every: int = 1024) -> DataFrame:
    """Every so many records of each file of a table that was written sorted: file, rn (the place in it), key."""
    rows = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("rn"), "key")
    return rows.where(F.col("rn") % every == 0)


def indexed_lookup(base: DataFrame, index: DataFrame, key: str, every: int = 1024) -> DataFrame:
    """A point read of a sorted table of unique keys: the entry with the smallest key that isn't below names file and place.

    Of that file the row groups whose statistics exclude the key aren't read; a file holds no key of another's range.
    """
    entry = index.where(F.col("key") >= key).agg(F.min_by(F.struct("file", "rn"), "key").alias("e")).first()["e"]
    if entry is None:  # above all keys
        return base.limit(0)
    place, spark = F.col("_metadata.row_index"), base.sparkSession
    return spark.read.schema(base.schema).parquet(entry["file"]).where((F.col("key") == key) & (place >= entry["rn"]) & (place < entry["rn"] + every))


def run_files(paths: DataFrame, workers: int) -> DataFrame:
    """Run files by shard from (path, length): names of another form, and shards that aren't there, are left out."""
    form = r"shard_(\d+)_chunk_(\d+)\.bin$"
    named = paths.where(F.col("path").rlike(form)).select(F.regexp_extract("path", form, 1).cast("int").alias("shard"), F.regexp_extract("path", form, 2).cast("int").alias("chunk"), "length")
    return named.where(F.col("shard") < workers).groupBy("shard").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"), F.sum("length").alias("bytes"))


class VersionedTable:
    """A table whose versions are folders; a pointer names the current one, so readers never see a half-written base."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(path)

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def versions(self) -> list[str]:
        """Published versions, oldest first: pointers are empty files named in order."""
        found = [s.getPath().getName() for s in self.fs.listStatus(self._path(""))] if self.fs.exists(self._path("")) else []
        return [n.removeprefix("at-").split("-", 1)[1] for n in sorted(n for n in found if n.startswith("at-"))]

    def read(self) -> DataFrame | None:
        names = self.versions()
        return self.spark.read.parquet(f"{self.root}/{names[-1]}") if names else None

    def publish(self, df: DataFrame, keep: int = 2) -> str:
        """Writes a new version, then its pointer; the folders of versions beyond the newest `keep` go."""
        before = self.versions()
        name = f"v{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        self.fs.create(self._path(f"at-{len(before):010d}-{name}"), False).close()
        for old in before[: max(0, len(before) + 1 - keep)]:
            self.fs.delete(self._path(old), True)
        return name
