"""Streams of commands: frames cut anywhere, keyed state by levels of runs or by the state store, and windowed rates."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidelog.operators.log import latest
from tidelog.operators.resp import parse
from tidelog.operators.runs import VersionedTable, sort_for_reads

COLUMNS = ["key", "seq", "op", "value"]


class RunSink:
    """foreachBatch sink of an ordered log into levels of sorted runs.

    A micro-batch is a run; its level says how many times `flush_bytes` it has, in powers of `most`. When `most` runs of a
    level wait they are merged into one, so a row is written again once for each level, not for each batch. Runs and their
    levels stand in a versioned list, replaced as a whole: readers and restarts see a merge done or not begun. A batch that
    comes again after a failure is one more run of the same writes, which change nothing.

    Tombstones stay unless `late` is given, the promise that no write comes with a seq that far below the largest seen:
    then a merge of all runs leaves out older tombstones, whose keys have no older write anywhere.
    """

    def __init__(self, listed: VersionedTable, folder: str, most: int = 2, flush_bytes: int = 128 << 20, late: int | None = None) -> None:
        if most < 2:
            raise ValueError("a merge takes two runs or more")
        self.listed, self.folder, self.most, self.flush_bytes, self.late = listed, folder.rstrip("/"), most, flush_bytes, late
        self.spark, self.fs = listed.spark, listed.fs

    def __call__(self, batch: DataFrame, number: int) -> None:
        made = self._write(latest(batch).select(*COLUMNS), 0)
        if made:
            runs = self._publish([*self.runs(), made])
            while same := self._crowded(runs):
                runs = self._merge(runs, same)

    def runs(self) -> list[Row]:
        """(path, level, top) of each run, a few for each level; top is its largest seq."""
        held = self.listed.read()
        return [] if held is None else held.collect()

    def read(self, runs: list[Row]) -> DataFrame:
        """The last write of each key in the runs, tombstones too."""
        return latest(self.spark.read.schema("key string, seq bigint, op string, value string").parquet(*[f"{self.folder}/{r.path}" for r in runs]))

    def current(self) -> DataFrame | None:
        """All flushed writes are visible, the newest seq wins."""
        runs = self.runs()
        return self.read(runs) if runs else None

    def finish(self) -> None:
        """The last merge, at a shutdown: one run of all."""
        runs = self.runs()
        if len(runs) > 1:
            self._merge(runs, runs)

    def _crowded(self, runs: list[Row]) -> list[Row]:
        levels = [r.level for r in runs]
        full = [n for n in levels if levels.count(n) >= self.most]
        return [r for r in runs if full and r.level == min(full)]

    def _merge(self, runs: list[Row], some: list[Row]) -> list[Row]:
        merged = self.read(some).select(*COLUMNS)
        if self.late is not None and len(some) == len(runs):
            merged = merged.where((F.col("op") == "SET") | (F.col("seq") >= max(r.top for r in runs) - self.late))
        made = self._write(merged, max(r.level for r in some) + 1)
        kept = self._publish([r for r in runs if r not in some] + ([made] if made else []))
        for r in some:
            self.fs.delete(self._path(r.path), True)
        return kept

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _write(self, rows: DataFrame, least: int) -> Row | None:
        """A sorted run of the rows, of the level that its bytes give but at least `least`; none where there are no rows."""
        name = f"run-{uuid.uuid4().hex}"
        sort_for_reads(rows).write.parquet(f"{self.folder}/{name}")
        top = self.spark.read.schema("seq bigint").parquet(f"{self.folder}/{name}").agg(F.max("seq")).first()[0]
        if top is None:
            self.fs.delete(self._path(name), True)
            return None
        size, level = self.fs.getContentSummary(self._path(name)).getLength(), least
        while size > self.flush_bytes * self.most**level:
            level += 1
        return Row(path=name, level=level, top=top)

    def _publish(self, runs: list[Row]) -> list[Row]:
        self.listed.publish(self.spark.createDataFrame(runs, "path string, level int, top bigint").coalesce(1))
        return runs


def into_runs(stream: DataFrame, sink: RunSink, checkpoint: str) -> StreamingQuery:
    """Starts the ingest of all that is there, then stops; a further start goes on from the checkpoint."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LastWrite(StatefulProcessor):
    """Per key the write with the largest seq; a late older one changes nothing."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "seq bigint, op string, value string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        best = held
        for chunk in rows:
            chunk = chunk[chunk["op"].isin(["SET", "DEL"])]
            if len(chunk):
                r = chunk.loc[chunk["seq"].idxmax()]
                if best is None or r["seq"] > best[0]:
                    best = (int(r["seq"]), r["op"], r["value"] if isinstance(r["value"], str) else None)
        if best is not None and best is not held:
            self.state.update(best)
            yield pd.DataFrame({"key": [key[0]], "seq": [best[0]], "op": [best[1]], "value": [best[2]]})

    def close(self) -> None:
        pass


class Frames(StatefulProcessor):
    """Per connection the number of the next chunk, the commands so far, the unfinished frame, and chunks that came early."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.at = handle.getValueState("at", "n bigint, place bigint, rest binary")
        self.early = handle.getMapState("early", "n bigint", "data binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, place, rest = self.at.get() if self.at.exists() else (0, 0, b"")
        for chunk in rows:
            for number, data in zip(chunk["n"], chunk["data"], strict=True):
                if number >= n:  # one that was taken before comes again
                    self.early.updateValue((int(number),), (bytes(data),))
        rest = bytes(rest)
        while self.early.containsKey((n,)):
            found, rest = parse(rest + bytes(self.early.getValue((n,))[0]))
            self.early.removeKey((n,))
            n += 1
            if found:
                made = pd.DataFrame(found, columns=["op", "key", "value", "corrupt"], dtype=object)
                made.insert(0, "place", range(place, place + len(found)))
                made.insert(0, "conn", key[0])
                place += len(found)
                yield made
        self.at.update((n, place, rest))

    def close(self) -> None:
        pass


def commands(chunks: DataFrame) -> DataFrame:
    """Commands of a stream of (conn, n, data): the chunks of each connection, numbered from 0, cut anywhere and in any order.

    A frame that a chunk leaves unfinished waits in the state store for the rest (needs its RocksDB provider).
    """
    kind = chunks.schema["conn"].dataType.simpleString()
    made = f"conn {kind}, place bigint, op string, key binary, value binary, corrupt binary"
    return chunks.groupBy("conn").transformWithStateInPandas(Frames(), outputStructType=made, outputMode="Append", timeMode="None")


def keyed_state(stream: DataFrame) -> DataFrame:
    """Changes of the keys' last writes, kept in the state store (needs its RocksDB provider)."""
    return stream.groupBy("key").transformWithStateInPandas(LastWrite(), outputStructType="key string, seq bigint, op string, value string", outputMode="Update", timeMode="None")


def rates(stream: DataFrame, ts: str = "ts", late: str = "10 seconds") -> DataFrame:
    """Operations of each second, closed by a watermark."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 second").alias("w")).agg(F.count("*").alias("ops"))
    return counted.select(F.col("w.start").alias("second"), "ops")


def to_console(stream: DataFrame, checkpoint: str) -> StreamingQuery:
    """Prints each closed second."""
    return stream.writeStream.format("console").option("checkpointLocation", checkpoint).outputMode("append").start()
