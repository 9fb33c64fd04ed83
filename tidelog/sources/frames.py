"""Sources of commands: captured frame files in a folder, as a batch or a stream, and a live socket."""

from __future__ import annotations

import socket
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, DataSourceStreamReader

from tidelog.operators.resp import parse

SCHEMA = "source string, place bigint, op string, key binary, value binary, corrupt binary"


@dataclass
class FrameFile(InputPartition):
    path: str


def _files(folder: str) -> list[str]:
    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def _commands(folder: str, name: str) -> Iterator[tuple]:
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}", compression=None) as f:
        found, rest = parse(f.read())
    for place, c in enumerate(found + ([("REST", None, None, rest)] if rest else [])):
        yield (name, place, *c)


class FrameReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[FrameFile]:
        return [FrameFile(n) for n in _files(self.folder)]

    def read(self, partition: FrameFile) -> Iterator[tuple]:
        if isinstance(partition, FrameFile):
            yield from _commands(self.folder, partition.path)


class FrameStream(DataSourceStreamReader):
    """The files that are there, a partition each, at most `most_bytes` of them in a batch, but one at least.

    The offset is the modification time and name of the last file taken, and the names taken of that time: a file that
    comes later is read whatever its name.
    """

    def __init__(self, folder: str, most_bytes: int) -> None:
        self.folder, self.most_bytes, self.at = folder, most_bytes, {"time": 0, "names": []}

    def _after(self, start: dict) -> list[tuple[int, str, int]]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        files = sorted((f.mtime_ns or 0, f.base_name, f.size or 0) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))
        return [f for f in files if f[0] > start["time"] or (f[0] == start["time"] and f[1] not in start["names"])]

    def initialOffset(self) -> dict:
        return {"time": 0, "names": []}

    def latestOffset(self) -> dict:
        taken, size = self.at, 0
        for time, name, length in self._after(self.at):
            if size and size + length > self.most_bytes:
                break
            size += length
            taken = {"time": time, "names": [*(taken["names"] if taken["time"] == time else []), name]}
        return taken

    def partitions(self, start: dict, end: dict) -> list[FrameFile]:
        self.at = end
        return [FrameFile(n) for t, n, _ in self._after(start) if t < end["time"] or (t == end["time"] and n in end["names"])]

    def commit(self, end: dict) -> None:
        self.at = end

    def read(self, partition: FrameFile) -> Iterator[tuple]:
        if isinstance(partition, FrameFile):
            yield from _commands(self.folder, partition.path)


class RespFrames(DataSource):
    """Format resp_frames; option path, and for a stream maxBytes of a batch."""

    @classmethod
    def name(cls) -> str:
        return "resp_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options["path"])

    def streamReader(self, schema) -> FrameStream:
        return FrameStream(self.options["path"], int(self.options.get("maxBytes", str(1 << 30))))


@dataclass
class Connection(InputPartition):
    port: int


class SocketReader(DataSourceReader):
    """Takes one connection on each port, a partition each, until the client ends it."""

    def __init__(self, host: str, ports: list[int]) -> None:
        self.host, self.ports = host, ports

    def partitions(self) -> list[Connection]:
        return [Connection(p) for p in self.ports]

    def read(self, partition: Connection) -> Iterator[tuple]:
        rest, place = b"", 0
        with socket.create_server((self.host, partition.port)) as server:
            connection, _ = server.accept()
            with connection:
                while data := connection.recv(1 << 16):
                    found, rest = parse(rest + data)
                    for c in found:
                        yield (f"{self.host}:{partition.port}", place, *c)
                        place += 1
        if rest:
            yield (f"{self.host}:{partition.port}", place, "REST", None, None, rest)


class RespSocket(DataSource):
    """Format resp_socket; options host, port, workers: ports port, port + 1, ..., one a shard."""

    @classmethod
    def name(cls) -> str:
        return "resp_socket"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SocketReader:
        first = int(self.options.get("port", "6380"))
        return SocketReader(self.options.get("host", "127.0.0.1"), [first + k for k in range(int(self.options.get("workers", "1")))])


def chunks(spark: SparkSession, folder: str, most_bytes: int = 128 << 20) -> DataFrame:
    """A stream of (conn, n, data) of the files `<connection>.<number>.resp` in a folder, numbered from 0 for each connection.

    What a connection sent may be cut anywhere between its files; streaming.ingest.commands carries frames over.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    files = files.option("pathGlobFilter", "*.resp").option("maxBytesPerTrigger", most_bytes).load(folder)
    form = r"([^/]+)\.(\d+)\.resp$"
    named = files.where(F.col("path").rlike(form))
    return named.select(F.regexp_extract("path", form, 1).alias("conn"), F.regexp_extract("path", form, 2).cast("bigint").alias("n"), F.col("content").alias("data"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RespFrames)
    spark.dataSource.register(RespSocket)
