"""Binary run files: a header of value length << 32 | key length, key, value, padded to 8; all ones for a tombstone."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: the length of a tombstone, and records for each entry of the sparse index.
TOMBSTONE = 0xFFFFFFFF
INDEX_EVERY = 1024


def encode_records(records: list[tuple[bytes, bytes | None]]) -> bytes:
    """A run in descending key order."""
    out = bytearray()
    for key, value in sorted(records, key=lambda r: r[0], reverse=True):
        out += struct.pack("<II", len(key), TOMBSTONE if value is None else len(value)) + key + (value or b"")
        out += bytes(-len(out) % 8)
    return bytes(out)


def decode_records(data: bytes) -> Iterator[tuple[int, bytes, bytes | None]]:
    """(offset, key, value) until the data ends, is cut off, or has an empty key."""
    at = 0
    while at + 8 <= len(data):
        key_size, value_size = struct.unpack_from("<II", data, at)
        size = 0 if value_size == TOMBSTONE else value_size
        if not key_size or at + 8 + key_size + size > len(data):
            return
        key = data[at + 8 : at + 8 + key_size]
        yield at, key, None if value_size == TOMBSTONE else data[at + 8 + key_size : at + 8 + key_size + size]
        at += (8 + key_size + size + 7) // 8 * 8


def encode_index(data: bytes) -> bytes:
    """The sparse index of a run: key length, offset, key, padded to 8."""
    out = bytearray()
    for k, (at, key, _) in enumerate(decode_records(data)):
        if k % INDEX_EVERY == 0:
            out += struct.pack("<IQ", len(key), at) + key
            out += bytes(-len(out) % 8)
    return bytes(out)


def decode_index(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, key) of the entries of a sparse index, until the data ends or is cut off."""
    at = 0
    while at + 12 <= len(data):
        size, offset = struct.unpack_from("<IQ", data, at)
        if not size or at + 12 + size > len(data):
            return
        yield offset, data[at + 12 : at + 12 + size]
        at += (12 + size + 7) // 8 * 8


def run_of(file: str) -> Column:
    """The run's number, from the name of a file that write_dumps made."""
    return F.regexp_extract(file, r"_chunk_(\d+)\.", 1).cast("bigint")


def write_dumps(runs: DataFrame, path: str) -> str:
    """A data and an index file for each run in a folder that all executors see, under names of their own until whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root)
        for batch in batches:
            for number, *files in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for data, end in zip(files, ("bin", "idx"), strict=True):
                    name = f"{root}/shard_0_chunk_{number}.{end}"
                    temporary = f"{name}.{uuid.uuid4().hex}.tmp"
                    with store.open_output_stream(temporary, compression=None) as out:
                        out.write(data)
                    store.move(temporary, name)
            yield batch.select([0])

    dumped(runs).mapInArrow(run, "run bigint").write.format("noop").mode("overwrite").save()
    return path


def read_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Entries of index files: file, rn (the record's number), offset, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(file, k * INDEX_EVERY, at, key) for file, data in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, (at, key) in enumerate(decode_index(data))]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["file", "rn", "offset", "key"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, rn bigint, offset bigint, key binary")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Records of run files: file, length, offset, key, op, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [(file, length, at, key, "DEL" if value is None else "SET", value) for at, key, value in decode_records(data)]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["file", "length", "offset", "key", "op", "value"])

    files = spark.read.format("binaryFile").load(path).select(F.col("path"), "length", "content")
    return files.mapInArrow(run, "file string, length bigint, offset bigint, key binary, op string, value binary")


def dumped(runs: DataFrame) -> DataFrame:
    """Per run its bytes in the binary format; a run is bounded by the flush that makes it."""
    packed = runs.groupBy("run").agg(F.collect_list(F.struct(F.col("key").cast("binary").alias("key"), F.when(F.col("op") == "SET", F.col("value").cast("binary")).alias("value"))).alias("rs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [encode_records([(r["key"], r["value"]) for r in rs]) for rs in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array([encode_index(d) for d in data], pa.binary())], names=["run", "data", "index"])

    return packed.mapInArrow(run, "run bigint, data binary, index binary")
