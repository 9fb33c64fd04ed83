"""The wire protocol: frames from commands, commands from frames.

Lengths are bytes and are honoured, so keys and values may hold anything. A frame that isn't one of the four commands,
or whose lengths don't fit, gives a row with op null and the bytes in `corrupt`; an unfinished frame at the end gives the
rest, for a stream to carry over.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARGUMENTS = {"SET": 2, "GET": 1, "DEL": 1, "WKS": 0}


def part(text: Column) -> Column:
    return F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit("\r\n"), text, F.lit("\r\n"))


def frame(op: Column, key: Column, value: Column) -> Column:
    """The request of a command, by expressions."""
    n = F.when(op == "SET", "3").when(op.isin("GET", "DEL"), "2").otherwise("1")
    return F.concat(F.lit("*"), n, F.lit("\r\n"), part(op), F.when(op == "WKS", "").otherwise(part(key)), F.when(op == "SET", part(value)).otherwise(""))


def parse(data: bytes) -> tuple[list[tuple[str | None, bytes | None, bytes | None, bytes | None]], bytes]:
    """Commands (op, key, value, corrupt) of a buffer, and the bytes of an unfinished one."""
    out, at = [], 0
    while at < len(data):
        found, end = _command(data, at)
        if end is None:  # unfinished
            break
        if found is None:  # resume at the next frame start
            start = data.find(b"\r\n*", at + 1)
            end = len(data) if start < 0 else start + 2
            found = (None, None, None, data[at:end])
        out.append(found)
        at = end
    return out, data[at:]


def _number(data: bytes, at: int, mark: bytes) -> tuple[int | None, int | None]:
    """The number behind a mark and where its line ends; (None, None) if unfinished, (None, 0) if wrong."""
    end = data.find(b"\r\n", at)
    if data[at : at + 1] not in (mark, b""):
        return None, 0
    if end < 0:
        return (None, None) if data[at + 1 :].strip(b"\r").isdigit() or at + 1 >= len(data) else (None, 0)
    digits = data[at + 1 : end]
    return (int(digits), end + 2) if digits.isdigit() else (None, 0)


def _command(data: bytes, at: int):
    n, at = _number(data, at, b"*")
    if n is None:
        return None, None if at is None else 0
    parts = []
    for _ in range(n):
        size, at = _number(data, at, b"$")
        if size is None:
            return None, None if at is None else 0
        if at + size + 2 > len(data):
            return None, None
        if data[at + size : at + size + 2] != b"\r\n":
            return None, 0
        parts.append(data[at : at + size])
        at += size + 2
    op = parts[0].decode("latin-1") if parts else ""
    if ARGUMENTS.get(op) != len(parts) - 1:
        return None, 0
    return (op, *(parts[1:] + [None, None])[:2], None), at


def parse_frames(df: DataFrame, id_column: str, data_column: str) -> DataFrame:
    """Per command its buffer's id, place, op, key, value and corrupt bytes; an unfinished rest is a corrupt row with op REST."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in enumerate(batch.column(1).to_pylist()):
                found, rest = parse(data or b"")
                found += [("REST", None, None, rest)] if rest else []
                rows += [(k, place, *c) for place, c in enumerate(found)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(arrays[0]), *arrays[1:]], names=["id", "place", "op", "key", "value", "corrupt"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(data_column).cast("binary").alias("data"))
    return rows.mapInArrow(run, f"id {kind}, place bigint, op string, key binary, value binary, corrupt binary").withColumnRenamed("id", id_column)


def parse_text(frames: Column) -> Column:
    """Struct of op, key, value of a text frame whose parts hold no line ends, by expressions alone."""
    lines = F.split(frames, "\r\n")
    op = F.get(lines, F.lit(2))
    return F.struct(op.alias("op"), F.when(op.isin("SET", "GET", "DEL"), F.get(lines, F.lit(4))).alias("key"), F.when(op == "SET", F.get(lines, F.lit(6))).alias("value"))
