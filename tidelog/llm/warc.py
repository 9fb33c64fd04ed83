"""WARC archives: a deterministic sharded writer, and a reader, as a data source of the engine.

Records are dealt into ranges of their page id and the hashes of their url and payload, whose bounds come from a sample
chosen by a hash of the three, and sorted in them, so the same rows give the same files. A task writes gzip members, one a
record, as they come, under temporary names and rolls to a new file by compressed size; the commit gives the files their
names and then writes the manifest, which the reader goes by, so an archive without one isn't there. Headers, record ids
and digests are made anew from the rows. An archive that is there is refused, unless it is to be overwritten: then files of
the same names are replaced, and a reader meanwhile fails by the manifest's digests. Neither reading nor writing holds more
than a record and a batch.

Of records with equal payloads of at least `least_bytes`, that with the smallest page id is a response and the others
are revisits of it. Rows with that smallest id and payload, repeated ones among them, are all responses; a null id is
never a revisit; a null payload is empty. Of the url, white space and control characters are percent-encoded in
WARC-Target-URI; such a url is also kept whole in a header of our own, so that reading gives it back. An empty table gives
an archive without files. Only the three columns named are read, so others can't clash. Rows that are equal in all three
columns stay in one task.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote, unquote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .shared import cut, new_path

FORMAT = "warc_shards"
READ = "page_id bigint, url string, payload string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, record_id string, file string"
#: Ranges at most: their bounds, from about 50 places for each, are made in the driver. Larger archives have larger ranges.
MAX_RANGES = 20_000
#: Bytes that the reader takes from a file at a time; rows and payload characters of a batch; renames at a time.
BLOCK, BATCH_ROWS, BATCH_CHARS, RENAMES = 1 << 16, 1000, 4 << 20, 32
#: Where rows without a page id are put.
NO_PAGE = -(1 << 63)
_UNSAFE = re.compile(r"[\s\x00-\x1f\x7f]")
ORIGIN = uuid.UUID("5b7c1f5e-3f0b-5d7c-9a51-5a2f1d1f6a10")


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, digest: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(ORIGIN, f'{page_id}/{digest.hex()}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, date: str) -> bytes:
    """A response record, or with `first` a revisit record without the payload."""
    digest = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    target = None if url is None else _UNSAFE.sub(lambda m: quote(m.group()), url)
    return _record(
        [
            ("WARC-Type", "response" if first is None else "revisit"),
            ("WARC-Record-ID", record_id(page_id, digest)),
            ("WARC-Date", date),
            ("WARC-Target-URI", None if url is None else target),
            ("X-Page-Url", None if target == url else quote(url, safe="")),
            ("WARC-Profile", None if first is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", None if first is None else record_id(first, digest)),
            ("WARC-Payload-Digest", "sha1:" + base32_sha1(digest)),
            ("WARC-Block-Digest", "sha1:" + base32_sha1(hashlib.sha1(block).digest())),
            ("Content-Type", "application/http;msgtype=response"),
            ("X-Page-Id", page_id),
            ("X-Refers-To-Page", first),
            ("X-Payload-Length", len(payload)),
        ],
        block,
    )


def member(record: bytes, level: int = 6) -> bytes:
    """A gzip member with no time in it."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The contents of each gzip member of a stream, read in blocks."""
    z, parts = zlib.decompressobj(31), []
    while block := stream.read(BLOCK):
        while block:
            parts.append(z.decompress(block))
            block = z.unused_data
            if z.eof:
                yield b"".join(parts)
                z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last member has no end")


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzipped file."""
    for raw in members(stream):
        head, _, rest = raw.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_file(stream: BinaryIO) -> Iterator[tuple]:
    """The page records of a file; digests that don't fit raise."""
    for headers, block in records(stream):
        if headers["WARC-Type"] not in ("response", "revisit"):
            continue
        if "sha1:" + base32_sha1(hashlib.sha1(block).digest()) != headers["WARC-Block-Digest"]:
            raise ValueError(f"block digest of {headers['WARC-Record-ID']}")
        payload = block.partition(b"\r\n\r\n")[2] if headers["WARC-Type"] == "response" else None
        stated = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if payload is not None and base32_sha1(hashlib.sha1(payload).digest()) != stated:
            raise ValueError(f"payload digest of {headers['WARC-Record-ID']}")
        number = lambda k, h=headers: int(h[k]) if k in h else None
        url = unquote(headers["X-Page-Url"]) if "X-Page-Url" in headers else headers.get("WARC-Target-URI")
        yield (number("X-Page-Id"), url, None if payload is None else payload.decode(), number("X-Payload-Length"), stated, headers["WARC-Type"], number("X-Refers-To-Page"), headers["WARC-Record-ID"])


class _Summed:
    """A stream that is written or read while the digest and the number of its bytes are kept."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.sum, self.size = stream, hashlib.sha256(), 0

    def _seen(self, data: bytes) -> bytes:
        self.sum.update(data)
        self.size += len(data)
        return data

    def read(self, size: int) -> bytes:
        return self._seen(self.stream.read(size))

    def write(self, data: bytes) -> None:
        self.stream.write(self._seen(data))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str, int, int, str]]  # temporary and final name, records, bytes, sha256


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.roll, self.date = options["path"], int(options["rollbytes"]), options["date"]
        self.temporary = f"_temporary/{uuid.uuid4().hex}"
        self.old = [f.name for f in _manifest(self.path) or []]
        if not overwrite and _manifest(self.path) is not None:
            raise ValueError(f"{self.path} has an archive; write it to another place or overwrite it")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = fs.FileSystem.from_uri(self.path)
        task, files = TaskContext.get().partitionId(), []
        store.create_dir(f"{root}/{self.temporary}")
        out, count, known = None, 0, (None, None)

        def close() -> None:
            out.stream.close()
            files.append((temporary, name, count, out.size, out.sum.hexdigest()))

        for batch in iterator:
            for page, kind, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:  # comes right before the rows that it is of
                    known = (page, url, digest), first
                    continue
                if out is None:
                    name = f"part-{task:05d}-{len(files):05d}.warc.gz"
                    temporary = f"{self.temporary}/{name}-{uuid.uuid4().hex}"
                    out, count = _Summed(store.open_output_stream(f"{root}/{temporary}", compression=None)), 0
                    info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(ORIGIN, name)}>"), ("WARC-Date", self.date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")]
                    out.write(member(_record(info, b"format: WARC File Format 1.1\r\n")))
                refers = known[1] if known[0] == (page, url, digest) else None
                out.write(member(page_record(page, url, (html or "").encode(), refers, self.date)))
                count += 1
                if out.size >= self.roll:
                    close()
                    out = None
        if out is not None:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = fs.FileSystem.from_uri(self.path)
        store.create_dir(root)
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        with ThreadPoolExecutor(RENAMES) as pool:
            list(pool.map(lambda f: store.move(f"{root}/{f[0]}", f"{root}/{f[1]}"), files))
        manifest = [{"file": n, "records": k, "bytes": b, "sha256": s} for _, n, k, b, s in files]
        with store.open_output_stream(f"{root}/{self.temporary}.json", compression=None) as out:
            out.write(json.dumps(manifest, indent=1).encode())
        store.move(f"{root}/{self.temporary}.json", f"{root}/manifest.json")
        for name in set(self.old) - {f[1] for f in files}:
            store.delete_file(f"{root}/{name}")
        self._clean(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(*fs.FileSystem.from_uri(self.path))

    def _clean(self, store: fs.FileSystem, root: str) -> None:
        """Takes this write's temporary files away, and their folder if no other write has any."""
        if store.get_file_info(f"{root}/{self.temporary}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.temporary}")
        if not store.get_file_info(fs.FileSelector(f"{root}/_temporary", allow_not_found=True)):
            with contextlib.suppress(FileNotFoundError):
                store.delete_dir(f"{root}/_temporary")


@dataclass
class File(InputPartition):
    name: str
    sha256: str


def _manifest(path: str) -> list[File] | None:
    """The files of the archive at the path; null if there is none."""
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/manifest.json").type != fs.FileType.File:
        return None
    with store.open_input_stream(f"{root}/manifest.json", compression=None) as f:
        return [File(x["file"], x["sha256"]) for x in json.loads(f.read())]


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[File]:
        files = _manifest(self.path)
        if files is None:
            raise FileNotFoundError(f"{self.path} has no manifest")
        return files

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        """Batches while the file is read; a file that isn't what the manifest says fails at its end."""
        if partition is None or not hasattr(partition, "name"):
            return
        store, root = fs.FileSystem.from_uri(self.path)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in READ.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        with store.open_input_stream(f"{root}/{partition.name}", compression=None) as f:
            stream, rows, size = _Summed(f), [], 0
            for row in read_file(stream):
                rows.append((*row, partition.name))
                size += len(row[2] or "")
                if len(rows) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)
        if stream.sum.hexdigest() != partition.sha256:
            raise ValueError(f"{partition.name} isn't what the manifest says")


class WarcShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return READ

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter({k.lower(): v for k, v in self.options.items()}, overwrite)

    def reader(self, schema) -> WarcReader:
        return WarcReader({k.lower(): v for k, v in self.options.items()})


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, roll_bytes: int = 1 << 30, range_bytes: int = 16 << 20, date: str = "2024-01-01T00:00:00Z", id_column: str = "page_id", url_column: str = "url", html_column: str = "html", overwrite: bool = False) -> None:
    """Writes the pages to an archive at `path`, which all executors must see."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcShards)
    html = F.coalesce(F.col(html_column), F.lit(""))
    rows = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    slim = cut(rows.select("page_id", "url", "digest", F.octet_length("html").cast("bigint").alias("size")), "digests")
    least = slim.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # written first: a join of two plain exchanges, of which the engine can split a frequent digest
    least = cut(least.where("n > 1").drop("n"), "least")
    revisits = slim.join(least, ["digest", "size"]).where("page_id > first").select("page_id", "url", "digest", "first").distinct()
    total, n_rows = slim.agg(F.sum("size"), F.count("*")).first()
    n = max(1, min(MAX_RANGES, -(-(total or 0) // range_bytes)))
    # about 50 different places for each range, chosen by hash; the hashes split an id that has very many rows
    place = [F.coalesce("page_id", F.lit(NO_PAGE)), F.xxhash64("url"), F.xxhash64("digest")]
    one_in = max(1, n_rows // (50 * n))
    chosen = slim.where(F.pmod(F.xxhash64(*place), F.lit(one_in)) == 0).select(*place).distinct()
    places = sorted(tuple(r) for r in chosen.collect())
    bounds = [places[len(places) * k // n] for k in range(1, n)] if places else []

    @F.pandas_udf("int")
    def range_of(page: pd.Series, url: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, p) for p in zip(page.tolist(), url.tolist(), digest.tolist(), strict=True)], dtype="int32")

    both = revisits.selectExpr("page_id", "0 as kind", "url", "cast(null as string) as html", "digest", "first")
    both = both.unionByName(rows.selectExpr("page_id", "1 as kind", "url", "html", "digest", "cast(null as bigint) as first"))
    dealt = both.withColumn("__range", range_of(*place)).repartitionById(n, F.col("__range")).drop("__range")
    ordered = dealt.sortWithinPartitions("page_id", *place[1:], "url", "digest", "kind")
    ordered.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("path", path).option("rollBytes", str(roll_bytes)).option("date", date).save()


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive's page records; `payload` is null for revisits."""
    spark.dataSource.register(WarcShards)
    return spark.read.format(FORMAT).option("path", path).load()


def round_trip(pages: DataFrame) -> DataFrame:
    path = new_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return read_archive(pages.sparkSession, path)
