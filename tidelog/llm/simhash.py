"""SimHash near-duplicates: fingerprints, links by pivot distance tables, connected groups.

Pairs meet in buckets: 64 bits are cut into limit + 3 blocks, and two fingerprints that differ in at most `limit` bits
agree on some three whole blocks, so every link shows in a bucket keyed by three blocks. A bucket of more than HOT_BUCKET
fingerprints is dealt again in the same way: its other bits are cut into limit + 2 blocks, of which a linked pair agrees
on some two.

For the fingerprints of a run of buckets a table of their Hamming distances to the reference fingerprints (pivots) is
computed once. Two fingerprints at distance d differ by at most d in each coordinate of that table, so a pair whose
largest coordinate difference is over the limit is discarded, and only survivors are compared bit by bit. In a larger
bucket, a search from each fingerprint takes out what it reaches, so a bucket gives a spanning forest, never all pairs.
Copies share a fingerprint and are one node. Fingerprints that agree on so many bits that the second deal leaves them
together too are searched in one task.

Null and empty texts have fingerprint zero and link like any other. Repeated rows and ties are members of the same
group; a null id never is the smallest unless a group has no other; an empty table gives an empty one; only the id and
text columns are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, folded, map_batches

#: The reference fingerprints: pseudo-random words from a fixed seed.
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 24, np.uint64)
#: Fingerprints of a bucket beyond which it is dealt again.
HOT_BUCKET = 4096
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_LANES = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """A bit is 1 if over half of the hashes of the text's word shingles have it."""
    words = folded(text).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: len(words) - width].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)]
    lanes = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8) + _LANES
    counts = np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256).astype(np.float64) @ _BYTE_BITS
    bits = (counts.ravel() * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4) -> DataFrame:
    """Per row: the id and `fp`, the fingerprint's 64 bits as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return map_batches(rows, run, f"id {kind}, fp bigint").withColumnRenamed("id", id_column)


def blocks(limit: int) -> list[tuple[int, int]]:
    """(first bit, bits) of limit + 3 blocks of the 64 bits."""
    edges = [64 * i // (limit + 3) for i in range(limit + 4)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """The distances of each fingerprint to each pivot."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)


def linked(fps: np.ndarray, table: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among distinct fingerprints of one bucket, as arrays of both ends."""
    rest, out = np.arange(len(fps)), []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop()
            at = np.flatnonzero(np.abs(table[rest, 0] - table[x, 0]) <= limit)
            at = at[np.abs(table[rest[at]] - table[x]).max(axis=1, initial=0) <= limit]
            at = at[np.bitwise_count(fps[rest[at]] ^ fps[x]) <= limit]
            if len(at):
                found = rest[at]
                out.append((np.full(len(found), fps[x]), fps[found]))
                front += found.tolist()
                keep = np.ones(len(rest), bool)
                keep[at] = False
                rest = rest[keep]
    return out


def _bucket_links(keys: np.ndarray, fps: np.ndarray, limit: int, small: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal keys; runs of up to `small` fingerprints are compared by shifted arrays."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    size_of = np.repeat(sizes, sizes)
    met = size_of > 1  # who is alone in its bucket has no use for a table
    keys, fps, size_of = keys[met], fps[met], size_of[met]
    starts, sizes = np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1], sizes[sizes > 1]
    table = pivot_table(fps)
    a_out, b_out = [], []
    for shift in range(1, small):
        i = np.flatnonzero((keys[shift:] == keys[:-shift]) & (size_of[:-shift] <= small)) if len(keys) > shift else np.empty(0, int)
        for few in (PIVOTS[:6], PIVOTS):  # most pairs are out by the first coordinates
            i = i[np.abs(table[i, : len(few)] - table[i + shift, : len(few)]).max(axis=1, initial=0) <= limit]
        i = i[np.bitwise_count(fps[i] ^ fps[i + shift]) <= limit]
        a_out.append(fps[i])
        b_out.append(fps[i + shift])
    for k in np.flatnonzero(sizes > small):
        run = slice(starts[k], starts[k] + sizes[k])
        for a, b in linked(fps[run], table[run], limit):
            a_out.append(a)
            b_out.append(b)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a_out]), np.concatenate([none, *b_out])


def _tables(limit: int) -> list[tuple[int, ...]]:
    return list(combinations(range(limit + 3), 3))


def _dealt_again(limit: int):
    """Rows (key, fp) of hot buckets, once for each two blocks of the bits that aren't in the key."""
    cuts = blocks(limit)
    rest = []
    for chosen in _tables(limit):
        free = np.array([b for k, (first, bits) in enumerate(cuts) if k not in chosen for b in range(first, first + bits)], np.uint64)
        parts = np.array_split(free, limit + 2)
        masks = [np.uint64(sum(1 << int(b) for b in part)) for part in parts]
        rest.append([x | y for x, y in combinations(masks, 2)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        masks = np.array(rest, np.uint64)[keys >> 50]
        mixed = (keys.view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) ^ (np.arange(masks.shape[1], dtype=np.uint64) << np.uint64(56))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) ^ (fps[:, None] & masks)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return pa.RecordBatch.from_arrays([pa.array(mixed.ravel().view(np.int64)), pa.array(np.repeat(fps, masks.shape[1]).view(np.int64))], names=["key", "fp"])

    return run


def links(distinct: DataFrame, limit: int = 4) -> DataFrame:
    """Pairs (a, b) with a < b of the column `fp` of distinct fingerprints, enough to connect all within `limit` bits."""
    cuts = blocks(limit)
    tables = []
    for t, chosen in enumerate(_tables(limit)):  # the table's number in the high bits, then the three blocks
        key = F.lit(0).cast("bigint")
        for c in chosen:
            first, bits = cuts[c]
            part = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))
            key = F.shiftleft(key, bits).bitwiseOR(part)
        tables.append(key.bitwiseOR(F.lit(t << 50)))
    keyed = distinct.select(F.explode(F.array(*tables)).alias("key"), "fp")
    # at most a row for each HOT_BUCKET rows
    hot = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_BUCKET).select("key"), "hot")
    if hot.limit(1).count():
        again = map_batches(keyed.join(hot, "key", "left_semi"), _dealt_again(limit), "key bigint, fp bigint")
        keyed = keyed.join(hot, "key", "left_anti").unionByName(again)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.uint64)

        def out(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = _bucket_links(keys, fps, limit)
            a, b = a.view(np.int64), b.view(np.int64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            held_k = np.concatenate([held_k, batch.column(0).to_numpy()])
            held_f = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
            last = np.searchsorted(held_k, held_k[-1]) if len(held_k) else 0  # the last run may go on
            if last:
                yield out(held_k[:last], held_f[:last])
                held_k, held_f = held_k[last:], held_f[last:]
        if len(held_k):
            yield out(held_k, held_f)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the smallest node that it reaches, as signed longs.

    Alternating large-star and small-star steps, each written to the shared folder, until nothing changes.
    """

    spent = []

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")).toDF("u", "v")
        if not large:
            both = both.where("v < u")
        # written first: a join of two plain exchanges, of which the engine can split a node of very many edges
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        spent.append(least)
        moved = both.join(least, "u")
        out = moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            out = moved.where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.where("m <> u").select("m", "u"))
        return out.where("a <> b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = state(now)
    while seen[0]:
        larger = cut(star(now, True), "edges")
        then = cut(star(larger, False), "edges")
        drop(now, larger, *spent)
        spent.clear()
        now, before, seen = then, seen, state(then)
        if seen == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = 4, limit: int = 4) -> DataFrame:
    """Per row: the id, `fp` and `component_id`, the smallest id among the rows that links lead to, itself included."""
    rows = cut(fingerprints(df.select(id_column, text_column), id_column, text_column, width), "fingerprints")
    least = rows.groupBy("fp").agg(F.min(id_column).alias("least"))
    roots = components(links(least.select("fp"), limit))
    rooted = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select(id_column, "fp", "component_id")
