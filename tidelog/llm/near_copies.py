"""Groups of near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, and the links
of op2's fingerprints.

Texts that op2's fingerprints link are one group from the start. Pairs of other texts meet in BANDS buckets by ROWS
minima of their shingle hashes each; at a similarity of exactly 0.8 a pair shares no bucket with probability
(1 - 0.8**5)**32, 3 in a million. Of buckets that hold more than one group, the texts are compared by their sets of
shingles, as 64-bit hashes: a search from a text takes out what it reaches, so a bucket of near copies is done soon; texts
that are not alike are all compared, by counting along the lists of who has a shingle. A bucket beyond BLOCK texts, or of
very many shingles, is cut into blocks, and each two blocks are compared by themselves, so no task holds a whole bucket.

Null and empty texts, repeated rows, null ids and empty tables are as in `simhash`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .shared import cut, drop, folded, map_batches, short_batches

WIDTH, ALIKE = 5, 0.8
BANDS, ROWS = 32, 5
#: Texts, and shingles, of a block.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 22
_FACTORS = np.random.default_rng(5).integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, width: int = WIDTH) -> set[bytes]:
    """The runs of `width` words; a shorter text is one run."""
    words = folded(text).split()
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def minima(found: set[bytes]) -> np.ndarray:
    """The least of the shingles' hashes under each factor."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s) for s in found), np.uint64, len(found))
    return (hashes * _FACTORS).min(axis=1)


def bucket_keys(table: np.ndarray) -> np.ndarray:
    """A key for each band of each row of minima."""
    rows = table.reshape(len(table), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        keys = (keys ^ rows[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        keys = keys ^ (keys >> np.uint64(29))
    return keys.view(np.int64)


def _described(df: DataFrame) -> DataFrame:
    """Per row: the id, its text's hash, op2's fingerprint, the number of shingles and the bucket keys."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(2).to_pylist()
        fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64).view(np.int64)
        sizes, keys = np.zeros(len(texts), np.int32), [[] for _ in texts]
        for k, text in enumerate(texts):
            found = shingles(text)
            if found:
                sizes[k], keys[k] = len(found), bucket_keys(minima(found)[None])[0]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps), pa.array(sizes), pa.array(keys, pa.list_(pa.int64()))], names=["id", "th", "fp", "n", "keys"])

    return map_batches(df, run, f"id {df.schema['id'].dataType.simpleString()}, th bigint, fp bigint, n int, keys array<bigint>")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows (key, th, fp, n, root) of buckets that have more than one root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            keys, roots = table.column("key").to_numpy(), table.column("root").to_numpy()
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            mixed = np.minimum.reduceat(roots, starts) != np.maximum.reduceat(roots, starts)
            yield from table.filter(pa.array(np.repeat(mixed, np.diff(np.r_[starts, len(keys)])))).to_batches()

        for batch in batches:
            if batch.num_rows:
                now = pa.Table.from_batches([batch])
                held = now if held is None else pa.concat_tables([held, now])
                keys = held.column("key").to_numpy()
                last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
                if last:
                    yield from out(held.slice(0, last))
                    held = held.slice(last)
        if held is not None:
            yield from out(held)

    return short_batches(rows).repartition("key").sortWithinPartitions("key").mapInArrow(run, "key bigint, th bigint, fp bigint, n int, root bigint")


def links(sets: list[np.ndarray], sizes: np.ndarray, roots: np.ndarray, least: float = ALIKE) -> list[tuple[int, int]]:
    """Edges of roots, enough to connect all texts that are alike; `sets` has each text's shingle hashes, each once."""
    count = len(sets)
    owner = np.repeat(np.arange(count), [len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    lists = owner[np.argsort(ids, kind="stable")]  # who has each shingle, shingle by shingle
    ends = np.cumsum(np.bincount(ids))
    own = np.split(ids, np.cumsum([len(x) for x in sets])[:-1])

    def near(x: int) -> np.ndarray:
        both = np.bincount(np.concatenate([lists[ends[i - 1] if i else 0 : ends[i]] for i in own[x]]), minlength=count)
        return (both > 0) & (both >= least * (sizes + sizes[x] - both))

    edges, alive = [], np.ones(count, bool)
    for seed in range(count):
        if not alive[seed]:
            continue
        reached = alive & (roots == roots[seed])
        alive &= ~reached
        front = np.flatnonzero(reached).tolist()
        while front and (left := int(alive.sum())):
            if left < len(front):  # the others' searches are fewer
                for y in np.flatnonzero(alive):
                    edges += [(int(r), int(roots[y])) for r in np.unique(roots[near(y)]) if r != roots[y]]
                return edges
            x = front.pop()
            found = np.unique(roots[alive & near(x)])
            if len(found):
                edges += [(int(roots[x]), int(r)) for r in found]
                reached = alive & np.isin(roots, found)
                alive &= ~reached
                front += np.flatnonzero(reached).tolist()
    return edges


def _compared(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of the roots of alike texts among the rows (cell, n, root, text) of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, edges = None, [], set()

        def search() -> None:
            if len({r for _, r, _ in held}) > 1:
                edges.update((min(e), max(e)) for e in links([x for _, _, x in held], np.array([n for n, _, _ in held]), np.array([r for _, r, _ in held])))

        def out() -> pa.RecordBatch:
            pairs = sorted(edges)
            edges.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for c, n, root, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != cell:
                    search()
                    cell, held = c, []
                    if len(edges) > 10_000:
                        yield out()
                held.append((n, root, np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in shingles(text)), np.uint64))))
        search()
        yield out()

    return short_batches(rows).repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint").distinct()


def _cells(buckets: DataFrame, block: int, shingle_block: int) -> DataFrame:
    """The bucket rows by cell: a bucket, or each two blocks of one that is large."""
    sizes = buckets.groupBy("key").agg(F.count("*").alias("c"), F.sum("n").alias("total"))
    n_blocks = F.greatest(F.ceil(F.col("c") / block), F.ceil(F.col("total") / shingle_block)).cast("int")
    large = cut(sizes.select("key", n_blocks.alias("blocks")).where("blocks > 1"), "large")
    if not large.limit(1).count():
        return buckets.withColumn("cell", F.col("key"))
    small = buckets.join(large, "key", "left_anti").withColumn("cell", F.col("key"))
    mine = buckets.join(large, "key").withColumn("mine", F.pmod(F.xxhash64("th"), F.col("blocks")))
    other = F.explode(F.expr("sequence(0L, cast(blocks - 1 as bigint))"))
    dealt = mine.withColumn("other", other).withColumn("cell", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")))
    return small.unionByName(dealt.select(*small.columns))


def groups(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id and `component_id`, the smallest id of its group."""
    given = df.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), F.col(text_column).alias("text"))
    rows = cut(_described(given), "described")
    fps = rows.select("fp").distinct()
    roots = simhash.components(simhash.links(fps))
    names = cut(fps.join(roots, fps.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "names")
    nodes = rows.dropDuplicates(["th"]).join(names, "fp")
    buckets = cut(_mixed(nodes.select(F.explode("keys").alias("key"), "th", "fp", "n", "root")), "buckets")
    texts = cut(given.join(buckets.select("th").distinct(), "th", "left_semi").select("th", "text").dropDuplicates(["th"]), "texts")

    cells = _cells(buckets, BLOCK, BLOCK_SHINGLES).join(texts, "th").select("cell", "n", "root", "text")
    found = cut(_compared(cells), "alike")
    drop(buckets, texts)
    moved = simhash.components(found)
    names = names.join(moved, names.root == moved.node, "left").select("fp", F.coalesce(moved.root, names.root).alias("root"))
    rooted = rows.select("id", "fp").join(names, "fp")
    named = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    return rooted.join(named, "root").select(F.col("id").alias(id_column), "component_id")
