"""Repeated passages removed exactly, by suffix arrays in a logarithmic index family.

A byte is removed if a string of `length` bytes that covers it also starts elsewhere, in the same or another document.
Sorting all suffixes of a corpus is out of reach, so equal strings are first brought together:

1. Each string of `length` bytes has an anchor, the k-gram in it with the smallest hash. Strings with one anchor follow
   one another; such a run and its bytes are a snippet. Equal strings have equal anchors, at equal places.
2. Anchors that occur once are done: their strings are unique. If all snippets of an anchor are equal, all their strings
   repeat. Equal snippets count as one, so hot passages shrink before anything is compared.
3. The other snippets, once each, go to tasks by their anchor. A task takes them in batches: a batch gets a suffix
   array, is merge-scanned against the existing levels for matches of the full length, and joins the levels, of which
   equal-sized ones merge. A family of levels ends at an anchor once it has FAMILY bytes, so a task's memory is bounded. An anchor with very many different snippets is cut finer first: the same steps with longer
   k-grams, up to the whole string, where an anchor's count decides.

Null and empty texts, and those shorter than `length`, keep all bytes. Documents that are equal, rows repeated with one
id among them, lose all that `length` bytes cover. Ties of hashes go to the leftmost; an empty table gives an empty one;
only the id and text columns are read, and the two that are added replace others of their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop, short_batches
from .suffix_array import suffix_array

#: Lengths of k-grams, as shares of the string's length: the first for documents, the others for hot anchors.
GRAMS = (0.2, 0.6, 0.8, 0.9, 0.95, 1.0)
#: Different snippets of one anchor beyond which it is cut finer; bytes of a batch and of a block of documents.
HOT_SNIPPETS, BATCH, BLOCK = 4096, 1 << 20, 1 << 20
#: Bytes of snippets of an index family, beyond which it ends with its anchor.
FAMILY = 32 << 20
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, modulo 2**64."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << max(20, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _powers[base] = tuple(both)
    return _powers[base]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Polynomial hashes of any part of a buffer."""

    def __init__(self, data: np.ndarray, base: int) -> None:
        self.power, self.inverse = _power(base, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[first]) * self.inverse[first]

    def grams(self, k: int) -> np.ndarray:
        n = max(0, len(self.sums) - k)
        return (self.sums[k:] - self.sums[:n]) * self.inverse[:n]


def anchors(data: np.ndarray, starts: np.ndarray, windows: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """The snippets of parts of a buffer, each with `windows` strings from its start on.

    Gives the part, the first string's place in the part, the number of strings, the anchor's hash and the snippet's.
    """
    one = Hashes(data, _BASES[0])
    grams = _mixed(one.grams(k))
    n = len(grams)
    key = (grams & ~np.uint64(0xFFFFFF)) | np.arange(n, dtype=np.uint64)
    w, span = length - k + 1, 1
    while span * 2 <= w:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if w > span:
        key = np.minimum(key[: len(key) - (w - span)], key[w - span :])
    part = np.repeat(np.arange(len(starts)), windows)
    place = np.arange(len(part)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = starts[part] + place
    anchor = (key[at] & np.uint64(0xFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (np.diff(anchor) != 0) | (np.diff(part) != 0)][: len(anchor)])
    count = np.diff(np.r_[new, len(anchor)])
    first, chosen = at[new], anchor[new]
    whole = Hashes(data, _BASES[1]).of(first, first + count + length - 1)
    shape = ((chosen - first).astype(np.uint64) << np.uint64(32)) | count.astype(np.uint64)
    return part[new], place[new], count, grams[chosen].view(np.int64), _mixed(whole ^ _mixed(shape)).view(np.int64)


def _blocks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of items of about BLOCK bytes."""
    first = total = 0
    for k, n in enumerate(sizes):
        total += n
        if total >= BLOCK or k == len(sizes) - 1:
            yield first, k + 1
            first, total = k + 1, 0


def _document_snippets(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t or "").encode() for t in batch.column(2).to_pylist()]
            # long texts in parts of BLOCK strings: a snippet cut there is two, of one anchor
            parts = [(row, first) for row, x in enumerate(raw) for first in range(0, max(1, len(x) - length + 1), BLOCK)]
            data = [raw[row][first : first + BLOCK + length - 1] for row, first in parts]
            at = np.array(parts, np.int64).reshape(-1, 2)
            for a, b in _blocks([len(x) for x in data]):
                sizes = np.array([len(x) for x in data[a:b]])
                starts = np.cumsum(sizes) - sizes
                windows = np.maximum(sizes - length + 1, 0)
                if windows.any():
                    part, place, count, h, sh = anchors(np.frombuffer(b"".join(data[a:b]), np.uint8), starts, windows, length, k)
                    rows, place = pa.array(at[a + part, 0]), at[a + part, 1] + place
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h), pa.array(sh), pa.array(place.astype(np.int32)), pa.array(count.astype(np.int32))], names=["id", "th", "h", "sh", "s", "m"])

    return run


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as big-endian numbers; a view."""
    return np.ndarray((max(0, len(buffer) - 7),), ">u8", np.ascontiguousarray(buffer), strides=(1,))


def _steps(length: int) -> list[int]:
    """Places of the words that cover a string; the last may overlap the one before."""
    return [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]


def _compare(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 as the string at a[i] is before, equal to or behind the one at b[j]."""
    out, open_ = np.zeros(len(i), np.int8), np.arange(len(i))
    for step in _steps(length):
        x, y = a[i[open_] + step], b[j[open_] + step]
        out[open_[x < y]] = -1
        out[open_[x > y]] = 1
        open_ = open_[x == y]
        if not len(open_):
            break
    return out


class Level:
    """Different strings of the full length, sorted: the buffer, their places in it and their classes."""

    def __init__(self, buffer: np.ndarray, places: np.ndarray, classes: np.ndarray) -> None:
        self.buffer, self.places, self.classes = buffer, places, classes
        self.words = _words(buffer)
        self.heads = self.words[places].astype(np.uint64)

    def scan(self, other: Level, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each string of the other level its place in the order here, and whether it is here, by a merge scan.

        Both are sorted, so they are merged by their first eight bytes; where those agree, the strings of both are merged
        by the next eight, and so on, until they are apart or equal.
        """
        lo = np.searchsorted(self.heads, other.heads, "left")
        hi = np.searchsorted(self.heads, other.heads, "right")
        here = np.zeros(len(lo), bool)
        theirs = np.flatnonzero(lo < hi)
        if not len(theirs):
            return lo, here
        # the runs here that some of theirs agree with, each once
        starts, first_of, run = np.unique(lo[theirs], return_index=True, return_inverse=True)
        sizes = hi[theirs][first_of] - starts
        mine = np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        n = len(mine)
        group = np.r_[np.repeat(np.arange(len(starts)), sizes), run]
        new = np.r_[np.zeros(n, bool), np.ones(len(theirs), bool)]
        who = np.arange(len(group))
        place = np.r_[self.places[mine], other.places[theirs]]
        below = np.zeros(len(theirs), np.int64)  # strings of its run here that stand before each of theirs
        for step in _steps(length)[1:]:
            word = np.empty(len(who), np.uint64)
            word[~new] = self.words[place[~new] + step]
            word[new] = other.words[place[new] + step]
            by = np.lexsort((word, group))
            group, word, who, new, place = group[by], word[by], who[by], new[by], place[by]
            next_group = np.r_[True, np.diff(group) != 0]
            heads = np.flatnonzero(next_group | np.r_[True, word[1:] != word[:-1]])
            cell = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(group)]))
            counts = np.cumsum(~new) - ~new  # of mine before each
            start_of = np.maximum.accumulate(np.where(next_group, np.arange(len(group)), 0))
            below[who[new] - n] += (counts[heads][cell] - counts[start_of])[new]
            # what goes on: cells with strings of both
            both = (np.bincount(cell, new, len(heads)) > 0) & (np.bincount(cell, ~new, len(heads)) > 0)
            on = both[cell]
            group, who, new, place = cell[on], who[on], new[on], place[on]
            if not len(who):
                break
        here[theirs[who[new] - n]] = True
        at = lo.copy()
        at[theirs] += below
        return at, here

    def with_(self, other: Level, length: int) -> Level:
        """Both levels, which have no string in common, as one."""
        at, _ = self.scan(other, length)
        slots = at + np.arange(len(at))
        mine = np.ones(len(self.places) + len(at), bool)
        mine[slots] = False
        places, classes = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
        places[mine], places[slots] = self.places, other.places + len(self.buffer)
        classes[mine], classes[slots] = self.classes, other.classes
        return Level(np.concatenate([self.buffer, other.buffer]), places, classes)


class IndexFamily:
    """Levels of doubling size. Adding a batch finds which of its strings are in the levels, and the other way round."""

    def __init__(self, length: int) -> None:
        self.length, self.levels, self.repeats = length, [], np.zeros(0, bool)

    def add(self, buffer: np.ndarray, windows: np.ndarray, certain: np.ndarray) -> np.ndarray:
        """The class of each string that starts at `windows`; those that are `certain` repeat in any case."""
        order = suffix_array(buffer.astype(np.int64), self.length)
        wanted = np.full(len(buffer), -1, np.int64)
        wanted[windows] = np.arange(len(windows))
        order = order[wanted[order] >= 0]
        words = _words(buffer)
        same = _compare(words, order[1:], words, order[:-1], self.length) == 0
        head = np.r_[True, ~same]
        group = np.cumsum(head) - 1
        members = np.bincount(group)
        sure = np.bincount(group, weights=certain[wanted[order]]) > 0
        new = Level(buffer, order[head], np.zeros(len(members), np.int64))
        classes = np.full(len(members), -1, np.int64)
        for level in self.levels:
            at, here = level.scan(new, self.length)
            classes[here] = level.classes[at[here]]
        fresh = classes < 0
        self.repeats[classes[~fresh]] = True
        classes[fresh] = len(self.repeats) + np.arange(fresh.sum())
        self.repeats = np.r_[self.repeats, (members[fresh] > 1) | sure[fresh]]
        level = Level(buffer, new.places[fresh], classes[fresh])
        while self.levels and len(self.levels[-1].places) < 2 * len(level.places):
            level = self.levels.pop().with_(level, self.length)
        self.levels.append(level)
        out = np.empty(len(windows), np.int64)
        out[wanted[order]] = classes[group]
        return out


def _runs(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of set flags at consecutive places of one owner: owner, first place, end."""
    at = np.flatnonzero(flags)
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(owner[at]) != 0)][: len(at)]
    first = at[new]
    last = at[np.r_[new[1:], True][: len(at)]] if len(at) else at
    return owner[first], place[first], place[last] + 1


_PIECE = "oh bigint, os bigint, h bigint, sh bigint, off int, m int, n bigint, data binary"
_RANGE = "oh bigint, os bigint, a int, b int"


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the wanted snippets out of the joined documents."""
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        for text, wants, extra in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode()
            for w in wants:
                for k, v in enumerate((w["h"], w["sh"], w["h"], w["sh"], 0, w["m"], w["n"], raw[w["s"] : w["s"] + w["m"] + extra])):
                    out[k].append(v)
        kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["oh", "os", "h", "sh", "off", "m", "n", "data"])


def _finer(length: int, k: int):
    """Cuts snippets anew by longer k-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(7).to_pylist()
            for a, b in _blocks([len(x) for x in data]):
                sizes = np.array([len(x) for x in data[a:b]])
                starts = np.cumsum(sizes) - sizes
                part, place, count, h, sh = anchors(np.frombuffer(b"".join(data[a:b]), np.uint8), starts, sizes - length + 1, length, k)
                rows = pa.array(a + part)
                old = batch.column(4).take(rows).to_numpy()
                pieces = [data[a + p][s : s + m + length - 1] for p, s, m in zip(part.tolist(), place.tolist(), count.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h), pa.array(sh), pa.array((old + place).astype(np.int32)), pa.array(count.astype(np.int32)), batch.column(6).take(rows), pa.array(pieces, pa.binary())],
                    names=["oh", "os", "h", "sh", "off", "m", "n", "data"],
                )

    return run


def _family(length: int, batch_bytes: int, family_bytes: int):
    """The repeated strings among a task's snippets, as ranges of string places in their first snippets.

    The snippets come by anchor. Equal strings have one anchor, so a family that has grown to `family_bytes` ends with
    its anchor, and the next anchor begins a new one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen, kept = IndexFamily(length), set(), []
        waiting: list[tuple] = []
        size = total = 0
        anchor = None

        def enter() -> None:
            buffer = np.frombuffer(b"".join(x[5] for x in waiting), np.uint8)
            sizes = np.array([len(x[5]) for x in waiting])
            m = sizes - length + 1
            owner = np.repeat(np.arange(len(waiting)), m)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
            starts = np.cumsum(sizes) - sizes
            certain = np.array([x[4] for x in waiting]) > 1
            classes = index.add(buffer, starts[owner] + place, certain[owner])
            kept.append((np.array([x[:3] for x in waiting], np.int64).reshape(-1, 3), m, classes))

        def found() -> Iterator[pa.RecordBatch]:
            if waiting:
                enter()
            for origin, m, classes in kept:
                owner = np.repeat(np.arange(len(m)), m)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
                who, a, b = _runs(index.repeats[classes], owner, place)
                off = origin[who, 2]
                yield pa.RecordBatch.from_arrays([pa.array(origin[who, 0]), pa.array(origin[who, 1]), pa.array((a + off).astype(np.int32)), pa.array((b + off).astype(np.int32))], names=["oh", "os", "a", "b"])

        for batch in batches:
            for oh, os, h, sh, off, _, n, data in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if h != anchor:
                    anchor, seen = h, set()
                    if total >= family_bytes:
                        yield from found()
                        index, kept, waiting, size, total = IndexFamily(length), [], [], 0, 0
                if (oh, os, off) in seen:  # of a document that is there twice
                    continue
                seen.add((oh, os, off))
                waiting.append((oh, os, off, sh, n, data))
                size += len(data)
                total += len(data)
                if size >= batch_bytes:
                    enter()
                    waiting, size = [], 0
        yield from found()

    return run


def _in_families(pieces: DataFrame, length: int) -> DataFrame:
    """The pieces by anchor, through families of bounded bytes."""
    return pieces.repartition("h").sortWithinPartitions("h").mapInArrow(_family(length, BATCH, FAMILY), _RANGE)


def _compare_snippets(pieces: DataFrame, length: int, k: int) -> DataFrame:
    """Ranges of repeated strings of the snippets: hot anchors are cut finer, the others go to the index families."""
    hot = cut(pieces.groupBy("h").agg(F.count("*").alias("c")).where(F.col("c") > HOT_SNIPPETS).select("h"), "hot")
    ranges, rest = [], pieces
    if hot.limit(1).count():
        rest = pieces.join(hot, "h", "left_anti").select(*pieces.columns)
        # one row for each snippet, also if its document is there twice
        more = pieces.join(hot, "h").dropDuplicates(["h", "sh", "oh", "os", "off"]).select(*pieces.columns)
        for gram in [round(length * g) for g in GRAMS if round(length * g) > k]:
            finer = cut(more.mapInArrow(_finer(length, gram), _PIECE), "finer")
            stats = finer.groupBy("h").agg(F.sum("n").alias("total"), F.min("sh").alias("lo"), F.max("sh").alias("hi"))
            stats = stats.where("total > 1")
            known = finer.join(stats, "h")
            ranges.append(cut(known.where("lo = hi").selectExpr("oh", "os", "off as a", "off + m as b"), "ranges"))
            mixed = known.where("lo <> hi").select(*finer.columns)
            counts = mixed.groupBy("h").agg(F.count("*").alias("c"))
            cold = mixed.join(counts.where(F.col("c") <= HOT_SNIPPETS), "h").select(*finer.columns)
            ranges.append(cut(_in_families(cold, length), "ranges"))
            more = cut(mixed.join(counts.where(F.col("c") > HOT_SNIPPETS), "h").select(*finer.columns), "hot")
            if not more.limit(1).count():
                break
    out = cut(_in_families(rest, length), "ranges")
    for r in ranges:
        out = out.union(r)
    return out


def repeats(df: DataFrame, length: int = 200, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per different (id, text hash) that has repeated strings: `id`, `th` and `found`, arrays of their places (s, [a, b))."""
    if length < 8:
        raise ValueError("strings are compared by words of eight bytes")
    docs = df.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("th"), F.col(text_column).alias("text"))
    k = round(length * GRAMS[0])
    found = short_batches(docs).mapInArrow(_document_snippets(length, k), f"id {df.schema[id_column].dataType.simpleString()}, th bigint, h bigint, sh bigint, s int, m int")
    found = cut(found, "found")
    again = found.groupBy("h").agg(F.count("*").alias("c"), F.min("sh").alias("lo"), F.max("sh").alias("hi")).where("c > 1")
    # written first: a join of two plain exchanges, of which the engine can split hot partitions
    again = cut(again.selectExpr("h", "lo = hi as alike"), "anchors")
    candidates = cut(found.join(again, "h"), "candidates")
    drop(again, found)
    mixed = candidates.where("not alike")
    firsts = mixed.groupBy("h", "sh").agg(F.count("*").alias("n"), F.min(F.struct("id", "th", "s", "m")).alias("at"))
    wants = firsts.groupBy(F.col("at.id").alias("id"), F.col("at.th").alias("th")).agg(F.collect_list(F.struct("h", "sh", F.col("at.s").alias("s"), F.col("at.m").alias("m"), "n")).alias("wants"))
    w, d = wants.alias("w"), docs.alias("d")
    joined = d.join(w, F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.th") == F.col("w.th"))).select("d.text", "w.wants", F.lit(length - 1).alias("extra"))
    pieces = cut(joined.mapInArrow(_fetch, _PIECE), "snippets")
    ranges = _compare_snippets(pieces, length, k)
    drop(pieces)
    spans = ranges.groupBy(F.col("oh").alias("h"), F.col("os").alias("sh")).agg(F.collect_list(F.struct("a", "b")).alias("ranges"))
    spans = cut(spans, "spans")  # written first, as above
    whole = F.array(F.struct(F.lit(0).alias("a"), F.col("m").alias("b")))
    marks = candidates.where("alike").select("id", "th", "s", whole.alias("ranges")).union(mixed.join(spans, ["h", "sh"]).select("id", "th", "s", "ranges"))
    out = cut(marks.groupBy("id", "th").agg(F.collect_set(F.struct("s", "ranges")).alias("found")), "marks")
    return out


def removed_spans(found: list, length: int) -> list[list[int]]:
    """The maximal runs [first, end) of bytes that the repeated strings cover."""
    out: list[list[int]] = []
    for first, end in sorted((x["s"] + r["a"], x["s"] + r["b"]) for x in found for r in x["ranges"]):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end + length - 1)
        else:
            out.append([first, end + length - 1])
    return out


def remove_repeats(df: DataFrame, length: int = 200, as_text: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All columns, `removed` (array of runs [first, end) of bytes) and `kept` (the remaining bytes; as_text: without what
    is left of characters that are removed in part). Columns of these two names are replaced."""
    marks = repeats(df, length, id_column, text_column)
    rows = df.withColumn("__th", F.xxhash64(text_column))
    m = marks.select(F.col("id").alias("__id"), F.col("th").alias("__mth"), F.col("found").alias("__found"))
    joined = rows.join(m, F.col(id_column).eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__mth")), "left")
    names = [c for c in df.columns if c not in ("removed", "kept")]
    at = names.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept = [], []
            for text, found in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist(), strict=True):
                raw = (text or "").encode()
                gone = removed_spans(found, length) if found else []
                spans.append(gone)
                if gone:
                    edges = [0, *[x for s in gone for x in s], len(raw)]
                    raw = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                kept.append(raw.decode(errors="ignore") if as_text else raw)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.string() if as_text else pa.binary())], names=[*names, "removed", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names)
    return joined.select(*names, "__found").mapInArrow(run, f"{fields}, removed array<array<bigint>>, kept {'string' if as_text else 'binary'}")
