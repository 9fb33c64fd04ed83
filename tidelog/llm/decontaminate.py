"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents in a task, of at most SHARD_WORDS words; a longer text is cut in parts that overlap by a
window less a word. Its words are numbered as they are found there, whatever the test phrases are; document ends are a
symbol of their own. The index is the Burrows-Wheeler transform of that sequence in a wavelet matrix with rank counts, and
the suffix positions at every SAMPLE-th place of the sequence. It is built once for a shard. All test phrases of a block
are then searched in it backwards together, a word at a time by two ranks each; the occurrences found are walked to the
next sampled position, and their spans are merged in each document.

The test phrases are made by a job and written to the shared folder; the driver never has them. Tasks read them there in
blocks of BLOCK_WINDOWS and hold one block at a time; if all are one block, a task reads it once.

Null and empty texts have no words and aren't contaminated. Repeated rows are searched each for itself; an item without
words has no window; items with the same text or id each count by id once; an item without an id hits words like any
other and isn't among `items`; empty tables give no hit or no rows; only the id and text columns are read, so other
columns can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, new_path, short_batches, texts_of
from .suffix_array import suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: One in so many suffix positions is kept; words of a shard; test phrases in a block.
SAMPLE, SHARD_WORDS, BLOCK_WINDOWS = 16, 1 << 19, 200_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.encode().lower().decode()) if text else []


def windows_of(text: str | None, width: int) -> list[str]:
    """The text's windows of `width` words, or all its words if they are fewer, space-joined."""
    words = words_of(text)
    return [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


class WaveletMatrix:
    """Rank over a sequence of non-negative integers: per bit a permuted bit vector with counts every 64 places."""

    def __init__(self, values: np.ndarray, bits: int) -> None:
        self.size, self.levels = len(values), []
        for b in range(bits - 1, -1, -1):
            bit = (values >> b & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(packed) // 8 + 2, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            ones = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            zeros = self.size - int(ones[-1])
            self.levels.append((b, words, ones, zeros))
            values = np.concatenate([values[~bit], values[bit]])

    @staticmethod
    def _ones(words: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ones[at >> 6] + np.bitwise_count(words[at >> 6] & mask)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place `at`."""
        start = np.zeros_like(at)
        for b, words, ones, zeros in self.levels:
            one = (symbols >> b & 1).astype(bool)
            n_at, n_start = self._ones(words, ones, at), self._ones(words, ones, start)
            at, start = np.where(one, zeros + n_at, at - n_at), np.where(one, zeros + n_start, start - n_start)
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for b, words, ones, zeros in self.levels:
            one = (words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            n = self._ones(words, ones, at)
            out |= one.astype(at.dtype) << b
            at = np.where(one, zeros + n, at - n)
        return out


class FMIndex:
    """Backward search and location over a sequence whose last symbol 0 is its only one."""

    def __init__(self, values: np.ndarray) -> None:
        order = suffix_array(values)
        self.size, top = len(values), int(values.max()) + 1
        last = values[order - 1]  # what stands before each suffix
        self.wavelet = WaveletMatrix(last.astype(np.int32), max(1, (top - 1).bit_length()))
        self.before = np.r_[0, np.cumsum(np.bincount(values, minlength=top))]
        marked = order % SAMPLE == 0
        self.marked = marked
        self.sampled = order[marked]
        self.sample_at = np.cumsum(marked) - 1

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [lo, hi) of phrases of one length, a row of the array each."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbols = phrases[live, k].astype(np.int64)
            base = np.where(symbols < len(self.before) - 1, self.before[np.minimum(symbols, len(self.before) - 1)], 0)
            known = symbols < len(self.before) - 1
            symbols = np.where(known, symbols, 0)
            lo[live] = base + self.wavelet.rank(symbols, lo[live])
            hi[live] = np.where(known, base + self.wavelet.rank(symbols, hi[live]), lo[live])
            live = live[lo[live] < hi[live]]
        gone = np.ones(len(phrases), bool)
        gone[live] = False
        hi[gone] = lo[gone]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The positions of the suffixes in these rows: steps back to the next sampled one."""
        out, rows, who, steps = np.empty(len(rows), np.int64), rows.copy(), np.arange(len(rows)), 0
        while len(who):
            done = self.marked[rows]
            out[who[done]] = self.sampled[self.sample_at[rows[done]]] + steps
            who, rows = who[~done], rows[~done]
            symbols = self.wavelet.access(rows)
            rows = self.before[symbols] + self.wavelet.rank(symbols, rows)
            steps += 1
        return out


class Phrases:
    """A block of windows: its words, and per length the windows as rows of numbers of words, with their items."""

    def __init__(self, windows: list[str], items: list) -> None:
        owners: dict[str, set] = {}
        for window, item in zip(windows, items, strict=True):
            owners.setdefault(window, set()).update(() if item is None else (item,))
        number: dict[str, int] = {}
        by_length: dict[int, tuple[list[list[int]], list[set]]] = {}
        for window, owner in owners.items():
            words = [number.setdefault(w, len(number)) for w in window.split(" ")]
            rows, who = by_length.setdefault(len(words), ([], []))
            rows.append(words)
            who.append(owner)
        self.words = list(number)
        self.by_length = [(n, np.array(rows, np.int64), who) for n, (rows, who) in sorted(by_length.items())]


class Shard:
    """The index of some word lists and where each position is in them."""

    def __init__(self, parts: list[list[str]]) -> None:
        # 0 ends the shard, 1 a part; the words follow as they come
        number: dict[str, int] = {}
        sizes = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        values = np.ones(int(sizes.sum()) + len(parts) + 1, np.int64)
        values[-1] = 0
        for start, part in zip(self.starts.tolist(), parts, strict=True):
            values[start : start + len(part)] = [number.setdefault(w, len(number) + 2) for w in part]
        self.number, self.index = number, FMIndex(values)

    def find(self, phrases: Phrases) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[set]]]:
        """Per length of windows: the length, the starts found in the sequence, which window each is, the windows' items."""
        local = np.array([self.number.get(w, -1) for w in phrases.words], np.int64)
        for n, rows, who in phrases.by_length:
            rows = local[rows]
            here = np.flatnonzero(rows.min(axis=1) >= 0)
            if not len(here):
                continue
            lo, hi = self.index.search(rows[here])
            sizes = hi - lo
            hit = np.flatnonzero(sizes)
            for some in np.array_split(hit, max(1, int(sizes.sum()) >> 20)):
                if len(some):
                    size = sizes[some]
                    ranges = np.repeat(lo[some] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
                    yield n, self.index.locate(ranges), np.repeat(here[some], size), who


def search_shard(parts: list[list[str]], blocks: Iterator[Phrases]) -> list[tuple[list[list[int]], set]]:
    """Per part: the merged spans [first, end) of hit words, and the items that occur."""
    out: list[tuple[list[list[int]], set]] = [([], set()) for _ in parts]
    if not any(parts):
        return out
    shard = Shard(parts)
    for phrases in blocks:
        for n, position, which, who in shard.find(phrases):
            part = np.searchsorted(shard.starts, position, side="right") - 1
            pairs = np.unique(np.stack([part, position - shard.starts[part]]), axis=1)
            for some in np.split(pairs, np.flatnonzero(np.diff(pairs[0])) + 1, axis=1):
                spans = out[int(some[0, 0])][0]
                spans[:] = merged(spans + [[first, first + n] for first in some[1].tolist()])
            for k, w in np.unique(np.stack([part, which], axis=1), axis=0).tolist():
                out[k][1].update(who[w])
    return out


def _search_texts(texts: list[str], width: int, blocks: Callable[[], Iterator[Phrases]], shard_words: int) -> list[tuple[int, list[list[int]], list]]:
    """Per text: its number of words, the merged spans of hit words, the items that occur, sorted as strings."""
    counts, found = [], [([], set()) for _ in texts]
    waiting, size = [], 0

    def search() -> None:
        for (k, first, _), (spans, items) in zip(waiting, search_shard([p[2] for p in waiting], blocks()), strict=True):
            if spans:
                found[k] = (merged(found[k][0] + [[a + first, b + first] for a, b in spans]), found[k][1] | items)
        waiting.clear()

    for k, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        for first in range(0, len(words) if len(words) < width else len(words) - width + 1, shard_words):
            part = words[first : first + shard_words + width - 1]
            if size + len(part) > shard_words:
                search()
                size = 0
            waiting.append((k, first, part))
            size += len(part)
    search()
    return [(n, spans, sorted(items, key=str)) for n, (spans, items) in zip(counts, found, strict=True)]


def merged(spans: list[list[int]]) -> list[list[int]]:
    """Sorted spans [first, end), those that meet made one."""
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


def without_words(text: str, spans: list[list[int]]) -> str:
    """The text without the words in the spans and what stands between them."""
    at, out, words = 0, [], [m.span() for m in WORD.finditer(text.encode().lower().decode())] if spans else []
    for first, end in spans:
        out.append(text[at : words[first][0]])
        at = words[end - 1][1]
    return "".join([*out, text[at:]])


class _Blocks:
    """The written test phrases, block by block; a task that needs only one keeps it."""

    def __init__(self, path: str, size: int) -> None:
        self.path, self.size, self.kept = path, size, None

    def __call__(self) -> Iterator[Phrases]:
        if self.kept is not None:
            yield from self.kept
            return
        store, root = fs.FileSystem.from_uri(self.path)
        files = sorted(f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".parquet"))
        windows, items, n_blocks = [], [], 0
        for name in files:
            with store.open_input_file(name) as f:
                for batch in pq.ParquetFile(f).iter_batches(min(self.size, 1 << 16)):
                    windows += batch.column(0).to_pylist()
                    items += batch.column(1).to_pylist()
                    if len(windows) >= self.size:
                        n_blocks += 1
                        yield Phrases(windows, items)
                        windows, items = [], []
        last = Phrases(windows, items)
        if not n_blocks:
            self.kept = [last]
        yield last


def write_windows(benchmark: DataFrame, width: int, item_column: str = "item_id", item_text: str = "text") -> str:
    """Writes the different (window, item) of the benchmark to the shared folder; the path."""
    kind = benchmark.schema[item_column].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        windows = [list(dict.fromkeys(windows_of(t, width))) for t in batch.column(1).to_pylist()]
        owner = np.repeat(np.arange(len(windows)), [len(w) for w in windows])
        return pa.RecordBatch.from_arrays([pa.array([w for ws in windows for w in ws], pa.string()), batch.column(0).take(pa.array(owner))], names=["window", "item"])

    path = new_path(benchmark.sparkSession, "windows")
    map_batches(benchmark.select(item_column, item_text), run, f"window string, item {kind}").distinct().write.parquet(path)
    return path


def find_phrases(df: DataFrame, benchmark: DataFrame, width: int = 10, remove: bool = False, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row: the id, `n_words`, `spans` (merged [first, end) of hit words), `items` (that occur, sorted as strings)
    and `text` without the spans' words if asked for, else null."""
    kind, item_kind = df.schema[id_column].dataType.simpleString(), benchmark.schema[item_column].dataType.simpleString()
    item_type = {"bigint": pa.int64(), "int": pa.int32()}.get(item_kind, pa.string())
    names = ["id", "text", "n_words", "spans", "items"]
    schema = f"id {kind}, text string, n_words bigint, spans array<array<bigint>>, items array<{item_kind}>"
    path, block, shard = write_windows(benchmark, width, item_column, item_text), BLOCK_WINDOWS, SHARD_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = _Blocks(path, block)
        for batch in batches:
            given = batch.column(1).to_pylist()
            found = _search_texts(texts_of(batch.column(1)), width, blocks, shard)
            texts = [t if t is None else without_words(t, f[1]) for t, f in zip(given, found, strict=True)] if remove else [None] * len(given)
            columns = [pa.array(texts, pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.list_(pa.int64()))), pa.array([f[2] for f in found], pa.list_(item_type))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    rows = short_batches(df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)
