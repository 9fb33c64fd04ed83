"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

A tokenisation is the one that the merge rules give if and only if each adjacent pair of its tokens is the one that
the rules give for the pair's own text. So a text is cut greedily into the longest piece at each place, all of which an
Aho-Corasick automaton finds in one pass; a piece is taken if it goes with the one before it, which is decided by
merging the two pieces' characters anew; else the next shorter piece is tried; if none is left, the position is marked
in a bitfield as failed and the piece before it is given up.

No piece has a space mark behind another character, so a mark behind such a character always starts a piece, and each
chunk (marks, then other characters) is encoded on its own; so is what follows a line feed, which is in no longer
piece. Chunks that recur are looked up.

Null and empty texts give the end id alone and decode to the empty text. Rows are independent: repeated rows, ties and
extra columns change nothing, and an empty table gives an empty one.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, short_batches, sliced, texts_of

MARK = "▁"
#: Chunks and pairs of pieces remembered in a Python worker; beyond that the memory starts anew.
CHUNKS, PAIRS = 300_000, 1_000_000
#: Numbers from here on are characters that are no piece.
OTHER = 1 << 20
_loaded: dict[str, Codec] = {}


class Codec:
    """The pieces of one model, and its encoder and decoder."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.end = model.eos_id()
        self.id_of = {model.id_to_piece(i): i for i in ids if i not in special and not model.is_unused(i)}
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.score = {p: model.get_score(i) for p, i in self.id_of.items()}
        self.byte_id = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        self.bytes_of = [b"" if model.is_control(i) else model.id_to_piece(i).replace(MARK, " ").encode() for i in ids]
        self.is_byte = np.zeros(len(self.bytes_of), bool)
        for value, i in self.byte_id.items():
            self.bytes_of[i] = bytes([value])
            self.is_byte[i] = True
        self.is_control = [model.is_control(i) for i in ids]
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.id_of):
            raise ValueError("a piece has a space mark behind another character: texts can't be cut into chunks")
        self.lines = not any("\n" in p for p in self.id_of)
        self.automaton = ahocorasick.Automaton()
        for piece in self.id_of:
            self.automaton.add_word(piece, self.id_of[piece] << 8 | len(piece))
        self.automaton.make_automaton()
        self.together = {p[k : k + 2] for p in self.id_of for k in range(len(p) - 1)}
        self.chunk_ids: dict[str, bytes] = {}
        self.part_ids: dict[str, bytes] = {}
        self.goes: dict[int, bool] = {}

    @staticmethod
    def load(path: str) -> Codec:
        """The codec of this file, read once in each Python process."""
        if path not in _loaded:
            _loaded[path] = Codec(path)
        return _loaded[path]

    def merged(self, text: str) -> list[str]:
        """The characters of a short text merged by the model's rules: the best score first, then the leftmost."""
        parts, score = list(text), self.score.get
        pairs = [score(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best, at = None, 0
            for i, s in enumerate(pairs):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at < len(pairs):
                pairs[at] = score(parts[at] + parts[at + 1])
            if at:
                pairs[at - 1] = score(parts[at - 1] + parts[at])

    def text_of(self, piece: int) -> str:
        return self.pieces[piece] if piece < OTHER else chr(piece - OTHER)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two pieces stay as they are when their text is merged; without a left one it is -1."""
        a, b = "" if left < 0 else self.text_of(left), self.text_of(right)
        if len(self.goes) >= PAIRS:
            self.goes.clear()
        found = self.goes[left << 22 | right] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def cut(self, chunk: str) -> list[int]:
        """The chunk's pieces by backtracking; a character that is no piece stands alone, as OTHER and its number."""
        n = len(chunk)
        here_of: list[list[int]] = [[] for _ in range(n)]
        for last, found in self.automaton.iter(chunk):
            here_of[last - (found & 255) + 1].append(found)  # the longest of a place comes last
        failed, pos, before, known, compatible = 0, 0, -1, self.goes.get, self.compatible
        taken: list[int] = []
        starts: list[int] = []
        tries = [0] * n  # how many of a place's pieces have been given up
        while pos < n:
            here = here_of[pos]
            if not here or here[0] & 255 != 1:
                here.insert(0, OTHER + ord(chunk[pos]) << 8 | 1)
            for k in range(len(here) - 1 - tries[pos], -1, -1):
                found = here[k]
                end, piece = pos + (found & 255), found >> 8
                if failed >> end & 1:
                    continue
                goes = known(before << 22 | piece)
                if goes or goes is None and compatible(before, piece):
                    tries[pos] = len(here) - 1 - k
                    taken.append(piece)
                    starts.append(pos)
                    pos, before = end, piece
                    break
            else:
                failed |= 1 << pos
                if not taken:
                    raise ValueError(f"no tokenisation of {chunk!r}")
                tries[pos] = 0
                taken.pop()
                pos = starts.pop()
                before = taken[-1] if taken else -1
        return taken

    def encode_chunk(self, chunk: str) -> bytes:
        """A chunk's ids; between two characters that stand together in no piece it is cut, and the parts remembered."""
        together, parts, first = self.together, [], 0
        for k in range(1, len(chunk)):
            if chunk[k - 1 : k + 1] not in together:
                parts.append(chunk[first:k])
                first = k
        if not first:
            return self.encode_part(chunk)
        parts.append(chunk[first:])
        out = []
        for part in parts:
            ids = self.part_ids.get(part)
            if ids is None:
                if len(self.part_ids) >= CHUNKS:
                    self.part_ids.clear()
                ids = self.part_ids[part] = self.encode_part(part)
            out.append(ids)
        return b"".join(out)

    def encode_part(self, part: str) -> bytes:
        ids = self.cut(part)
        if max(ids) >= OTHER:
            ids = [i for piece in ids for i in ([piece] if piece < OTHER else [self.byte_id[b] for b in chr(piece - OTHER).encode()])]
        return array("i", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text with the end id, as the bytes of int32."""
        if not text:
            return np.int32(self.end).tobytes()
        marked = (MARK + text).replace(" ", MARK)
        # behind the first character, a mark after another character starts a chunk
        if not self.lines or MARK * 2 in marked or marked[-1] == MARK or MARK + "\n" in marked:
            chunks = re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)
        else:
            chunks = marked[1:].replace("\n", MARK + "\n").split(MARK)  # each without its one mark, or from a line feed
        found = list(map(self.chunk_ids.get, chunks))
        if None in found:
            whole = (MARK, "\n")
            for i, ids in enumerate(found):
                if ids is None:
                    ids = self.chunk_ids.get(chunks[i])
                    if ids is None:
                        if len(self.chunk_ids) >= CHUNKS:
                            self.chunk_ids.clear()
                        ids = self.encode_chunk(chunks[i] if chunks[i][:1] in whole else MARK + chunks[i])
                        self.chunk_ids[chunks[i]] = ids
                    found[i] = ids
        found.append(np.int32(self.end).tobytes())
        return b"".join(found)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids are nothing, the first mark goes, a byte that is no UTF-8 is U+FFFD."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_loose(ids)
        first = next((i for i in ids if not self.is_control[i]), None)
        return text[1:] if first is not None and not self.is_byte[first] and text[:1] == " " else text

    def _decode_loose(self, ids: list[int]) -> str:
        out, run = [], b""
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.bytes_of[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        break
                    except UnicodeDecodeError:
                        size = 0
                else:
                    out.append("�")
                run = run[max(size, 1) :]
            if i is not None:
                out.append(self.bytes_of[i].decode())
        return "".join(out)


def encode_decode(df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each row its id, `ids` (array of int, the end id last) and `decoded` (the text that those ids give back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(model_path)
        for batch in sliced(batches, 1):
            encoded = [codec.encode(t) for t in texts_of(batch.column(1))]
            offsets = np.zeros(len(encoded) + 1, np.int64)
            np.cumsum([len(x) >> 2 for x in encoded], out=offsets[1:])
            values = np.frombuffer(b"".join(encoded), np.int32)
            decoded = [codec.decode(np.frombuffer(x, np.int32).tolist()) for x in encoded]
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(decoded, pa.string())], names=["id", "ids", "decoded"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    return short_batches(rows).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_column)


def decode(df: DataFrame, model_path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """For each row its id and `decoded`, the text of its ids; null ids give the empty text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = Codec.load(model_path)
        texts = [codec.decode(ids or []) for ids in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "decoded"])

    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("id"), F.col(ids_column).alias("ids"))
    return map_batches(rows, run, f"id {kind}, decoded string").withColumnRenamed("id", id_column)
