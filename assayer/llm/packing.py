"""Packing of documents into windows by the sum-of-squares rule.

Documents come one by one.  Whole windows are cut off a document first; the rest
of it goes where the sum, over all fill levels, of the squared number of partly
filled windows at that level grows least: into a window at one of the levels with
room for it, or into a new one.  An array holds how many windows stand at each
level, so a placement costs one pass over the levels, however many windows there
are.

Each partition of the input packs its own windows, so nothing is shuffled and no
task sees more than its partition.  Open windows are bounded: when there are more
than ``max_open`` of them, or at a partition's end, the emptiest are dissolved and
their pieces placed again by the same rule, now without new windows.  A piece that
no window has room for fills the emptiest one, and its rest is placed in turn.  One
window of a partition at most then stays unfilled.

Defined results
  null text       packed as an empty one: the end id alone
  repeated rows   each row is packed by itself
  null id         carried as null
  long texts      of any kind and length are encoded in linear time; a document
                  of more than a window is cut into whole windows and a rest
  extra columns   stay behind; an id column with the name of a result is refused
"""

from __future__ import annotations

import unicodedata
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._run import refuse_clash, ship

CAPACITY, END_ID, SPECIAL = 1024, 0, "<|endoftext|>"


@dataclass(slots=True)
class Piece:
    document: int  # place in the table of documents that the packer was given
    start: int
    ids: np.ndarray


class Packer:
    """Places documents one by one; ``closed`` takes each window that is done, as a list of pieces."""

    def __init__(self, capacity: int = CAPACITY, max_open: int = 2048):
        self.capacity, self.max_open = capacity, max_open
        self.levels = np.zeros(capacity + 1, np.int64)  # level: partly filled windows at it
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity)]
        self.open = 0
        self.closed: list[list[Piece]] = []

    def place(self, size: int, new: bool = True) -> int:
        """The level of the window to put ``size`` ids into (0: a new one; without ``new``, none has room)."""
        n, c = self.levels, self.capacity
        before = n[: c - size + 1].copy()
        after = n[size : c + 1]
        growth = 2 * (after - before) + 2
        growth[before == 0] = np.iinfo(np.int64).max
        growth[0] = 2 * n[size] + 1 if new else np.iinfo(np.int64).max
        if before[c - size] and c - size:  # a full window counts no more
            growth[c - size] = 1 - 2 * before[c - size]
        level = int(len(growth) - 1 - np.argmin(growth[::-1]))  # of equals, the fullest
        return level if new or growth[level] < np.iinfo(np.int64).max else 0

    def add(self, document: int, ids: np.ndarray) -> None:
        whole = len(ids) // self.capacity * self.capacity
        for at in range(0, whole, self.capacity):
            self.closed.append([Piece(document, at, ids[at : at + self.capacity])])
        if whole < len(ids):
            self._put(Piece(document, whole, ids[whole:]))
            if self.open > self.max_open:
                self.compact(self.max_open // 2)

    def _put(self, piece: Piece) -> None:
        size = len(piece.ids)
        level = self.place(size)
        window = self._take(level) if level else []
        window.append(piece)
        self._keep(window, level + size)

    def _take(self, level: int) -> list[Piece]:
        self.levels[level] -= 1
        self.open -= 1
        return self.windows[level].pop()

    def _keep(self, window: list[Piece], level: int) -> None:
        if level == self.capacity:
            self.closed.append(window)
        else:
            self.levels[level] += 1
            self.open += 1
            self.windows[level].append(window)

    def compact(self, most: int) -> None:
        """Dissolves the emptiest windows into the others until ``most`` at most are open."""
        while self.open > most:
            for piece in self._take(self._emptiest()):
                self._refill(piece)

    def _emptiest(self) -> int:
        return int(np.flatnonzero(self.levels)[0])

    def _refill(self, piece: Piece) -> None:
        while self.open:
            size = len(piece.ids)
            if size <= self.capacity and (level := self.place(size, new=False)):
                self._keep([*self._take(level), piece], level + size)
                return
            level = self._emptiest()
            room = self.capacity - level
            self._keep([*self._take(level), Piece(piece.document, piece.start, piece.ids[:room])], self.capacity)
            piece = Piece(piece.document, piece.start + room, piece.ids[room:])
        self._keep([piece], len(piece.ids))

    def finish(self) -> None:
        self.compact(1)
        for level in range(self.capacity):
            self.closed += self.windows[level]
        self.levels[:], self.open = 0, 0
        self.windows = [[] for _ in range(self.capacity)]


class Tokenizer:
    """The ids that the tokenizers library gives for a file of a byte-level vocabulary.

    Texts are split as that library does, and each different piece is encoded by its
    model once.  Characters that are unassigned in the Unicode version of this Python
    can be letters to one splitter and not to another, so a text with one of them goes
    through the library whole.
    """

    def __init__(self, path: str, pattern: str, special: str = SPECIAL, kept: int = 200_000):
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.special, self.special_id = special, self.library.token_to_id(special)
        letters, model = _byte_letters(tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)), self.library.model
        self.pieces = bpe.Pieces(pattern, lambda p: [t.id for t in model.tokenize(charmap_decode(p.encode(), "strict", letters)[0])], kept)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; pieces that are new to several of them are encoded in a row."""
        split = [self._parts(t) for t in texts]
        found, out = self.pieces.encode_all(p for parts in split for p in parts), []
        for text, parts in zip(texts, split):
            if not parts:
                out.append(np.asarray(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
                continue
            ids = [next(found)]
            for _ in parts[1:]:
                ids += [np.array([self.special_id], np.int32), next(found)]
            out.append(np.concatenate(ids).astype(np.uint32))
        return out

    def _parts(self, text: str) -> list[str]:
        """What lies between special tokens; nothing for a text that goes through the library."""
        if not _western(text) and _unassigned()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return []
        return text.split(self.special) if self.special_id is not None else [text]


def _western(text: str) -> bool:
    """Whether all characters are below U+0100, where all are assigned."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _byte_letters(alphabet) -> str:
    """The letter that the library writes for each byte, seen on characters whose UTF-8 has that byte."""
    letters = ["\0"] * 256  # some bytes never occur
    for code in (*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x10000, 0x400), *range(0x10000, 0x110000, 0x10000)):
        for byte, letter in zip(chr(code).encode(), alphabet.pre_tokenize_str(chr(code))[0][0]):
            letters[byte] = letter
    return "".join(letters)


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def tokenizer(path: str, pattern: str, kept: int = 200_000) -> Tokenizer:
    return Tokenizer(path, pattern, kept=kept)


OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(df: DataFrame, *, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, max_open: int = 2048, json_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: where it lies in its document and in its sequence; ``with_ids`` adds the ids.

    ``sequence_id`` joins the partition's number and a count, so it is unique.
    """
    ship(df.sparkSession)
    refuse_clash((id_column,), [*(x.split()[0] for x in OUT.split(", ")), "token_ids"])
    source = df.select(F.col(id_column), F.col(text).alias("__text"))
    kind = source.schema[0].dataType.simpleString()
    names = [id_column, *[x.split()[0] for x in OUT.split(", ")]] + ["token_ids"] * with_ids
    schema = f"`{id_column}` {kind}, {OUT}" + ", token_ids array<int>" * with_ids

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = tokenizer(json_path or public_tokenizers.path("byte_bpe_50k.json"), bpe.default_pattern())
        packer = Packer(capacity, max_open)
        documents: dict[int, list] = {}  # place: id, its tokens, tokens not yet given out
        context = TaskContext.get()
        sequence, place, id_type = (context.partitionId() if context else 0) << 40, 0, pa.int64()

        def given() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for window in packer.closed:
                offset = 0
                for p in window:
                    d = documents[p.document]
                    rows.append((d[0], p.start, len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes()), d[1], sequence, offset, *([p.ids.astype(np.int32)] if with_ids else [])))
                    offset += len(p.ids)
                    d[2] -= len(p.ids)
                    if not d[2]:
                        del documents[p.document]
                sequence += 1
            packer.closed.clear()
            columns = list(zip(*rows)) or [[]] * len(names)
            kinds = [id_type, *[pa.int64()] * 6] + [pa.list_(pa.int32())] * with_ids
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encoder.encode(t or ""), np.uint32(END_ID))
                documents[place] = [doc, len(ids), len(ids)]
                packer.add(place, ids)
                place += 1
                if len(packer.closed) >= 4096:
                    yield given()
        packer.finish()
        if packer.closed:
            yield given()

    return source.mapInArrow(packed, schema)
