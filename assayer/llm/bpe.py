"""Byte-level BPE with whole texts cut into overlapping chunks.

A long text is cut into chunks that overlap.  Threads pre-tokenise the chunks at
the same time, each from the chunk's own start, which may lie inside a
pre-token.  Where the boundaries of two neighbours meet inside their overlap they
agree from there on, since a match depends only on what follows it; the chunks are
stitched at that place.  Where they never meet, the second is matched again from
the first one's last boundary.  The pieces are then encoded one by one, and
decoding joins the bytes of the ids.

Defined results
  null text      as an empty one: no ids
  null ids       as an empty list: no bytes
  repeated rows  each row is encoded by itself
  long texts     cost time in proportion to their length; a row is one array of ids
  extra columns  stay behind unless named in ``carry``; a carried one with the name
                 of the result is refused
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._run import refuse_clash, ship

CHUNK, OVERLAP, THREADS = 1 << 15, 512, 2
#: Characters that the pattern looks at behind the end of a match that could be another one: of "'re" the last two.
LOOK_AHEAD = 2
#: Characters of the longest piece that is remembered, and of texts that are looked up before what is new in them is encoded.
LONGEST, TOGETHER = 64, 1 << 19


def ends(text: str, pattern: regex.Pattern, start: int, stop: int) -> list[int]:
    """Ends of the matches from ``start`` on that hold whatever follows ``stop``.

    A match that could have been longer, had more of the text been seen, ends less
    than ``LOOK_AHEAD`` characters before ``stop``.
    """
    found = list(accumulate(map(len, pattern.findall(text, start, stop, concurrent=True)), initial=start))[1:]
    if stop < len(text):
        while found and found[-1] > stop - LOOK_AHEAD:
            found.pop()
    return found


def pretokenise(text: str, pattern: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP, pool: ThreadPoolExecutor | None = None) -> list[str]:
    """All matches of a pattern that covers every character, by chunks; the time grows with the text's length alone."""
    if overlap <= LOOK_AHEAD or chunk < 1:
        raise ValueError(f"chunks must overlap by more than {LOOK_AHEAD} characters")
    n = len(text)
    if n <= chunk:
        return pattern.findall(text)
    starts = range(0, n, chunk)
    spans = [(text, pattern, s, min(n, s + chunk + overlap)) for s in starts]
    parts = list(pool.map(lambda x: ends(*x), spans)) if pool else [ends(*x) for x in spans]
    true = parts[0]
    for s, part, span in zip(starts[1:], parts[1:], spans[1:]):
        mine = {s, *part}
        k = next((k for k in range(_first(true, s), len(true)) if true[k] in mine), None)
        if k is None:  # no boundary in common: go on from the last one that is sure
            true += ends(text, pattern, true[-1] if true else 0, span[3])
        else:
            del true[k + 1 :]
            true += part[_first(part, true[k] + 1) :]
    cuts = [0, *true]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])] + ([text[cuts[-1] :]] if cuts[-1] < n else [])


def _first(values: list[int], least: int) -> int:
    from bisect import bisect_left

    return bisect_left(values, least)


def plain(pattern: str) -> re.Pattern | None:
    """The same pattern for the faster engine of the standard library, its classes written out; None if it has others.

    Classes end at U+FFFF, so it serves texts without characters beyond.
    """
    spelled = {}
    for name in (r"\p{L}", r"\p{N}", r"\s"):
        one, found = regex.compile(name), []
        for c in range(0x10000):
            if not 0xD800 <= c < 0xE000 and one.match(chr(c)):
                if found and found[-1][1] == c - 1:
                    found[-1][1] = c
                else:
                    found.append([c, c])
        spelled[name] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in found)
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{''.join(spelled.values())}]").replace(r"\S", f"[^{spelled[r'\s']}]")
    for name, chars in spelled.items():
        out = out.replace(name, f"[{chars}]")
    return None if re.search(r"\\p|\\P|\(\?[^!:=]|[+*?}]\+", out) else re.compile(out)


class _Known(dict):
    """Pieces and the bytes of their ids; one that isn't there is taken from the generation before, or gets an empty place for its ids."""

    def __init__(self, before: dict[str, bytes]):
        self.before, self.new, self.long = before, {}, {}

    def __missing__(self, piece: str) -> bytes | bytearray:
        ids = self.before.get(piece)
        if ids is None:
            return (self.new if len(piece) <= LONGEST else self.long).setdefault(piece, bytearray())
        self[piece] = ids
        return ids


class Pieces:
    """Pre-tokenised pieces met lately with their ids, in two generations of ``kept`` each, so frequent ones stay.

    Texts are looked up some at a time, and then the pieces that nobody knew are encoded in a row.
    A piece of more than ``LONGEST`` characters is forgotten when its texts are done, so what is
    remembered is bounded in bytes too, whatever the texts.
    """

    def __init__(self, pattern: str, ids_of: Callable[[str], list[int]], kept: int = 200_000):
        self.pattern, self.fast, self.ids_of, self.kept = regex.compile(pattern), plain(pattern), ids_of, kept
        self.known = _Known({})

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, pool: ThreadPoolExecutor | None = None) -> np.ndarray:
        """Ids of the whole text.  Chunks pay with threads alone: without a ``pool`` the faster engine, linear too, takes long texts whole."""
        return self._together([text], chunk, overlap, pool)[0]

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """Ids of each text, ``TOGETHER`` characters and a text at a time."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= TOGETHER:
                yield from self._together(some)
                some, size = [], 0
        yield from self._together(some)

    def _split(self, text: str, chunk: int, overlap: int, pool: ThreadPoolExecutor | None) -> list[str]:
        if (len(text) <= chunk or not pool) and self.fast and (text.isascii() or len(text.encode("utf-16-le")) == 2 * len(text)):
            return self.fast.findall(text)
        return pretokenise(text, self.pattern, chunk, overlap, pool)

    def _together(self, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP, pool: ThreadPoolExecutor | None = None) -> list[np.ndarray]:
        if len(self.known) > self.kept:
            self.known.before = {}
            self.known = _Known(self.known)
        known = self.known
        known.new, known.long = {}, {}  # places that an error left empty are none
        found = [list(map(known.__getitem__, self._split(t, chunk, overlap, pool))) for t in texts]
        for piece, place in known.new.items():
            known[piece] = ids = array("i", self.ids_of(piece)).tobytes()
            place += ids
        for piece, place in known.long.items():
            place += array("i", self.ids_of(piece)).tobytes()
        known.new, known.long = {}, {}
        return [np.frombuffer(b"".join(x), np.int32) for x in found]


class Vocabulary(Pieces):
    """Ranks of a vocabulary file."""

    def __init__(self, path: str, pattern: str, kept: int = 200_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        super().__init__(pattern, self.library._encode_single_piece, kept)
        tokens = [b""] * (max(ranks.values()) + 1)
        for b, i in ranks.items():
            tokens[i] = b
        self.lengths = np.array([len(b) for b in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids) -> bytes:
        """The bytes of all ids, one behind the other."""
        ids = np.asarray(ids, np.int64)
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        at += np.arange(len(at))
        return self.bytes[at].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode(df: DataFrame, *, text: str = "text", path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, carry: tuple[str, ...] = ("doc_id",), out: str = "token_ids", rows_at_once: int = 256) -> DataFrame:
    """The columns in ``carry`` and the ids of the whole text.

    ``path`` and ``pattern`` are found on each worker if not given.
    """
    ship(df.sparkSession)
    refuse_clash(carry, (out,))
    source = df.select(*carry, F.col(text).alias("__text"))
    fields = source.schema.fields[:-1]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` array<int>"])

    def encoded(batches):
        v = vocabulary(path or default_path(), pattern or default_pattern())
        with ThreadPoolExecutor(THREADS) as pool:
            for whole in batches:
                for at in range(0, whole.num_rows, rows_at_once):
                    batch = whole.slice(at, rows_at_once)
                    ids = [v.encode(t or "", chunk, overlap, pool) for t in batch.column(len(names)).to_pylist()]
                    cuts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [lists], [*names, out])

    return source.mapInArrow(encoded, schema)


def decode(df: DataFrame, *, ids: str = "token_ids", path: str | None = None, pattern: str | None = None, out: str = "decoded", rows_at_once: int = 256) -> DataFrame:
    """``df`` with the bytes that its ids stand for."""
    ship(df.sparkSession)
    refuse_clash(df.columns, (out,))
    fields = df.schema.fields
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{out}` binary"])

    def decoded(batches):
        v = vocabulary(path or default_path(), pattern or default_pattern())
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(at, rows_at_once)
                lists = batch.column(ids)
                values, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
                found = [v.decode(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]  # of a null list both are the same
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], [*names, out])

    return df.mapInArrow(decoded, schema)


def digests(df: DataFrame, *, ids: str = "token_ids", decoded: str = "decoded", carry: tuple[str, ...] = ("doc_id",), block: int = 1 << 16) -> DataFrame:
    """The columns in ``carry``, ``n_tokens``, and SHA-256 of the ids (decimal, joined by one space) and of the decoded bytes.

    Ids are hashed block by block, so no text of all of them is ever held.
    """
    ship(df.sparkSession)
    refuse_clash(carry, ("n_tokens", "ids_sha256", "decoded_sha256"))
    source = df.select(*carry, F.col(ids), F.col(decoded))
    names = [f.name for f in source.schema.fields[:-2]]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-2]] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"])

    def hashed(batches):
        for batch in batches:
            lists, rows = batch.column(len(names)), []
            values, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for a, b, data in zip(cuts[:-1].tolist(), cuts[1:].tolist(), batch.column(len(names) + 1)):
                h = hashlib.sha256()
                for at in range(a, b, block):
                    h.update((" " * (at > a) + " ".join(map(str, values[at : min(b, at + block)].tolist()))).encode())
                rows.append((b - a, h.hexdigest(), hashlib.sha256(data.as_buffer() or b"").hexdigest()))
            columns = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string())))], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(hashed, schema)
