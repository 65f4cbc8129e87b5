"""Periodic runs of words: stretches that repeat one block of words over and over.

For each text the lags at which words meet themselves again are counted exactly.  Frequent
words are counted by autocorrelation, one Fourier transform each; of rare words all pairs of places
are subtracted.  A run of period q and length n has n - q matches at lag q, so only lags with
as many matches as the shortest run of their period needs are looked at further.  There the islands
of matches are found: long ones cover several multiples of the lag, so these are tested first.
Matches within a run that was found already don't count for multiples of its period, since what
has the smaller period is no run of the larger one.

Nothing is shuffled, and each text is one row of one task.

Defined results
  null or empty text, no word   no word, no run, an empty text
  null id         carried as null
  repeated rows   each row is looked at by itself
  ties            of runs with the same exponent the first is the strongest, then the shorter period
  long texts      whole; time grows about as n * sqrt(n) at most, where most words are frequent
                  or rare alike, memory with n
  extra columns   stay behind; an id column with the name of a result is refused
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._run import refuse_clash, ship

WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: A run has this many words, and this many times its period, at least.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Numbers that one transform of frequent words holds.
_AT_ONCE = 1 << 21
RUNS = "array<struct<start:long,length:long,period:long>>"


def needed(q, words: int = LEAST_WORDS, times: int = LEAST_TIMES):
    """Matches at lag q of the shortest run with period q."""
    return np.maximum(words, times * q) - q


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """How many words equal the word q places on, for q up to ``most``, exactly."""
    n, found = len(ids), np.zeros(most + 1, np.int64)
    size = 1 << int(n + most).bit_length()  # so long that nothing wraps around
    times = np.bincount(ids)
    heavy = np.flatnonzero((times > 16) & (32 * times * times > size * size.bit_length()))
    if len(heavy):
        power = np.zeros(size // 2 + 1)
        for at in range(0, len(heavy), max(1, _AT_ONCE // size)):
            words = heavy[at : at + max(1, _AT_ONCE // size)]
            spectrum = np.fft.rfft((ids == words[:, None]).astype(np.float64), size, axis=1)
            power += (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
        found += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    rare = np.ones(len(times), bool)
    rare[heavy] = False
    rare &= times > 1
    places = np.flatnonzero(rare[ids])
    places = places[np.argsort(ids[places], kind="stable")]  # of each word in a row, in order
    word = ids[places]
    end = np.searchsorted(word, word, "right") if len(word) else word
    here, step = np.arange(len(places)), 1
    while len(here):
        here = here[here + step < end[here]]
        lags = places[here + step] - places[here]
        near = lags <= most
        here = here[near]  # places further on are further away
        found += np.bincount(lags[near], minlength=most + 1)
        step += 1
    found[0] = n
    return found


def islands(ids: np.ndarray, q: int, need: int) -> list[tuple[int, int]]:
    """Start and end of each longest stretch of ``need`` or more matches at lag q."""
    n, step = len(ids) - q, need // 3
    if n < need:
        return []
    if step < 4:
        return _long(ids[:n] == ids[q:], 0, need)
    hit = ids[:n:step] == ids[q::step][: -(-n // step)]  # an island covers three of these in a row at least
    three = np.flatnonzero(hit[:-2] & hit[1:-1] & hit[2:])
    out: list[tuple[int, int]] = []
    for group in np.split(three, np.flatnonzero(np.diff(three) > 1) + 1) if len(three) else []:
        a, b = max(0, (int(group[0]) - 1) * step), min(n, (int(group[-1]) + 3) * step + 1)
        out += _long(ids[a:b] == ids[a + q : b + q], a, need)
    return sorted(set(out))


def _long(match: np.ndarray, first: int, need: int) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], match.view(np.int8), [0]))))
    return [(first + int(a), first + int(b)) for a, b in zip(edges[::2], edges[1::2]) if b - a >= need]


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] * (q > 1)


def runs(ids: np.ndarray, words: int = LEAST_WORDS, times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run, by start and period."""
    n = len(ids)
    most = n // times
    if n < words or most < 1:
        return []
    matches, found = lag_counts(ids, most), []
    need = needed(np.arange(most + 1), words, times)
    q = 0
    for q in np.flatnonzero(matches >= need).tolist():
        if not q or matches[q] < need[q]:  # it may be less by now
            continue
        for a, b in islands(ids, q, int(need[q])):
            if any((ids[a : b + q - d] == ids[a + d : b + q]).all() for d in (q // p for p in _primes(q))):
                continue
            length = b + q - a
            found.append((a, length, q))
            multiples = np.arange(2 * q, min(most, length) + 1, q)
            matches[multiples] -= length - multiples
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run that repeats its period most often."""
    best = None
    for r in found:
        if best is None or (by := r[1] * best[2] - best[1] * r[2]) > 0 or by == 0 and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


def collapse(words: list[str], found: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def detect(df: DataFrame, *, id_column: str = "doc_id", text: str = "text", words: int = LEAST_WORDS, times: int = LEAST_TIMES) -> DataFrame:
    """The id column, n_words, ``runs`` (by start, then period), ``strongest`` and ``collapsed``, the text's kept words joined by one space.

    A run has ``words`` words and ``times`` its smallest period at least.
    """
    if words < 1 or times < 4:
        raise ValueError("a run has a word and four times its period at least")  # three multiples of a lag are tested first
    ship(df.sparkSession)
    refuse_clash((id_column,), ("n_words", "runs", "strongest", "collapsed"))
    source = df.select(F.col(id_column), F.col(text).alias("__text"))
    kind = source.schema[0].dataType.simpleString()
    names = [id_column, "n_words", "runs", "strongest", "collapsed"]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    as_run = lambda r: None if r is None else dict(zip(("start", "length", "period"), r))

    def detected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                given = _WORD.findall(t.as_py() or "")
                number = defaultdict(count().__next__)
                found = runs(np.fromiter(map(number.__getitem__, given), np.int64, len(given)), words, times)
                rows.append((len(given), [as_run(r) for r in found], as_run(strongest(found)), " ".join(collapse(given, found))))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.list_(run), run, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    return source.mapInArrow(detected, f"`{id_column}` {kind}, n_words long, runs {RUNS}, strongest {RUNS[6:-1]}, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the repeats that the query's contract puts into every document whose crc32(doc_id) is a multiple of ten."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / 10).cast("long"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    whole = F.struct(words.alias("w"), F.size(words).cast("long").alias("n"), g.alias("g"))

    def repeated(x: Column) -> Column:
        a = F.pmod(x["g"], x["n"])
        p = 1 + F.floor((x["n"] - a) / (3 + F.pmod(x["g"], F.lit(8)))).cast("long")
        again = lambda i: F.when(i >= a, a + F.pmod(i - a, p)).otherwise(i).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), x["n"] - 1), lambda i: F.get(x["w"], again(i))), " ")

    done = F.get(F.transform(F.array(whole), lambda x: F.when(x["n"] > 0, repeated(x)).otherwise(text)), F.lit(0))
    return F.when(h % 10 == 0, done).otherwise(text)


def digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What ``detect`` found, as counts, the strongest run and SHA-256 of all runs and of the collapsed text."""
    s = F.col("strongest")
    line = lambda r: F.concat(F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")]), F.lit("\n"))
    return found.select(
        id_column,
        F.size("runs").cast("long").alias("n_runs"),
        *[s[f].alias(f) for f in ("start", "length", "period")],
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
