"""Quality rules by distribution divergence.

Each language of the corpus has two reference histograms, counted over all its
documents: classes of characters, and its commonest words (all other words fall
into one more bin).  A document passes if the Jensen-Shannon distance of its own
histograms to those of its language stays within a limit.  A histogram of few
events is noise, so each comparison has a minimum length below which it abstains.
A text without a reference of its own is held against that of the language which is
nearest by n-grams (see ``language_id``); where none is near, both comparisons abstain.

Defined results
  null text      as an empty one: no words, ``base_failed``, not kept
  null language  has no reference of its own, and neither has a language with
                 fewer than ``min_reference_words`` words
  no letter      and no reference of its own: the nearest by classes of characters
  repeated rows  each row is judged by itself, so equal rows get equal results
  long texts     are judged whole
  extra columns  stay behind unless carried; a carried one with a result's name is refused
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._run import cut, refuse_clash, ship
from .language_id import Profiles, learn

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
PIECE_WORDS, HELD_WORDS = 20_000, 4_000_000  # words of a language that make a piece, and those that a task holds
TOLD = 4  # a piece tells its words from this part of the common share on
#: Character classes, in the order of the histogram.
CLASSES = ("lower", "upper", "digit", "space", "line end", "sentence", "quote", "symbol", "other ascii", "wide lower", "wide upper", "other wide")


@dataclass(frozen=True)
class Limits:
    """Limits of the verdict; shares and distances are between 0 and 1.

    A histogram of n events in k bins strays from its source by about
    sqrt((k - 1) / (8 n ln 2)), so the limit of a distance is its base and ``noise``
    times that.
    """

    min_words: int = 50
    max_repeat_share: float = 0.5
    common_words: int = 50
    common_share: float = 0.002
    min_reference_words: int = 2_000
    noise: float = 1.1
    max_char_distance: float = 0.20
    char_guard: int = 200
    max_word_distance: float = 0.09
    word_guard: int = 50

    def within(self, distance: float | None, base: float, bins: int, events: int) -> bool:
        return distance is None or distance <= base + self.noise * ((bins - 1) / (8 * events * log(2))) ** 0.5


@dataclass
class Reference:
    chars: np.ndarray
    words: dict[str, int] = field(default_factory=dict)
    word_shares: np.ndarray | None = None


class References(dict[str, Reference]):
    """The reference of each language, and the n-grams that tell these languages apart."""

    profiles: Profiles | None = None  # None: every text has a reference of its own, or there is none at all

    def of(self, text: str, lang: str | None) -> Reference | None:
        """What a text is held against; None if no language is near."""
        if lang in self or not self or not text or self.profiles is None:
            return self.get(lang)
        near, known = self.profiles.nearest(text)
        if near is None:
            chars = char_histogram(text)
            return min(self.values(), key=lambda r: js_distance(chars, r.chars))
        return self[near] if known else None


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, len(CLASSES) - 1, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.islower():
            table[code] = 0 if code < 128 else 9
        elif c.isupper():
            table[code] = 1 if code < 128 else 10
    for code in range(128):
        c = chr(code)
        if c.isalpha():
            continue
        table[code] = 2 if c.isdigit() else 4 if c == "\n" else 3 if c in SPACES else 5 if c in ".,;:!?" else 6 if c in "'\"-()" else 7 if c in SYMBOLS else 8
    return table


def char_histogram(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_class_table()[codes], minlength=len(CLASSES))


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance, base 2, of two histograms with any totals over 0."""
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(0.0, terms.sum() / 2)))


def words_of(text: str) -> list[bytes]:
    """Words, as UTF-8: bytes.split() cuts at just the six ASCII spaces."""
    return text.encode("utf-8", "surrogatepass").split()


def base_features(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    grams = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(grams)) < len(grams):
        times = Counter(grams)
        last = 0  # words before this place are counted
        for i, g in enumerate(grams):
            if times[g] > 1:
                repeated += i + 3 - max(i, last)
                last = i + 3
    return word_chars, symbols, len(lines) - len(set(lines)), repeated


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        yield from zip(*columns)


def build_references(df: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang", *, id_column: str = "doc_id", for_others: bool = True) -> References:
    """The references of each language.

    Common words are those with at least ``common_share`` of a language's words, the
    ``common_words`` most frequent of them.  Two passes find them.  In the first, tasks
    cut each language's texts into pieces of at least ``PIECE_WORDS`` words, and of each piece
    tell the words with a ``TOLD``-th of that share in it; what is too little for a piece counts
    whole.  A word can be common only if what was told of it, and a ``TOLD``-th of the share in all
    other pieces, come to the share.  So at least 1 - 1 / ``TOLD`` of the share was told of it, and
    however many vocabularies a language has, no more than 1 / ((1 - 1 / ``TOLD``) ``common_share``)
    words of it are left: 667.  Spark also drops those that enough others are ahead of for
    certain.  The second pass counts the words that are left and the classes of characters; only these
    come to the driver, and only for languages that have a reference.

    N-grams are learned from a bounded sample of each language.  With ``for_others``
    false only the rows of ``df`` are to be judged, so if each has a reference of its
    own, there is nothing to learn them for.
    """
    ship(df.sparkSession)
    share = limits.common_share
    source = df.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))

    def pieces(batches):
        whole: dict[str | None, tuple[Counter, int]] = {}  # each language's last piece, which takes up what is left at the end
        parts: dict[str | None, tuple[Counter, int]] = {}
        held = 0

        def given(la: str | None, words: Counter, n: int, large: bool) -> pa.RecordBatch:
            rows = [(w.decode("utf-8", "replace"), k) for w, k in words.items() if not large or k >= share / TOLD * n]
            ws, ks = [None, *(w for w, _ in rows)], [n, *(k for _, k in rows)]
            none = [0] * len(ws)
            columns = [[la] * len(ws), ws, ks if large else none, none if large else ks, [0, *[n] * len(rows)] if large else none]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(),) * 2 + (pa.int64(),) * 3)], ["l", "w", "large", "small", "told"])

        def all_of_them() -> Iterator[pa.RecordBatch]:
            for la, (words, n) in parts.items():
                if la in whole:
                    whole[la][0].update(words)
                    whole[la] = whole[la][0], whole[la][1] + n
                else:
                    yield given(la, words, n, False)
            for la, (words, n) in whole.items():
                yield given(la, words, n, True)
            parts.clear()
            whole.clear()

        for t, la in _rows(batches):
            if not t:
                continue
            found = words_of(t) if la is not None else []
            words, n = parts.get(la) or (Counter(), 0)
            words.update(found)
            parts[la] = words, n + len(found)
            held += len(found)
            if n + len(found) >= PIECE_WORDS:
                if la in whole:
                    yield given(la, *whole[la], True)
                whole[la] = parts.pop(la)
            if held > HELD_WORDS:
                yield from all_of_them()
                held = 0
        yield from all_of_them()

    known = source.mapInArrow(pieces, "l string, w string, large long, small long, told long")
    known = cut(known.groupBy("l", "w").agg(*[F.sum(c).alias(c) for c in ("large", "small", "told")]), "pieces")
    totals = known.where("w IS NULL").select("l", F.col("large").alias("all_large"), (F.col("large") + F.col("small")).alias("total"))
    has = F.col("l").isNotNull() & (F.col("total") >= max(1, limits.min_reference_words))
    counted_words = known.where("w IS NOT NULL").join(totals.where(has), "l")
    least = F.col("large") + F.col("small")
    most = least + share / TOLD * (F.col("all_large") - F.col("told"))
    sure = Window.partitionBy("l").orderBy(F.desc("least"), "w")
    words = counted_words.select("l", "w", least.alias("least"), most.alias("most"), "total").where(F.col("most") >= share * F.col("total"))
    words = words.withColumn("bar", F.nth_value("least", limits.common_words).over(sure.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    words = words.where(F.col("bar").isNull() | (F.col("most") >= F.col("bar"))).select("l", "w")
    wanted: dict[str, set[bytes]] = {la: set() for la in totals.where(has).select("l").toArrow()["l"].to_pylist()}
    for la, w in zip(*(c.to_pylist() for c in words.toArrow().columns)):
        wanted[la].add(w.encode())
    sent = df.sparkSession.sparkContext.broadcast(wanted)

    def counted(batches):
        chars: dict[str, np.ndarray] = {}
        sizes: dict[str, int] = {}
        times: dict[str, Counter] = {}
        for batch in batches:
            met: dict[str, Counter] = {}
            for t, la in _rows([batch]):
                if t and la in sent.value:
                    found = words_of(t)
                    met.setdefault(la, Counter()).update(found)
                    chars[la] = chars.get(la, 0) + char_histogram(t)
                    sizes[la] = sizes.get(la, 0) + len(found)
            for la, c in met.items():
                times.setdefault(la, Counter()).update({w: c[w] for w in sent.value[la] if w in c})
        rows = [(la, "n", "", n) for la, n in sizes.items()]
        for la in chars:
            rows += [(la, "c", str(i), int(n)) for i, n in enumerate(chars[la])]
            rows += [(la, "w", w.decode("utf-8", "replace"), n) for w, n in times[la].items()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(),) * 3 + (pa.int64(),))], ["l", "kind", "item", "n"])

    sums = source.mapInArrow(counted, "l string, kind string, item string, n long").groupBy("l", "kind", "item").agg(F.sum("n").alias("n")).toArrow()
    out, top = References(), {}
    for la in wanted:
        out[la] = Reference(np.zeros(len(CLASSES)))
    for la, kind, item, n in zip(*(c.to_pylist() for c in sums.columns)):
        if kind == "c":
            out[la].chars[int(item)] = n
        else:
            top.setdefault(la, []).append((-n, item))
    for la, found in top.items():
        found.sort()  # the total comes first: no word is more frequent, and the empty one sorts before all others
        total = -found[0][0]
        chosen = [x for x in found[1:] if -x[0] >= share * total][: limits.common_words]
        out[la].words = {w: i for i, (_, w) in enumerate(chosen)}
        out[la].word_shares = np.array([-n for n, _ in chosen] + [total + sum(n for n, _ in chosen)], float)
    if out and (for_others or not totals.where(F.coalesce(~has, F.lit(True))).isEmpty()):
        out.profiles = learn(df.where(F.col(lang).cast("string").isin(*out)), id_column=id_column, text=text, lang=lang)
    return out


def verdict(text: str, words: list[bytes], reference: Reference | None, limits: Limits) -> tuple[float | None, float | None, bool]:
    """Distances of characters and words (None: too short, or no reference), and whether both are within limits."""
    by_char = by_word = None
    if reference is not None and len(text) >= limits.char_guard:
        by_char = js_distance(char_histogram(text).astype(float), reference.chars)
    if reference is not None and len(words) >= limits.word_guard and reference.words:
        where = reference.words
        counts = np.zeros(len(where) + 1)
        for w, n in Counter(words).items():
            counts[where.get(w.decode("utf-8", "replace"), len(where))] += n
        by_word = js_distance(counts, reference.word_shares)
    good = limits.within(by_char, limits.max_char_distance, len(CLASSES), len(text))
    good = good and limits.within(by_word, limits.max_word_distance, len(reference.words) + 1 if reference else 1, len(words))
    return by_char, by_word, good


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _decide(t: str, reference: Reference | None, limits: Limits) -> tuple:
    """The values of OUT for one text."""
    words = words_of(t)
    base = base_features(t, words)
    failed = len(words) < limits.min_words or base[3] > limits.max_repeat_share * len(words)
    by_char, by_word, good = verdict(t, words, reference, limits)
    return len(words), *base, failed, good and not failed, by_char, by_word


def keep(df: DataFrame, references: References | None = None, limits: Limits = Limits(), *, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df``, with its columns, that ``judge`` keeps."""
    spark = df.sparkSession
    ship(spark)
    if references is None:
        references = build_references(df, limits, text, lang, id_column=id_column, for_others=False)
    sent = spark.sparkContext.broadcast(references)

    def kept(batches):
        refs = sent.value
        for batch in batches:
            rows = zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist())
            yield batch.filter(pa.array([_decide(t or "", refs.of(t or "", None if la is None else str(la)), limits)[6] for t, la in rows], pa.bool_()))

    return df.mapInArrow(kept, df.schema)


def judge(df: DataFrame, references: References | None = None, limits: Limits = Limits(), *, id_column: str = "doc_id", text: str = "text", lang: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: the id, the columns in ``carry``, and those of OUT."""
    spark = df.sparkSession
    ship(spark)
    if references is None:
        references = build_references(df, limits, text, lang, id_column=id_column, for_others=False)
    sent = spark.sparkContext.broadcast(references)
    refuse_clash((id_column, *carry), (x.split()[0] for x in OUT.split(", ")))
    source = df.select(id_column, *carry, F.col(text).alias("__text"), F.col(lang).cast("string").alias("__lang"))
    kept_columns = source.schema.fields[:-2]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept_columns) + ", " + OUT

    def judged(batches):
        refs = sent.value
        for batch in batches:
            texts, langs = (c.to_pylist() for c in batch.columns[-2:])
            rows = []
            for t, la in zip(texts, langs):
                rows.append(_decide(t or "", refs.of(t or "", la), limits))
            columns = list(zip(*rows)) or [[]] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = [f.name for f in kept_columns]
            yield pa.RecordBatch.from_arrays(batch.columns[:-2] + [pa.array(c, k) for c, k in zip(columns, kinds)], names + [x.split()[0] for x in OUT.split(", ")])

    return source.mapInArrow(judged, schema)
