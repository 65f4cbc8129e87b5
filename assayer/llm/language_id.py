"""Language identification by rank-order profiles of n-grams.

A text is lower-cased; its runs of letters, set off by single spaces, give all
n-grams of one to ``orders`` characters.  A language's profile lists its most
frequent n-grams by rank.  A document's own most frequent n-grams are compared
with each profile: the distance is the sum of the differences in rank, and
n-grams that a profile lacks count ``profile_size``.  The smallest distance wins,
and of equal ones the language whose name sorts first.

Defined results
  null text, or no letter    ``und`` with score 0
  no profile at all          ``und`` with score 0
  null language              such a row is not learned from, but is predicted
  repeated rows              each row is predicted by itself; learned from once
  null ids                   rows are drawn by id and text, so they are drawn as any other
  very many languages        each is one column of sparse ranks; what comes to the
                             driver is ``size`` n-grams of each
  long texts                 are read whole; a text's n-grams are numbers in arrays
  extra columns              stay behind unless carried; a carried one with a result's
                             name is refused
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._run import cut, refuse_clash, ship

UNKNOWN = "und"
#: Mean difference in rank beyond which a text is of no known language.  On sf0.1, with the sizes that
#: ``learn`` takes, 999 of 1000 texts with 300 n-grams are within 0.46 of their own language, all but
#: mixtures with 100 to 300 within 0.58; Polish, Finnish and random letters are at 0.74 or more from 50 words on.
MAX_DISTANCE = 0.6
#: A text of fewer different n-grams tells less, so its limit rises in proportion, by ``FEW_ALLOWANCE`` at most.
FEW_GRAMS, FEW_ALLOWANCE = 100, 0.2
_BITS, MOST_ORDERS = 21, 3  # bits of a code point, and how many of these an integer holds
#: Learned languages up to which their sampling shares are broadcast; of more they are joined like any table.
_BROADCAST_LANGUAGES = 20_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(text: str, orders: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams as integers, ascending, and how often each occurs; a gram holds one letter at least."""
    if not 1 <= orders <= MOST_ORDERS:
        raise ValueError(f"n-grams of 1 to {MOST_ORDERS} characters fit an integer, not of {orders}")
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shown = letter.copy()  # letters, and the first other character after each run of letters
    shown[1:] |= letter[:-1]
    codes = np.where(letter, codes, 32)[shown].astype(np.int64)
    if codes[-1] != 32:
        codes = np.append(codes, 32)
    codes = np.concatenate(([32], codes))
    found, gram = [], codes
    found.append(gram[gram != 32])
    for n in range(2, orders + 1):
        gram = (gram[:-1] << _BITS) | codes[n - 1 :]
        inside = codes[1 : len(codes) - 1] != 32  # no space but at the ends: the middle of a trigram is a letter
        found.append(gram if n == 2 else gram[inside[: len(gram)]] if n == 3 else gram)
    return np.unique(np.concatenate(found), return_counts=True)


def most_frequent(values: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent values, ties to the smaller one."""
    return values[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    """Ranks of all profiles' n-grams: of each n-gram, the languages that hold it and its rank in each."""

    languages: list[str]
    values: np.ndarray  # all n-grams, ascending
    starts: np.ndarray  # where each one's languages begin, and the end of all
    holders: np.ndarray  # places in ``languages``
    ranks: np.ndarray
    size: int
    document_size: int

    @classmethod
    def of(cls, tops: dict[str, np.ndarray], size: int, document_size: int) -> Profiles:
        languages = sorted(tops)
        lengths = [len(tops[x]) for x in languages]
        grams_of = np.concatenate([np.empty(0, np.int64), *(tops[x] for x in languages)])
        holders = np.repeat(np.arange(len(languages)), lengths)
        ranks = np.concatenate([np.empty(0, np.int64), *(np.arange(n) for n in lengths)])
        order = np.argsort(grams_of, kind="stable")
        values, first = np.unique(grams_of[order], return_index=True)
        return cls(languages, values, np.append(first, len(order)), holders[order].astype(np.int32), ranks[order].astype(np.int32), size, document_size)

    def distances(self, text: str | None, orders: int = 3) -> np.ndarray | None:
        """Mean difference in rank to each language, from 0 to 1; None without a letter."""
        return self._compared(text, orders)[0]

    def nearest(self, text: str | None, orders: int = 3, max_distance: float = MAX_DISTANCE) -> tuple[str | None, bool]:
        """The nearest language (None without a letter or a profile), and whether it is within the limit."""
        d, n = self._compared(text, orders)
        if d is None:
            return None, False
        limit = max_distance + FEW_ALLOWANCE * max(0.0, 1 - n / FEW_GRAMS)
        return self.languages[int(d.argmin())], float(d.min()) <= limit

    def _compared(self, text: str | None, orders: int) -> tuple[np.ndarray | None, int]:
        """The distances, and how many different n-grams of the text they come from."""
        values, counts = grams(text, orders) if text else ((), ())
        if not len(values) or not self.languages:
            return None, 0
        top = most_frequent(values, counts, self.document_size)
        at = np.minimum(np.searchsorted(self.values, top), len(self.values) - 1)
        places = np.flatnonzero(self.values[at] == top)
        begin, n = self.starts[at[places]], self.starts[at[places] + 1] - self.starts[at[places]]
        mine = np.repeat(places, n)
        where = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        saved = self.size - np.minimum(np.abs(self.ranks[where] - mine), self.size)  # of the difference for a gram that is lacking
        total = np.bincount(self.holders[where], saved, len(self.languages))
        return (self.size * len(top) - total) / (self.size * len(top)), len(top)


def held_in(id_column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves another remainder than ``fold``."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds, F.lit(-1)) != fold


def learn(df: DataFrame, *, id_column: str = "doc_id", text: str = "text", lang: str = "lang", sample_per_language: int = 1_500, size: int = 400, document_size: int = 300, orders: int = 3) -> Profiles:
    """Profiles from rows with a language.

    ``sample_per_language`` bounds what is learned from: rows are taken by the hash
    of their id and text, with the chance that makes so many rows of a language
    expected, and equal ones once.
    """
    spark = df.sparkSession
    ship(spark)
    if not 1 <= orders <= MOST_ORDERS:
        raise ValueError(f"n-grams of 1 to {MOST_ORDERS} characters fit an integer, not of {orders}")
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(id_column), F.col(text)).alias("h"))
    shares = cut(rows.groupBy("l").agg(F.least(F.lit(1.0), F.lit(float(sample_per_language)) / F.count("*")).alias("p")), "shares")
    chances = F.broadcast(shares) if shares.count() <= _BROADCAST_LANGUAGES else shares
    taken = rows.join(chances, "l").where((F.pmod("h", F.lit(1 << 30)) / F.lit(float(1 << 30))) < F.col("p")).dropDuplicates(["l", "h"]).select("l", "t")

    def count(batches):
        for batch in batches:
            parts = defaultdict(list)
            for la, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts[la].append(grams(t, orders))
            for la, found in parts.items():
                values, where = np.unique(np.concatenate([v for v, _ in found]), return_inverse=True)
                totals = np.bincount(where, np.concatenate([c for _, c in found]), len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([la] * len(values), pa.string()), pa.array(values, pa.int64()), pa.array(totals, pa.int64())], ["l", "g", "n"])

    counted = taken.mapInArrow(count, "l string, g long, n long").groupBy("l", "g").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("l").orderBy(F.desc("n"), "g")
    ranked = counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("l", "g", "rank").toArrow()
    found, tops = ranked.sort_by([("l", "ascending"), ("rank", "ascending")]), {}
    if found.num_rows:
        names, first = np.unique(found["l"].to_numpy(), return_index=True)
        tops = dict(zip(names.tolist(), np.split(found["g"].to_numpy(), first[1:])))
    return Profiles.of(tops, size, document_size)


def predict(df: DataFrame, profiles: Profiles, *, text: str = "text", orders: int = 3, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``, ``lang_pred``, ``score`` and ``distance``.

    ``distance`` is that of the language chosen (null for ``und``).  ``score`` sets
    it against the runner-up's: 0.5 if both are as near, 1 if it is 0, and 1 minus
    the distance if there is one language only.
    """
    spark = df.sparkSession
    ship(spark)
    refuse_clash(carry, ("lang_pred", "score", "distance"))
    sent = spark.sparkContext.broadcast(profiles)
    source = df.select(*carry, F.col(text).alias("__text"))
    fields = source.schema.fields[:-1]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["lang_pred string, score double, distance double"])

    def predicted(batches):
        p = sent.value
        for batch in batches:
            rows = []
            for t in batch.column(len(fields)).to_pylist():
                d = p.distances(t, orders)
                if d is None:
                    rows.append((UNKNOWN, 0.0, None))
                    continue
                order = np.argsort(d, kind="stable")
                best = float(d[order[0]])
                score = 1 - best if len(order) == 1 else 1.0 if best == 0 else float(d[order[1]] / (best + d[order[1]]))
                rows.append((p.languages[order[0]], score, best))
            columns = list(zip(*rows)) or [[]] * 3
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.float64()))], [*names, "lang_pred", "score", "distance"])

    return source.mapInArrow(predicted, schema)


def keep(df: DataFrame, profiles: Profiles, *, text: str = "text", lang: str = "lang", max_distance: float = MAX_DISTANCE, orders: int = 3) -> DataFrame:
    """The rows of ``df``, with its columns, whose language is known.

    Rejected are texts without a letter and texts farther than ``max_distance`` from
    every profile (for texts of fewer than ``FEW_GRAMS`` different n-grams, a little
    more).  Rows without a language get the predicted one.
    """
    spark = df.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(profiles)

    def kept(batches):
        p = sent.value
        for batch in batches:
            found, names = [], []
            for t, la in zip(batch.column(text).to_pylist(), batch.column(lang).to_pylist()):
                near, known = p.nearest(t, orders, max_distance)
                found.append(known)
                names.append(near if la is None else la)
            at = batch.schema.get_field_index(lang)
            yield batch.set_column(at, batch.schema.field(at), pa.array(names, batch.schema.field(at).type)).filter(pa.array(found, pa.bool_()))

    return df.mapInArrow(kept, df.schema)
