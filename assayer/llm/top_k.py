"""Exact top-k search by inner product: columnar branch and bound.

Candidates stand in vertical layout, a row of the block for each dimension.
Scores accumulate one group of dimensions at a time; what the other dimensions
can still add is at most the product of the norms of both remainders
(Cauchy-Schwarz).  Candidates whose bound stays below a query's k-th best score
so far are compacted away, and only the rest reads the next dimensions.

Queries come to the tasks in passes of bounded size, run one after the other over all
candidates; every task keeps k candidates for each query, and the best k of these are
final.  What the driver holds is one pass, however many queries there are; what passes find is
added to one folder and read once, so the plan is the same for any number of them.

Defined results
  null id, null vector, null or non-finite component   takes no part, nor does a
                       vector with a component too large for a double once scaled
  vectors of another length than the query's           are no candidates for it
  repeated query ids   one query, the largest of its vectors
  repeated candidates  each row is a candidate; rows with the query's id are its own
  scores over 64 bits  are held at the largest or least long
  extra columns        stay behind; vectors of any length are rows of their own
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._run import cut, scratch, ship

STEP, BLOCK, QUERY_GROUP = 16, 8192, 64
PASS_BYTES = 32 << 20


def scaled(vector, scale: float = 256.0) -> np.ndarray | None:
    """floor(scale * x) of each component, or None if the vector takes no part."""
    if vector is None or any(x is None for x in vector):
        return None
    with np.errstate(over="ignore"):
        v = np.floor(scale * np.asarray(vector, np.float64))
    return v if np.isfinite(v).all() else None


def remainders(v: np.ndarray, step: int) -> np.ndarray:
    """Norms of what is left after 1, 2, ... groups of dimensions (rows: vectors), rounded up."""
    squares = np.add.reduceat(v * v, np.arange(0, v.shape[1], step), axis=1) if v.shape[1] else np.zeros((len(v), 0))
    left = squares[:, ::-1].cumsum(1)[:, ::-1]
    return np.sqrt(np.concatenate((left[:, 1:], np.zeros((len(v), 1))), axis=1)) * (1 + 1e-9)


@dataclass
class Best:
    """The k best candidates of each query so far: by score, then by smaller id."""

    scores: np.ndarray
    ids: np.ndarray

    @classmethod
    def none(cls, queries: int, k: int) -> Best:
        return cls(np.full((queries, k), -np.inf), np.full((queries, k), np.iinfo(np.int64).max))

    def take(self, q: int, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        if len(scores) > k:
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            near = scores >= least
            scores, ids = scores[near], ids[near]
        s, i = np.concatenate((self.scores[q], scores)), np.concatenate((self.ids[q], ids))
        order = np.lexsort((i, -s))[:k]
        self.scores[q], self.ids[q] = s[order], i[order]


class Searcher:
    """Queries of one length; ``search`` takes blocks of candidates."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, step: int = STEP):
        self.ids, self.vectors, self.k, self.step = ids, vectors, k, step
        self.left = remainders(vectors, step)
        self.most = float(np.abs(vectors).max(initial=0))
        self.best = Best.none(len(ids), k)

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        if vectors.shape[1] * self.most * float(np.abs(vectors).max(initial=0)) >= 2**53:
            return self._wide(ids, vectors)
        first = min(len(ids), 256)  # a few whole scores give every query a bound
        seed = self.vectors @ vectors[:first].T
        for q in range(len(self.ids)):
            other = ids[:first] != self.ids[q]
            self.best.take(q, seed[q, other], ids[:first][other])
        ids, vectors = ids[first:], vectors[first:]
        if not len(ids):
            return
        columns, left, step = np.ascontiguousarray(vectors.T), remainders(vectors, self.step).T, self.step
        for at in range(0, len(self.ids), QUERY_GROUP):
            group = slice(at, at + QUERY_GROUP)
            so_far = self.vectors[group, :step] @ columns[:step]
            can = so_far + self.left[group, :1] * left[0] >= self.best.scores[group, -1:]
            for q, partial, alive in zip(range(at, at + len(so_far)), so_far, can):
                here = np.flatnonzero(alive & (ids != self.ids[q]))
                score = partial[here]
                for g, d in enumerate(range(step, columns.shape[0], step), 1):
                    if not len(here):
                        break
                    score = score + self.vectors[q, d : d + step] @ columns[d : d + step, here]
                    can_be = score + self.left[q, g] * left[g, here] >= self.best.scores[q, -1]
                    here, score = here[can_be], score[can_be]
                if len(here):
                    self.best.take(q, score, ids[here])

    def _wide(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """The same without floats, for components so large that a double could round."""
        mine, theirs = [[int(x) for x in v] for v in self.vectors], [[int(x) for x in v] for v in vectors]
        for q, v in enumerate(mine):
            pairs = [(sum(a * b for a, b in zip(v, w)), i) for w, i in zip(theirs, ids.tolist()) if i != self.ids[q]]
            kept = [(int(s), i) for s, i in zip(self.best.scores[q], self.best.ids[q].tolist()) if s != -np.inf]
            top = sorted(kept + pairs, key=lambda x: (-x[0], x[1]))[: self.k]
            if self.best.scores.dtype != object:
                self.best.scores = self.best.scores.astype(object)
            for r, (s, i) in enumerate(top):
                self.best.scores[q, r], self.best.ids[q, r] = s, i

    def found(self) -> Iterator[tuple[int, int, int]]:
        low, high = -(1 << 63), (1 << 63) - 1
        for q, i in enumerate(self.ids.tolist()):
            for s, c in zip(self.best.scores[q].tolist(), self.best.ids[q].tolist()):
                if s != -np.inf:
                    yield i, c, max(low, min(high, int(s)))


def search(df: DataFrame, queries: DataFrame, *, k: int = 5, id_column: str = "vec_id", vector: str = "embedding", scale: float = 256.0, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows of ``df`` for each row of ``queries``."""
    spark = df.sparkSession
    ship(spark)
    rows = df.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    asked = queries.where(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    size = asked.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    passes = max(1, -(-size // pass_bytes))
    if passes > 1:  # queries are written by pass, so that each reads its own alone
        asked = asked.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(passes)).alias("p"))
        asked = cut(asked.repartitionByRange(passes, "p").sortWithinPartitions("p"), "queries")
    out = scratch(spark, "found")
    for p in range(passes):
        mine = (asked.where(F.col("p") == p) if passes > 1 else asked).groupBy("id").agg(F.max("v").alias("v")).collect() if size else []
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for r in mine:
            if (v := scaled(r.v, scale)) is not None:
                by_length.setdefault(len(v), []).append((r.id, v))
        sent = spark.sparkContext.broadcast({n: (np.array([i for i, _ in x], np.int64), np.stack([v for _, v in x])) for n, x in by_length.items()})
        one = _best(rows.mapInArrow(_scan(sent, k, scale), "query_id long, vec_id long, score long"), k)
        if passes == 1:
            return one
        one.write.mode("append").parquet(out)  # run now, so that the driver and the workers hold the queries of one pass only
        sent.destroy()
    return spark.read.schema(one.schema).parquet(out)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(sent, k: int, scale: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = {n: Searcher(ids, vectors, k) for n, (ids, vectors) in sent.value.items()}
        held: dict[int, tuple[list, list]] = {n: ([], []) for n in searchers}

        def flush(n: int) -> None:
            ids, vectors = held[n]
            if ids:
                searchers[n].search(np.array(ids, np.int64), np.stack(vectors))
                held[n] = ([], [])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(v) in held and (x := scaled(v, scale)) is not None:
                    held[len(v)][0].append(i)
                    held[len(v)][1].append(x)
                    if len(held[len(v)][0]) >= BLOCK:
                        flush(len(v))
        for n in held:
            flush(n)
        for s in searchers.values():
            out = list(zip(*s.found())) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return scan
