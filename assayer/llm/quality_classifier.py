"""Quality classifier on random-indexing word vectors.

A text becomes a stream of tokens: each word's letters and digits in lower case,
the word's shape (runs of capitals, small letters, digits and signs), and marks
where a word or a line repeats.  Every token has a fixed random index vector, a
few +1 and -1 at places drawn from its hash.  A token's word vector is the sum of
the index vectors of its neighbours in the sample, besides its own.  A document
is the mean of its tokens' vectors; a network of two layers, in numpy, turns that
into a probability, which a temperature fitted on rows kept from training
calibrates.

Defined results
  null or empty text        the network's score for a document without tokens
  rows without label, or
  with a null label         scored, not learned from
  an id labelled twice      its mean label, 1 from one half on
  an id with several texts  one of them is learned from, the one with the least hash
  long texts                are learned from and scored whole; no text comes to the driver
  extra columns             stay behind unless carried; a carried ``score`` is refused
  one class or none in the
  sample                    the smoothed share of label 1 is everyone's score
  repeated rows             each row is scored by itself
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._run import cut, refuse_clash, ship

REPEATED_WORD, REPEATED_LINE = "\x00word", "\x00line"
_RUNS = ((re.compile(r"[^\W\d_]+"), None), (re.compile(r"\d+"), "9"))
_CORE = re.compile(r"[\W_]+")
_SIGNS = re.compile(r"([^\w])\1+")
_KEPT, _LONGEST = 200_000, 64  # words whose tokens a worker remembers, and characters of the longest of them


def shape(word: str) -> str:
    def letters(m: re.Match) -> str:
        x = m[0]
        return "A" if x.isupper() and len(x) > 1 else "Aa" if x[0].isupper() else "a"

    return _SIGNS.sub(r"\1\1", _RUNS[1][0].sub("9", _RUNS[0][0].sub(letters, word)))


def word_tokens(word: str) -> tuple[str, ...]:
    core = _CORE.sub("", word).lower()
    return (core, "\x01" + shape(word)) if core else ("\x01" + shape(word),)


def stream(text: str) -> list[str]:
    """The tokens of a text, in order."""
    out: list[str] = []
    seen: set[str] = set()
    known, last = _memory, None
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        if line in seen:
            out.append(REPEATED_LINE)
        seen.add(line)
        for w in words:
            found = known.get(w)
            if found is None:
                if len(known) > _KEPT:
                    known.clear()
                found = word_tokens(w)
                if len(w) <= _LONGEST:
                    known[w] = found
            out += found
            if w == last:
                out.append(REPEATED_WORD)
            last = w
    return out


_memory: dict[str, tuple[str, ...]] = {}


def index_vector(token: str, size: int, ones: int = 8) -> np.ndarray:
    rng = np.random.default_rng(xxhash.xxh64_intdigest(token.encode("utf-8", "replace"), seed=7))
    v = np.zeros(size, np.float32)
    v[rng.choice(size, ones, replace=False)] = rng.choice((-1.0, 1.0), ones)
    return v


@dataclass
class Model:
    tokens: dict[str, int]
    vectors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    temperature: float = 1.0
    constant: float | None = None

    def pooled(self, text: str | None) -> np.ndarray:
        """The mean of the tokens' vectors, the share of unknown tokens and the log of the length."""
        ids = np.fromiter(self._ids(text or ""), np.int32)
        known = ids[ids >= 0]
        out = np.zeros(self.vectors.shape[1] + 2, np.float32)
        if len(known):
            which, times = np.unique(known, return_counts=True)
            out[:-2] = times.astype(np.float32) @ self.vectors[which] / len(known)
        out[-2] = 1 - len(known) / max(1, len(ids))
        out[-1] = np.log1p(len(ids))
        return out

    def _ids(self, text: str) -> Iterable[int]:
        """The places of the tokens that ``stream`` gives, in another order."""
        words, known, get = text.split(), self.__dict__.setdefault("_known", {}), self.tokens.get
        if len(known) > _KEPT:
            known.clear()
        long: dict[str, tuple[int, ...]] = {}  # forgotten with the text
        for w in set(words):
            if w not in known:
                (known if len(w) <= _LONGEST else long)[w] = tuple(get(t, -1) for t in word_tokens(w))
        of = (lambda w: long.get(w) or known[w]) if long else known.__getitem__
        lines = [x for x in text.split("\n") if x.split()]
        marks = [get(REPEATED_WORD, -1)] * sum(map(eq, words, words[1:])) + [get(REPEATED_LINE, -1)] * (len(lines) - len(set(lines)))
        return chain(chain.from_iterable(map(of, words)), marks)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.mean) / self.spread @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64) / self.temperature, -60, 60)))


def context_sums(texts: Iterable[str], tokens: dict[str, int], index: np.ndarray, window: int) -> np.ndarray:
    """For each token, the sum of the index vectors of its neighbours: whole numbers, so the order of adding is of no account."""
    around = np.zeros(index.shape)
    for group in _groups(map(stream, texts), 20_000):
        ids = np.fromiter(chain.from_iterable((*(tokens.get(t, -1) for t in x), *[-1] * window) for x in group), np.int32)
        for apart in range(1, window + 1):
            left, right = ids[:-apart], ids[apart:]
            both = (left >= 0) & (right >= 0)
            for a, b in ((left[both], right[both]), (right[both], left[both])):
                order = np.argsort(a, kind="stable")
                which, first = np.unique(a[order], return_index=True)
                if len(which):
                    around[which] += np.add.reduceat(index[b[order]].astype(np.float64), first, axis=0)
    return around


def word_vectors(index: np.ndarray, around: np.ndarray) -> np.ndarray:
    """A token's neighbours, as a unit vector, and its own index vector, as another."""
    norm = np.linalg.norm(around, axis=1, keepdims=True)
    ones = np.linalg.norm(index.astype(np.float64), axis=1, keepdims=True)
    return (around / np.where(norm > 0, norm, 1) + index / np.where(ones > 0, ones, 1)).astype(np.float32)


def _groups(streams: Iterable[list[str]], tokens: int) -> Iterator[list[list[str]]]:
    group, n = [], 0
    for s in streams:
        group.append(s)
        n += len(s)
        if n >= tokens:
            yield group
            group, n = [], 0
    if group:
        yield group


def fit(model: Model, x: np.ndarray, labels: np.ndarray, *, hidden: int = 32, steps: int = 300, seed: int = 11) -> Model:
    """Fits the network to pooled documents; every fifth is kept from training, for the temperature."""
    labels = np.asarray(labels, np.float32)
    if len(labels) < 10 or labels.min() == labels.max():
        model.constant = float((labels.sum() + 1) / (len(labels) + 2))
        return model
    kept = np.arange(len(x)) % 5 == 4
    if labels[kept].min() == labels[kept].max() or labels[~kept].min() == labels[~kept].max():
        kept = np.zeros(len(x), bool)
    model.mean, model.spread = x[~kept].mean(0), x[~kept].std(0) + 1e-6
    z, y = (x[~kept] - model.mean) / model.spread, labels[~kept]
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
    params = [p.astype(np.float32) for p in params]
    weight = np.where(y > 0.5, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * 0.5 + 0.5  # between the classes' shares and equal ones
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = params
        h = np.maximum(z @ w1 + b1, 0)
        p = 1 / (1 + np.exp(-(h @ w2 + b2)))
        d = (weight * (p - y) / len(y)).astype(np.float32)
        dh = np.outer(d, w2) * (h > 0)
        grads = [z.T @ dh + 1e-3 * w1, dh.sum(0), h.T @ d + 1e-3 * w2, d.sum(keepdims=True)]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = (params[k] - 0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    model.layers = params
    if kept.any():
        logits, y = model.logits(x[kept]).astype(np.float64), labels[kept]
        losses = {t: float(np.mean(np.logaddexp(0, -logits / t) * y + np.logaddexp(0, logits / t) * (1 - y))) for t in np.geomspace(0.25, 8, 61)}
        model.temperature = float(min(losses, key=losses.get))
    return model


def learn(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "quality", sample: int = 2_400, size: int = 96, window: int = 2, most_tokens: int = 8_000, least_times: int = 3, **network) -> Model:
    """A model from at most ``sample`` labelled ids, those with the smallest hashes.

    The sample's size doesn't grow with the corpus, so the broadcast of its ids is of
    bounded size.  Its texts, of any length, stay in a table: tasks count tokens, add
    up contexts and pool documents.  What comes to the driver is the ``most_tokens``
    most frequent tokens (of ``least_times`` at least), their sums, and the pooled
    documents.
    """
    spark = docs.sparkSession
    ship(spark)
    drawn = (
        labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .groupBy(F.col(id_column).alias("id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    drawn = F.broadcast(cut(drawn, "drawn"))  # ``sample`` rows at most
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(drawn, "id")
    rows = texts.groupBy("id", "label").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = cut(rows.repartition(spark.sparkContext.defaultParallelism, "id"), "sample")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = Counter(chain.from_iterable(stream(t) for batch in batches for t in batch.column(0).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array(list(times), pa.string()), pa.array(list(times.values()), pa.int64())], ["token", "n"])

    found = rows.select("t").mapInArrow(counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    chosen = [r.token for r in found.where(F.col("n") >= least_times).orderBy(F.desc("n"), "token").limit(most_tokens).collect()]
    tokens = {t: i for i, t in enumerate(chosen)}
    index = np.stack([index_vector(t, size) for t in chosen]).astype(np.int8) if chosen else np.zeros((0, size), np.int8)
    sent = spark.sparkContext.broadcast((tokens, index))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, vectors = sent.value
        around = context_sums((t for batch in batches for t in batch.column(0).to_pylist()), known, vectors, window)
        some = np.flatnonzero(around.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(list(around[some]), pa.list_(pa.float64()))], ["token", "sums"])

    parts = rows.select("t").mapInArrow(added, "token int, sums array<double>")
    sums = parts.groupBy("token").agg(F.array(*[F.sum(F.get("sums", F.lit(d))) for d in range(size)]).alias("sums")).collect()
    around = np.zeros(index.shape)
    for r in sums:
        around[r.token] = r.sums
    model = Model(tokens, word_vectors(index, around), np.zeros(size + 2, np.float32), np.ones(size + 2, np.float32))
    told = spark.sparkContext.broadcast(model)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [told.value.pooled(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float32()))], ["h", "label", "x"])

    made = rows.select(F.xxhash64("id").alias("h"), "label", "t").mapInArrow(pooled, "h long, label int, x array<float>").orderBy("h", "label", "x").collect()
    sent.destroy()
    told.destroy()
    x = np.array([r.x for r in made], np.float32).reshape(len(made), size + 2)
    return fit(model, x, np.array([r.label for r in made], np.float32), **network)


def score(df: DataFrame, model: Model, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry`` and ``score``, the calibrated probability of label 1."""
    spark = df.sparkSession
    ship(spark)
    refuse_clash(carry, ("score",))
    sent = spark.sparkContext.broadcast(model)
    source = df.select(*carry, F.col(text).alias("__text"))
    fields = source.schema.fields[:-1]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])

    def scored(batches):
        m = sent.value
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            x = np.stack([m.pooled(t) for t in texts]) if texts else np.zeros((0, len(m.mean)), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(m.scores(x), pa.float64())], [*names, "score"])

    return source.mapInArrow(scored, schema)
