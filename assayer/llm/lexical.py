"""Ranked lexical search: best-first branch and bound over trees of maxima.

Documents are read once; what stays of each is its number of terms and how often it holds
each term that a query asks for.  From these postings each task builds segments of documents in
the order of their ids.  Over a segment every term has a tree: a leaf is what the term adds to the
score of one document, a node the greatest leaf of a range of documents.

A query adds up its terms' nodes: that bounds the score of all documents of a range.  The ranges
are kept in a heap, that with the highest bound is opened first, and the search ends when
the highest bound is below the k-th best score so far.  A range whose bound equals that score is
opened too, since a document in it may have the smaller id.  Each task goes from segment to
segment with the best that it has, and only k rows of each query and task are shuffled.

Queries come in blocks of bounded size, each against all postings; what every block finds is
appended to one folder and read once, so neither the plan nor the driver's memory grows with them.

Defined results
  null or empty text, no term   no document: not counted
  null document id     counted in all statistics, but never found, since nothing names it
  null item id or text, no term   finds nothing
  repeated item ids    one query, the greatest of their texts
  repeated terms       of a query count as often as they stand in it
  repeated rows        each is a document of its own, and takes a rank of its own
  ties                 go to the smaller id
  long texts           whole
  extra columns        stay behind
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._run import cut, scratch, ship

FAN, SEGMENT, POSTINGS = 32, 8192, 1 << 21
BLOCK_BYTES = 8 << 20
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
FOUND = "item_id long, doc_id long, score long"


def terms(text: str | None) -> list[bytes]:
    """Letters and digits of ASCII and all characters beyond it, in a row; A-Z in lower case.  As UTF-8."""
    return _TERM.findall((text or "").encode().lower())  # of bytes, only A-Z change


@dataclass
class Stats:
    """Of all documents that hold a term: how many, all their terms, and for each term of a query how many hold it."""

    documents: int
    words: int
    holding: dict[int, int]

    def weight(self, term: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.holding.get(term, 0) + 1)))

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return 75 + (25 * n * self.documents) // self.words


@dataclass
class Level:
    """Nodes of all terms' trees at one height, by term and range."""

    node: np.ndarray  # number of the range within the segment
    most: np.ndarray  # its greatest leaf
    first: np.ndarray  # where its children begin at the level below; one number more than there are nodes


class Segment:
    """The trees of some documents: ``ids`` ascending, postings as parallel arrays of document (a place in ``ids``), term and what it adds."""

    def __init__(self, ids: np.ndarray, document: np.ndarray, term: np.ndarray, adds: np.ndarray, fan: int = FAN):
        self.ids, self.fan = ids, fan
        order = np.lexsort((document, term))
        self.levels = [Level(document[order], adds[order], np.zeros(0, np.int64))]
        term, width = term[order], len(ids)
        while width > 1:
            below, width = self.levels[-1], -(-width // fan)
            above = below.node // fan
            first = np.flatnonzero(np.concatenate(([True], (above[1:] != above[:-1]) | (term[1:] != term[:-1])))) if len(term) else np.zeros(0, np.int64)
            most = np.maximum.reduceat(below.most, first) if len(first) else below.most
            self.levels.append(Level(above[first], most, np.append(first, len(term))))
            term = term[first]
        self.root = {t: i for i, t in enumerate(term.tolist())}  # one node of each term is left

    def search(self, asked: list[tuple[int, int]], best: Best) -> None:
        """Offers to ``best`` every document that can be among the best; ``asked``: terms and how often."""
        known = [(self.root[t], n) for t, n in asked if t in self.root]
        if not known:
            return
        nodes, times = (np.array(x, np.int64) for x in zip(*known))
        top = len(self.levels) - 1
        bound = int((self.levels[top].most[nodes] * times).sum())
        heap = [(-bound, top, 0, nodes, times)]
        serial = 0
        while heap and -heap[0][0] >= best.least:
            bound, height, _, nodes, times = heapq.heappop(heap)
            level = self.levels[height]
            if not height:  # a segment of one document
                best.offer(-bound, int(self.ids[level.node[nodes[0]]]))
                continue
            a, n = level.first[nodes], level.first[nodes + 1] - level.first[nodes]
            ends = np.cumsum(n)
            children = np.arange(ends[-1]) + np.repeat(a - ends + n, n)
            below, times = self.levels[height - 1], np.repeat(times, n)
            ranges = below.node[children]
            low = int(ranges.min())
            bounds = np.zeros(int(ranges.max()) - low + 1, np.int64)
            np.add.at(bounds, ranges - low, below.most[children] * times)
            if height == 1:
                for at in np.flatnonzero(bounds >= best.least).tolist():
                    best.offer(int(bounds[at]), int(self.ids[low + at]))
                continue
            open_ = bounds >= best.least
            kept = open_[ranges - low]
            children, times, ranges = children[kept], times[kept], ranges[kept]
            order = np.argsort(ranges, kind="stable")
            cuts = np.flatnonzero(np.diff(ranges[order])) + 1
            for of in np.split(order, cuts) if len(order) else []:
                serial += 1
                heapq.heappush(heap, (-int(bounds[ranges[of[0]] - low]), height - 1, serial, children[of], times[of]))


class Best:
    """The k best documents of a query so far: by score, then by smaller id."""

    def __init__(self, k: int):
        self.k, self.found, self.least = k, [], 1

    def offer(self, score: int, doc: int) -> None:
        if score < self.least:
            return
        if len(self.found) < self.k:
            heapq.heappush(self.found, (score, -doc))
        else:
            heapq.heappushpop(self.found, (score, -doc))
        if len(self.found) == self.k:
            self.least = self.found[0][0]


def postings(df: DataFrame, words: dict[bytes, int], id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers of those in ``words``) and times, for documents with a term."""
    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(words)
    source = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value
        for batch in batches:
            rows = []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                if given := terms(t.as_py()):
                    held = Counter(filter(None, map(number.get, given)))
                    rows.append((i, len(given), list(held), list(held.values())))
            columns = list(zip(*rows)) or [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n", "terms", "times"])

    return source.mapInArrow(posted, "doc_id long, n long, terms array<int>, times array<int>")


def statistics(posted: DataFrame) -> Stats:
    """Counted over all documents; a row for each asked term comes to the driver."""
    total = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    each = posted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return Stats(total[0], total[1], {r.term: r.n for r in each.collect()})


def rank(df: DataFrame, queries: DataFrame, *, k: int = 20, id_column: str = "doc_id", text: str = "text", item: str = "item_id", query: str = "text", block_bytes: int = BLOCK_BYTES, segment: int = SEGMENT) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of ``df`` for each row of ``queries``, scores above 0 only."""
    spark = df.sparkSession
    asked = queries.where(F.col(item).isNotNull() & F.col(query).isNotNull()).groupBy(F.col(item).cast("long").alias("item_id")).agg(F.max(query).alias("text"))
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = -(-size // block_bytes)
    if blocks > 1:  # written by block, so that each reads its own alone
        asked = asked.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int"))
        asked = cut(asked.repartitionByRange(blocks, "block").sortWithinPartitions("block"), "queries")
    out = scratch(spark, "ranked")
    spark.createDataFrame([], FOUND).write.parquet(out)
    for b in range(blocks):
        mine = {r.item_id: terms(r.text) for r in (asked.where(F.col("block") == b) if blocks > 1 else asked).collect()}
        words = {w: i for i, w in enumerate(dict.fromkeys(w for x in mine.values() for w in x), 1)}
        posted = cut(postings(df, words, id_column, text), "postings")
        stats = statistics(posted)
        wanted = {i: sorted(Counter(words[w] for w in x).items()) for i, x in mine.items()}
        weights = np.array([0, *(stats.weight(t) for t in range(1, len(words) + 1))], np.int64)
        search(posted, wanted, stats, weights, k, segment).write.mode("append").parquet(out)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    found = spark.read.schema(FOUND).parquet(out).withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(posted: DataFrame, wanted: dict[int, list[tuple[int, int]]], stats: Stats, weights: np.ndarray, k: int, segment: int = SEGMENT) -> DataFrame:
    """The k best of each query among the documents of each task."""
    sent = posted.sparkSession.sparkContext.broadcast((wanted, stats.documents, stats.words, weights))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, documents, words, weights = sent.value
        counted = Stats(documents, words, {})
        best = {i: Best(k) for i in wanted}
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            if not held:
                return
            whole = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            whole = whole.filter(whole["doc_id"].is_valid()).sort_by("doc_id").combine_chunks()
            if not whole.num_rows:
                return
            lists = whole["terms"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            term, times = (whole[c].combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
            document = np.repeat(np.arange(whole.num_rows), sizes)
            m = counted.lengths(whole["n"].to_numpy())
            adds = weights[term] * ((1_000_000_000 * times) // (1000 * times + 12 * m[document]))
            trees = Segment(whole["doc_id"].to_numpy(), document, term, adds)
            for i, terms_ in wanted.items():
                trees.search(terms_, best[i])

        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                held.append(batch.slice(a, 1024))
                if sum(x.num_rows for x in held) >= segment or sum(len(x.column(2).flatten()) for x in held) >= POSTINGS:
                    flush()
        flush()
        rows = [(i, -d, s) for i, b in best.items() for s, d in b.found]
        columns = list(zip(*rows)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    return posted.mapInArrow(searched, FOUND)
