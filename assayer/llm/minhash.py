"""Near duplicates by an inverted join over MinHash coordinates.

1. Every text gives the set of its word shingles, a signature and a key of the
   whole set.  Texts with equal sets form a class; from here on a class counts as
   one document, so copies cost nothing.
2. Each coordinate's value is posted.  Of two sets at the threshold, ``needed``
   of the ``size`` coordinates are equal (but for a chance of about one in a
   million), so both hold a common value among their ``size - needed + 1`` rarest.
   Only that prefix is joined, rarest first; values that no other class has fill
   it without being posted, and a class with too few shared values is out.
3. The sets of the remaining classes are made again, and their shingles counted.
   Shingles that one class alone holds bound what it can share with any other.
4. Each posting list links its members with a leader, the member with the largest
   part shared; collisions over the whole signature are counted, and links
   confirmed on the full sets.  Lists that one component covers need no more.  In
   the others, members outside of the list's main component meet the members of
   other components, once for each pair, where their sizes, shared parts and what
   each shares with the leader leave the threshold in reach.  So no list gives all
   its pairs, and no link between components is lost.
5. Components of the links give each document its smallest reachable id.

Defined results
  null or empty text   0 shingles, linked with nothing
  null id              takes no part: component null, kept
  repeated rows        are in one class and share its component; a repeated id
                       is kept wherever it equals its component
  long texts           give sets of as many shingles; a set is one row
  extra columns        stay behind
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components
from ._run import cut, ship
from .shingles import MinHash, needed_matches, shingle_sets

SIZE = 40
_ROWS = 1024


def _set_key(values: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(values.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _batches(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, _ROWS):
            yield whole.slice(at, _ROWS)


def signatures(df: DataFrame, *, id_column: str, text: str, width: int, size: int) -> DataFrame:
    """id, n (set size), k1 and k2 (key of the set), sig."""
    source = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("t"))

    def made(batches):
        hashes = MinHash(size)
        for batch in _batches(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            keys = [_set_key(s) for s in sets]
            sigs = [hashes.signature(s) if len(s) else None for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sigs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "k1", "k2", "sig"])

    return source.mapInArrow(made, "id long, n long, k1 long, k2 long, sig array<long>")


def full_sets(df: DataFrame, wanted: DataFrame, *, id_column: str, text: str, width: int) -> DataFrame:
    """id and the set of its shingles, for the ids and keys of ``wanted``."""
    source = df.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("t")).join(wanted.select("id"), "id", "left_semi")

    def made(batches):
        for batch in _batches(batches):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            keys = [_set_key(s) for s in sets]
            columns = [batch.column(0), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "k1", "k2", "members"])

    return source.mapInArrow(made, "id long, k1 long, k2 long, members array<long>")


def _may_link(percent: int, a: str, b: str, through: bool = False) -> Column:
    """Whether two sets can reach the threshold, by their sizes and their shared parts.

    ``through`` adds what is known by a leader both were held against: ``t`` shingles
    shared with it, ``g - t`` others that aren't the set's alone.  Two sets share at
    most the lesser of each.
    """
    most = F.least(F.col(f"{a}.g"), F.col(f"{b}.g"))
    if through:
        rest = F.least(F.col(f"{a}.g") - F.col(f"{a}.t"), F.col(f"{b}.g") - F.col(f"{b}.t"))
        known = F.col(f"{a}.t").isNotNull() & F.col(f"{b}.t").isNotNull()
        most = F.when(known, F.least(F.col(f"{a}.t"), F.col(f"{b}.t")) + rest).otherwise(most)
    return 100 * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, needed: int) -> DataFrame:
    """Pairs a, b with ``i``, the size of what their full sets share, and ``linked``: signatures collide often enough and the sets reach the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("members").alias("ma"))
    right = sets.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("members").alias("mb"))
    collisions = F.size(F.array_intersect("sa", "sb"))
    both = F.size(F.array_intersect("ma", "mb"))
    # ``a`` is the one with many pairs, if any: its set is sent to them, and isn't shuffled once for each
    counted = pairs.join(right, "b").join(left, "a").select("a", "b", collisions.alias("k"), both.alias("i"), (F.size("ma") + F.size("mb")).alias("s"))
    return counted.select("a", "b", "i", ((F.col("k") >= needed) & (100 * F.col("i") >= percent * (F.col("s") - F.col("i")))).alias("linked"))


def link(df: DataFrame, *, percent: int = 80, id_column: str = "doc_id", text: str = "text", width: int = 5, size: int = SIZE, deviations: float = 5.0) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``df``.

    A link right at the threshold is missed if fewer coordinates are equal than
    expected less ``deviations`` standard deviations, about once in a million at 5;
    with more, the chance falls further and prefixes get longer.
    """
    ship(df.sparkSession)
    needed = needed_matches(size, percent / 100, deviations)
    documents = cut(signatures(df, id_column=id_column, text=text, width=width, size=size), "signatures")

    linked = documents.where("id IS NOT NULL AND n > 0")
    classes = linked.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    posted = classes.select("id", F.explode("sig").alias("v"))
    times = cut(posted.groupBy("v").agg(F.count("*").alias("f")).where("f > 1"), "times")  # a table, so that skewed values of the join can be split
    shared = posted.join(times, "v").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "v"))).alias("p")).where(F.size("p") >= needed)
    prefixes = cut(shared.select("id", F.transform(F.slice("p", 1, F.size("p") - needed + 1), lambda x: x["v"]).alias("prefix")), "prefixes")

    wanted = cut(classes.join(prefixes, "id").select("id", "k1", "k2", "n", "sig", "prefix"), "wanted")
    members = full_sets(df, wanted, id_column=id_column, text=text, width=width).dropDuplicates(["id", "k1", "k2"])
    sets = cut(wanted.join(members, ["id", "k1", "k2"]), "sets")
    alone = sets.select("id", F.explode("members").alias("m")).groupBy("m").agg(F.count("*").alias("f"), F.min("id").alias("id")).where("f = 1").groupBy("id").agg(F.count("*").alias("u"))
    posts = sets.select("id", "n", "prefix").join(alone, "id", "left").select("id", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("g"), "prefix")
    posts = cut(posts.where(100 * F.col("g") >= percent * F.col("n")).select("id", "n", "g", "prefix", F.explode("prefix").alias("v")), "posts")

    rank = F.struct((F.col("g") / F.col("n")).alias("r"), (-F.col("id")).alias("i"))
    leaders = posts.groupBy("v").agg(F.count("*").alias("f"), F.max(F.struct(rank.alias("rank"), "id", "n", "g")).alias("lead")).where("f > 1")
    leaders = cut(leaders.select("v", "f", "lead.id", "lead.n", "lead.g"), "leaders")
    star = posts.alias("x").join(leaders.alias("l"), (F.col("x.v") == F.col("l.v")) & (F.col("x.id") != F.col("l.id")) & _may_link(percent, "x", "l"))
    star = star.select(F.col("l.id").alias("a"), F.col("x.id").alias("b")).distinct()
    star = cut(_compared(star, sets, percent, needed), "star")
    links = star.where("linked").select("a", "b")
    roots = components.connected(links)

    long = leaders.where("f > 2").select("v", F.col("id").alias("lead"))
    placed = posts.join(long, "v").join(roots, "id", "left").join(star.select(F.col("a").alias("lead"), F.col("b").alias("id"), F.col("i").alias("t")), ["lead", "id"], "left")
    shared_with_lead = F.when(F.col("id") == F.col("lead"), F.col("n")).otherwise(F.col("t"))
    placed = cut(placed.select("id", "n", "g", "prefix", "v", F.coalesce("root", "id").alias("c"), shared_with_lead.alias("t")), "placed")
    shares = placed.groupBy("v", "c").agg(F.count("*").alias("f")).groupBy("v").agg(F.count("*").alias("parts"), F.max(F.struct("f", "c"))["c"].alias("main"))
    mixed = cut(shares.where("parts > 1").select("v", "main"), "mixed")
    held = cut(placed.join(mixed, "v"), "held")  # a table, so that both sides of the next join can be split at a frequent value
    odd = held.where("c <> main")
    tried = held.alias("x").join(
        odd.alias("y"),
        (F.col("x.v") == F.col("y.v"))
        & (F.col("x.c") != F.col("y.c"))
        & ((F.col("x.c") == F.col("x.main")) | (F.col("x.id") < F.col("y.id")))
        & _may_link(percent, "x", "y", through=True)
        & (F.get(F.array_intersect("x.prefix", "y.prefix"), F.lit(0)) == F.col("x.v")),  # once for each pair: at the first value in common
    )
    tried = tried.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    more = cut(_compared(tried, sets, percent, needed).where("linked").select("a", "b"), "more_links")
    if not more.isEmpty():
        roots = components.connected(links.union(more))

    found = classes.select("k1", "k2", "id").join(roots, "id", "left").select("k1", "k2", F.coalesce("root", "id").alias("component_id"))
    found = cut(found, "found")
    out = documents.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "k1", "k2").join(found, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
