"""Profiles of columns in which nearly every value is different.

A histogram of such a column shuffles the column itself.  Here a value is shuffled as a digest of 128 bits and
a count; sums, lengths and verdicts of rules need no shuffle of values at all.  Texts are fetched for the few that
are reported: those of the winning digests, and where more values are equally frequent than are
wanted, the smallest of these.  Some of them, picked by their digests, are fetched first; the values
wanted are no greater than the smallest of those, so a second look at the table takes only what is as small.

Two different values have one digest with a chance of about pairs / 2 ** 128.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nulls import quoted
from ..functions.rules import Rule
from ..sources import scratch
from ..sources.files import ROW
from . import partial, profile
from .profile import Profile

#: Of equally frequent values so many are fetched first.
PICKED = 128
#: Rows of the second look up to which they are sent to all executors; beyond, digests are shuffled once more.
SENT = 100_000
#: From this share of different values and this mean length on, digests are less than the values.
LEAST_SHARE, LEAST_LENGTH = 0.5, 20
_KEYS = ["c", "d1", "d2"]


def near_unique(df: DataFrame, columns: list[str], share: float = LEAST_SHARE, length: float = LEAST_LENGTH) -> list[str]:
    """The columns worth digests, by a sketch of their different values and by their mean length."""
    if not columns:
        return []
    aggs = [a for i, c in enumerate(columns) for a in (F.approx_count_distinct(quoted(c).cast("string")).alias(f"d{i}"), F.count(quoted(c)).alias(f"n{i}"), F.avg(F.char_length(quoted(c).cast("string"))).alias(f"l{i}"))]
    r = df.agg(*aggs).first()
    return [c for i, c in enumerate(columns) if r[f"n{i}"] and r[f"d{i}"] > share * r[f"n{i}"] and r[f"l{i}"] > length]


def _cells(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    """c (number of the column), both halves of the digest, and ``v`` if asked for; nulls left out."""

    def cell(i: int, c: str) -> Column:
        v = quoted(c).cast("string")
        return F.when(v.isNotNull(), F.struct(F.lit(i).alias("c"), F.xxhash64(v).alias("d1"), F.xxhash64(F.lit(1), v).alias("d2"), v.alias("v")))

    each = df.select(F.explode(F.array_compact(F.array(*[cell(i, c) for i, c in enumerate(columns)]))).alias("x"))
    return each.select(*[f"x.{k}" for k in (*_KEYS, *more)])


def digests(df: DataFrame, columns: list[str]) -> DataFrame:
    """c, d1, d2 and how often each value comes."""
    return _cells(df, columns).groupBy(*_KEYS).agg(F.count("*").alias("n"))


def counts(df: DataFrame, rules: Mapping[str, Rule], columns: list[str], counted: DataFrame, as_of=None) -> DataFrame:
    """What ``profile.counts`` gives, without a histogram."""
    sums = partial.states(df.select(*[quoted(c) for c in df.columns if c != ROW]), rules, columns=columns, as_of=as_of, sketches=False)
    unique = counted.groupBy("c").agg(F.count("*").alias("unique_count"))
    mean = F.when(F.col("valued_count") > 0, F.col("length_sum") / F.col("valued_count"))
    joined = sums.join(unique, F.col("c") == F.col("position"), "left")
    return joined.select("column_name", "total_count", "non_null_count", F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "conforming_count", "min_length", "max_length", mean.alias("avg_length"))


def top_values(df: DataFrame, columns: list[str], counted: DataFrame, n: int = 5, picked: int = PICKED) -> DataFrame:
    """What ``profile.top_values`` gives: column_name, value, n and rank; ties to the smaller text."""
    by_count = Window.partitionBy("c").orderBy(F.desc("n"), "d1", "d2")
    leading = counted.withColumn("r", F.row_number().over(by_count)).where(F.col("r") <= n)
    bars = leading.groupBy("c").agg(F.min("n").alias("bar"))  # a row for each column, here and below
    above = counted.join(F.broadcast(bars), "c").where(F.col("n") >= F.col("bar"))
    spread = Window.partitionBy("c").orderBy("d1", "d2")
    tied = above.where(F.col("n") == F.col("bar"))
    first = tied.withColumn("r", F.row_number().over(spread)).where(F.col("r") <= picked).drop("r")
    few = scratch.cut(above.where(F.col("n") > F.col("bar")).unionByName(first), "few")  # n + picked rows of a column at most
    texts = _cells(df, columns, "v").join(F.broadcast(few), _KEYS).groupBy(*_KEYS, "n", "bar").agg(F.any_value("v").alias("v"))
    texts = scratch.cut(texts, "texts")
    wanted = texts.groupBy("c").agg((n - F.count_if(F.col("n") > F.col("bar"))).alias("k"))
    smallest = texts.where(F.col("n") == F.col("bar")).withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("v")))
    limit = smallest.join(F.broadcast(wanted), "c").where(F.col("r") <= F.col("k")).groupBy("c").agg(F.max("v").alias("most"))
    size = tied.groupBy("c").agg(F.count("*").alias("ties"))
    limit = limit.join(F.broadcast(size), "c").where(F.col("ties") > picked).select("c", "most")  # of the others all are there
    small = _cells(df, columns, "v").join(F.broadcast(limit), "c").where(F.col("v") <= F.col("most")).select(*_KEYS, "v").distinct()
    small = scratch.cut(small, "small")
    more = (F.broadcast(small) if small.count() <= SENT else small).join(tied, _KEYS).select(*_KEYS, "n", "bar", "v")
    order = Window.partitionBy("c").orderBy(F.desc("n"), "v")
    found = texts.select(*_KEYS, "n", "bar", "v").unionByName(more).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    return found.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1).alias("column_name"), F.col("v").alias("value"), "n", "rank")


def profile_routed(df: DataFrame, rules: Mapping[str, Rule], *, columns: list[str] | None = None, by_digest: list[str] | None = None, as_of=None, dataset_name: str = "dataset", top: int = 5, examples: int = 50, weighting: str = "columns") -> Profile:
    """As ``profile.profile``, each column by the way that moves less: near-unique ones by digests, the others by a histogram.

    ``by_digest`` names those of the first kind; without it a pass over the table tells them.
    """
    columns = profile.profiled_columns(df) if columns is None else columns
    chosen = near_unique(df, columns) if by_digest is None else [c for c in columns if c in by_digest]
    others = [c for c in columns if c not in chosen]
    conditional = profile.conditional_counts(df, columns)
    conditional = None if conditional is None else profile.held(conditional)
    found = most = None
    if others:
        hist = profile.judged(profile.histogram(df, others), rules, as_of).persist()
        found, most = profile.held(profile.counts(hist)), profile.held(profile.top_values(hist, top))
        hist.unpersist()
    if chosen:
        counted = scratch.cut(digests(df, chosen), "digests")
        wide, best = counts(df, rules, chosen, counted, as_of), profile.held(top_values(df, chosen, counted, top))
        found, most = wide if found is None else found.unionByName(wide), best if most is None else most.unionByName(best)
    rows = profile.held(profile.metrics(df, rules, columns, as_of, conditional=conditional, found=found))
    none = df.sparkSession.createDataFrame([], "column_name string, position int, row_index long, value string")
    bad = profile.held(profile.violations(df, rules, examples, columns, as_of)) if ROW in df.columns else none
    return Profile(rows, profile.held(profile.dataset_profile(rows, weighting=weighting, dataset_name=dataset_name)), most, bad, conditional)
