"""Quality of arriving rows: one profile per micro-batch, or metrics per time window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import is_null_like, quoted
from ..functions.rules import Rule, conforms
from ..operators import issues, profile
from ..sources.history import History


def windowed(df: DataFrame, at: str, column: str, rule: Rule | None, *, window: str = "1 day", late: str = "2 days", as_of=None) -> DataFrame:
    """Completeness and conformity of a column for each window; batch or stream."""
    c = quoted(column)
    if df.isStreaming:
        df = df.withWatermark(at, late)
    n, good = F.count_if(~is_null_like(c, column)), F.count_if(conforms(c, rule, column, as_of))
    found = df.groupBy(F.window(at, window).alias("w")).agg(F.count("*").alias("total_count"), n.alias("non_null_count"), good.alias("conforming_count"))
    return found.select(F.col("w.start").alias("window_start"), "total_count", "non_null_count", "conforming_count", (F.col("non_null_count") / F.col("total_count") * 100).alias("completeness_score"), F.when(F.col("non_null_count") > 0, F.col("conforming_count") / F.col("non_null_count") * 100).otherwise(0.0).alias("conformity_score"))


def profile_batches(history: History, rules: Mapping[str, Rule], *, dataset_name: str, clock: Callable[[], dt.datetime] = dt.datetime.now) -> Callable[[DataFrame, int], None]:
    """For ``writeStream.foreachBatch``: stores a run for each micro-batch, under the batch's number, so a repeated batch replaces its run."""

    def each(batch: DataFrame, number: int) -> None:
        found = profile.profile(batch, rules, dataset_name=dataset_name)
        history.store(found, issues.detect(found, rules), at=clock(), dataset_name=dataset_name, run_id=f"batch-{number:012d}")

    return each


def key_counts(df: DataFrame, at: str, key: str, *, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """How often each key comes in each window, over all micro-batches: the counts are Spark's state, kept until the watermark has passed."""
    if df.isStreaming:
        df = df.withWatermark(at, late)
    return df.where(quoted(key).isNotNull()).groupBy(F.window(at, window).alias("w"), quoted(key).alias("key")).agg(F.count("*").alias("n"))


def uniqueness(df: DataFrame, at: str, key: str, *, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """window_start, total_count, unique_count, duplicate_count and uniqueness_score of a key column; batch or stream.

    A stream gives each window once, when the watermark has passed its end, and leaves out rows that come later than ``late``.
    Duplicates in different micro-batches count, and so do those before and after a restart from a checkpoint.
    """
    counted = key_counts(df, at, key, window=window, late=late)
    again = F.window(F.window_time("w"), window) if df.isStreaming else F.col("w")
    found = counted.groupBy(again.alias("w")).agg(F.sum("n").alias("total_count"), F.count("*").alias("unique_count"))
    duplicates = F.col("total_count") - F.col("unique_count")
    return found.select(F.col("w.start").alias("window_start"), "total_count", "unique_count", duplicates.alias("duplicate_count"), (F.col("unique_count") / F.col("total_count") * 100).alias("uniqueness_score"))


def first_of_each(df: DataFrame, at: str, keys: list[str], *, late: str = "2 days") -> DataFrame:
    """The first row of each key within ``late``, across micro-batches and restarts; in a batch, of each key at all."""
    if not df.isStreaming:
        return df.dropDuplicates(keys)
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
