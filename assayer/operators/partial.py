"""Profiles that can be merged.

The state of a column holds exact sums and two sketches: one for how many different values there are, one
for the most frequent.  States of different files, runs or days add up to the state of all
of them, so a dataset that grows is profiled by reading only what is new.

Sums, lengths and scores are exact.  Different values are estimated with a standard error of about
1.04 / sqrt(2 ** ``lg``): 0.8 % as set, and a little less than exact below a thousand.  Frequent values are
exact while a column has no more than three quarters of ``items`` different ones; beyond, a count is off by
at most 3.5 / ``items`` of all rows, so a value more frequent than that is never missed.
"""

from __future__ import annotations

from collections.abc import Mapping
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nulls import is_null_like, quoted
from ..functions.rules import ENTITY_TYPE, NAME_COLUMNS, Rule, conditionally_complete, conforms
from ..sources.files import ROW, as_text
from ..sources.history import History
from .profile import UNIQUE_COLUMN, profiled_columns

LG, ITEMS = 14, 1_000
#: Columns that one pass aggregates; a pass reads only these.
AT_ONCE = 40


def states(df: DataFrame, rules: Mapping[str, Rule], *, columns: list[str] | None = None, as_of=None, source: Column | None = None, lg: int = LG, items: int = ITEMS, sketches: bool = True) -> DataFrame:
    """A row for each source and column.  Nothing but a state for each task, source and column is shuffled.

    Without ``sketches`` only the exact sums are made.  ``source`` tells the file or part that a row belongs to; all rows are one, named "", without it.
    """
    columns = profiled_columns(df) if columns is None else columns
    from_ = F.lit("") if source is None else source
    found = None
    for at in range(0, len(columns), AT_ONCE):
        some = columns[at : at + AT_ONCE]
        aggs = []
        for i, c in enumerate(some):
            v = quoted(c).cast("string")
            there = ~is_null_like(v, c)
            valid = conditionally_complete(quoted(ENTITY_TYPE), v, c) if c in NAME_COLUMNS and ENTITY_TYPE in df.columns else there
            good = F.count_if(there & conforms(v, rules[c], c, as_of)) if c in rules else F.count_if(there)
            length = F.char_length(v)  # a sketch leaves out empty text, so that is counted as a character nothing else has
            aggs += [
                F.count_if(there).alias(f"n{i}"), F.count_if(valid).alias(f"m{i}"), good.alias(f"g{i}"), F.count(v).alias(f"v{i}"), F.coalesce(F.sum(length.cast("long")), F.lit(0)).alias(f"s{i}"),
                F.min(length).alias(f"a{i}"), F.max(length).alias(f"b{i}"),
            ]
            if sketches:
                aggs += [F.hll_sketch_agg(F.when(v == "", F.lit("\0")).otherwise(v), lg).alias(f"d{i}"), F.call_function("approx_top_k_accumulate", v, F.lit(items)).alias(f"f{i}")]
        one = df.groupBy(from_.alias("source")).agg(F.count("*").alias("t"), *aggs)
        rows = F.array(*[
            F.struct(
                F.lit(at + i).alias("position"), F.lit(c).alias("column_name"), F.col("t").alias("total_count"), F.col(f"n{i}").alias("non_null_count"), F.col(f"m{i}").alias("n_valid"), F.col(f"g{i}").alias("conforming_count"),
                F.col(f"v{i}").alias("valued_count"), F.col(f"s{i}").alias("length_sum"), F.col(f"a{i}").alias("min_length"), F.col(f"b{i}").alias("max_length"),
                *([F.col(f"d{i}").alias("distinct_sketch"), F.col(f"f{i}").alias("frequent")] if sketches else []),
            )
            for i, c in enumerate(some)
        ])
        part = one.select("source", F.explode(rows).alias("x")).select("source", "x.*")
        found = part if found is None else found.unionByName(part)
    return found


def merge(parts: DataFrame, *by: str, items: int = ITEMS) -> DataFrame:
    """States added up to one for each column, and for each value of the columns ``by``."""
    sums = [F.sum(c).alias(c) for c in ("total_count", "non_null_count", "n_valid", "conforming_count", "valued_count", "length_sum")]
    return parts.groupBy(*by, "column_name").agg(
        F.min("position").alias("position"), *sums, F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"),
        F.hll_union_agg("distinct_sketch").alias("distinct_sketch"), F.call_function("approx_top_k_combine", "frequent", F.lit(items)).alias("frequent"),
    )


def metrics(merged: DataFrame) -> DataFrame:
    """What ``profile.metrics`` gives, from states: all but ``unique_count``, ``duplicate_count`` and the uniqueness are exact."""
    total, non_null = F.col("total_count"), F.col("non_null_count")
    unique = F.least(F.hll_sketch_estimate("distinct_sketch"), F.col("valued_count"))
    score = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b * 100)
    return merged.withColumn("unique_count", unique).select(
        "position",
        "column_name",
        "total_count",
        "non_null_count",
        (total - non_null).alias("null_count"),
        "unique_count",
        (total - F.col("unique_count")).alias("duplicate_count"),
        "conforming_count",
        (non_null - F.col("conforming_count")).alias("non_conforming_count"),
        score(F.col("n_valid"), total).alias("completeness_score"),
        F.when((F.col("column_name") == UNIQUE_COLUMN) & (total > 0), F.col("unique_count") / total * 100).alias("uniqueness_score"),
        score(F.col("conforming_count"), non_null).alias("conformity_score"),
        "min_length",
        "max_length",
        F.when(F.col("valued_count") > 0, F.col("length_sum") / F.col("valued_count")).alias("avg_length"),
    )


def top_values(merged: DataFrame, n: int = 5, items: int = ITEMS) -> DataFrame:
    """column_name, value, n and rank of the most frequent values, nulls left out, ties to the smaller text; ``items`` as the states were made with."""
    listed = F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(items))
    each = merged.select("column_name", F.explode(listed).alias("x")).select("column_name", F.col("x.item").alias("value"), F.col("x.count").alias("n")).where(F.col("value").isNotNull())
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def profile_new(spark: SparkSession, store: History, path: str, rules: Mapping[str, Rule], *, dataset_name: str, run_id: str, columns: list[str] | None = None, as_of=None) -> DataFrame:
    """Reads the Parquet files of a dataset that no run has read before, keeps their states, and merges those of all files there are now.

    A file is known by its path: files are added or removed, not changed.
    """
    there = spark.read.parquet(path).inputFiles()
    known = {r.source for r in store.table("profile_states", dataset_name).select("source").distinct().collect()}  # as many as the driver lists files
    new = [f for f in there if f not in known]
    if new:
        df = spark.read.parquet(*map(unquote, new))
        columns = columns or [c for c in df.columns if c != ROW]
        text = df.select("*", F.input_file_name().alias("__source"))
        found = states(as_text(text), rules, columns=columns, as_of=as_of, source=F.col("__source"))
        store.store_states(found, dataset_name=dataset_name, run_id=run_id)
    now = spark.createDataFrame([(f,) for f in there], "source string")
    return merge(store.table("profile_states", dataset_name).join(now, "source", "left_semi"))
