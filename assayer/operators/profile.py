"""Column and dataset profiles.

Wide tables are profiled by way of a histogram: rows are turned to (column, value),
counted with one shuffle, and the null model and the rules are evaluated once per
distinct value.  Uniqueness, top values, lengths and conformity all come from that.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.nulls import is_null_like, quoted, strip
from ..functions.rules import ENTITY_TYPE, NAME_COLUMNS, Rule, conditionally_complete, entity_type, matches_long, required_of
from ..sources.files import ROW

UNIQUE_COLUMN = "NPI"
UNIVERSAL = (UNIQUE_COLUMN, ENTITY_TYPE)


@dataclass
class Profile:
    metrics: DataFrame  # one row for each column
    dataset: DataFrame  # one row
    top_values: DataFrame  # column_name, value, n, rank
    violations: DataFrame  # column_name, position, row_index, value
    conditional: DataFrame | None = None  # column_name, n_valid, n_individual, n_organization, n_invalid


def profiled_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW]


def histogram(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column_name, value (text, null for null) and n."""
    columns = profiled_columns(df) if columns is None else columns
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("x")).groupBy("x.column_name", "x.value").agg(F.count("*").alias("n"))


def judged(hist: DataFrame, rules: Mapping[str, Rule], as_of: dt.date | str | None = None) -> DataFrame:
    """The histogram with is_null and ok for each value."""
    name, value = F.col("column_name"), F.col("__v")  # read often, so a projection of its own
    out = hist.withColumn("__v", strip(F.col("value"))).withColumn("is_null", is_null_like(value, name, stripped=True))
    return out.withColumn("ok", F.when(F.col("is_null"), False).otherwise(matches_long(name, value, rules, as_of))).drop("__v")


def counts(hist: DataFrame) -> DataFrame:
    """Counts and lengths of each column, from its judged histogram."""
    n = F.col("n")
    given = F.when(F.col("value").isNotNull(), n)
    length = F.char_length("value")
    return hist.groupBy("column_name").agg(
        F.sum("n").alias("total_count"),
        F.coalesce(F.sum(F.when(~F.col("is_null"), n)), F.lit(0)).alias("non_null_count"),
        F.count("value").alias("unique_count"),
        F.coalesce(F.sum(F.when(F.col("ok"), n)), F.lit(0)).alias("conforming_count"),
        F.min(length).cast("int").alias("min_length"),
        F.max(length).cast("int").alias("max_length"),
        (F.sum(length * given) / F.sum(given)).alias("avg_length"),
    )


def conditional_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame | None:
    """For the name columns whose need depends on the entity type: rows that meet it, and rows that don't by type."""
    names = [c for c in NAME_COLUMNS if c in (columns or df.columns)]
    if ENTITY_TYPE not in df.columns or not names:
        return None
    et = entity_type(quoted(ENTITY_TYPE))
    missing = lambda c, k: F.count_if((et == k) & (F.lit(required_of(c)) == k) & is_null_like(quoted(c), c))
    aggs: list[Column] = []
    for i, c in enumerate(names):
        aggs += [F.count_if(conditionally_complete(quoted(ENTITY_TYPE), quoted(c), c)).alias(f"v{i}"), missing(c, 1).alias(f"p{i}"), missing(c, 2).alias(f"o{i}")]
    one = df.agg(F.count_if(~F.coalesce(et.isin(1, 2), F.lit(False))).alias("bad"), *aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"v{i}").alias("n_valid"), F.col(f"p{i}").alias("n_individual"), F.col(f"o{i}").alias("n_organization"), F.col("bad").alias("n_invalid")) for i, c in enumerate(names)])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def metrics(df: DataFrame, rules: Mapping[str, Rule], columns: list[str] | None = None, as_of=None, hist: DataFrame | None = None, conditional: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """One row for each column: counts, completeness, uniqueness (of the NPI alone), conformity, lengths.

    ``found`` is what ``counts`` gives, where that was made in another way.
    """
    columns = profiled_columns(df) if columns is None else columns
    if found is None:
        found = counts(judged(histogram(df, columns), rules, as_of) if hist is None else hist)
    spark = df.sparkSession
    listed = spark.createDataFrame([(i, c) for i, c in enumerate(columns)], "position int, column_name string")
    rows = listed.join(found, "column_name", "left").na.fill(0, ["total_count", "non_null_count", "unique_count", "conforming_count"])
    valid = F.col("non_null_count")
    conditional = conditional_counts(df, columns) if conditional is None else conditional
    if conditional is not None:
        rows = rows.join(conditional.select("column_name", "n_valid"), "column_name", "left")
        valid = F.coalesce("n_valid", valid)
    total, non_null = F.col("total_count"), F.col("non_null_count")
    return rows.select(
        "position",
        "column_name",
        "total_count",
        "non_null_count",
        (total - non_null).alias("null_count"),
        "unique_count",
        (total - F.col("unique_count")).alias("duplicate_count"),
        "conforming_count",
        (non_null - F.col("conforming_count")).alias("non_conforming_count"),
        F.when(total == 0, 0.0).otherwise(valid / total * 100).alias("completeness_score"),
        F.when((F.col("column_name") == UNIQUE_COLUMN) & (total > 0), F.col("unique_count") / total * 100).alias("uniqueness_score"),
        F.when(non_null == 0, 0.0).otherwise(F.col("conforming_count") / non_null * 100).alias("conformity_score"),
        "min_length",
        "max_length",
        "avg_length",
    )


def dataset_profile(found: DataFrame, *, weighting: str = "columns", dataset_name: str = "dataset") -> DataFrame:
    """One row: the columns' mean scores, or with ``weighting="cells"`` the shares of all cells."""
    if weighting == "columns":
        complete, conform = F.coalesce(F.avg("completeness_score"), F.lit(0.0)), F.coalesce(F.avg("conformity_score"), F.lit(0.0))
    elif weighting == "cells":
        share = lambda a, b, none: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b) * 100).otherwise(none)
        complete, conform = share("non_null_count", "total_count", 0.0), share("conforming_count", "non_null_count", 0.0)
    else:
        raise ValueError(weighting)
    return found.agg(
        F.coalesce(F.max("total_count"), F.lit(0)).alias("total_rows"),
        F.count("*").cast("int").alias("total_columns"),
        complete.alias("overall_completeness"),
        F.coalesce(F.max(F.when(F.col("column_name") == UNIQUE_COLUMN, F.col("uniqueness_score"))), F.lit(100.0)).alias("overall_uniqueness"),
        conform.alias("overall_conformity"),
    ).select(F.lit(dataset_name).alias("dataset_name"), "*")


def top_values(hist: DataFrame, n: int = 5) -> DataFrame:
    """The n most frequent values of each column, nulls left out, ties to the smaller text."""
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return hist.where(F.col("value").isNotNull()).select("column_name", "value", "n", F.row_number().over(order).alias("rank")).where(F.col("rank") <= n)


def violations(df: DataFrame, rules: Mapping[str, Rule], n: int = 50, columns: list[str] | None = None, as_of=None) -> DataFrame:
    """The first n cells of each column, by row, that are there and break its rule.

    Cells are tested where they are read; a limit per column before the shuffle keeps
    what moves to n rows for each task and column.
    """
    columns = [c for c in (profiled_columns(df) if columns is None else columns) if c in rules]
    schema = "column_name string, position int, row_index long, value string"
    if not columns:
        return df.sparkSession.createDataFrame([], schema)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), quoted(c).cast("string").alias("value")) for c in columns]))
    name, v = F.col("column_name"), F.col("__v")
    long = df.select(ROW, cells.alias("x")).select("x.column_name", ROW, "x.value").withColumn("__v", strip(F.col("value")))
    bad = long.where(~is_null_like(v, name, stripped=True) & ~matches_long(name, v, {c: rules[c] for c in columns}, as_of)).drop("__v")
    order = Window.partitionBy("column_name").orderBy(ROW)
    return bad.select("column_name", F.row_number().over(order).alias("position"), F.col(ROW).alias("row_index"), "value").where(F.col("position") <= n)


def held(df: DataFrame) -> DataFrame:
    """The same rows as a local table: for results of a few rows for each column, which later steps read often."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def profile(df: DataFrame, rules: Mapping[str, Rule], *, columns: list[str] | None = None, as_of=None, dataset_name: str = "dataset", top: int = 5, examples: int = 50, weighting: str = "columns") -> Profile:
    """All of a dataset's profile; ``df`` has a ``row_index`` where examples are wanted.

    The dataset is read for the histogram, for the conditional columns and for the
    examples.  What comes of it has a bounded number of rows for each column and is
    computed here, once.
    """
    columns = profiled_columns(df) if columns is None else columns
    hist = judged(histogram(df, columns), rules, as_of).persist()
    conditional = conditional_counts(df, columns)
    conditional = None if conditional is None else held(conditional)
    found = held(metrics(df, rules, columns, as_of, hist, conditional))
    most = held(top_values(hist, top))
    hist.unpersist()
    none = df.sparkSession.createDataFrame([], "column_name string, position int, row_index long, value string")
    bad = held(violations(df, rules, examples, columns, as_of)) if ROW in df.columns else none
    return Profile(found, held(dataset_profile(found, weighting=weighting, dataset_name=dataset_name)), most, bad, conditional)


def critical_columns(found: DataFrame, least: float = 95.0) -> DataFrame:
    """Columns whose conformity is below the limit."""
    return found.where(F.col("conformity_score") < least)
