"""Validation of columns and whole datasets against rules, without a profile."""

from __future__ import annotations

import time
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import is_null_like, quoted
from ..functions.rules import Rule, conforms
from ..sources.files import ROW
from .profile import counts, histogram, judged, profiled_columns, violations


def validate_column(df: DataFrame, column: str, rule: Rule | None, as_of=None) -> DataFrame:
    """One row: counts and conformity of one column; 100 where nothing is there to conform."""
    c = quoted(column)
    missing, ok = is_null_like(c, column), conforms(c, rule, column, as_of)
    n, good = F.count_if(~missing), F.count_if(ok)
    return df.agg(
        F.count("*").alias("total_count"),
        n.alias("non_null_count"),
        good.alias("conforming_count"),
        (n - good).alias("non_conforming_count"),
        F.when(n > 0, good / n * 100).otherwise(100.0).alias("conformity_score"),
    ).select(F.lit(column).alias("column_name"), F.lit(rule.rule_id if rule else None).cast("string").alias("rule_id"), "*")


def validate_dataset(df: DataFrame, rules: Mapping[str, Rule], *, columns: list[str] | None = None, as_of=None, samples: int = 3) -> DataFrame:
    """A row for each column: counts, rate, rule, and the first bad values."""
    columns = profiled_columns(df) if columns is None else columns
    spark = df.sparkSession
    found = counts(judged(histogram(df, columns), rules, as_of))
    listed = spark.createDataFrame([(i, c, rules[c].rule_type if c in rules else "N/A", rules[c].rule_id if c in rules else None) for i, c in enumerate(columns)], "position int, column_name string, rule_type string, rule_id string")
    rows = listed.join(found, "column_name", "left").na.fill(0, ["total_count", "non_null_count", "conforming_count"])
    if ROW in df.columns:
        bad = violations(df, rules, samples, columns, as_of).groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("position", "value")))["value"].alias("samples"))
        rows = rows.join(bad, "column_name", "left")
    else:
        rows = rows.withColumn("samples", F.lit(None).cast("array<string>"))
    n, good = F.col("non_null_count"), F.col("conforming_count")
    return rows.select(
        "position",
        "column_name",
        "rule_type",
        "rule_id",
        "total_count",
        n,
        (F.col("total_count") - n).alias("null_count"),
        good,
        (n - good).alias("non_conforming_count"),
        F.when(n > 0, good / n * 100).otherwise(100.0).alias("conformity_rate"),
        F.coalesce("samples", F.array().cast("array<string>")).alias("samples"),
    )


def overall(found: DataFrame) -> DataFrame:
    """One row over ``validate_dataset``'s: all values' conformity (100 if there are none), the columns' mean, and totals."""
    n = F.sum("non_null_count")
    return found.agg(
        F.when(n > 0, F.sum("conforming_count") / n * 100).otherwise(100.0).alias("overall_conformity_rate"),
        F.avg("conformity_rate").alias("average_column_rate"),
        F.sum("non_conforming_count").alias("total_violations"),
        F.count("*").alias("columns_validated"),
        F.sum("total_count").alias("cells"),
    )


def scores(df: DataFrame, rules: Mapping[str, Rule], columns: Mapping[str, str], as_of=None) -> DataFrame:
    """Conformity and plain completeness; ``columns`` says which column of ``df`` holds the values of which one."""
    renamed = df.select(*[quoted(held).cast("string").alias(name) for name, held in columns.items()])
    found = counts(judged(histogram(renamed, list(columns)), rules, as_of))
    n = F.col("non_null_count")
    return found.select(
        "column_name",
        "total_count",
        F.when(F.col("total_count") > 0, n / F.col("total_count") * 100).otherwise(0.0).alias("completeness"),
        F.when(n > 0, F.col("conforming_count") / n * 100).otherwise(0.0).alias("conformity"),
    )


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row for each column of either side, with the improvement where both have it."""
    b = before.select("column_name", F.col("completeness").alias("completeness_before"), F.col("conformity").alias("conformity_before"))
    a = after.select("column_name", F.col("completeness").alias("completeness_after"), F.col("conformity").alias("conformity_after"))
    return b.join(a, "column_name", "full").withColumn("conformity_gain", F.col("conformity_after") - F.col("conformity_before")).withColumn("completeness_gain", F.col("completeness_after") - F.col("completeness_before"))


def improvement(both: DataFrame) -> DataFrame:
    """One row: mean scores of either side, and the mean gain over the columns that both have."""
    return both.agg(
        F.count("conformity_before").alias("columns_before"),
        F.count("conformity_after").alias("columns_after"),
        F.count("conformity_gain").alias("columns_common"),
        *[F.avg(f"{what}_{when}").alias(f"average_{what}_{when}") for what in ("completeness", "conformity") for when in ("before", "after")],
        F.avg("completeness_gain").alias("mean_completeness_gain"),
        F.avg("conformity_gain").alias("mean_conformity_gain"),
    )


def throughput(df: DataFrame, rules: Mapping[str, Rule], *, as_of=None) -> DataFrame:
    """rule_type, n_columns, values, seconds and values_per_second: each type's rules over their columns in a job of its own.

    The first job also pays for what Spark does once; the times are those of this cluster as busy as it is.
    """
    kinds: dict[str, list[str]] = {}
    for c in df.columns:
        if c in rules:
            kinds.setdefault(rules[c].rule_type, []).append(c)
    rows = []
    for kind, columns in sorted(kinds.items()):
        began = time.monotonic()
        n = df.agg(F.count("*"), *[F.count_if(conforms(quoted(c), rules[c], c, as_of)) for c in columns]).first()[0]
        rows.append((kind, len(columns), n * len(columns), time.monotonic() - began))
    found = df.sparkSession.createDataFrame(rows, "rule_type string, n_columns int, values long, seconds double")
    return found.withColumn("values_per_second", F.try_divide("values", "seconds"))
