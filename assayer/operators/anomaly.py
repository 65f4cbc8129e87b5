"""Anomalies: a run's scores against those of earlier runs, by difference or z-score."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = ("completeness", "uniqueness", "conformity")


@dataclass(frozen=True)
class Settings:
    min_history: int = 3
    max_history: int = 50
    z_limit: float = 2.5
    limits: Mapping[str, float] = field(default_factory=lambda: {"completeness": 10.0, "uniqueness": 5.0, "conformity": 5.0})
    degradations_only: bool = True
    oldest_first: bool = True  # which points stay when there are more than max_history


def limit_of(metric: Column, limits: Mapping[str, float]) -> Column:
    out = F.lit(5.0)
    for name, value in limits.items():
        out = F.when(metric == name, F.lit(float(value))).otherwise(out)
    return out


def melted(metrics: DataFrame, *carry: str) -> DataFrame:
    """metric and value rows of the three scores, without nulls."""
    long = metrics.unpivot([*carry, "column_name"], [f"{m}_score" for m in METRICS], "metric", "value")
    return long.withColumn("metric", F.regexp_replace("metric", "_score$", "")).where(F.col("value").isNotNull())


def baseline(history: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """dataset_name, column_name, metric, n, mean, std (population), least and most.

    ``history`` has a row for each run, column and metric: dataset_name, column_name,
    metric, profiling_timestamp, value.  Equal values have exactly their own mean and
    no deviation, whatever sums of doubles say.
    """
    keys = ["dataset_name", "column_name", "metric"]
    order = Window.partitionBy(*keys).orderBy(F.col("profiling_timestamp") if settings.oldest_first else F.desc("profiling_timestamp"), "value")
    kept = history.where(F.col("value").isNotNull()).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= settings.max_history)
    low, high = F.min("value"), F.max("value")
    return kept.groupBy(*keys).agg(
        F.count("*").alias("history_size"),
        F.when(low == high, low).otherwise(F.avg("value")).alias("baseline_value"),
        F.when(low == high, 0.0).otherwise(F.stddev_pop("value")).alias("baseline_std"),
        low.alias("least"),
        high.alias("most"),
    )


def evaluate(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Anomalous rows of those with value, baseline_value, baseline_std, history_size and metric."""
    limit = limit_of(F.col("metric"), settings.limits)
    delta = F.col("value") - F.col("baseline_value")
    size = F.abs(F.col("delta"))
    out = rows.where(F.col("history_size") >= settings.min_history).withColumn("delta", delta).withColumn("threshold", limit)
    out = out.where(~((F.col("baseline_std") == 0) & (F.col("delta") == 0)))
    out = out.withColumn("z_score", F.when(F.col("baseline_std") == 0, F.lit(float("inf"))).otherwise(F.try_divide(size, F.col("baseline_std"))))
    if settings.degradations_only:
        out = out.where(F.col("delta") <= 0)
    out = out.where((size >= F.col("threshold")) | (F.col("z_score") >= settings.z_limit))
    severity = (
        F.when((size >= F.col("threshold") * 2) | (F.col("z_score") >= settings.z_limit * 1.5), "high").when((size >= F.col("threshold") * 1.2) | (F.col("z_score") >= settings.z_limit), "medium").otherwise("low")
    )
    return out.withColumn("severity", severity).withColumn("detection_method", F.lit("delta_zscore_composite"))


def detect(current: DataFrame, history: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Anomalies of a run: ``current`` has dataset_name, column_name, metric and value."""
    found = evaluate(current.join(baseline(history, settings), ["dataset_name", "column_name", "metric"]), settings)
    context = F.create_map(
        *[x for k, v in {"baseline_mean": F.col("baseline_value"), "baseline_std": F.col("baseline_std"), "absolute_delta": F.abs("delta"), "threshold": F.col("threshold"), "z_score_threshold": F.lit(settings.z_limit), "history_size": F.col("history_size").cast("double")}.items() for x in (F.lit(k), v)]
    )
    return found.select("dataset_name", "column_name", "metric", F.col("value").alias("current_value"), "baseline_value", "delta", "z_score", "severity", "detection_method", context.alias("context"))


def detect_all(history: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every run of a history against the runs before it, in one pass.

    The baseline of a run is that of its earlier points (with ``oldest_first``, of the
    first ``max_history`` of them).
    """
    w = Window.partitionBy("dataset_name", "column_name", "metric").orderBy("profiling_timestamp")
    if settings.oldest_first:
        seen = history.where(F.col("value").isNotNull()).withColumn("__r", F.row_number().over(w))
        earlier, held = w.rowsBetween(Window.unboundedPreceding, -1), F.when(F.col("__r") <= settings.max_history, F.col("value"))
    else:
        seen, earlier, held = history.where(F.col("value").isNotNull()), w.rowsBetween(-settings.max_history, -1), F.col("value")
    low, high = F.min(held).over(earlier), F.max(held).over(earlier)
    rows = seen.select(
        "*",
        F.count(held).over(earlier).alias("history_size"),
        F.when(low == high, low).otherwise(F.avg(held).over(earlier)).alias("baseline_value"),
        F.when(low == high, 0.0).otherwise(F.stddev_pop(held).over(earlier)).alias("baseline_std"),
    )
    return evaluate(rows, settings).drop("__r")


def uniform_settings(delta: float, z_limit: float, **more) -> Settings:
    """Settings of the one-number request: half the difference for uniqueness."""
    return Settings(z_limit=z_limit, limits={"completeness": delta, "conformity": delta, "uniqueness": delta / 2}, **more)


def finite_z(c: Column, most: float = 999.0) -> Column:
    """For exports that know no infinity."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), most).otherwise(c)
