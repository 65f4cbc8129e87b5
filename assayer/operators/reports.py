"""Reports over the history, over validations and over profiles, and their exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def runs_per_dataset(runs: DataFrame) -> DataFrame:
    return runs.groupBy("dataset_name").agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), "dataset_name")


def runs_per_column(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("column_name").agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), "column_name")


def earlier_runs(runs: DataFrame, dataset: str) -> DataFrame:
    """How many runs a dataset has besides the present one."""
    return runs.where(F.col("dataset_name") == dataset).agg(F.greatest(F.count("*") - 1, F.lit(0)).alias("history_size"))


def statistics(runs: DataFrame, metrics: DataFrame, issues: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row of five counts."""
    n = lambda df, name, what=F.count("*"): df.agg(what.alias(name)).withColumn("k", F.lit(1))
    out = n(runs, "run_count")
    for part in (n(metrics, "metric_count"), n(issues, "issue_count"), n(anomalies, "anomaly_count"), n(runs, "dataset_count", F.count_distinct("dataset_name"))):
        out = out.join(part, "k")
    return out.drop("k")


def stability(points: DataFrame) -> DataFrame:
    """Mean, population deviation and range of each column's scores; stable where all are equal."""
    low, high = F.min("value"), F.max("value")
    return points.groupBy("column_name").agg(
        F.count("*").alias("points"),
        F.when(low == high, low).otherwise(F.avg("value")).alias("mean"),
        F.when(low == high, 0.0).otherwise(F.stddev_pop("value")).alias("std"),
        low.alias("least"),
        high.alias("most"),
        (low == high).alias("stable"),
    )


def covered_columns(points: DataFrame, least: int = 3) -> DataFrame:
    """Columns with enough runs for a baseline."""
    return points.groupBy("column_name").agg(F.count_distinct("run_id").alias("runs")).withColumn("enough", F.col("runs") >= least)


def coverage(rules: DataFrame, points: DataFrame) -> DataFrame:
    """Columns that have only a rule or only a history, and which of them: both anti joins."""
    ruled, known = rules.select("column_name").distinct(), points.select("column_name").distinct()
    alone = ruled.join(known, "column_name", "left_anti").withColumn("has", F.lit("rule"))
    return alone.unionByName(known.join(ruled, "column_name", "left_anti").withColumn("has", F.lit("history")))


def nth_smallest(df: DataFrame, column: str, n: int, buckets: int = 1024) -> int | None:
    """The n-th smallest whole number of a column, from 0 on; None if there are fewer.

    Counts per range of values find the range that holds it, which is then divided again: seven
    passes at most, each of which brings ``buckets`` counts to the driver and sorts nothing.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("long").alias("v"))
    low, high, total = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if n < 0 or n >= total:
        return None
    while low < high:
        width = -(-(high - low + 1) // buckets)
        inside = values.where(F.col("v").between(low, high))
        at = F.expr(f"CAST((CAST(v AS DECIMAL(20,0)) - {low}BD) div {width}BD AS INT)")  # whole numbers: a quotient of decimals would be rounded
        for bucket, count in sorted(tuple(r) for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n")).collect()):
            if n < count:
                low, high = low + bucket * width, min(high, low + (bucket + 1) * width - 1)
                break
            n -= count
    return low


def outlier_runs(runs: DataFrame, times: float = 2.0, by: str | None = None) -> DataFrame:
    """Runs with more than ``times`` the median rows, the upper of two middle ones; none of fewer than two runs.

    One task per dataset sorts its runs if ``by`` names that column; without it the median is selected by
    counts per range, so no task holds all runs.
    """
    if by is None:
        n = runs.count()
        median = nth_smallest(runs, "total_rows", n // 2 - runs.where(F.col("total_rows").isNull()).count()) if n else None
        found = runs.withColumn("median_rows", F.lit(median).cast("long"))
        return found.where(F.lit(n >= 2) & (F.col("total_rows") > times * F.col("median_rows")))
    part = Window.partitionBy(by)
    ranked = runs.withColumn("__r", F.row_number().over(part.orderBy("total_rows"))).withColumn("__n", F.count("*").over(part))
    middle = F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 2) + 1, F.col("total_rows"))).over(part)
    return ranked.withColumn("median_rows", middle).where((F.col("__n") >= 2) & (F.col("total_rows") > times * F.col("median_rows"))).drop("__r", "__n")


def recent(rows: DataFrame, at: str, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc(at)).limit(n)


def worst_columns(found: DataFrame, n: int = 10, by: str = "non_conforming_count") -> DataFrame:
    """Columns with the most violations."""
    return found.where(F.col(by) > 0).orderBy(F.desc(by), "column_name").limit(n)


def remaining_violations(found: DataFrame, n: int = 10, by: str = "non_conforming_count") -> DataFrame:
    """What the columns behind the first n have together."""
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc(by), "column_name")  # a row for each column of a dataset
    rest = found.where(F.col(by) > 0).withColumn("__r", F.row_number().over(order)).where(F.col("__r") > n)
    return rest.agg(F.count("*").alias("columns"), F.coalesce(F.sum(by), F.lit(0)).alias("violations"))


def quality_band(c: Column) -> Column:
    return F.when(c.isNull(), "none").when(c == 100, "perfect").when(c >= 90, "good").otherwise("poor")


def completeness_band(c: Column) -> Column:
    return F.when(c >= 90, "good").when(c >= 70, "fair").otherwise("poor")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").otherwise("low")


def flagged(rows: DataFrame, delta_limit: float = 5.0, z_limit: float = 2.0) -> DataFrame:
    """Rows of value, baseline_value and baseline_std, and why each is or isn't an anomaly."""
    delta = F.col("value") - F.col("baseline_value")
    z = F.when(F.col("baseline_std") > 0, F.abs(delta) / F.col("baseline_std")).otherwise(F.when(delta == 0, 0.0).otherwise(float("inf")))
    return rows.withColumn("status", F.when(delta > 0, "improvement (ignored)").when((F.abs(delta) < delta_limit) & (z < z_limit), "within thresholds").otherwise("flagged"))


def by_kind(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def _percent(c: Column) -> Column:
    return F.format_string("%.2f%%", c)


def column_details(metrics: DataFrame) -> DataFrame:
    """A profile's columns as text for a file, worst first."""
    unique = F.col("uniqueness_score")
    return metrics.orderBy("conformity_score", "completeness_score", "column_name").select(
        "column_name",
        "total_count",
        "non_null_count",
        _percent(F.col("completeness_score")).alias("completeness"),
        F.coalesce(F.when(unique.isNotNull(), _percent(unique)), F.lit("N/A")).alias("uniqueness"),
        F.when(unique.isNotNull(), F.col("duplicate_count").cast("string")).otherwise("N/A").alias("duplicates"),
        _percent(F.col("conformity_score")).alias("conformity"),
        "non_conforming_count",
    )


def validation_details(found: DataFrame) -> DataFrame:
    """A validation's columns as text for a file, worst first, with their first samples in one field."""
    return found.orderBy("conformity_rate", "column_name").select("column_name", "rule_type", "rule_id", "total_count", "non_null_count", "conforming_count", "non_conforming_count", _percent(F.col("conformity_rate")).alias("conformity_rate"), F.concat_ws("; ", F.slice("samples", 1, 3)).alias("samples"))


def as_json(rows: DataFrame, examples: int = 5) -> DataFrame:
    """Each row as a JSON document; examples are cut to a few."""
    if "examples" in rows.columns:
        rows = rows.withColumn("examples", F.slice("examples", 1, examples))
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def profile_document(profile, issues: DataFrame, examples: int = 5) -> DataFrame:
    """One row with a whole profile as a JSON document: dataset, columns and issues, nested.

    It has a row's part for each column and issue, as many as the columns allow.
    """
    shown = issues.withColumn("examples", F.slice("examples", 1, examples))
    return _document(profile.dataset, "dataset", columns=(profile.metrics, "column_name"), issues=(shown, "seq"))


def validation_document(overall: DataFrame, found: DataFrame) -> DataFrame:
    """One row with a validation as a JSON document: the summary, and a part for each column."""
    return _document(overall, "summary", column_results=(found, "column_name"))


def recommendation_document(totals: DataFrame, recommendations: DataFrame) -> DataFrame:
    """One row with recommendations as a JSON document: the counts, and the list."""
    return _document(totals, "summary", recommendations=(recommendations, "seq"))


def _document(head: DataFrame, name: str, **parts: tuple[DataFrame, str]) -> DataFrame:
    out = head.select(F.struct(*head.columns).alias(name))
    for part, (rows, order) in parts.items():
        listed = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__by"), F.to_json(F.struct(*rows.columns)).alias("json")))).alias("x"))
        out = out.withColumn("__one", F.lit(1)).join(listed.select(F.transform("x", lambda x: x["json"]).alias(part), F.lit(1).alias("__one")), "__one").drop("__one")
    texts = [F.concat(F.lit(f'"{p}":['), F.array_join(p, ","), F.lit("]")) for p in parts]
    return out.select(F.concat(F.lit(f'{{"{name}":'), F.to_json(name), F.lit(","), F.concat_ws(",", *texts), F.lit("}")).alias("json"))
