"""The chain of all stages: profile, store, compare, recommend, repair, validate again."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import Rule
from ..operators import anomaly, issues, profile, recommend, repair, validate
from ..sources import files, scratch
from ..sources.catalog import provider_rules
from ..sources.history import History


@dataclass
class Outcome:
    profile: profile.Profile
    issues: DataFrame
    anomalies: DataFrame | None
    recommendations: DataFrame
    repaired: repair.Repaired | None = None
    comparison: DataFrame | None = None
    run_id: str | None = None


def run(df: DataFrame, rules: Mapping[str, Rule] | None = None, *, at: dt.datetime, dataset_name: str = "dataset", history: History | None = None, settings: anomaly.Settings = anomaly.Settings(), maps: repair.Maps | None = None, execute: bool = True, only_actionable: bool = True, rows_to_profile: int | None = None, folder: str | None = None) -> Outcome:
    """All stages over a dataset with a ``row_index``; ``rows_to_profile`` samples what is profiled, not what is repaired.

    ``folder``, a shared one, takes the outcomes of repairs, so that they are worked out once; without it
    they go to a scratch folder.
    """
    rules = provider_rules() if rules is None else rules
    day = at.date()
    profiled = files.sample(df, rows_to_profile) if rows_to_profile else df
    found = profile.profile(profiled, rules, as_of=day, dataset_name=dataset_name)
    seen = issues.detect(found, rules)
    run_id = anomalies = None
    if history is not None:
        run_id = history.store(found, seen, at=at, dataset_name=dataset_name, rules_applied=len(rules))
        current = anomaly.melted(found.metrics.withColumn("dataset_name", files.F.lit(dataset_name)), "dataset_name")
        anomalies = anomaly.detect(current, history.points(dataset_name, exclude_run=run_id, before=at), settings)
        history.store_anomalies(anomalies, dataset_name=dataset_name, run_id=run_id, at=at)
    advice = recommend.recommend(seen, found.metrics, rules, df)
    out = Outcome(found, seen, anomalies, advice, run_id=run_id)
    if execute:
        recs = repair.collected(advice)
        out.repaired = repair.repair(df, recs, rules, maps=maps, as_of=day, only_actionable=only_actionable, folder=folder or scratch.fresh_path(df.sparkSession, "outcomes"))
        touched = [c for c in dict.fromkeys([*(r.column_name for r in recs), *rules]) if c in df.columns]
        before = validate.scores(df, rules, {c: c for c in touched}, as_of=day)
        after = validate.scores(repair.effective(out.repaired.table, touched), rules, {c: c for c in touched}, as_of=day)
        out.comparison = validate.before_after(before, after)
    return out


def run_file(spark: SparkSession, path: str, *, at: dt.datetime, output: str | None = None, history_root: str | None = None, **more) -> Outcome:
    """The chain over a file; the repaired table and the audit rows go beside ``output``."""
    df = files.load_dataset(spark, path)
    name = more.pop("dataset_name", path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0])
    folder = f"{output}.outcomes" if output else None
    out = run(df, at=at, dataset_name=name, history=History(spark, history_root) if history_root else None, folder=folder, **more)
    if output and out.repaired is not None:
        if output == path:
            files.backup(path, at)
        files.save_dataset(out.repaired.table.drop(files.ROW), output)
        files.save_dataset(out.repaired.sidecar, output.rsplit(".", 1)[0] + "_fix_recommendations.csv")
    return out
