"""Stage-by-stage functions over files that return plain values, for a web layer or a notebook."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import Rule
from ..operators import anomaly, issues, profile, recommend, repair, reports
from ..sources import files, scratch
from ..sources.catalog import provider_rules
from ..sources.history import History


def values(df: DataFrame) -> list[dict]:
    """Rows as JSON-ready dictionaries; for results of a row per column or issue."""
    return [json.loads(r[0]) for r in reports.as_json(df).collect()]


def _profiled(spark: SparkSession, path: str, rules: Mapping[str, Rule] | None, day: dt.date | None):
    rules = provider_rules() if rules is None else rules
    df = files.load_dataset(spark, path)
    found = profile.profile(df, rules, as_of=day)
    return df, rules, found, issues.detect(found, rules)


def profile_file(spark: SparkSession, path: str, *, rules: Mapping[str, Rule] | None = None, day: dt.date | None = None) -> dict:
    """Dataset, columns and issues of a file; nothing is stored."""
    _, _, found, seen = _profiled(spark, path, rules, day)
    return {"dataset": values(found.dataset)[0], "columns": values(found.metrics), "issues": values(seen)}


def anomalies_of(spark: SparkSession, history: History, dataset: str, *, delta: float = 5.0, z_limit: float = 2.5, run_id: str | None = None) -> dict:
    """Anomalies of a stored run, the latest by default, with z-scores that JSON can hold.  LookupError without a run."""
    run_id = run_id or history.latest_run(dataset)
    if run_id is None:
        raise LookupError(f"no run of {dataset}")
    run, metrics = history.profile_of(run_id, dataset)
    at = run.first().profiling_timestamp
    settings = anomaly.uniform_settings(delta, z_limit)
    found = anomaly.detect(anomaly.melted(metrics, "dataset_name"), history.points(dataset, exclude_run=run_id, before=at), settings)
    rows = values(found.withColumn("z_score", anomaly.finite_z(F.col("z_score"))))
    return {"run_id": run_id, "history_size": reports.earlier_runs(history.table("profiling_runs"), dataset).first()[0], "anomalies": rows}


def recommendations_of(spark: SparkSession, path: str, *, rules: Mapping[str, Rule] | None = None, day: dt.date | None = None) -> dict:
    df, rules, found, seen = _profiled(spark, path, rules, day)
    advice = recommend.recommend(seen, found.metrics, rules, df)
    return {"recommendations": values(advice), **values(recommend.summary(advice))[0]}


def apply_fixes(spark: SparkSession, path: str, output: str, accepted: Iterable[Mapping], *, rules: Mapping[str, Rule] | None = None, day: dt.date | None = None, maps: repair.Maps | None = None) -> dict:
    """Applies accepted recommendations, actionable or not; writes the table and its audit rows and shows the first rows."""
    rules = provider_rules() if rules is None else rules
    df = files.load_dataset(spark, path, focused_only=False)
    names = repair.Recommendation.__dataclass_fields__
    recs = [repair.Recommendation(**{k: v for k, v in r.items() if k in names}) for r in accepted]
    folder = scratch.fresh_path(spark, "outcomes")  # worked out once for all that follows
    done = repair.repair(df, recs, rules, maps=maps, as_of=day, only_actionable=False, folder=folder)
    table = done.table.drop(files.ROW)
    files.save_dataset(table, output)
    audit = output.rsplit(".", 1)[0] + "_fix_recommendations.csv"
    files.save_dataset(done.sidecar, audit)
    results, shown = values(done.results), [r.asDict() for r in files.preview(files.first_rows(done.table, 20).drop(files.ROW)).collect()]
    told = {"results": results, "rows_fixed": sum(r["rows_fixed"] for r in results), "details": values(repair.details(done.sidecar)), "columns": table.columns, "row_count": table.count()}
    scratch.release(folder)
    return {"output": output, "audit": audit, "preview": shown, **told}


def download(spark: SparkSession, path: str) -> Iterator[bytes]:
    """The chunks of a repaired CSV file, for a response that is streamed.  FileNotFoundError if it isn't there."""
    return files.chunks(spark, path)
