"""The history of profiles: Parquet tables, and a commit record for each run.

Rows are stored under a version of their own, which nobody reads before the run's commit record,
written last, names it.  Records are only added, and the latest one of a run holds: it names a version, or
says that the run was deleted.  Readers join to these records, so a run that is stored again while it
is read is seen whole, as it was or as it is.  Files that no record names any more are removed by
``vacuum``, which also ends deletes and removes what broken writes left.

Anomalies are found after a run was stored, so they have a record of their own.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import _fs, exists

KEYS = "dataset_name string, run_id string"
COMMITS = "run_id string, kind string, version string, at timestamp, dataset_name string"
DELETED = ""
#: A mergeable profile of one column of one source.
STATE = (
    "source string, position int, column_name string, total_count long, non_null_count long, n_valid long, conforming_count long, valued_count long, length_sum long, min_length int, max_length int, "
    "distinct_sketch binary, frequent struct<sketch:binary,maxItemsTracked:int,itemDataType:string,itemDataTypeDDL:string>"
)
TABLES = {
    "profiling_runs": "profiling_timestamp timestamp, total_rows long, total_columns int, overall_completeness double, overall_uniqueness double, overall_conformity double, execution_time_seconds double, data_size_mb double, processing_mode string, rules_applied int, created_at timestamp",
    "column_metrics": "column_name string, total_count long, non_null_count long, unique_count long, duplicate_count long, completeness_score double, uniqueness_score double, conformity_score double, conforming_count long, non_conforming_count long, min_length int, max_length int, avg_length double, most_common_values array<struct<value:string,count:long>>, conformity_violations array<string>, detected_at timestamp",
    "issues": "issue_id string, column_name string, issue_type string, count long, percentage double, description string, examples array<string>, rule_violated string, detected_at timestamp",
    "profile_states": STATE,
    "anomalies": "anomaly_id string, column_name string, metric string, current_value double, baseline_value double, delta double, z_score double, severity string, detection_method string, context map<string,double>, detected_at timestamp",
}
#: Tables that a record of each kind covers.
KINDS = {"run": ("column_metrics", "issues", "profiling_runs"), "states": ("profile_states",), "anomalies": ("anomalies",)}
SCORES = ("completeness", "uniqueness", "conformity")


def _id(*parts: str):
    return F.sha2(F.concat_ws("~", *[F.col(p).cast("string") for p in parts]), 256)


class History:
    def __init__(self, spark: SparkSession, root: str, retention_days: int | None = 180):
        self.spark, self.root, self.retention_days = spark, root.rstrip("/"), retention_days

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _rows(self, name: str) -> DataFrame:
        schema = f"{TABLES[name]}, {KEYS}, version string"
        if not exists(self.spark, self._path(name)):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._path(name))

    def commits(self) -> DataFrame:
        """dataset_name, run_id, kind and version (null: deleted): the record that holds for each run and kind."""
        if not exists(self.spark, self._path("commits")):
            return self.spark.createDataFrame([], "dataset_name string, run_id string, kind string, version string")
        said = self.spark.read.schema(COMMITS).parquet(self._path("commits"))
        last = said.groupBy("dataset_name", "run_id", "kind").agg(F.max(F.struct("at", "version")).alias("x"))
        return last.select("dataset_name", "run_id", "kind", F.nullif("x.version", F.lit(DELETED)).alias("version"))

    def table(self, name: str, dataset: str | None = None) -> DataFrame:
        """One of TABLES, as far as it is committed; empty until something is."""
        kind = next(k for k, names in KINDS.items() if name in names)
        live = self.commits().where((F.col("kind") == kind) & F.col("version").isNotNull())
        if dataset is not None:
            live = live.where(F.col("dataset_name") == dataset)
        rows = self._rows(name).where(F.lit(True) if dataset is None else F.col("dataset_name") == dataset)
        columns = [c for c in rows.columns if c != "version"]
        return rows.join(live.select("dataset_name", "run_id", "version"), ["dataset_name", "run_id", "version"]).select(*columns)

    def _put(self, name: str, rows: DataFrame, dataset: str, run_id: str, version: str) -> None:
        keys = {"dataset_name": dataset, "run_id": run_id, "version": version}
        kinds = dict(x.split(" ", 1) for x in _fields(TABLES[name]))
        whole = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()], *[F.lit(v).alias(k) for k, v in keys.items()])
        whole.write.mode("append").partitionBy(*keys).parquet(self._path(name))

    def _commit(self, records: list[tuple[str, str, str, str | None]]) -> None:
        """Adds records of (dataset, run, kind, version); all of a dataset become visible at once."""
        now = dt.datetime.now(dt.timezone.utc)
        rows = [(run, kind, version or DELETED, now, dataset) for dataset, run, kind, version in records]
        if rows:
            self.spark.createDataFrame(rows, COMMITS).coalesce(1).write.mode("append").partitionBy("dataset_name").parquet(self._path("commits"))

    def _named(self, dataset: str, run_id: str) -> None:
        if not dataset or not run_id:
            raise ValueError("a dataset and a run have names")

    def store(self, profile, issues: DataFrame | None = None, *, at: dt.datetime, dataset_name: str | None = None, run_id: str | None = None, seconds: float = 0.0, size_mb: float = 0.0, rules_applied: int = 0, mode: str = "distributed") -> str:
        """Stores a profile (and its issues) and returns the run's id."""
        run_id = run_id or str(uuid.uuid4())
        dataset, version = dataset_name or profile.dataset.first().dataset_name, uuid.uuid4().hex
        self._named(dataset, run_id)
        when = F.lit(at).cast("timestamp")
        top = profile.top_values.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "n"))).alias("t"))
        top = top.select("column_name", F.transform("t", lambda x: F.struct(x["value"].alias("value"), x["n"].alias("count"))).alias("most_common_values"))
        bad = profile.violations.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("position", "value")))["value"].alias("conformity_violations"))
        metrics = profile.metrics.join(top, "column_name", "left").join(bad, "column_name", "left").withColumn("detected_at", when)
        self._put("column_metrics", metrics, dataset, run_id, version)
        if issues is not None:
            self._put("issues", issues.withColumn("issue_id", _id("column_name", "issue_type", "seq")).withColumn("detected_at", when), dataset, run_id, version)
        run = profile.dataset.withColumns({"profiling_timestamp": when, "execution_time_seconds": F.lit(seconds), "data_size_mb": F.lit(size_mb), "processing_mode": F.lit(mode), "rules_applied": F.lit(rules_applied), "created_at": when})
        self._put("profiling_runs", run.drop("dataset_name"), dataset, run_id, version)
        self._commit([(dataset, run_id, "run", version)])
        if self.retention_days:
            self.expire(at)
        return run_id

    def store_anomalies(self, anomalies: DataFrame, *, dataset_name: str, run_id: str, at: dt.datetime) -> None:
        rows = anomalies.drop("dataset_name").withColumn("anomaly_id", F.sha2(F.concat_ws("~", F.lit(run_id), "column_name", "metric"), 256)).withColumn("detected_at", F.lit(at).cast("timestamp"))
        self._store_one("anomalies", rows, dataset_name, run_id)

    def store_states(self, states: DataFrame, *, dataset_name: str, run_id: str) -> None:
        """Keeps mergeable profiles (``operators.partial``) of the sources that a run has read."""
        self._store_one("states", states, dataset_name, run_id)

    def _store_one(self, kind: str, rows: DataFrame, dataset: str, run_id: str) -> None:
        self._named(dataset, run_id)
        version = uuid.uuid4().hex
        self._put(KINDS[kind][0], rows, dataset, run_id, version)
        self._commit([(dataset, run_id, kind, version)])

    def _of(self, table: str, run_id: str, dataset: str | None) -> DataFrame:
        return self.table(table, dataset).where(F.col("run_id") == run_id)

    def _only(self, run_id: str, dataset: str | None) -> str | None:
        """The dataset of a run; an error where several have a run of that id and none is named."""
        if dataset is not None:
            return dataset
        found = [r.dataset_name for r in self.commits().where((F.col("run_id") == run_id) & F.col("version").isNotNull()).select("dataset_name").distinct().limit(2).collect()]
        if len(found) > 1:
            raise ValueError(f"several datasets have a run {run_id}: name one")
        return found[0] if found else None

    def profile_of(self, run_id: str, dataset: str | None = None) -> tuple[DataFrame, DataFrame]:
        """The stored run and its metrics: counts and scores without value are 0, but for uniqueness."""
        dataset = self._only(run_id, dataset)
        m = self._of("column_metrics", run_id, dataset)
        zero = [c for c in m.columns if c.endswith("_count")] + ["completeness_score", "conformity_score"]
        return self._of("profiling_runs", run_id, dataset), m.na.fill(0, zero)

    def latest_run(self, dataset: str) -> str | None:
        return self.table("profiling_runs").where(F.col("dataset_name") == dataset).agg(F.max_by("run_id", F.struct("profiling_timestamp", "run_id"))).first()[0]

    def points(self, dataset: str | None = None, *, exclude_run: str | None = None, before: dt.datetime | None = None) -> DataFrame:
        """dataset_name, column_name, metric, run_id, profiling_timestamp, value: all scores of earlier runs, for ``operators.anomaly``."""
        runs = self.table("profiling_runs").select("dataset_name", "run_id", "profiling_timestamp")
        if dataset is not None:
            runs = runs.where(F.col("dataset_name") == dataset)
        if exclude_run is not None:
            runs = runs.where(F.col("run_id") != exclude_run)
        if before is not None:
            runs = runs.where(F.col("profiling_timestamp") < F.lit(before).cast("timestamp"))
        joined = self.table("column_metrics").join(runs, ["dataset_name", "run_id"])
        long = joined.unpivot(["dataset_name", "column_name", "run_id", "profiling_timestamp"], [f"{s}_score" for s in SCORES], "metric", "value")
        return long.withColumn("metric", F.regexp_replace("metric", "_score$", "")).where(F.col("value").isNotNull())

    def column_history(self, dataset: str, column: str, metric: str, *, limit: int = 50, exclude_run: str | None = None, before: dt.datetime | None = None) -> DataFrame:
        """The points of one column, oldest first, the oldest ``limit`` of them."""
        if metric not in SCORES:
            raise ValueError(f"unknown metric {metric}")
        p = self.points(dataset, exclude_run=exclude_run, before=before).where((F.col("column_name") == column) & (F.col("metric") == metric))
        return p.orderBy("profiling_timestamp", "run_id").limit(limit).select("profiling_timestamp", "value", "run_id")

    def expire(self, now: dt.datetime) -> list[str]:
        """Deletes runs older than the retention, with all that belongs to them."""
        limit = F.lit(now - dt.timedelta(days=self.retention_days)).cast("timestamp")
        old = self.table("profiling_runs").where(F.col("profiling_timestamp") < limit).select("dataset_name", "run_id").collect()
        self._delete([(r.dataset_name, r.run_id, kind) for r in old for kind in KINDS])
        return [r.run_id for r in old]

    def delete_run(self, run_id: str, dry_run: bool = False, dataset: str | None = None) -> dict[str, int]:
        """Rows of a run in each table, deleted unless it is a dry run; mergeable states are told only if it has any."""
        dataset = self._only(run_id, dataset)
        found = {n: self._of(n, run_id, dataset).count() if dataset is not None else 0 for n in ("anomalies", "issues", "column_metrics", "profiling_runs", "profile_states")}
        if not found["profile_states"]:
            del found["profile_states"]
        if not dry_run and dataset is not None:
            self._delete([(dataset, run_id, kind) for kind in KINDS])
        return found

    def clear_anomalies(self, dataset: str | None = None, dry_run: bool = False) -> int:
        """Deletes the anomalies of a dataset, or of all."""
        rows = self.table("anomalies", dataset)
        n = rows.count()
        if not dry_run:
            self._delete([(r.dataset_name, r.run_id, "anomalies") for r in rows.select("dataset_name", "run_id").distinct().collect()])
        return n

    def _delete(self, runs: list[tuple[str, str, str]]) -> None:
        """Records that these runs are deleted, then removes their files; ``vacuum`` ends what breaks off between."""
        self._commit([(*r, None) for r in runs])
        for dataset, run_id, kind in runs:
            for name in KINDS[kind]:
                fs, where = _fs(self.spark, f"{self._path(name)}/{self._part('dataset_name', dataset)}/{self._part('run_id', run_id)}")
                if fs.exists(where) and not fs.delete(where, True):
                    raise OSError(f"not deleted: {where}")

    def _part(self, key: str, value: str) -> str:
        """The folder of a partition, escaped as Spark does."""
        return f"{key}={self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)}"

    def vacuum(self, grace: dt.timedelta = dt.timedelta(days=1)) -> int:
        """Removes versions that no record names and that weren't written within ``grace``; returns how many.

        Reads that began before a run was stored again, and writes that aren't committed yet, need their
        files that long.
        """
        live = {tuple(r) for r in self.commits().where(F.col("version").isNotNull()).select("dataset_name", "run_id", "kind", "version").collect()}  # a row for each run
        kept = {f"{n}/{self._part('dataset_name', d)}/{self._part('run_id', r)}/version={v}" for d, r, k, v in live for n in KINDS[k]}
        oldest, gone = dt.datetime.now().timestamp() - grace.total_seconds(), 0
        for name in TABLES:
            fs, where = _fs(self.spark, f"{self._path(name)}/dataset_name=*/run_id=*/version=*")
            for s in fs.globStatus(where) or []:
                path = s.getPath()
                parts = path.toString().rsplit("/", 4)
                if "/".join(parts[1:]) not in kept and s.getModificationTime() / 1000 <= oldest:
                    gone += bool(fs.delete(path, True))
        return gone


def _fields(schema: str) -> list[str]:
    """The fields of a DDL schema; commas inside of types don't part them."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return [*out, schema[start:].strip()]
