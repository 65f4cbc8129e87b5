"""Commit records of the history, and profiles that are merged."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assayer.functions.rules import Rule
from assayer.operators import issues, partial, profile, reports
from assayer.sources import history
from assayer.sources.files import ROW
from assayer.sources.history import History

AT = dt.datetime(2024, 6, 30, 12)
NPI = Rule("NPI", "NPI", "regex", {"pattern": r"^\d{10}$"})
NAMES = ["a:b", "x/y", "50%", "plain", "a=b #?", "é"]


def stored(spark, h, dataset, run="r", values=("1234567890", "x", None), at=AT):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{ROW} long, NPI string")
    p = profile.profile(df, {"NPI": NPI}, as_of=AT.date(), dataset_name=dataset)
    h.store(p, issues.detect(p, {"NPI": NPI}), at=at, dataset_name=dataset, run_id=run)


def anomalies(spark):
    return spark.createDataFrame([("NPI", "conformity", 1.0)], "column_name string, metric string, current_value double")


def test_names_that_paths_escape(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"), retention_days=None)
    for n in NAMES:
        h.store_anomalies(anomalies(spark), dataset_name=n, run_id="r:1/2", at=AT)
    for n in NAMES:
        assert h.clear_anomalies(n, dry_run=True) == 1 == h.clear_anomalies(n) and h.clear_anomalies(n) == 0
    assert h.table("anomalies").count() == 0 and not list((tmp_path / "h" / "anomalies").rglob("*.parquet"))
    with pytest.raises(ValueError):
        h.store_anomalies(anomalies(spark), dataset_name="", run_id="r", at=AT)


def test_datasets_with_equal_run_ids(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    stored(spark, h, "a:b")
    stored(spark, h, "50%", values=("1234567890",))
    with pytest.raises(ValueError, match="several datasets"):
        h.profile_of("r")
    assert h.profile_of("r", "a:b")[0].first().total_rows == 3 and h.profile_of("r", "50%")[0].first().total_rows == 1
    with pytest.raises(ValueError):
        h.delete_run("r", dry_run=True)
    assert h.delete_run("r", dataset="a:b")["profiling_runs"] == 1
    assert [r.dataset_name for r in h.table("profiling_runs").collect()] == ["50%"]
    assert h.expire(AT + dt.timedelta(days=400)) == ["r"] and h.table("column_metrics").count() == 0
    assert h.delete_run("none") == {"anomalies": 0, "issues": 0, "column_metrics": 0, "profiling_runs": 0}


def test_a_run_stored_again_is_seen_whole(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"), retention_days=None)
    stored(spark, h, "d")
    reading = {t: h.table(t) for t in ("column_metrics", "issues", "profiling_runs")}
    before = {t: sorted(map(str, df.collect())) for t, df in reading.items()}
    put = h._put

    def broken(name, rows, dataset, run_id, version):
        if name == "profiling_runs":
            raise OSError("disk full")
        put(name, rows, dataset, run_id, version)

    h._put = broken
    with pytest.raises(OSError):
        stored(spark, h, "d", values=("1234567890",))
    h._put = put
    assert {t: sorted(map(str, h.table(t).collect())) for t in reading} == before  # nothing of the broken write
    stored(spark, h, "d", values=("1234567890",))
    assert {t: sorted(map(str, df.collect())) for t, df in reading.items()} == before  # what was opened before stays
    assert h.table("profiling_runs").first().total_rows == 1 and h.table("column_metrics").first().total_count == 1
    assert h.vacuum() == 0  # all of it is young
    assert h.vacuum(dt.timedelta(0)) > 0 and h.vacuum(dt.timedelta(0)) == 0
    assert h.table("profiling_runs").first().total_rows == 1 == h.table("column_metrics").count()


def test_a_broken_delete_is_resumed(spark, tmp_path, monkeypatch):
    h = History(spark, str(tmp_path / "h"), retention_days=None)
    stored(spark, h, "a:b")
    stored(spark, h, "kept")

    def fails(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(history, "_fs", fails)
        m.setattr(History, "table", lambda self, name, dataset=None, t=History.table: self._rows(name) if dataset is None else t(self, name, dataset))
        with pytest.raises(OSError):
            h._delete([("a:b", "r", "run")])
    assert [r.dataset_name for r in h.table("profiling_runs").collect()] == ["kept"] and h.table("column_metrics", "a:b").isEmpty()
    assert len(list((tmp_path / "h" / "profiling_runs").iterdir())) >= 2
    assert h.vacuum(dt.timedelta(0)) == 3 and h.table("issues").select("dataset_name").distinct().count() == 1


def test_states_of_parts_merge_to_the_whole(spark, tmp_path):
    rows = spark.range(0, 30_000, 1, 5).select(
        F.col("id").alias(ROW), F.when(F.col("id") % 3 == 0, F.concat(F.lit("1"), F.lpad(F.col("id").cast("string"), 9, "0"))).when(F.col("id") % 3 == 1, "").otherwise("bad").alias("NPI"),
        F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 40).cast("string")).alias("few"), F.sha2(F.col("id").cast("string"), 256).alias("many"), F.lit(None).cast("string").alias("none"),
    )
    whole = profile.profile(rows, {"NPI": NPI}, as_of=AT.date())
    rows.where(f"{ROW} < 10000").drop(ROW).write.parquet(str(tmp_path / "d é 50%"))
    h = History(spark, str(tmp_path / "h"))
    first = partial.profile_new(spark, h, str(tmp_path / "d é 50%"), {"NPI": NPI}, dataset_name="a/b", run_id="1", as_of=AT.date())
    assert {r.total_count for r in first.collect()} == {10_000}
    rows.where(f"{ROW} >= 10000").drop(ROW).write.mode("append").parquet(str(tmp_path / "d é 50%"))
    read = []
    real = partial.states
    partial.states = lambda df, *a, **k: read.append(df.count()) or real(df, *a, **k)
    try:
        merged = partial.profile_new(spark, h, str(tmp_path / "d é 50%"), {"NPI": NPI}, dataset_name="a/b", run_id="2", as_of=AT.date())
    finally:
        partial.states = real
    assert read == [20_000]  # only what is new
    got, want = ({r.column_name: r.asDict() for r in df.collect()} for df in (partial.metrics(merged), whole.metrics))
    about = {"unique_count", "duplicate_count", "uniqueness_score"}
    for c in want:
        assert {k: v for k, v in got[c].items() if k not in about} == pytest.approx({k: v for k, v in want[c].items() if k not in about}), c
        assert abs(got[c]["unique_count"] - want[c]["unique_count"]) <= 0.03 * want[c]["unique_count"]
    assert got["few"]["unique_count"] == 40 and got["none"]["unique_count"] == 0
    tops = lambda df: sorted((r.column_name, r.value, r.n, r["rank"]) for r in df.where("column_name IN ('few')").collect())
    assert tops(partial.top_values(merged)) == tops(whole.top_values)
    few = partial.merge(partial.states(rows, {}, columns=["few"], items=60, lg=10), items=60)
    assert tops(partial.top_values(few, items=60)) == tops(whole.top_values) and partial.metrics(few).first().unique_count == 40
    assert partial.profile_new(spark, h, str(tmp_path / "d é 50%"), {"NPI": NPI}, dataset_name="a/b", run_id="3").count() == 4  # nothing new to read
    assert partial.states(rows.limit(0), {}, source=F.col("few")).count() == 0 and partial.merge(partial.states(rows.limit(0), {})).count() in (0, 4)


def test_median_of_ranges(spark):
    values = [0, 5, 5, 5, -3, 10**15, 7, 2**62, -(2**62), 6, 6, 100]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "total_rows long").repartition(4)
    assert [reports.nth_smallest(df, "total_rows", n, 4) for n in range(len(values))] == sorted(values)
    assert reports.nth_smallest(df, "total_rows", len(values)) is None and reports.nth_smallest(df, "total_rows", -1) is None
    plan = reports.outlier_runs(spark.createDataFrame([(3,), (4,), (100,)], "total_rows long"))
    assert "Window" not in plan._jdf.queryExecution().toString() and [r.total_rows for r in plan.collect()] == [100]
