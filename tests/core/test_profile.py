import datetime as dt

import pytest
from pyspark.sql import functions as F

from assayer.functions.rules import ENTITY_TYPE, NAME_COLUMNS, Rule
from assayer.operators import anomaly, issues, profile, recommend, repair, reports, validate
from assayer.plans import pipeline
from assayer.sources import files
from assayer.sources.catalog import provider_rules
from assayer.sources.files import ROW
from assayer.sources.history import History

RULES = provider_rules()
AT = dt.datetime(2024, 6, 30, 12)


def frame(spark, **columns):
    n = len(next(iter(columns.values())))
    rows = [(i, *[None if c[i] is None else str(c[i]) for c in columns.values()]) for i in range(n)]
    return spark.createDataFrame(rows, ", ".join([f"{ROW} long", *[f"`{c}` string" for c in columns]]))


def metrics(df, rules=RULES):
    return {r.column_name: r for r in profile.metrics(df, rules, as_of=AT.date()).collect()}


def test_completeness_and_uniqueness(spark):
    m = metrics(frame(spark, NPI=[1, 2, None, 4, None]))
    assert m["NPI"].completeness_score == 60.0
    m = metrics(frame(spark, NPI=[1, 2, 2, 3, 3]))["NPI"]
    assert (m.unique_count, m.duplicate_count, m.uniqueness_score) == (3, 2, 60.0)


def test_conditional_completeness(spark):
    last, first, org = NAME_COLUMNS
    df = frame(spark, **{ENTITY_TYPE: ["1"] * 5, last: ["a", "b", "c", None, "n/a"], org: [None] * 4 + ["x"]})
    m = metrics(df)
    assert m[last].completeness_score == 60.0 and m[org].completeness_score == 100.0
    df = frame(spark, **{ENTITY_TYPE: ["1", "1.9", "2", "3", None], org: [None, None, None, "x", "x"]})
    got = profile.conditional_counts(df).first()
    assert (got.n_valid, got.n_individual, got.n_organization, got.n_invalid) == (2, 0, 1, 2)


def test_conformity_lengths_top(spark):
    m = metrics(frame(spark, NPI=["1234567890", "x", "12", None]))["NPI"]
    assert round(m.conformity_score, 2) == 33.33 and m.non_conforming_count == 2
    m = metrics(frame(spark, other=["a", "b", None]))["other"]
    assert m.conformity_score == 100.0 and m.uniqueness_score is None
    m = metrics(frame(spark, t=["a", "abc", "abcde", None]))["t"]
    assert (m.min_length, m.max_length, m.avg_length) == (1, 5, 3.0)
    top = profile.top_values(profile.histogram(frame(spark, t=["A", "B", "A", "C", "A", "B", None]))).collect()
    assert [(r.value, r.n) for r in sorted(top, key=lambda r: r["rank"])] == [("A", 3), ("B", 2), ("C", 1)]


def test_empty_dataset(spark):
    p = profile.profile(frame(spark, NPI=["1"], **{ENTITY_TYPE: ["1"]}).limit(0), RULES, as_of=AT.date())
    one = p.dataset.first()
    assert one.total_rows == 0 and one.overall_completeness == 0 and one.overall_uniqueness == 100.0
    assert p.violations.count() == 0


def test_issues(spark):
    last, first, org = NAME_COLUMNS
    df = frame(spark, NPI=["1234567890", "1234567890", "bad"], **{ENTITY_TYPE: ["1", "2", None], last: [None, "x", "y"], org: ["a", None, None]})
    found = {(r.column_name, r.issue_type, r.rule_violated): r for r in issues.detect(profile.profile(df, RULES, as_of=AT.date()), RULES).collect()}
    assert found["NPI", "uniqueness", "NPI_UNIQUE"]["count"] == 1
    assert found["NPI", "conformity", "NPI_FORMAT"].examples == ["bad"]
    assert found[last, "completeness", f"{last}_REQUIRED_FOR_INDIVIDUAL"]["count"] == 1
    assert found[org, "completeness", f"{org}_REQUIRED_FOR_ORGANIZATION"]["count"] == 1
    assert found[ENTITY_TYPE, "completeness", f"{ENTITY_TYPE}_REQUIRED"]["count"] == 1
    empty = frame(spark, NPI=[None, None, None, None, "1234567890"])
    kinds = {r.column_name for r in issues.detect(profile.profile(empty, RULES, as_of=AT.date()), RULES).collect()}
    assert "__DATASET__" in kinds


def test_counts_add_up_whatever_the_partitions(spark):
    df = frame(spark, NPI=[str(10**9 + i) if i % 3 else "n/a" for i in range(50)])
    for parts in (1, 7):
        m = metrics(df.repartition(parts))["NPI"]
        assert m.non_null_count + m.null_count == m.total_count == 50
        assert m.conforming_count + m.non_conforming_count == m.non_null_count


def test_validation(spark):
    v = validate.validate_dataset(frame(spark, NPI=["1234567890", "x", None], t=["a", None, "-"]), RULES)
    got = {r.column_name: r for r in v.collect()}
    assert got["NPI"].conformity_rate == 50.0 and got["NPI"].samples == ["x"] and got["t"].rule_type == "N/A"
    assert validate.overall(v).first().total_violations == 1
    assert validate.validate_column(frame(spark, t=[None]), "t", None).first().conformity_score == 100.0


def history(spark, values, metric="completeness"):
    rows = [("d", "NPI", metric, dt.datetime(2024, 1, 1 + i), f"r{i}", v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset_name string, column_name string, metric string, profiling_timestamp timestamp, run_id string, value double")


def now(spark, value, metric="completeness"):
    return spark.createDataFrame([("d", "NPI", metric, value)], "dataset_name string, column_name string, metric string, value double")


def test_anomalies(spark):
    s = anomaly.Settings(z_limit=2.0)
    hit = anomaly.detect(now(spark, 70.0), history(spark, [96.0, 95.5, 97.0, 95.8]), s).collect()
    assert len(hit) == 1 and hit[0].severity == "high" and hit[0].delta < -25
    assert anomaly.detect(now(spark, 60.0), history(spark, [90.0, 91.0]), s).isEmpty()
    assert anomaly.detect(now(spark, 96.1), history(spark, [96.1] * 3), s).isEmpty()  # equal values: no difference, whatever sums say
    flat = anomaly.detect(now(spark, 96.0), history(spark, [96.1] * 7), s).first()
    assert flat.z_score == float("inf") and flat.severity == "high"
    assert anomaly.detect(now(spark, 100.0), history(spark, [50.0, 51.0, 52.0]), s).isEmpty()
    assert anomaly.detect(now(spark, 100.0), history(spark, [50.0, 51.0, 52.0]), anomaly.Settings(degradations_only=False)).count() == 1
    assert anomaly.detect_all(history(spark, [96.0, 95.5, 97.0, 95.8, 70.0]), s).collect()[0].run_id == "r4"


def test_history_round_trip(spark, tmp_path):
    h = History(spark, str(tmp_path / "h"))
    df = frame(spark, NPI=["1234567890", "x", None])
    p = profile.profile(df, RULES, as_of=AT.date(), dataset_name="d")
    seen = issues.detect(p, RULES)
    for day in range(3):
        h.store(p, seen, at=AT + dt.timedelta(days=day), run_id=f"r{day}")
    h.store(p, seen, at=AT, run_id="r0")  # again: replaced, not doubled
    assert h.table("column_metrics").count() == 3 and h.latest_run("d") == "r2"
    run, m = h.profile_of("r1")
    assert run.first().total_rows == 3 and m.first().conforming_count == 1 and m.first().conformity_violations == ["x"]
    assert h.column_history("d", "NPI", "conformity", exclude_run="r2").count() == 2
    with pytest.raises(ValueError):
        h.column_history("d", "NPI", "other")
    assert h.delete_run("r1", dry_run=True)["column_metrics"] == 1 and h.delete_run("r1")["profiling_runs"] == 1
    assert h.table("column_metrics").count() == 2
    assert h.expire(AT + dt.timedelta(days=400)) and h.table("profiling_runs").count() == 0
    assert h.clear_anomalies() == 0


def test_recommendations(spark):
    place = "Provider Business Mailing Address"
    cols = {"NPI": ["12-34567890", "12345678901", "x", "1234567890"], f"{place} State Name": ["NY", "CA", None, "TX"], f"{place} Country Code (If outside U.S.)": ["US", None, None, None], ENTITY_TYPE: ["1", "1", None, None], NAME_COLUMNS[0]: ["a", None, None, None], NAME_COLUMNS[1]: [None, None, None, None], NAME_COLUMNS[2]: [None, None, "org", None]}
    df = frame(spark, **cols)
    p = profile.profile(df, RULES, as_of=AT.date())
    got = {(r.column_name, r.issue_type): r for r in recommend.recommend(issues.detect(p, RULES), p.metrics, RULES, df).collect()}
    npi = got["NPI", "conformity"]
    assert npi.confidence_score == 0.85 and npi.actionable and "3 violations" in npi.rationale and "2 of them" in npi.rationale
    assert got[f"{place} Country Code (If outside U.S.)", "completeness"].suggested_value == "US"
    assert got[f"{place} State Name", "completeness"].confidence_score == 0.6
    et = got[ENTITY_TYPE, "completeness"]
    assert round(et.confidence_score, 4) == round(0.85 / 2, 4) and et.actionable
    assert got[NAME_COLUMNS[0], "completeness"].fix_strategy == "conditional_imputation"
    assert recommend.summary(recommend.recommend(issues.detect(p, RULES), p.metrics, RULES, df)).first().total == len(got)


def test_repair_keeps_originals_and_holds_its_rules(spark):
    place = "Provider Business Mailing Address"
    df = frame(spark, NPI=["12-34567890", "abc", "1234567890", None], **{f"{place} State Name": ["new york", "Ontario", "QQ", "TX"], f"{place} Country Code (If outside U.S.)": ["US", "CA", "US", None], NAME_COLUMNS[0]: ["Smith, MD", "Jones", None, "X9"]})
    recs = [repair.Recommendation(c, "conformity", "format_correction", 0.9) for c in ("NPI", f"{place} State Name", NAME_COLUMNS[0])] + [repair.Recommendation("Gone", "conformity", "format_correction")]
    states = spark.createDataFrame([("ONTARIO", "CA")], "state string, country string")
    out = repair.repair(df, recs, RULES, maps=repair.Maps(states=states), as_of=AT.date())
    rows = {r[ROW]: r for r in out.table.collect()}
    assert [rows[i]["NPI__auto_fixed"] for i in range(4)] == ["1234567890", None, None, None]
    assert rows[0]["NPI"] == "12-34567890" and rows[0]["NPI__fix_applied"] and not rows[1]["NPI__fix_applied"]
    assert rows[0][f"{place} State Name__auto_fixed"] == "NY" and rows[0]["Provider Medical Title/Degree"] == "MD"
    side = {(r[ROW], r["column"]): (r.recommended_value, r.reason) for r in out.sidecar.collect()}
    assert side[1, f"{place} State Name"] == ("Ontario", "foreign state name")
    assert side[2, f"{place} State Name"][1].startswith("State column") and side[1, "NPI"] == (None, "Need Review")
    assert side[0, NAME_COLUMNS[0]] == ("Smith", "Split medical degree/title: MD")
    after = validate.scores(repair.effective(out.table, ["NPI"]), RULES, {"NPI": "NPI"}).first()
    assert round(after.conformity, 2) == 66.67
    quiet = repair.repair(df, recs[:1], RULES, as_of=AT.date(), recommendations_only=True)
    assert "NPI__auto_fixed" not in quiet.table.columns and quiet.sidecar.count() == 2


def test_context_imputation(spark):
    place = "Provider Business Mailing Address"
    cols = {f"Provider First Line Business Mailing Address": ["1 Main St, Boston", None, None], "Provider Second Line Business Mailing Address": [None] * 3, f"{place} City Name": [None, "Boston", None], f"{place} State Name": [None, None, None], f"{place} Postal Code": ["x", None, "90210"], f"{place} Country Code (If outside U.S.)": ["US"] * 3}
    recs = [repair.Recommendation(f"{place} {c} Name", "completeness", "context_imputation", 0.8, True) for c in ("City", "State")]
    cities = spark.createDataFrame([("BOSTON", "MA")], "city string, state string")
    postal = spark.createDataFrame([("90210", "CA"), ("902", "CA")], "code string, state string")
    out = repair.repair(frame(spark, **cols), recs, RULES, maps=repair.Maps(cities=cities, postal=postal))
    side = {(r[ROW], r["column"].split()[-2]): r.recommended_value for r in out.sidecar.collect()}
    assert side == {(0, "City"): "BOSTON", (2, "City"): None, (0, "State"): None, (1, "State"): "MA", (2, "State"): "CA"}


@pytest.mark.parametrize("others", [0, 10_001])
def test_city_agrees_with_state_whatever_the_size_of_the_map(spark, others):
    place = "Provider Business Mailing Address"
    lines = ["Springfield Gardens, Boston, Salem", "Springfield Gardens, Salem, Boston", "Springfield Gardens, Boston", "Springfield Gardens, Boston", "Boston", "Springfield Gardens, Boston", None]
    cols = {"Provider First Line Business Mailing Address": lines, f"{place} City Name": [None] * 5 + ["Given", None], f"{place} State Name": ["ma", " MA ", "TX", None, "TX", "MA", "MA"]}
    cities = spark.createDataFrame([("BOSTON", "MA"), ("SALEM", "MA"), *((f"TOWN {i}", "MA") for i in range(others))], "city string, state string")
    rec = repair.Recommendation(f"{place} City Name", "completeness", "context_imputation", 0.8, True)
    out = repair.repair(frame(spark, **cols), [rec], RULES, maps=repair.Maps(cities=cities))
    got = {r[ROW]: r[f"{place} City Name__auto_fixed"] for r in out.table.collect()}
    assert got == {0: "BOSTON", 1: "SALEM", 2: "SPRINGFIELD GARDENS", 3: "SPRINGFIELD GARDENS", 4: "BOSTON", 5: None, 6: None}
    assert {r[ROW]: r.recommended_value for r in out.sidecar.collect()} == {i: x for i, x in got.items() if i != 5}


def test_reports(spark):
    runs = spark.createDataFrame([("d", f"r{i}", n) for i, n in enumerate([1, 2, 3, 7])], "dataset_name string, run_id string, total_rows long")
    assert [r.run_id for r in reports.outlier_runs(runs).collect()] == ["r3"]  # upper median 3
    assert reports.outlier_runs(runs.limit(1)).isEmpty()
    assert reports.earlier_runs(runs, "d").first().history_size == 3
    m = profile.metrics(frame(spark, NPI=["1234567890", None], t=["a", "b"]), RULES)
    assert reports.column_details(m).count() == 2 and reports.as_json(m).count() == 2
    assert reports.validation_details(validate.validate_dataset(frame(spark, NPI=["x", "y"]), RULES)).first().samples == "x; y"


def test_whole_chain(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    (tmp_path / "in.csv").write_text('NPI,Entity Type Code,other\n1234567890,1,a\n"12-34567890",2.0,b\nbad,,c\n', encoding="utf-8")
    out = pipeline.run_file(spark, path, at=AT, history_root=str(tmp_path / "h"), output=str(tmp_path / "out.csv"))
    assert out.comparison.where("column_name = 'NPI'").first().conformity_gain > 30
    assert out.anomalies.isEmpty() and out.run_id
    assert spark.read.csv(str(tmp_path / "out_fix_recommendations.csv"), header=True).count() >= 2


def test_files(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("NPI,name\n1,Jos\xe9\n2,\"a\nb\"\n".encode("latin-1"))
    df = files.load_dataset(spark, str(tmp_path / "l.csv"), focused_only=False)
    assert [tuple(r) for r in df.orderBy(ROW).collect()] == [("1", "José", 0), ("2", "a\nb", 1)]
    with pytest.raises(FileNotFoundError):
        files.load_dataset(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.txt").write_text("")
    with pytest.raises(ValueError):
        files.load_dataset(spark, str(tmp_path / "x.txt"))
    big = spark.range(100, numPartitions=7).withColumn("NPI", F.col("id").cast("string"))
    rows = files.with_row_index(big).collect()
    assert sorted(r[ROW] for r in rows) == list(range(100)) and all(r[ROW] == r.id for r in rows)
    assert [r.id for r in files.with_row_index(big, ["NPI"]).orderBy(ROW).limit(3).collect()] == [0, 1, 10]
    one = files.save_dataset(big, str(tmp_path / "one.csv"), single_file=True)
    assert (tmp_path / "one.csv").is_file() and files.file_size_mb(spark, one) > 0
    assert files.sample(big, 10, key="id").collect() == files.sample(big.repartition(3), 10, key="id").collect()
    assert files.backup(one, AT).endswith("one_backup_20240630_120000.csv")


def test_stream_profiles_each_batch(spark, tmp_path):
    from assayer.streaming import quality

    frame(spark, NPI=["1234567890", "x"]).drop(ROW).write.parquet(str(tmp_path / "in"))
    h = History(spark, str(tmp_path / "h"), retention_days=None)
    stream = spark.readStream.schema("NPI string").parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(quality.profile_batches(h, {"NPI": RULES["NPI"]}, dataset_name="s", clock=lambda: AT)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert h.table("column_metrics").first().conformity_score == 50.0
