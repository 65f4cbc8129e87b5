import datetime as dt
import subprocess
import sys
from pathlib import Path

import pytest

import assayer.__main__ as cli
from assayer.plans import service
from assayer.sources.history import History

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("NPI,Entity Type Code,other\n1234567890,1,a\n12-34567890,2.0,b\nbad,,c\n")
    return str(path)


def test_commands(spark, csv, tmp_path):
    h = str(tmp_path / "h")
    first = cli.main(["run", "--dataset", csv, "--history", h, "--output-file", str(tmp_path / "o.csv")])
    assert first["dataset"]["total_rows"] == 3 and first["results"] and first["anomalies"] == []
    quiet = cli.main(["run", "--dataset", csv, "--skip-anomaly-detection", "--skip-executor"])
    assert "results" not in quiet and "anomalies" not in quiet
    report = cli.main(["report", "--history", h])
    assert report["statistics"]["run_count"] == 1 and len(report["runs"]) == 1
    assert cli.main(["outliers", "--history", h, "--delete"])["deleted"] == []
    assert cli.main(["clear-anomalies", "--history", h, "--dry-run"])["anomalies"] == 0
    assert cli.main(["delete-run", "--history", h, "--run-id", report["runs"][0]["run_id"]])["profiling_runs"] == 1
    cli.main(["sample", "--dataset", csv, "--rows", "2", "--output-file", str(tmp_path / "s.parquet")])
    assert spark.read.parquet(str(tmp_path / "s.parquet")).count() == 2


def test_service(spark, csv, tmp_path):
    day = dt.date(2024, 6, 30)
    found = service.profile_file(spark, csv, day=day)
    assert found["dataset"]["total_rows"] == 3 and found["issues"]
    advice = service.recommendations_of(spark, csv, day=day)
    assert advice["total"] == len(advice["recommendations"])
    done = service.apply_fixes(spark, csv, str(tmp_path / "o.csv"), advice["recommendations"], day=day)
    assert len(done["preview"]) == 3 and any(r["rows_fixed"] for r in done["results"])
    with pytest.raises(LookupError):
        service.anomalies_of(spark, History(spark, str(tmp_path / "h")), "d")


def test_entry_without_the_other_part(tmp_path):
    """Without the folders for training data the entry imports and gives its own queries."""
    import shutil

    shutil.copytree(ROOT / "assayer", tmp_path / "assayer", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and not any(n.startswith('op1') for n in q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert "fine" in out.stdout, out.stderr


def test_downloads_have_one_header(spark, tmp_path):
    from assayer.sources import files

    path = str(tmp_path / "o.csv")
    df = spark.range(0, 300, 1, 4).selectExpr("id", "CONCAT('line\n', id, '\"') AS `odd\nname`")
    files.save_dataset(df, path)
    for size in (7, 64, 1 << 20):
        (tmp_path / "got.csv").write_bytes(b"".join(service.download(spark, path) if size == 1 << 20 else files.chunks(spark, path, size)))
        got = spark.read.csv(str(tmp_path / "got.csv"), header=True, escape='"', multiLine=True)
        assert got.columns == ["id", "odd\nname"] and sorted(int(r[0]) for r in got.collect()) == list(range(300))
    one = files.save_dataset(df.limit(3), str(tmp_path / "one.csv"), single_file=True)
    assert b"".join(service.download(spark, one)) == (tmp_path / "one.csv").read_bytes()
    with pytest.raises(FileNotFoundError):
        next(service.download(spark, str(tmp_path / "none.csv")))


def test_throughput_by_rule_type(spark):
    from assayer.functions.rules import Rule
    from assayer.operators import validate

    df = spark.createDataFrame([("1", "a", "b")] * 10, "x string, y string, z string")
    rules = {"x": Rule("1", "x", "numeric"), "y": Rule("2", "y", "regex", {"pattern": "a"}), "z": Rule("3", "z", "regex", {"pattern": "a"})}
    got = {r.rule_type: r for r in validate.throughput(df, rules).collect()}
    assert (got["regex"].n_columns, got["regex"]["values"], got["numeric"]["values"]) == (2, 20, 10) and got["regex"].values_per_second > 0
    assert validate.throughput(df, {}).isEmpty() and validate.throughput(df.limit(0), rules).count() == 2
