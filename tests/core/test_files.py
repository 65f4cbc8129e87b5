"""Places of rows, and CSV files read in parts."""

import random

import pytest
from pyspark.sql import functions as F

from assayer.operators import accept
from assayer.sources import csv_records, files, scratch
from assayer.sources.files import ROW


def wide(spark, n=300_000):
    return spark.range(0, n, 1, 12).select("id", F.sha2(F.col("id").cast("string"), 256).alias("k"), F.repeat(F.col("id").cast("string"), 5).alias("w"))


@pytest.fixture
def adaptive(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def whole(df, n):
    r = df.agg(F.count("*").alias("n"), F.min(ROW).alias("a"), F.max(ROW).alias("b"), F.count_distinct(ROW).alias("d")).first()
    return tuple(r) == (n, 0, n - 1, n)


def test_no_row_is_lost_however_the_plan_is_adapted(spark, adaptive):
    df, n = wide(spark), 300_000
    by_key = files.with_row_index(df, ["k"])
    assert whole(by_key, n)
    step = by_key.selectExpr("k", f"lead(k) OVER (ORDER BY {ROW}) AS after").where("after < k").count()
    assert step == 0
    assert whole(files.with_row_index(df.repartition("k")), n)
    assert whole(files.with_row_index(df.groupBy("k").agg(F.max("w").alias("w"))), n)
    assert whole(files.with_row_index(df.join(df.select("id"), "id")), n)
    plain = files.with_row_index(df)
    assert plain.where(F.col("id") != F.col(ROW)).count() == 0 and whole(plain, n)
    some = files.with_row_index(df, ["k"]).select(ROW)  # fewer columns, the same rows
    assert whole(some, n)


def test_rows_of_nothing_and_of_stored_files(spark, tmp_path):
    assert files.with_row_index(spark.range(0)).count() == 0
    spark.range(0, 5000, 1, 7).write.parquet(f"{tmp_path}/a.parquet")
    got = files.load_dataset(spark, f"{tmp_path}/a.parquet", focused_only=False)
    assert got.where(F.col("id").cast("long") != F.col(ROW)).count() == 0 and whole(got, 5000)
    late = got.where("id >= '4990'")  # places are those of the file, whatever is filtered
    assert late.where(F.col("id").cast("long") != F.col(ROW)).count() == 0


def test_places_over_several_csv_files(spark, tmp_path):
    d = tmp_path / "many.csv"
    d.mkdir()
    n = 0
    for f, rows in (("a", 3000), ("b", 10), ("c", 700)):
        (d / f"{f}.csv").write_text("k,v\n" + "".join(f"{n + i},{'x' * 20}\n" for i in range(rows)))
        n += rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")
    try:
        got = files.load_dataset(spark, str(d), focused_only=False)
        assert whole(got, n) and got.where(F.col("k").cast("long") != F.col(ROW)).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


VALUES = ["", "a", "two words", 'say "hi"', "line\nline", "x\n\n\ny", "a,b", '"', '""', "\n", "é", ",\n,", "z" * 50]


def quoted(v, rng):
    return '"' + v.replace('"', '""') + '"' if rng.random() < 0.3 or any(c in v for c in '",\n') else v


def odd_csv(rows, seed, end="\n", long_value=0):
    rng = random.Random(seed)
    out = ['k,"na\nme",c' if end == "\n" else "k,name,c"]
    for i in range(rows):
        values = [str(i), quoted(rng.choice(VALUES), rng), quoted(rng.choice(VALUES) if not long_value or i % 500 else "L\n" * long_value, rng)]
        if rng.random() < 0.05:
            values[1] = '5" pipe'  # not quoted, so its quote is a character
        if rng.random() < 0.03:
            values[2] = '"closed"and more'
        out.append(",".join(values))
    return end.join(out) + (end if seed % 2 else "")


@pytest.mark.parametrize("seed,end,long_value,encoding", [(1, "\n", 0, "utf-8"), (2, "\r\n", 0, "utf-8"), (3, "\n", 3000, "utf-8"), (4, "\n", 0, "latin-1")])
def test_csv_with_line_ends_in_values_is_read_in_parts(spark, tmp_path, seed, end, long_value, encoding):
    path = tmp_path / "q.csv"
    path.write_bytes(odd_csv(2000, seed, end, long_value).encode(encoding))
    code = "ISO-8859-1" if encoding == "latin-1" else "UTF-8"
    one = spark.read.csv(str(path), header=True, quote='"', escape='"', multiLine=True, encoding=code)
    want = [tuple(r) for r in one.collect()]
    assert len(want) == 2000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.load_dataset(spark, str(path), focused_only=False)
        rows = got.orderBy(ROW).collect()
        assert [tuple(r)[:-1] for r in rows] == want and [r[ROW] for r in rows] == list(range(2000))
        text = csv_records.lines(spark, str(path))
        assert text.rdd.getNumPartitions() > 4 and text.select(csv_records.BLOCK).distinct().count() > 4
        by_shuffle = csv_records.records(text, csv_records.states(text), sent=0)
        assert by_shuffle.count() == csv_records.records(text, csv_records.states(text)).count() >= 2001
        assert sorted(map(str, files.read_csv(spark, str(path)).collect())) == sorted(map(str, one.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_plain_csv_stays_plain(spark, tmp_path):
    (tmp_path / "p.csv").write_text('a,b\n1,"x, y"\n2,5" pipe\n3,""\n')
    df = files.read_csv(spark, str(tmp_path / "p.csv"))
    assert "MapInArrow" not in df._jdf.queryExecution().toString()
    assert [tuple(r) for r in df.collect()] == [tuple(r) for r in spark.read.csv(str(tmp_path / "p.csv"), header=True, quote='"', escape='"', multiLine=True).collect()]
    known = files.read_csv(spark, str(tmp_path / "p.csv"), "UTF-8", False)
    assert known.collect() == df.collect()


def test_another_header_is_an_error(spark, tmp_path):
    d = tmp_path / "h.csv"
    d.mkdir()
    (d / "a.csv").write_text('a,b\n1,"x\ny"\n')
    (d / "b.csv").write_text('b,a\n1,"x\ny"\n')
    with pytest.raises(Exception, match="another header"):
        files.read_csv(spark, str(d)).collect()


def test_scratch_is_released(spark):
    df = scratch.cut(spark.range(3), "gone")
    path = df.inputFiles()[0].rsplit("/", 1)[0]
    assert files.exists(spark, path)
    scratch.release(*[p for p in list(scratch._made) if p.split(":")[-1].lstrip("/") == path.split(":")[-1].lstrip("/")])
    assert not files.exists(spark, path)


def test_accepted_repairs_leave_other_partitions_alone(spark, tmp_path, monkeypatch):
    path = tmp_path / "t.parquet"
    df = spark.range(0, 9_000, 1, 6).selectExpr("id", "CAST(id AS STRING) AS v", "IF(id % 4 = 3, NULL, CONCAT('p/', id % 4)) AS p", "CAST(id AS INT) AS n")
    df.write.partitionBy("p").parquet(str(path))
    loaded = files.load_dataset(spark, str(path), focused_only=False)
    before = {r[ROW]: (int(r.id), r.v, r.p, int(r.n)) for r in loaded.collect()}
    by_id = {x[0]: i for i, x in before.items()}
    picked = [i for i in range(0, 9_000) if i % 4 in (1, 3) and i % 7 == 0]
    cells = [(by_id[i], "v", f"new {i}", 1) for i in picked] + [(by_id[i], "v", "older", 0) for i in picked] + [(by_id[picked[0]], "n", "-5", 0), (by_id[2], "v", None, 0)]
    audit = f"{ROW} long, column string, recommended_value string, seq int"
    kept = {f.name for d in ("p=p%2F0", "p=p%2F2") for f in (path / d).glob("*.parquet")}
    for sent in (50_000, 1):
        monkeypatch.setattr(accept, "CHANGES_SENT", sent)
        done = accept.apply(spark, str(path), spark.createDataFrame(cells, audit).repartition(3), ["p"])
        assert (done.cells, done.rows, done.partitions) == (len(picked) + 1, len(picked), 2)
        assert {f.name for d in ("p=p%2F0", "p=p%2F2") for f in (path / d).glob("*.parquet")} == kept
        after = {r[ROW]: (int(r.id), r.v, r.p, int(r.n)) for r in files.load_dataset(spark, str(path), focused_only=False).collect()}
        want = {i: (x[0], f"new {x[0]}" if x[0] in set(picked) else x[1], x[2], -5 if x[0] == picked[0] else x[3]) for i, x in before.items()}
        assert after == want  # the full rewrite, every row in its place
    none = accept.apply(spark, str(path), spark.createDataFrame(cells[:0], audit), ["p"])
    assert none.cells == 0 == none.partitions
    for bad in ([(0, "p", "x", 0)], [(0, "absent", "x", 0)], [(9_000, "v", "x", 0)]):
        with pytest.raises(ValueError):
            accept.apply(spark, str(path), spark.createDataFrame(bad, audit), ["p"])
