"""Near-unique columns by digests, and state across micro-batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from assayer.functions.rules import Rule
from assayer.operators import profile, wide
from assayer.sources.files import ROW
from assayer.streaming import quality

RULE = {"w1": Rule("W", "w1", "regex", {"pattern": "^[0-9a-f]+$"})}


def shuffled(spark, run):
    """Bytes that the stages of ``run`` wrote to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        seq = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (seq.apply(i) for i in range(seq.size()))}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


def rows(spark, n=12_000):
    h = lambda i: F.sha2(F.concat(F.lit(f"{i}:"), F.col("id").cast("string")), 256)
    many = [F.concat(*[h(i * 10 + j) for j in range(3)]).alias(f"w{i}") for i in range(14)]
    twice = F.when(F.col("id") % 3 == 0, F.concat(F.lit("some longer common text "), (F.col("id") % 999).cast("string"))).otherwise(h(99)).alias("twice")
    ties = F.concat(F.lit("always the same beginning of "), (F.col("id") % (n // 2)).cast("string")).alias("ties")
    return spark.range(0, n, 1, 4).select(F.col("id").alias(ROW), *many, twice, ties, F.lit(None).cast("string").alias("none"), (F.col("id") % 9).cast("string").alias("few"))


def test_digests_give_the_same_profile_with_less_shuffled(spark):
    df = rows(spark)
    want, plain_bytes = shuffled(spark, lambda: profile.profile(df, RULE))
    names = [f"w{i}" for i in range(14)] + ["twice", "ties"]
    got, bytes_ = shuffled(spark, lambda: wide.profile_routed(df, RULE, by_digest=names))
    for part in ("metrics", "dataset", "top_values", "violations"):
        assert sorted(map(str, getattr(got, part).collect())) == sorted(map(str, getattr(want, part).collect())), part
    assert bytes_ <= plain_bytes / 3, (bytes_, plain_bytes)
    assert [c for c in wide.near_unique(df, profile.profiled_columns(df)) if c != "ties"] == names[:-1]  # "ties" has just the share


def test_digests_of_odd_columns(spark):
    df = spark.createDataFrame([(i, v, None) for i, v in enumerate(["", "a", "a", None, "b", "", "c", "d", "e", "f"])], f"{ROW} long, `x.y` string, n string")
    for picked in (1, 2, 128):
        counted = wide.digests(df, ["x.y", "n"])
        got = sorted(map(str, wide.top_values(df, ["x.y", "n"], counted, 5, picked).collect()))
        assert got == sorted(map(str, profile.top_values(profile.histogram(df, ["x.y", "n"])).collect()))
    empty = wide.profile_routed(df.limit(0), {}, by_digest=["x.y"])
    assert {r.column_name: r.total_count for r in empty.metrics.collect()} == {"x.y": 0, "n": 0}


def test_uniqueness_over_batches_restarts_and_late_rows(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 6, d, h)
    source, schema = str(tmp_path / "in"), "at timestamp, NPI string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)

    def run(df_of, out, mode="append"):
        stream = df_of(spark.readStream.schema(schema).parquet(source))
        q = stream.writeStream.outputMode(mode).format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"{out}-state")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    def both():
        run(lambda d: quality.uniqueness(d, "at", "NPI"), "windows")
        run(lambda d: quality.first_of_each(d, "at", ["NPI"]), "first")

    put([(day(1), "a"), (day(1, 5), "b"), (day(1, 6), None)])
    both()
    put([(day(1, 9), "a"), (day(2), "a")])  # the same key in another batch, after a restart
    both()
    put([(day(9), "z")])  # the watermark passes the first days
    both()
    put([(day(1, 12), "c"), (day(9, 1), "z")])  # too late for its window
    both()
    put([(day(20), "end")])
    both()
    put([(day(21), "more")])
    both()
    got = {r.window_start: (r.total_count, r.unique_count, r.duplicate_count) for r in spark.read.parquet(str(tmp_path / "windows")).collect()}
    assert got[day(1)] == (3, 2, 1) and got[day(2)] == (1, 1, 0) and got[day(9)] == (2, 1, 1)
    first = sorted(r.NPI or "" for r in spark.read.parquet(str(tmp_path / "first")).collect())
    assert first.count("a") == 1 and first.count("b") == 1 and first.count("z") == 1


def test_uniqueness_of_a_batch(spark):
    rows_ = [(dt.datetime(2024, 6, 1, h), k) for h, k in enumerate(["a", "a", None, "b"])]
    df = spark.createDataFrame(rows_, "at timestamp, k string")
    r = quality.uniqueness(df, "at", "k").first()
    assert (r.total_count, r.unique_count, r.duplicate_count) == (3, 2, 1) and r.uniqueness_score == pytest.approx(200 / 3)
    assert quality.first_of_each(df, "at", ["k"]).count() == 3


def test_states_in_texts_as_one_by_one(spark):
    from assayer.functions import states

    names = list(states.STATES)
    texts = [*names, *[n.lower() for n in names], *[f"{a} {b}" for a in names[::4] for b in names[::5]], "WEST VIRGINIA", "in west virginia, arkansas", "KANSASARKANSAS", "none", "", None, "WASHINGTON DC", "NEW MEXICO NEW YORK"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    chain = F.coalesce(*[F.when(F.upper("t").contains(name), F.lit(code)) for name, code in states.STATES.items()])
    found = df.select("t", chain.alias("want"), states.state_in_text(F.col("t")).alias("got"))
    assert found.where(~F.col("want").eqNullSafe(F.col("got"))).collect() == [] and found.where("got IS NOT NULL").count() > 150
    one, many = (df.select(c)._jdf.queryExecution().optimizedPlan().toString() for c in (states.state_in_text(F.col("t")), chain))
    assert len(one) < len(many)


def test_rules_are_sql_functions(spark):
    from assayer.functions import sql
    from assayer.sources.catalog import provider_rules

    rules = provider_rules()
    made = sql.register(spark, rules, as_of="2024-06-30")
    assert len(made) == len(rules) + 1 and "conforms_npi" in made
    got = spark.sql("SELECT conforms_npi(x) AS npi, null_like(x) AS none FROM VALUES ('1234567890'), ('x'), (' N/A '), (NULL) AS t(x)").collect()
    assert [tuple(r) for r in got] == [(True, False), (False, False), (False, True), (False, True)]
    with pytest.raises(ValueError):
        sql.register(spark, {"a b": RULE["w1"], "a-b": RULE["w1"]})
