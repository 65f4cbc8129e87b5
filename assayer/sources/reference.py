"""Reference maps: small tables that cells are looked up in.

Each comes as a DataFrame.  ``lookup`` joins it: by broadcast if the map's rows are
counted and few, otherwise as any join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import strip
from ..functions.states import normal_postal_code
from .files import exists

BROADCAST_ROWS = 200_000


def _key(c: str) -> Column:
    return F.upper(strip(F.col(c)))


def _rows(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame | None:
    if not exists(spark, path):
        return None
    df = spark.read.csv(path, header=True)
    by_name = {c.strip().lower(): c for c in df.columns}
    if any(n not in by_name for n in names):
        raise ValueError(f"{path} needs the columns {', '.join(names)}")
    return df.select(*[F.col(f"`{by_name[n]}`").alias(n) for n in names])


def _last(df: DataFrame, key: str, value: str) -> DataFrame:
    """One row for each key, the last one's value."""
    line = F.monotonically_increasing_id()
    return df.where(F.col(key).isNotNull() & (F.col(key) != "")).withColumn("__n", line).groupBy(key).agg(F.max_by(value, "__n").alias(value))


def empty(spark: SparkSession, key: str, value: str) -> DataFrame:
    return spark.createDataFrame([], T.StructType([T.StructField(key, T.StringType()), T.StructField(value, T.StringType())]))


def city_states(spark: SparkSession, path: str) -> DataFrame:
    """city and state, in upper case; a missing file is an empty map."""
    df = _rows(spark, path, ("city_name", "state_code"))
    return empty(spark, "city", "state") if df is None else _last(df.select(_key("city_name").alias("city"), _key("state_code").alias("state")), "city", "state")


def postal_states(spark: SparkSession, path: str) -> DataFrame:
    """code and state: normalized codes, and their first three digits."""
    df = _rows(spark, path, ("postal_code", "state_code"))
    if df is None:
        return empty(spark, "code", "state")
    rows = df.select(normal_postal_code(F.col("postal_code")).alias("code"), _key("state_code").alias("state")).where("code IS NOT NULL")
    both = rows.select(F.explode(F.array_distinct(F.array("code", F.left("code", F.lit(3))))).alias("code"), "state")
    return _last(both, "code", "state")


def state_countries(spark: SparkSession, path: str) -> DataFrame:
    """Distinct pairs of state and country, in upper case."""
    df = _rows(spark, path, ("state_name", "country_code"))
    return empty(spark, "state", "country") if df is None else df.select(_key("state_name").alias("state"), _key("country_code").alias("country")).distinct()


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if its rows are few, by count."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def lookup(df: DataFrame, key: Column, table: DataFrame, table_key: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the value of the table's row with this key or null; table keys are unique."""
    side = small(table.select(F.col(table_key).alias("__k"), F.col(value).alias(out)))
    return df.withColumn("__key", key).join(side, F.col("__key") == F.col("__k"), "left").drop("__key", "__k")


def first_in_state(df: DataFrame, rows: DataFrame, row: str, candidates: Column, state: Column, cities: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``, the first of the candidates that ``cities`` has in the row's state, or null.

    Candidates and state are of ``rows``, the same rows as those of ``df`` by ``row``; only hits are joined back.
    """
    side = small(cities.select(F.col("city").alias("__k"), F.col("state").alias("__v")))
    asked = rows.select(F.col(row).alias("__r"), state.alias("__s"), F.posexplode(candidates).alias("__n", "__x"))
    hits = asked.join(side, (F.col("__x") == F.col("__k")) & (F.col("__s") == F.col("__v"))).groupBy("__r").agg(F.min_by("__x", "__n").alias(out))
    return df.join(hits, F.col(row) == F.col("__r"), "left").drop("__r")


def postal_lookup(df: DataFrame, code: Column, table: DataFrame, out: str) -> DataFrame:
    """The state of a normalized code in full, else of its first five digits, else of three."""
    for n, name in ((None, "__s0"), (5, "__s5"), (3, "__s3")):
        key = code if n is None else F.when(F.char_length(code) >= n, F.left(code, F.lit(n)))
        df = lookup(df, key, table, "code", "state", name)
    return df.withColumn(out, F.coalesce("__s0", "__s5", "__s3")).drop("__s0", "__s5", "__s3")


def foreign_state(df: DataFrame, state: Column, country: Column, pairs: DataFrame, out: str) -> DataFrame:
    """Whether the pair of state and country is known, for countries other than US."""
    side = small(pairs.select(F.col("state").alias("__s"), F.col("country").alias("__c"), F.lit(True).alias("__hit")))
    v, land = F.upper(strip(state)), F.upper(strip(country))
    held = df.withColumn("__v", v).withColumn("__l", land)
    joined = held.join(side, (F.col("__v") == F.col("__s")) & (F.col("__l") == F.col("__c")), "left")
    return joined.withColumn(out, F.coalesce(F.col("__hit") & (F.col("__l") != "US"), F.lit(False))).drop("__v", "__l", "__s", "__c", "__hit")
