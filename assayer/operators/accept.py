"""Accepted repairs applied to a stored table, partition by partition.

Audit rows name cells by the row's place in the table (``files.load_dataset``) and the column.  Places are found
from the files themselves, so which partitions hold changed rows is known before any
other column is read.  Only these partitions are read, changed and written again; all others keep their files.

Rows keep their order within a partition and partitions theirs, so every row keeps its place, and a run that
broke off can be repeated: it sets the same cells to the same values.

Defined results
  no accepted row        nothing is written
  several for one cell   the last by ``seq``, where there is that column, else the greatest value
  null value             is no repair: the cell stays
  a place beyond the table   an error, and nothing is written
  a column that isn't there, or one that the table is partitioned by   an error
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import quoted
from ..sources import files, scratch
from ..sources.files import ROW

#: Changed rows up to which they are sent to all executors; beyond, the touched partitions are shuffled for the join too.
CHANGES_SENT = 50_000


@dataclass
class Applied:
    cells: int
    rows: int
    partitions: int


def changes(accepted: DataFrame) -> DataFrame:
    """row_index and a map of columns to values, a row for each changed row."""
    order = ["seq"] if "seq" in accepted.columns else ["recommended_value"]
    given = accepted.where(F.col("recommended_value").isNotNull() & F.col(ROW).isNotNull())
    cells = given.groupBy(ROW, "column").agg(F.max_by("recommended_value", F.struct(*order)).alias("value"))
    return cells.groupBy(ROW).agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("__changed"))


def apply(spark: SparkSession, path: str, accepted: DataFrame, partitioned_by: list[str]) -> Applied:
    """Writes the accepted values into the Parquet table at ``path``, which is partitioned by these columns."""
    stored = spark.read.parquet(path)
    if not partitioned_by or [c for c in partitioned_by if c not in stored.columns]:
        raise ValueError(f"the table isn't partitioned by {partitioned_by}")
    changed = scratch.cut(changes(accepted), "accepted")
    named = [r.column for r in changed.select(F.explode(F.map_keys("__changed")).alias("column")).distinct().collect()]  # as many as columns
    if wrong := [c for c in named if c not in stored.columns or c in partitioned_by]:
        raise ValueError(f"no columns to change: {', '.join(sorted(wrong))}")
    rows, cells = changed.agg(F.count("*"), F.coalesce(F.sum(F.size("__changed")), F.lit(0))).first()
    if not rows:
        return Applied(0, 0, 0)
    few = lambda df: F.broadcast(df) if rows <= CHANGES_SENT else df
    keys = [quoted(c) for c in partitioned_by]
    places = files.placed(stored.select(*keys), partitioned_by)
    hit = scratch.cut(places.join(few(changed.select(ROW)), ROW).groupBy(*keys).agg(F.count("*").alias("__rows")), "touched")
    found, partitions = hit.agg(F.sum("__rows"), F.count("*")).first()
    if found != rows:
        raise ValueError(f"{rows - (found or 0)} accepted rows have a place that the table doesn't have")
    same = None
    for c in partitioned_by:
        one = F.col(f"t.{_q(c)}").eqNullSafe(F.col(f"h.{_q(c)}"))
        same = one if same is None else same & one
    numbered = files.placed(stored, stored.columns).alias("t")
    touched = numbered.join((F.broadcast(hit) if partitions <= CHANGES_SENT else hit).alias("h"), same, "left_semi")
    joined = touched.join(few(changed), ROW, "left")
    values = [F.coalesce(F.try_element_at("__changed", F.lit(f.name)).cast(f.dataType), quoted(f.name)).alias(f.name) if f.name in named else quoted(f.name) for f in stored.schema]
    out = joined.select(*values, ROW).repartitionByRange(*keys, ROW).sortWithinPartitions(*keys, ROW).drop(ROW)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitioned_by).parquet(path)
    return Applied(cells, rows, partitions)


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
