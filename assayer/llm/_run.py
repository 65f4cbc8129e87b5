"""What the operators of this subpackage share about running on a cluster."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes that a Python worker gets at once; a single row may have more bytes.
BATCH_ROWS, BATCH_BYTES = 1_000, 32 << 20
_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Lets Python workers that this session starts import this library, and bounds what they get at once.

    On a cluster the library is installed or sent with --py-files; in local mode
    the workers only need the folder that the driver imported it from.  Rows are
    whole documents, so Arrow batches of the default ten thousand rows can be large.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") or 0) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in spark.checkpoint.dir.  Where that is unset in local mode, a
    folder below the warehouse is used and set as the checkpoint folder; elsewhere
    there is no such folder to guess, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: lineage ends there.

    Tasks stay those of ``df``; adaptive execution merges small shuffle partitions, and
    the scan packs small files.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores behind it as make it none of ``columns``, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def refuse_clash(carried: Iterable[str], results: Iterable[str]) -> None:
    """An error for carried columns that have a result's name, since nobody could tell them apart."""
    taken = {c.lower() for c in results}
    if both := [c for c in carried if c.lower() in taken]:
        raise ValueError(f"rename these columns, results have their names: {', '.join(both)}")


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: whoever owns the folder clears it
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
