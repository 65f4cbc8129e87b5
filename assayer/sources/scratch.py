"""Tables that cut a plan's lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names.

    Where that is unset in local mode, a folder below the warehouse is used and set;
    elsewhere no folder is known to be shared, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by ``release`` or when this process ends."""
    if not _made:
        atexit.register(release)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` and reads it again.  Part files stand in the order of the partitions that wrote them."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*paths: str) -> None:
    """Removes these paths, or all that this process made and still has; what was read from them can't be read again."""
    for path in paths or list(_made):
        spark = _made.pop(path, None)
        if spark is None:
            continue
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if not fs.delete(where, True):
                beside = [s.getPath() for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}*")) or []]
                for p in beside:
                    fs.delete(p, True)
        except Exception:  # the session has ended: whoever owns the folder clears it
            return
