"""Datasets in files: CSV, Parquet and Excel, read as text, with each row's place."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.nulls import quoted
from . import csv_records, scratch
from .catalog import focused_columns

ROW = "row_index"
KINDS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".xlsx": "excel", ".xls": "excel"}


def _kind(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in KINDS:
        raise ValueError(f"unsupported file format: {suffix or path}")
    return KINDS[suffix]


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def file_size_mb(spark: SparkSession, path: str) -> float:
    fs, where = _fs(spark, path)
    return fs.getContentSummary(where).getLength() / 1024 / 1024


def focus(df: DataFrame, columns: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The focused columns that are there, in configured order; all columns if none is."""
    present = [c for c in (focused_columns() if columns is None else columns) if c in df.columns]
    return df.select(*[quoted(c) for c in [*keep, *[c for c in present if c not in keep]]]) if present else df


def as_text(df: DataFrame) -> DataFrame:
    """Every column but the row's place as text."""
    return df.select(*[quoted(f.name) if f.name == ROW or isinstance(f.dataType, T.StringType) else quoted(f.name).cast("string").alias(f.name) for f in df.schema])


def with_row_index(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Adds the 0-based place of each row, from 0 on without a gap.

    The frame is evaluated once, into a table in the shared folder, and what was written is
    numbered: by its part files, which stand in the order of the partitions, and by each row's
    place in its file.  So no row can be lost or get another's number, however the frame's plan is adapted.
    With ``order`` a range sort comes first, again without a single task for all rows.
    """
    if order:
        df = df.orderBy(*[quoted(c) for c in order])
    return placed(scratch.cut(df, "numbered"), df.columns, [])


#: Files whose first places are sent to all executors; beyond, both sides are shuffled.
FILES_SENT = 100_000


def placed(table: DataFrame, columns: list[str], keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The columns of stored files with each row's place: in the order of ``keys``, within them of folders and files and of the rows in each.

    Rows of equal keys stand together in a file.  Counting reads no column but the keys; a row for each
    file and key is summed up, as many as the driver lists itself.
    """
    part, inside = "__part", "__inside"
    name = F.col("_metadata.file_path")
    rows = table.select(*[quoted(c) for c in columns], *keys, name.alias(part), F.col("_metadata.row_index").alias(inside))
    each = rows.groupBy(part, *keys).agg(F.count("*").alias("__n"), F.min(inside).alias("__first"))
    number = F.regexp_extract(part, r"part-(\d+)-[^/]*$", 1).try_cast("long")
    folder = F.regexp_replace(part, "/[^/]*$", "")
    before = Window.orderBy(*keys, folder, number, part).rowsBetween(Window.unboundedPreceding, -1)
    starts = each.select(part, *keys, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__start"))
    starts = F.broadcast(starts) if each.count() <= FILES_SENT else starts
    joined = rows.join(starts, [part, *keys], "left")
    place = F.coalesce(F.col("__start"), F.raise_error(F.concat(F.lit("not counted: "), part)).cast("long")) + F.col(inside)
    return joined.select(*[quoted(c) for c in columns], place.alias(ROW))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, line_ends: bool | None = None) -> DataFrame:
    """A CSV file with a header, all text.  UTF-8, or Latin-1 where the bytes aren't UTF-8.

    Files are read in parts, those with line ends in quoted values too.  Unless both are given, one pass over
    the lines tells the encoding and whether quoted values hold line ends.
    """
    return _csv_rows(spark, path, encoding, line_ends).drop(csv_records.FILE, csv_records.BLOCK, csv_records.LATE, csv_records.SEQ)


def _csv_rows(spark: SparkSession, path: str, encoding: str | None, line_ends: bool | None) -> DataFrame:
    """The rows of CSV files, and columns to order them by: file, block and more."""
    if encoding is None or line_ends is None:
        seen = spark.read.option("lineSep", "\n").text(path).agg(F.bool_or(~F.is_valid_utf8("value")).alias("latin"), F.bool_or(F.col("value").rlike(csv_records.OPENS)).alias("across")).first()
        encoding = encoding or ("ISO-8859-1" if seen.latin else "UTF-8")
        line_ends = bool(seen.across) if line_ends is None else line_ends
    options = {"header": True, "inferSchema": False, "quote": '"', "escape": '"', "encoding": encoding, "enforceSchema": False}
    if not line_ends:
        plain = spark.read.options(**options).csv(path)
        return plain.select("*", F.col("_metadata.file_path").alias(csv_records.FILE), F.col("_metadata.file_block_start").alias(csv_records.BLOCK))
    names = spark.read.options(**options, multiLine=True).csv(path).columns
    first = spark.read.options(**options | {"header": False}, multiLine=True).csv(path).first()
    text = csv_records.lines(spark, path)
    return csv_records.parse(csv_records.records(text, csv_records.states(text)), names, list(first or []), encoding)


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook; a workbook is bounded by its format (about a million rows), so the driver reads it."""
    import pandas as pd

    frame = pd.read_excel(path, dtype=str)
    schema = T.StructType([T.StructField(str(c), T.StringType()) for c in frame.columns])
    return spark.createDataFrame(frame.astype(object).where(frame.notna(), None).values.tolist(), schema)


def load_dataset(spark: SparkSession, path: str, *, focused_only: bool = True, columns: list[str] | None = None, row_index: bool = True, encoding: str | None = None) -> DataFrame:
    """A dataset by its suffix.  FileNotFoundError if it isn't there, ValueError for another format."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    kind = _kind(path)
    df = _csv_rows(spark, path, encoding, None) if kind == "csv" else spark.read.parquet(path) if kind == "parquet" else read_excel(spark, path)
    keys = [k for k in (csv_records.FILE, csv_records.BLOCK, csv_records.LATE, csv_records.SEQ) if kind == "csv" and k in df.columns]
    names = [c for c in df.columns if c not in keys]
    if focused_only:
        names = focus(df.drop(*keys), columns).columns
    if not row_index:
        return as_text(df.select(*[quoted(c) for c in names]))
    if kind == "parquet":  # files hold their rows' places
        return as_text(placed(df, names, []))
    if kind == "excel":
        return with_row_index(as_text(df.select(*[quoted(c) for c in names])))
    # a task may read blocks of several files: rows are written with their blocks, which then give the order
    rows = as_text(df.select(*[quoted(c) for c in names])) if not keys else df.select(*[quoted(c).cast("string").alias(c) for c in names], *keys)
    return placed(scratch.cut(rows, "rows"), names, [k for k in keys if k != csv_records.SEQ])


def _csv(writer: DataFrameWriter) -> DataFrameWriter:
    """Values as they are: Spark would strip them when it writes."""
    return writer.options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def save_dataset(df: DataFrame, path: str, *, single_file: bool = False) -> str:
    """Writes by suffix.  A folder of part files, or with ``single_file`` one file written by one task."""
    kind = _kind(path)
    if kind == "excel":
        df.toPandas().to_excel(path, index=False)
        return path
    if not single_file:
        (_csv(df.write.mode("overwrite")).csv if kind == "csv" else df.write.mode("overwrite").parquet)(path)
        return path
    folder = f"{path}.parts"
    one = df.coalesce(1).write.mode("overwrite")
    _csv(one).csv(folder) if kind == "csv" else one.parquet(folder)
    fs, where = _fs(df.sparkSession, folder)
    target = _fs(df.sparkSession, path)[1]
    part = next(s.getPath() for s in fs.listStatus(where) if s.getPath().getName().startswith("part-"))
    fs.delete(target, True)
    fs.rename(part, target)
    fs.delete(where, True)
    return path


def chunks(spark: SparkSession, path: str, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a saved CSV, a file or a folder of parts, in their order and with one header; ``size`` of them at once.

    For a download: it goes through the driver, but never more of it than a chunk and a header.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    fs, where = _fs(spark, path)
    parts = [where] if fs.getFileStatus(where).isFile() else sorted((s.getPath() for s in fs.listStatus(where) if s.isFile() and not s.getPath().getName().startswith(("_", "."))), key=lambda p: (len(p.getName()), p.getName()))
    read = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
    for i, part in enumerate(parts):
        left, stream, header = fs.getFileStatus(part).getLen(), fs.open(part), i > 0
        held = b""
        try:
            while left:
                n = min(size, left)
                held += bytes(read.toByteArray(stream, n))
                left -= n
                if header:  # ends with the first line end outside of quotes
                    at = _header_end(held)
                    if at is None and left:
                        continue
                    held, header = held[at or len(held) :], False
                if held:
                    yield held
                held = b""
        finally:
            stream.close()


def _header_end(data: bytes) -> int | None:
    at = -1
    while (at := data.find(b"\n", at + 1)) >= 0:
        if data.count(b'"', 0, at) % 2 == 0:
            return at + 1
    return None


def backup(path: str, at: datetime) -> str:
    """A copy ``<stem>_backup_<time><suffix>`` beside a local file or folder."""
    p = Path(path)
    to = p.with_name(f"{p.stem}_backup_{at:%Y%m%d_%H%M%S}{p.suffix}")
    (shutil.copytree if p.is_dir() else shutil.copy2)(p, to)
    return str(to)


def first_rows(df: DataFrame, n: int = 100) -> DataFrame:
    """The first n rows by their place."""
    return df.orderBy(ROW).limit(n)


def sample(df: DataFrame, n: int, seed: int = 42, key: str = ROW) -> DataFrame:
    """Exactly n rows (all, if fewer), the same ones every time: those whose keyed hash is least."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), quoted(key).cast("string")).cast("binary")), quoted(key)).limit(n)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first rows with empty text for nulls."""
    return df.limit(n).na.fill("")
