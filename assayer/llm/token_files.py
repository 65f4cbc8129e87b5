"""Token ids in Parquet files that readers can enter anywhere.

A dataset of token ids is two tables in one folder.  ``tokens`` has a row for each
document: its id, the shard it lies in, where its ids start there, how many they are, and
the ids as a list column.  ``shards`` has a row for each shard: how many ids all shards before
it hold, what it holds itself, and the ids of its first and last document.

Rows are in ascending order of their ids, over all shards: they are dealt by ranges and sorted
within each, so no task sees more than its range.  Lists are written with a dictionary (two bytes
for most ids at most) or as deltas; row groups have a bounded size and pages a bounded number of
rows, each with its entry in the page index.  So a reader of a few documents opens the row groups
and pages that hold them, and a reader of lengths and places opens no page of ids at all.

Defined results
  null text       as an empty one: the end id alone
  null id         stands before all others, as does any row with one
  repeated rows   are rows of their own, next to each other; rows of equal ids stand in the order of
                  the tasks that read them, then of their texts
  many rows of one id   are dealt by the task that read them too, so that they are not one range
  long texts      are encoded in linear time; a document is one row
  extra columns   stay behind; an id column with the name of a result is refused
  empty table     two empty tables
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bpe, packing
from ._run import fresh, refuse_clash, ship

END_ID = 2
PIECES = 400_000  # pieces of text remembered by a worker, twice; about 160 MB
ROW_GROUP_BYTES, PAGE_ROWS, SHARD_BYTES = 32 << 20, 256, 128 << 20
#: Rows of ``shards`` up to which it is sent to all executors: 64 MB of them at most.
SHARDS_SENT = 1 << 20
RESULTS = ("shard", "start", "n_tokens", "token_ids")
_LIST = "token_ids.list.element"


def ordered(df: DataFrame, id_column: str, text: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Id, text and shard number of each row, dealt into ranges of ids in ascending order and sorted within."""
    spark = df.sparkSession
    where = fresh([id_column], "task")
    source = df.select(F.col(id_column), F.coalesce(F.col(text), F.lit("")).alias("__text"), F.spark_partition_id().alias(where))
    ranges = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // shard_bytes
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = least < ranges < 1 << 30  # what isn't read from files can have any size, which Spark tells as the largest
    dealt = source.repartitionByRange(*([ranges] if known else []), id_column, where)
    return dealt.sortWithinPartitions(id_column, where, F.xxhash64("__text")).select(id_column, "__text", F.spark_partition_id().alias("shard"))


def encode(rows: DataFrame, *, end_id: int = END_ID, json_path: str | None = None) -> DataFrame:
    """What ``ordered`` gives, with ids in place of texts and each document's place in its shard."""
    ship(rows.sparkSession)
    name = rows.columns[0]
    schema = f"`{name}` {rows.schema[0].dataType.simpleString()}, shard int, start long, n_tokens int, token_ids array<int>"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = packing.tokenizer(json_path or public_tokenizers.path("byte_bpe_50k.json"), bpe.default_pattern(), PIECES)
        end, at = np.array([end_id], np.int32), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # lists of a few rows at once
                some = batch.slice(a, 256)
                ids = [np.concatenate((x.view(np.int32), end)) for x in encoder.encode_all(some.column(1).to_pylist())]
                lengths = np.array([len(x) for x in ids], np.int64)
                cuts = np.concatenate(([0], np.cumsum(lengths)))
                lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))
                columns = [some.column(0), some.column(2), pa.array(at + cuts[:-1], pa.int64()), pa.array(lengths, pa.int32()), lists]
                at += int(cuts[-1])
                yield pa.RecordBatch.from_arrays(columns, [name, *RESULTS])

    return rows.mapInArrow(encoded, schema)


def write(df: DataFrame, path: str, *, id_column: str = "doc_id", text: str = "text", end_id: int = END_ID, encoding: str = "dictionary", row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS, shard_bytes: int = SHARD_BYTES, json_path: str | None = None) -> None:
    """Writes the ids of all texts as a dataset in the folder ``path``; ``encoding`` is that of the lists: "dictionary" or "delta"."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    refuse_clash((id_column,), RESULTS)
    rows = encode(ordered(df, id_column, text, shard_bytes), end_id=end_id, json_path=json_path)
    options = {
        "parquet.block.size": row_group_bytes,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": False,
        f"parquet.enable.dictionary#{_LIST}": encoding == "dictionary",
        "parquet.enable.dictionary#shard": True,
        "parquet.writer.version": "PARQUET_2_0",  # numbers without a dictionary are deltas
        "compression": "zstd",
    }
    rows.write.options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).parquet(f"{path}/tokens")
    shards(df.sparkSession, path).write.parquet(f"{path}/shards")


def shards(spark: SparkSession, path: str, group: int = 4096) -> DataFrame:
    """A row for each shard, from the columns of lengths and places alone: shard, base, documents, n_tokens, first_id and last_id.

    Sums run within groups of shards and over the groups, so no task holds more than ``group`` of them
    or a row for each group.
    """
    tokens = spark.read.parquet(f"{path}/tokens")
    name = tokens.columns[0]
    each = tokens.groupBy("shard").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("n_tokens"), F.min(name).alias("first_id"), F.max(name).alias("last_id"))
    each = each.withColumn("bundle", F.expr(f"shard div {group}"))
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = each.withColumn("inside", before(Window.partitionBy("bundle").orderBy("shard")))
    bundles = each.groupBy("bundle").agg(F.sum("n_tokens").alias("n_tokens")).select("bundle", before(Window.orderBy("bundle")).alias("start"))
    return inside.join(bundles, "bundle").select("shard", (F.col("start") + F.col("inside")).alias("base"), "documents", "n_tokens", "first_id", "last_id")


def read(spark: SparkSession, path: str, *, least=None, most=None) -> DataFrame:
    """The documents with their ids; ``start`` counts the ids of all documents before, in the whole dataset.

    ``least`` and ``most`` bound the document ids: the scan then opens only the row groups and
    pages whose statistics meet them.
    """
    return _placed(spark, path, _within(spark, path, least, most))


def places(spark: SparkSession, path: str, *, least=None, most=None) -> DataFrame:
    """As ``read``, without the ids: none of their pages is opened."""
    return _placed(spark, path, _within(spark, path, least, most).drop("token_ids"))


def _within(spark: SparkSession, path: str, least, most) -> DataFrame:
    tokens = spark.read.parquet(f"{path}/tokens")
    name = F.col(tokens.columns[0])
    if least is not None:
        tokens = tokens.where(name >= F.lit(least))
    return tokens if most is None else tokens.where(name <= F.lit(most))


def _placed(spark: SparkSession, path: str, tokens: DataFrame) -> DataFrame:
    """Adds the ids of all shards before; ``shards`` is sent to all executors only if its counted rows allow it."""
    bases = spark.read.parquet(f"{path}/shards").select("shard", "base")
    joined = tokens.join(F.broadcast(bases) if bases.count() <= SHARDS_SENT else bases, "shard")
    return joined.select(*[(F.col("base") + F.col("start")).alias("start") if c == "start" else F.col(c) for c in tokens.columns])


def digests(tokens: DataFrame) -> DataFrame:
    """The id column, ``start``, ``n_tokens`` as counted from the list, and ``ids_crc32`` of the ids as little-endian 32-bit integers."""
    ship(tokens.sparkSession)
    source = tokens.select(tokens.columns[0], "start", "token_ids")
    name = source.columns[0]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values, cuts = lists.values.to_numpy().astype("<i4", copy=False), lists.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            columns = [batch.column(0), batch.column(1), pa.array(np.diff(cuts), pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [name, "start", "n_tokens", "ids_crc32"])

    return source.mapInArrow(summed, f"`{name}` {source.schema[0].dataType.simpleString()}, start long, n_tokens long, ids_crc32 long")
