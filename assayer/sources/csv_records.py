"""CSV files whose quoted values hold line ends, read in parts.

Where a record ends depends on whether a quote is open, and that on all that was read before.
So each block of a file is first reduced to what it does to that state: for a block that
begins outside of a quoted value, and for one that begins inside, the state that it ends in.  Put
together in the order of the blocks these give the state at the start of every block, and each can be
cut into records by itself.  The pieces of a record that goes on in the next block are a row or two
for each block; only these are shuffled and joined.

Quotes count as the CSV reader counts them: one opens a value only where a field begins, a doubled
one inside is a character, and what follows a closed value up to the next comma belongs to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A line that begins outside of a quoted value and ends inside of one.
OPENS = r'^(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+|),)*+"[^"]*+(?:""[^"]*+)*+$'
FILE, BLOCK, LATE, SEQ, RECORD = "__file", "__block", "__late", "__seq", "__record"
#: Blocks whose states are sent to all executors; beyond, they are joined by a shuffle of both sides.
BLOCKS_SENT = 1 << 17


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line as bytes, with its file and the start of its block."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(BLOCK), F.col("value").cast("binary").alias("line"))


def _walker():
    """A function of a line and the state at its start that gives the state at its end; without anything to import, so that it can be sent."""

    def walk(line: bytes, inside: bool) -> bool:
        if b'"' not in line:
            return inside
        at, n = 0, len(line)
        while True:
            if not inside:
                while at < n and line[at] != 34:  # a field that isn't quoted
                    at = line.find(b",", at) + 1
                    if not at:
                        return False
                if at >= n:
                    return False
                at += 1
            inside = False
            while True:  # to the quote that closes the value
                at = line.find(b'"', at)
                if at < 0:
                    return True
                if line[at + 1 : at + 2] != b'"':
                    break
                at += 2
            at = line.find(b",", at) + 1
            if not at:
                return False

    return walk


def states(text: DataFrame) -> DataFrame:
    """file, block and ``inside``: whether the block begins within a quoted value.  A row for each block."""
    walk = _walker()

    def reduced(batches):
        import pyarrow as pa

        names = [FILE, BLOCK, "from_out", "from_in"]
        now, done = None, []
        out = inn = False
        for batch in batches:
            for f, b, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (f, b) != now:
                    if now:
                        done.append((*now, out, inn))
                    now, out, inn = (f, b), False, True
                if b'"' in line:
                    same = out == inn
                    out = walk(line, out)
                    inn = out if same else walk(line, inn)
        if now:
            done.append((*now, out, inn))
        columns = list(zip(*done)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], names)

    blocks = text.mapInArrow(reduced, f"{FILE} string, {BLOCK} long, from_out boolean, from_in boolean")
    in_order = F.array_sort(F.collect_list(F.struct(F.col(BLOCK).alias("b"), F.col("from_out").alias("o"), F.col("from_in").alias("i"))))
    start = F.struct(F.lit(False).alias("now"), F.array().cast("array<struct<block:bigint,inside:boolean>>").alias("told"))
    step = lambda a, x: F.struct(F.when(a["now"], x["i"]).otherwise(x["o"]).alias("now"), F.concat(a["told"], F.array(F.struct(x["b"].alias("block"), a["now"].alias("inside")))).alias("told"))
    told = blocks.groupBy(FILE).agg(F.aggregate(in_order, start, step)["told"].alias("told"))
    return told.select(FILE, F.explode("told").alias("x")).select(FILE, F.col("x.block").alias(BLOCK), F.col("x.inside").alias("inside"))


def records(text: DataFrame, known: DataFrame, sent: int = BLOCKS_SENT) -> DataFrame:
    """file, block, late, seq and record (bytes, without its line end).

    Records stand in the order of these columns; a record that began in a block and ended in a later one is ``late``.
    The text is read once for whole records and once more for the pieces of others.
    """
    walk = _walker()
    if known.count() <= sent:
        source = text.join(F.broadcast(known), [FILE, BLOCK])
    else:
        source = text.withColumn(SEQ, F.monotonically_increasing_id()).join(known, [FILE, BLOCK])
        source = source.repartition(FILE, BLOCK).sortWithinPartitions(FILE, BLOCK, SEQ)
    source = source.select(FILE, BLOCK, "inside", "line")

    def cut_up(batches):
        import pyarrow as pa

        names = [FILE, BLOCK, SEQ, "kind", RECORD]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        rows, now, held, seq, first, inside = [], None, [], 0, False, False

        def given():
            columns = list(zip(*rows)) or [[]] * 5
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        def left():  # what a block ends with: 1 begins here, 2 neither begins nor ends here; -1 is what ends a record from before
            if held:
                rows.append((*now, seq, 2 if first else 1, b"\n".join(held)))

        for batch in batches:
            for f, b, start, line in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (f, b) != now:
                    left()
                    now, held, seq, inside = (f, b), [], 0, start
                    first = inside
                held.append(line)
                inside = walk(line, inside)
                if not inside:
                    rows.append((*now, seq, -1 if first else 0, b"\n".join(held)))
                    held, first = [], False
                    seq += 1
                    if len(rows) >= 1000:
                        yield given()
        left()
        yield given()

    found = source.mapInArrow(cut_up, f"{FILE} string, {BLOCK} long, {SEQ} long, kind int, {RECORD} binary")
    columns = [FILE, BLOCK, LATE, SEQ, RECORD]
    whole = found.where(F.col("kind") == 0).withColumn(LATE, F.lit(False)).select(*columns)
    order = Window.partitionBy(FILE).orderBy(BLOCK, SEQ)
    parts = found.where(F.col("kind") != 0).withColumn("no", F.sum((F.col("kind") == 1).cast("int")).over(order))
    joined = parts.groupBy(FILE, "no").agg(F.array_sort(F.collect_list(F.struct(F.col(BLOCK).alias("b"), F.col(SEQ).alias("s"), F.hex(RECORD).alias("r")))).alias("x"))
    one = F.unhex(F.array_join(F.transform("x", lambda p: p["r"]), "0A"))
    stitched = joined.select(FILE, F.col("x")[0]["b"].alias(BLOCK), F.lit(True).alias(LATE), F.col("x")[0]["s"].alias(SEQ), one.alias(RECORD))
    return whole.unionByName(stitched)


def parse(found: DataFrame, names: list[str], headings: list[str | None], encoding: str) -> DataFrame:
    """The values of each record, as the CSV reader would give them; records without a character go, and so do headers.

    A file whose first record isn't ``headings`` is an error.
    """
    text = F.regexp_replace(F.decode(RECORD, encoding), "\r$", "")
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    rows = found.withColumn(RECORD, text).where((F.col(RECORD) != "")).withColumn("x", F.from_csv(RECORD, schema.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}))
    values = F.array(*[F.col(f"x.c{i}") for i in range(len(names))])
    header: Column = (F.col(BLOCK) == 0) & (F.col(SEQ) == 0)
    as_expected = F.when(values.eqNullSafe(F.array(*[F.lit(n).cast("string") for n in headings])), F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("another header in "), FILE)).cast("boolean"))
    kept = rows.where(F.when(header, as_expected).otherwise(F.lit(True)))
    return kept.select(FILE, BLOCK, LATE, SEQ, *[F.col(f"x.c{i}").alias(n) for i, n in enumerate(names)])
