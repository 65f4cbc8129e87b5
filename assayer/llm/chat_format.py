"""Chat formatting from every participant's side, in DataFrame functions only.

For each participant of a conversation the dialogue is rendered with that speaker
as the assistant; all others are users with their names, and system turns stay
what they are.  The mask lists the spans of characters to learn from: what the
assistant says, with its end mark.

A dialogue is one row for each participant, however long it is: a row holds up to 2 GB, as
any text in Spark does.  Who wants rows of fewer messages names limits: ``segment_turns`` cuts every
dialogue at multiples of that many turn numbers, and ``tie_rows`` deals a turn number that more
rows have over parts of its segment, by their hashes, about as many to each.  Then a conversation with any part
of all rows is rendered by many tasks.  Such a row begins with the last system turn before
its first turn (``opened``), unless it begins with one of its own, so it holds the instructions that its turns were given under.

Defined results
  null or empty text    a turn without content
  null or empty role    the participant ``unknown``
  null turn             such rows come before all others, in a segment of their own, -1, where dialogues are cut
  null conversation     one conversation with a null id
  ties                  ordered by turn, role and text
  repeated rows         are rendered as often as they come; they are counted first, so
                        any number of them is a few rows
  system turns only     no participant, so no row
  marks within a text   ``<|`` becomes ``< |``, so no text can forge a turn
  long texts            are rendered whole; one text is part of one row for each participant
  extra columns         stay behind
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._run import cut

START, END, SYSTEM, UNNAMED = "<|im_start|>", "<|im_end|>", "system", "unknown"
_HASH_BITS = 28


def _role(role: str) -> Column:
    name = F.regexp_replace(F.trim(F.coalesce(F.col(role).cast("string"), F.lit(""))), r"\s+", "_")
    return F.when(name == "", UNNAMED).otherwise(name)


def _hash(*values: Column) -> Column:
    """The first 28 bits of the md5 of values."""
    joined = F.concat_ws("\x01", *[v.cast("string") for v in values])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, _HASH_BITS // 4), 16, 10).cast("long")


def _turns() -> Column:
    """Counted turns of a group in order, each as often as it came."""
    return F.flatten(F.transform(F.sort_array(F.collect_list("turn")), lambda m: F.array_repeat(F.struct(m["t"], m["r"], m["x"]), m["n"].cast("int"))))


def _whole(rows: DataFrame) -> DataFrame:
    """A row for each conversation and participant, with all turns in order."""
    equal = rows.groupBy("conv_id", "t", "r", "x").agg(F.count("*").alias("n"))
    each = equal.select("conv_id", F.struct("t", "r", "x", "n").alias("turn")).groupBy("conv_id").agg(_turns().alias("turns"))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda m: m["r"]), lambda r: r != SYSTEM))
    none = F.lit(0).cast("long")
    return each.select("conv_id", F.explode(speakers).alias("perspective"), none.alias("segment"), none.alias("part"), "turns", F.lit(None).cast("string").alias("ruled"))


def _parts(rows: DataFrame, segment_turns: int | None, tie_rows: int | None) -> DataFrame:
    """A row for each part of each segment and participant, with its turns in order and the system turn in force before the first.

    Both sides of the last join are tables, so it can be split where a conversation has very many rows.
    """
    equal = rows.groupBy("conv_id", "t", "r", "x").agg(F.count("*").alias("n"))
    segment = F.lit(0) if segment_turns is None else F.coalesce(F.floor(F.col("e.t") / segment_turns), F.lit(-1))
    if tie_rows is None:
        dealt, placed = F.lit(0), equal.alias("e")
    else:
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {tie_rows}")))
        some = equal.select("conv_id", "t", "r", "x", "n", chunk.alias("c"))
        some = some.withColumn("n", F.least(F.lit(tie_rows), F.col("n") - tie_rows * F.col("c"))).alias("e")
        crowded = rows.groupBy("conv_id", "t").agg(F.count("*").alias("w")).where(F.col("w") > tie_rows)
        crowded = cut(crowded, "crowded").alias("k")  # a table, so that the join can be split at a crowded turn
        placed = some.join(crowded, F.col("e.conv_id").eqNullSafe(F.col("k.conv_id")) & F.col("e.t").eqNullSafe(F.col("k.t")), "left")
        dealt = F.shiftright(F.expr(f"(w + {tie_rows - 1}) div {tie_rows}") * _hash(F.col("r"), F.col("x"), F.col("c")), _HASH_BITS)
        dealt = F.when(F.col("w").isNull(), 0).otherwise(dealt)
    turns = placed.select("e.conv_id", segment.cast("long").alias("segment"), dealt.cast("long").alias("part"), F.struct("e.t", "r", "x", "n").alias("turn"))
    parts = cut(turns.groupBy("conv_id", "segment", "part").agg(_turns().alias("turns")), "parts")
    system = rows.where(F.col("r") == SYSTEM).groupBy("conv_id", "t").agg(F.max("x").alias("x")).select("conv_id", "t", "x", F.lit(None).cast("long").alias("segment"), F.lit(None).cast("long").alias("part"))
    heads = parts.select("conv_id", F.col("turns")[0]["t"].alias("t"), F.lit(None).cast("string").alias("x"), "segment", "part")
    before = Window.partitionBy("conv_id").orderBy("t", F.col("part").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    ruled = heads.unionByName(system).withColumn("ruled", F.last("x", True).over(before)).where(F.col("part").isNotNull()).select("conv_id", "segment", "part", "ruled")
    same = F.col("p.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("p.segment") == F.col("r.segment")) & (F.col("p.part") == F.col("r.part"))
    ruled = cut(ruled.where(F.col("ruled").isNotNull()), "ruled")
    parts = parts.alias("p").join(ruled.alias("r"), same, "left").select("p.conv_id", "p.segment", "p.part", "turns", "ruled").alias("p")
    speakers = cut(rows.where(F.col("r") != SYSTEM).select("conv_id", F.col("r").alias("perspective")).distinct(), "speakers").alias("s")
    each = parts.join(speakers, F.col("p.conv_id").eqNullSafe(F.col("s.conv_id")))
    return each.select("p.conv_id", "perspective", "segment", "part", "turns", "ruled")


def rotate(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_turns: int | None = None, tie_rows: int | None = None) -> DataFrame:
    """conv_id, perspective, segment, part, n_messages, opened, text, spans (start and end of each part to learn) and n_target_chars.

    Dialogues are whole, and segment and part 0, unless a limit is given.
    """
    body = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = df.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("long").alias("t"), _role(role).alias("r"), body.alias("x"))
    each = _whole(rows) if segment_turns is None and tie_rows is None else _parts(rows, segment_turns, tie_rows)
    opened = F.col("ruled").isNotNull() & (F.col("turns")[0]["r"] != SYSTEM)

    def message(m: Column) -> Column:
        mine = m["r"] == F.col("perspective")
        head = F.when(mine, F.lit("assistant")).when(m["r"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), m["r"]))
        head = F.concat(F.lit(START), head, F.lit("\n"))
        content = F.concat(m["x"], F.lit(END))
        return F.struct(F.concat(head, content, F.lit("\n")).alias("whole"), mine.alias("mine"), F.char_length(head).alias("head"), F.char_length(content).alias("content"))

    def placed(a: Column, m: Column) -> Column:
        start = a["at"] + m["head"]
        span = F.array(F.struct(start.alias("start"), (start + m["content"]).alias("end")))
        return F.struct((start + m["content"] + 1).alias("at"), F.when(m["mine"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    keys = ["conv_id", "perspective", "segment", "part"]
    opening = F.when(F.col("opened"), F.concat(F.lit(f"{START}{SYSTEM}\n"), F.col("ruled"), F.lit(f"{END}\n"))).otherwise("")
    made = each.select(*keys, opened.alias("opened"), "ruled", F.transform("turns", message).alias("m")).select(*keys, "opened", opening.alias("opening"), "m")
    none = F.struct(F.char_length("opening").alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    made = made.select(*keys, F.size("m").cast("long").alias("n_messages"), "opened", F.concat("opening", F.array_join(F.transform("m", lambda x: x["whole"]), "")).alias("text"), F.aggregate("m", none, placed)["spans"].alias("spans"))
    return made.withColumn("n_target_chars", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
