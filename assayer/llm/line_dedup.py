"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

Lines without a word count as separators: they are never matched nor removed.
From each other line on, the fewest lines with ``run_words`` words form a gram; a
gram's hash combines those of its lines.  Winnowing selects the least gram of
every window of ``window_words`` words of starts, so a repeated run holds a
selected gram in all its copies as soon as it is about ``run_words`` and
``window_words`` long; a line of ``run_words`` words always is one by itself.

Occurrences of a selected gram are ordered by id, hash of the text, and place.  All
but the first meet the first one, line by line to both sides.  Those that leave it at
the same place with the same next line then meet the first among themselves from
there, and so on: every occurrence finds the longest agreement with any earlier one,
yet there is one row per occurrence and round, whatever the group's size.  The lines
of the later run go.  Lines around a gram are looked at as far as the next selected
gram can begin and end, ``run_words + window_words`` words; agreement beyond that is
found from that gram.

Defined results
  null text       stays null, nothing removed
  repeated rows   equal id and text: one document, each row gets the same result
  null id         comes first in the order of occurrences
  repeats inside
  a document      the later ones go
  long texts      cost work in proportion to their lines; one text is one row
  extra columns   stay, but ``n_lines`` and ``n_removed_lines`` are replaced
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._run import cut, fresh, scratch

RUN_WORDS, WINDOW_WORDS = 20, 10
_WORD = r"[^\x20\x09-\x0D]+"


def _lines(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """For each distinct document: places, hashes and numbers of words of its lines with words."""
    lines = F.transform(
        F.split(F.col(text), "\n", -1),
        lambda line, i: F.struct(i.alias("at"), F.xxhash64(line).alias("h"), F.regexp_count(line, F.lit(_WORD)).alias("n")),
    )
    rows = df.where(F.col(text).isNotNull()).select(F.col(id_column).alias("id"), F.xxhash64(text).alias("th"), F.filter(lines, lambda x: x["n"] > 0).alias("x"))
    rows = rows.select("id", "th", F.col("x.at").alias("at"), F.col("x.h").alias("h"), F.col("x.n").alias("n")).where(F.size("h") > 0)
    return rows.dropDuplicates(["id", "th"])


def _grams(run: int) -> Column:
    """Of each line from which on there are ``run`` words: the gram's hash, its place and number of lines."""

    def gram(i: Column) -> Column:
        none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("len"), F.lit(0).cast("long").alias("g"))
        lines = F.arrays_zip(F.slice("h", i + 1, F.lit(run)).alias("h"), F.slice("n", i + 1, F.lit(run)).alias("n"))
        folded = F.aggregate(lines, none, lambda a, x: F.when(a["w"] >= run, a).otherwise(F.struct((a["w"] + x["n"]).alias("w"), (a["len"] + 1).alias("len"), F.xxhash64(a["g"], x["h"]).alias("g"))))
        return F.struct(folded["g"].alias("g"), i.alias("i"), folded["len"].alias("len"), folded["w"].alias("w"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size("h") - 1), gram), lambda x: x["w"] >= run)


def _selected(window: int) -> Column:
    """The least grams of the windows; equal ones to the first."""

    def least(x: Column) -> Column:
        starts = F.aggregate(F.slice("n", x["i"] + 1, F.lit(window)), F.struct(F.lit(0).alias("w"), F.lit(0).alias("c")), lambda a, n: F.when(a["w"] >= window, a).otherwise(F.struct((a["w"] + n).alias("w"), (a["c"] + 1).alias("c"))))
        return F.array_min(F.slice("grams", x["i"] + 1, starts["c"]))

    return F.array_distinct(F.transform("grams", least))


def _agree(a: str, b: str) -> Column:
    """How many values agree from the front."""
    short = F.least(F.size(a), F.size(b))
    stop = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(stop == 0, short).otherwise(F.least(stop - 1, short)).cast("int")


def _reach(n: Column, words: int) -> Column:
    """How many lines, with ``n`` words each, begin within so many words."""
    none = F.struct(F.lit(0).alias("w"), F.lit(0).alias("c"))
    return F.aggregate(n, none, lambda a, x: F.when(a["w"] >= words, a).otherwise(F.struct((a["w"] + x).alias("w"), (a["c"] + 1).alias("c"))))["c"]


def _around(words: int) -> list[Column]:
    """Hashes before (nearest first) and after a gram that starts at line ``i`` and has ``len`` lines, as far as ``words`` from its start."""
    i, last = F.col("i"), F.col("i") + F.col("len")
    back = F.reverse(F.slice("n", F.greatest(F.lit(1), i - words + 1), F.least(i, F.lit(words))))
    left, right = _reach(back, words), _reach(F.slice("n", i + 2, F.lit(words)), words)
    before = F.reverse(F.slice("h", i - left + 1, left))
    return [before.alias("before"), F.slice("h", last + 1, F.greatest(F.lit(0), right - (F.col("len") - 1))).alias("after")]


#: Occurrences of which the first ones are sent to all executors: 10 MB of them at most.
FEW = 50_000


def _agreements(met: DataFrame) -> DataFrame:
    """id, th and spans of lines (lo, hi) in which an occurrence equals an earlier one.

    ``met`` has an occurrence of a gram in each row, twice: with the lines to its left
    and to its right (``context``), and a ``key`` that is the same for one gram and side.
    """
    spark, folder, number = met.sparkSession, scratch(met.sparkSession, "agreements"), 0
    while True:
        first = met.groupBy("key").agg(F.count("*").alias("f"), F.min(F.struct("id", "th", "i", "context")).alias("first")).where("f > 1").select("key", "first")
        # a table, so that the join can be split at a frequent key; of few occurrences no more than half as many can be first
        first = F.broadcast(first) if met.count() <= FEW else cut(first, "first")
        later = met.join(first, "key").where(~F.struct("id", "th", "i").eqNullSafe(F.struct("first.id", "first.th", "first.i")))
        here = F.when(F.col("right"), F.struct(F.col("i").alias("lo"), (F.col("i") + F.col("len") + F.col("e")).alias("hi"))).otherwise(F.struct((F.col("i") - F.col("e")).alias("lo"), (F.col("i") + F.col("len")).alias("hi")))
        further = F.when(F.col("e") < F.size("context"), F.xxhash64("key", "e", F.get("context", F.col("e"))))
        later = later.withColumn("e", _agree("context", "first.context")).select("id", "th", "i", "len", "right", "context", here.alias("span"), further.alias("key"))
        later.write.parquet(f"{folder}/round={number}")
        rows = spark.read.schema(later.schema).parquet(f"{folder}/round={number}")
        if rows.isEmpty():
            break
        met, number = rows.where("key IS NOT NULL").select("key", "id", "th", "i", "len", "right", "context"), number + 1
    return spark.read.schema(later.schema).parquet(folder).select("id", "th", "span")


def repeated_lines(df: DataFrame, *, id_column: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """id, th (hash of the text) and ``removed``, the places among all the text's lines that go."""
    docs = cut(_lines(df, id_column, text), "lines")
    prints = docs.select("id", "th", "n", _grams(run_words).alias("grams"))
    prints = cut(prints.select("id", "th", F.explode(_selected(window_words)).alias("x")).select("id", "th", "x.g", "x.i", "x.len"), "prints")
    often = cut(prints.groupBy("g").agg(F.count("*").alias("f")).where("f > 1").select("g"), "often")
    m, b = prints.join(often, "g").alias("m"), docs.alias("b")
    met = m.join(b, F.col("m.id").eqNullSafe(F.col("b.id")) & (F.col("m.th") == F.col("b.th"))).select("m.*", *_around(run_words + window_words))
    sides = F.array(F.struct(F.lit(False).alias("right"), F.col("before").alias("context")), F.struct(F.lit(True).alias("right"), F.col("after").alias("context")))
    met = met.select("g", "id", "th", "i", "len", F.explode(sides).alias("x")).select(F.xxhash64("g", "x.right").alias("key"), "id", "th", "i", "len", "x.right", "x.context")
    spans = _agreements(cut(met, "occurrences")).groupBy("id", "th").agg(F.collect_set("span").alias("spans")).alias("s")
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda v: F.slice("at", v["lo"] + 1, v["hi"] - v["lo"]))))
    return spans.join(b, F.col("s.id").eqNullSafe(F.col("b.id")) & (F.col("s.th") == F.col("b.th"))).select("s.id", "s.th", gone.alias("removed"))


def dedup(df: DataFrame, *, id_column: str = "doc_id", text: str = "text", run_words: int = RUN_WORDS, window_words: int = WINDOW_WORDS) -> DataFrame:
    """``df`` with its text less the later repeated runs, and the numbers of lines ``n_lines`` and ``n_removed_lines``."""
    gone = repeated_lines(df, id_column=id_column, text=text, run_words=run_words, window_words=window_words).alias("g")
    names, own = [c for c in df.columns if c not in ("n_lines", "n_removed_lines")], fresh(df.columns, "hash")
    docs = df.select(*[F.col(f"`{c}`") for c in names], F.xxhash64(text).alias(own)).alias("d")
    joined = docs.join(gone, F.col(f"d.{id_column}").eqNullSafe(F.col("g.id")) & (F.col(f"d.{own}") == F.col("g.th")) & F.col(f"d.{text}").isNotNull(), "left")
    lines = F.split(F.col(f"d.{text}"), "\n", -1)
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("g.removed"))
    held = F.transform(F.array(lines), lambda x: F.transform(places, lambda i: F.get(x, i)))  # split once, not for each place
    left = F.array_join(F.get(held, F.lit(0)), "\n")
    new = F.when(F.col("g.removed").isNull(), F.col(f"d.{text}")).otherwise(left)
    out = [new.alias(c) if c == text else F.col(f"d.`{c}`") for c in names]
    return joined.select(*out, F.when(F.col(f"d.{text}").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), F.coalesce(F.size("g.removed"), F.lit(0)).cast("long").alias("n_removed_lines"))
