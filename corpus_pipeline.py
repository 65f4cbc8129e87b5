"""Documents to packed windows, by five operators of ``assayer.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import language_id, line_dedup, minhash, packing, quality_rules
from assayer.llm._run import cut, fresh

#: No stage but a few counts can be said in SQL: the tests hold each against brute force.
ORACLE_SQL = None


def _quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep(docs)


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go; a missing ``lang`` is filled in."""
    return language_id.keep(docs, language_id.learn(docs))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and so does a document that has no word left."""
    done = line_dedup.dedup(docs)
    left = done.where((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(F.col("n_removed_lines") == 0, F.col("n_chars")).otherwise(F.char_length("text").cast("long"))).select(*docs.columns)


def _minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once.

    Documents are near from a similarity of 0.8 on, the least that near duplicates take
    where no contract says otherwise (``op1`` is bound to 0.85).  Copies have lost what
    they repeat in the stage before, so little of them is left to be alike.
    """
    stays, own = minhash.link(docs, percent=80).where("kept").select("doc_id").distinct().alias("s"), fresh(docs.columns, "hash")
    rows = docs.withColumn(own, F.xxhash64("text")).alias("d")
    kept = rows.join(stays, F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).select(*docs.columns)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", _quality_rules),
    ("language_id", _language_id),
    ("line_dedup", _line_dedup),
    ("minhash_near_dedup", _minhash),
    ("packing", _packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
