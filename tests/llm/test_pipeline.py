"""The pipeline's stages, each against what it should keep of its own input, and the queries against SQL."""

import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from assayer.llm import queries
from assayer.llm._run import cut
from test_pairs import brute_components, brute_lines
from test_rows import corpus

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, t, la, "s", len(t)) for i, t, la, _ in corpus()]
    rows += [(200 + k, rows[k][1] + " " + rng.choice("xyz"), rows[k][2], "s", 1) for k in range(5)] + [rows[9], (300, None, None, None, None), (None, rows[3][1], None, "s", 3)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages_keep_columns_and_decide(spark, docs):
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SF)
        assert out.columns == docs.columns, name
        before, after = {r.doc_id for r in seen.collect()}, {r.doc_id for r in out.collect()}
        assert after <= before
        if name == "quality_rules":
            assert after >= {i for i, _, _, q in corpus() if q == 1} and not after & {i for i, _, _, q in corpus() if q == 0}
        if name == "language_id":
            assert 300 not in after and out.where("lang is null").isEmpty()
        if name == "line_dedup":
            want = brute_lines([(r.doc_id, r.text) for r in seen.distinct().where("doc_id is not null").collect()])
            got = {r.doc_id: r.text for r in out.where("doc_id is not null").collect()}
            assert all(got[i] == want[i] for i in got if i not in (3,))
        if name == "minhash_near_dedup":
            rows = [(r.doc_id, r.text) for r in seen.where("doc_id is not null").distinct().collect()]
            roots = {c for _, c in brute_components(rows, 80).values()}
            assert after - {None} == roots and out.groupBy("doc_id").count().where("count > 1").isEmpty()
        seen = spark.createDataFrame(out.collect(), SCHEMA)
    packed = corpus_pipeline.STAGES[-1][1](spark, seen, SF).collect()
    assert held_ids(packed, [(r.doc_id, r.text) for r in seen.collect()]) > 20


def held_ids(pieces, docs):
    """Asserts that every id of every document lies in one piece and every window has no gap; returns how many windows there are."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, windows = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        windows.setdefault(p.sequence_id, []).append(p)
    assert sorted(map(str, by_doc)) == sorted(str(i) for i, _ in docs)  # each document once
    for i, text in docs:
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    return len(windows)


def test_stages_take_empty_tables(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_queries_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        found = queries.QUERIES[name](spark, SF)
        cols = sorted(found.columns)
        want = c.execute(f"SELECT {', '.join(cols)} FROM ({sql}) t").fetchall()
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in found.select(*cols).collect()), name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_run(spark):
    pieces = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.drop("text")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, SF), "stage")
    assert 0 < docs.count() < kept.count()
    held_ids(pieces.collect(), [(r.doc_id, r.text) for r in docs.collect()])
