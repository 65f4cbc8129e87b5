"""Token files, lexical search and periodic runs against brute force."""

import binascii
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from assayer.llm import bpe, lexical, periodic, quality_classifier, queries, token_files

DOCS = "/root/testdata/sf0.001"


# --- token files


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def brute_tokens(rows, library):
    """doc_id, start, n_tokens and crc of each, by rows in order of their ids."""
    out, at = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


ODD = [(7, "b"), (None, "no id"), (3, None), (3, None), (5, ""), (-2, "negative é 日本 \U0001f600"), (9, "x" * 3000), (1, "<|endoftext|> in a text"), (2**40, "far"), (4, " ".join(f"w{i}" for i in range(4000)))]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_token_files_hold_every_id(spark, tmp_path, library, encoding):
    df = spark.createDataFrame([(*r, 1) for r in ODD], "doc_id long, text string, hash int").repartition(4)
    path = str(tmp_path / "t")
    token_files.write(df, path, encoding=encoding)
    got = [tuple(r) for r in token_files.digests(token_files.read(spark, path)).collect()]
    assert sorted(got, key=str) == sorted(brute_tokens(ODD, library), key=str)
    whole = token_files.read(spark, path).orderBy("start").collect()
    assert [r.n_tokens for r in whole] == [len(r.token_ids) for r in whole] and [r.doc_id for r in whole] == [x[0] for x in brute_tokens(ODD, library)]
    slim = token_files.places(spark, path)
    assert "token_ids" not in slim._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in slim.where("doc_id IS NOT NULL").select("doc_id", "start", "n_tokens").collect()) == sorted((r.doc_id, r.start, r.n_tokens) for r in whole if r.doc_id is not None)
    some = token_files.read(spark, path, least=4, most=9)
    assert "PushedFilters" in some._jdf.queryExecution().executedPlan().toString() or "GreaterThanOrEqual" in some._jdf.queryExecution().toString()
    assert sorted(r.doc_id for r in some.collect()) == [4, 5, 7, 9]


def test_token_files_have_bounded_groups_and_page_indexes(spark, tmp_path):
    df = spark.range(0, 40_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("text"))
    for encoding, name in (("dictionary", "RLE_DICTIONARY"), ("delta", "DELTA_BINARY_PACKED")):
        path = tmp_path / encoding
        token_files.write(df, str(path), encoding=encoding, row_group_bytes=1 << 20, page_rows=100)
        files = sorted((path / "tokens").glob("*.parquet"))
        metas = [pq.ParquetFile(f).metadata for f in files]
        assert sum(m.num_row_groups for m in metas) > len(files)
        group = metas[0].row_group(0)
        columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
        assert name in columns["token_ids.list.element"].encodings and "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
        assert all(c.has_offset_index and c.has_column_index for c in (columns["doc_id"], columns["n_tokens"])) and columns["token_ids.list.element"].has_offset_index
        firsts = [m.row_group(g).column(0).statistics.min for m in metas for g in range(m.num_row_groups)]
        assert firsts == sorted(firsts)  # ranges in order, over files and groups
        shards = spark.read.parquet(f"{path}/shards").orderBy("shard").collect()
        assert [s.base for s in shards] == [sum(x.n_tokens for x in shards[:i]) for i in range(len(shards))] and sum(s.documents for s in shards) == 40_000
        grouped = token_files.shards(spark, str(path), group=2).orderBy("shard").collect()
        assert [tuple(r) for r in grouped] == [tuple(r) for r in shards]


def test_token_files_of_nothing_and_wrong_names(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    token_files.write(empty, str(tmp_path / "e"))
    assert token_files.digests(token_files.read(spark, str(tmp_path / "e"))).count() == 0 == token_files.places(spark, str(tmp_path / "e")).count()
    with pytest.raises(ValueError):
        token_files.write(empty.withColumnRenamed("doc_id", "Start"), str(tmp_path / "x"), id_column="Start")
    with pytest.raises(ValueError):
        token_files.write(empty, str(tmp_path / "x"), encoding="plain")


def test_one_id_of_many_rows_is_many_ranges(spark, tmp_path):
    df = spark.range(0, 4_000, 1, 40).select(F.lit(5).alias("doc_id"), F.lit("same text").alias("text"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in token_files.ordered(df, "doc_id", "text").groupBy("shard").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sizes) > 3 and max(sizes) < 2_000


def test_token_query_equals_the_library(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, queries.op11_token_files(spark, DOCS).collect())) == sorted(brute_tokens(rows, library))


def test_remembered_pieces_are_bounded(library):
    v = bpe.vocabulary(bpe.default_path(), bpe.default_pattern())
    rng = random.Random(1)
    before = sum(len(k) for k in v.known)
    for _ in range(20):
        v.encode("".join(rng.choices("acgt", k=50_000)) + " end")
    assert sum(len(k) for k in v.known) - before < 1000 and not v.known.long


def test_remembered_words_are_bounded():
    m = quality_classifier.Model({"\x01a": 3}, np.ones((9, 4), np.float32), np.zeros(6), np.ones(6))
    long = ["ab" * 50_000 + chr(97 + i) for i in range(9)]
    ids = [list(m._ids(f"{w} x {w}")) for w in long]
    assert all(sorted(i) == sorted(ids[0]) for i in ids) and set(m._known) == {"x"}
    quality_classifier._memory.clear()
    assert all(len(quality_classifier.stream(w)) == 2 for w in long) and not quality_classifier._memory


def test_both_engines_split_alike():
    import regex

    pattern = bpe.default_pattern()
    fast, slow, rng = bpe.plain(pattern), regex.compile(pattern), random.Random(1)
    parts = ["a", "'", " ", "\n", "\x1c", "\x85", "　", "é", "ß", "1", "²", "٣", "!", "—", "字", "ll", "re", "\t", "́", "\x00", "﻿"]
    for _ in range(1500):
        t = "".join(rng.choice([*parts, chr(rng.randrange(0xD7FF))]) for _ in range(50))
        assert fast.findall(t) == slow.findall(t)
    assert bpe.plain(r"(?i:'s)|\p{L}+") is None and bpe.plain(r"\p{Lu}+") is None


# --- lexical search


def brute_terms(t):
    lower = (t or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def brute_rank(docs, items, k=20):
    held = [(i, brute_terms(t)) for i, t in docs]
    held = [(i, w) for i, w in held if w]
    n_docs, n_words = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, w in held:
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    best = {}
    for i, t in items:
        if i is not None and t is not None:
            best[i] = max(best.get(i, ""), t)
    out = []
    for i, text in best.items():
        scores = []
        for d, w in held:
            m, s = 75 + 25 * len(w) * n_docs // n_words, 0
            for t in brute_terms(text):
                tf = w.count(t)
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))
                s += weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def words(rng, n, most=60):
    return " ".join(f"{'Wé'[rng.random() < 0.3]}{min(most, int(rng.paretovariate(0.7)))}" for _ in range(n))


@pytest.mark.parametrize("segment,fan", [(8192, 32), (16, 2), (7, 3)])
def test_rank_equals_brute_force(spark, monkeypatch, segment, fan):
    rng = random.Random(4)
    docs = [(i, words(rng, rng.randrange(1, 60))) for i in range(500)] + [(1000 + i, "W1 é2 same text") for i in range(60)] + [(2000, None), (2001, ""), (2002, "!!"), (None, "W1 W2 W3"), (7, "W1 W2"), (2003, words(rng, 9000))]
    rng.shuffle(docs)
    items = [(i, words(rng, 8)) for i in range(12)] + [(50, "W1 W1 W1 same"), (51, None), (52, "absent"), (None, "W1"), (53, ""), (50, "A"), (54, "SAME Text, same!")]
    monkeypatch.setattr(lexical.Segment.__init__, "__defaults__", (fan,))
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, item_id string").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute_rank(docs, items)
    assert sorted(map(tuple, lexical.rank(df, q, segment=segment).collect())) == want and len(want) > 200
    if fan == 2:  # queries in many blocks
        assert sorted(map(tuple, lexical.rank(df, q, segment=segment, block_bytes=200).collect())) == want


def test_ranges_are_opened_best_first_and_pruned():
    rng = np.random.default_rng(3)
    n, terms = 4096, 30
    weight = np.where(np.arange(n) < 64, 50, 1)  # the best documents stand together
    document, term = np.repeat(np.arange(n), terms), np.tile(np.arange(terms), n)
    adds = rng.integers(1, 10, n * terms) * weight[document]
    s = lexical.Segment(np.arange(n) * 3, document, term, adds.astype(np.int64), 16)
    asked, best, offered = [(t, 1 + t % 2) for t in range(10)], lexical.Best(20), []
    real = best.offer
    best.offer = lambda score, doc: offered.append(doc) or real(score, doc)
    s.search(asked, best)
    scores = np.zeros(n, np.int64)
    for t, times in asked:
        scores += adds.reshape(n, terms)[:, t] * times
    want = sorted(((-int(x), i * 3) for i, x in enumerate(scores)))[:20]
    assert sorted((-x, -d) for x, d in best.found) == want and len(offered) < n / 8


def test_equal_scores_are_opened_for_smaller_ids():
    n = 300
    ids = np.arange(n)[::1]
    s = lexical.Segment(ids, np.arange(n), np.zeros(n, np.int64), np.full(n, 5, np.int64), 4)
    best = lexical.Best(20)
    late = lexical.Segment(ids + n, np.arange(n), np.zeros(n, np.int64), np.full(n, 5, np.int64), 4)
    late.search([(0, 1)], best)
    s.search([(0, 1)], best)
    assert sorted(-d for _, d in best.found) == list(range(20))


def test_rank_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank(docs.limit(0), items).count() == 0 == lexical.rank(docs, items.limit(0)).count()
    got = lexical.rank(docs, items).collect()
    assert [tuple(r) for r in got] == brute_rank([(1, "a b")], [(1, "a")])


def test_lexical_query_equals_its_sql(spark, tmp_path):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DOCS}/{t}.parquet')")
    want = sorted(con.execute(queries.ORACLES["op12_lexical_search"]).fetchall())
    assert sorted(map(tuple, queries.op12_lexical_search(spark, DOCS).collect())) == want and len(want) > 100


# --- periodic runs


def brute_runs(w, words=6, times=4):
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, e = i, j + q
            if e - s >= max(words, times * q) and not any(all(w[k] == w[k + d] for k in range(s, e - d)) for d in range(1, q)):
                out.add((s, e - s, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic_words(rng):
    n, k = rng.choice([0, 1, 5, 6, 7, 20, 60, 150, 300]), rng.choice([1, 2, 3, 8, 50])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 8:
            a, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
            for i in range(a + p, rng.randrange(a, n)):
                w[i] = w[i - p]
    return w


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(700):
        w = periodic_words(rng)
        ids = np.array(w, np.int64)
        assert periodic.runs(ids) == brute_runs(w), w
        if w:
            counts = periodic.lag_counts(ids, len(w) // 4)
            assert all(counts[q] == sum(w[i] == w[i + q] for i in range(len(w) - q)) for q in range(len(w) // 4 + 1))
        assert periodic.runs(ids, 3, 5) == brute_runs(w, 3, 5)


def test_long_periods_and_frequent_words():
    rng = random.Random(5)
    block = [rng.randrange(40) for _ in range(700)]
    w = [rng.randrange(40) for _ in range(2_000)] + block * 5 + block[:123] + [99] * 50 + [1, 2] * 30
    found = periodic.runs(np.array(w, np.int64))
    assert found == brute_runs(w) and {q for _, _, q in found} >= {1, 2, 700}
    one = periodic.runs(np.zeros(200_000, np.int64))
    assert one == [(0, 200_000, 1)]


def brute_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = binascii.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    found = brute_runs(w)
    keep = [True] * n
    for s, length, q in found:
        keep[s + q : s + length] = [False] * (length - q)
    best = None
    for r in sorted(found, key=lambda r: (r[0], r[2])):
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *four, sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for x, k in zip(w, keep) if k)))


def test_periodic_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    rows = [tuple(r) for r in spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t if len(t or "") < 6_000 else t[:6_000]) for i, t in rows]  # brute force takes the square of a text
    rows += [(10_000 + i, " ".join(f"w{x}" for x in periodic_words(rng))) for i in range(300)] + [(None, "a " * 9), (None, None), (90_000, ""), (90_001, " \n\t"), (90_002, "é é é é é é é"), (90_002, "é é é é é é é"), (-5, "x y " * 8)]
    spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, runs string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(tuple, queries.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((brute_digest(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 60


def test_periodic_operator_on_odd_input(spark):
    df = spark.createDataFrame([(1, None), (2, "a b " * 5 + "c")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.detect(df).collect()}
    assert (got[1].n_words, got[1].runs, got[1].strongest, got[1].collapsed) == (0, [], None, "")
    assert got[2].collapsed == "a b c" and tuple(got[2].strongest) == (0, 10, 2)
    assert periodic.detect(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.detect(df, times=3)
    with pytest.raises(ValueError):
        periodic.detect(df.withColumnRenamed("doc_id", "Runs"), id_column="Runs")
