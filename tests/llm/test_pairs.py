"""MinHash near-dedup, line dedup and components against brute force."""

import collections
import os
import random

import numpy as np
import pytest

from assayer.llm import components, line_dedup, minhash, shingles

WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + more)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3, bases=12, copies=14):
    """Bases with copies of few to many changed words, exact copies, other cases and spaces, short and empty texts."""
    rng, rows = random.Random(seed), []
    for _ in range(bases):
        words = rng.choices(WORDS, k=rng.choice([6, 30, 90, 200]))
        for _ in range(copies):
            w = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append(rng.choice([" ", "\n", "\t  "]).join(w if rng.random() < 0.8 else [x.upper() for x in w]))
    rows += [None, "", " \n", "one", "One", "one two", "a b c d e", "a b c d e f", "é b c d e", "É b c d e"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("percent", [85, 80])
def test_components_equal_brute_force(spark, percent):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link(docs(spark, rows), percent=percent).collect()}
    assert got == brute_components(rows, percent)


def test_components_of_the_documents_equal_an_exact_join(spark):
    """Every pair that shares a shingle, counted; over all documents of a bundled table."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no bundled tables here")
    rows = [tuple(r) for r in spark.read.parquet(path).select("doc_id", "text").collect()]
    sets = {i: shingle_set(t) for i, t in rows}
    holders, shared = collections.defaultdict(list), collections.Counter()
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for h in holders.values():
        shared.update((a, b) for k, a in enumerate(sorted(h)) for b in sorted(h)[k + 1 :])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r.doc_id: r.component_id for r in minhash.link(spark.read.parquet(path), percent=85).collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(got)


def test_large_near_group_with_outsiders(spark):
    """Copies of one base that differ from each other: only some are linked, none by way of all pairs."""
    rng = random.Random(5)
    base = rng.choices(WORDS, k=150)
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(i % 6):
            w[rng.randrange(150)] = f"x{rng.randrange(60)}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.link(docs(spark, rows), percent=85).collect()}
    assert got == brute_components(rows, 85)


def test_minhash_edge_cases(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (None, None), (3, None)]
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, component_id int, kept string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.link(df).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True), (3, 0, 3, True)], key=str)
    assert minhash.link(docs(spark, [])).count() == 0
    assert minhash.link(docs(spark, [(5, "")])).first().component_id == 5


def test_shingle_sets_equal_plain_ones():
    texts = [t for _, t in corpus(9)] + [" nbsp stays inside words here now", "x" * 3000 + " " + "y " * 50]
    for size in (64, 1 << 19):
        got = shingles.shingle_sets(texts, group_bytes=size)
        assert [len(s) for s in got] == [len(shingle_set(t)) for t in texts]
    by_hash = {}
    for t, s in zip(texts, got):
        assert by_hash.setdefault(shingle_set(t), s.tobytes()) == s.tobytes()


def test_signature_estimates_similarity():
    a, b = (np.unique(shingles.mix(np.arange(x, x + 1000, dtype=np.uint64))) for x in (0, 100))
    mh = shingles.MinHash(400)
    assert abs((mh.signature(a) == mh.signature(b)).mean() - 900 / 1100) < 0.08


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, i) for i in range(4000, 4100)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.id: r.root for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# --- line dedup


def line(rng, n):
    return " ".join(rng.choices(WORDS, k=n))


def brute_lines(rows, run=line_dedup.RUN_WORDS, window=line_dedup.WINDOW_WORDS):
    """Every pair of equal grams, extended as far as it goes; the order of grams is the one thing taken from the hashes."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    text_hash = lambda b: signed(xxhash.xxh64_intdigest(b, seed=42))
    fold = lambda v, seed: signed(xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed & ((1 << 64) - 1)))
    table = {(i, text_hash(t.encode())): [(k, x, len(x.encode().split())) for k, x in enumerate(t.split("\n")) if x.encode().split()] for i, t in rows if t is not None}
    prints = []
    for key, ls in table.items():
        grams = []
        for a in range(len(ls)):
            n = words = g = 0
            while a + n < len(ls) and words < run:
                g, words, n = fold(text_hash(ls[a + n][1].encode()), fold(g, 42)), words + ls[a + n][2], n + 1
            if words >= run:
                grams.append((g, a, n))
        chosen = set()
        for a in range(len(grams)):
            n = words = 0
            while a + n < len(ls) and words < window:
                words, n = words + ls[a + n][2], n + 1
            chosen.add(min(grams[a : a + n]))
        prints += [(tuple(x[1] for x in ls[a : a + n]), key, a, n) for _, a, n in chosen]
    places, gone = collections.defaultdict(list), collections.defaultdict(set)
    for content, key, a, n in prints:
        places[content].append((key, a))
    for content, key, a, n in prints:
        mine = table[key]
        for k0, a0 in places[content]:
            if (k0, a0) >= (key, a):
                continue
            theirs, lo, hi = table[k0], 0, 0
            while a - lo > 0 and a0 - lo > 0 and mine[a - lo - 1][1] == theirs[a0 - lo - 1][1]:
                lo += 1
            while a + n + hi < len(mine) and a0 + n + hi < len(theirs) and mine[a + n + hi][1] == theirs[a0 + n + hi][1]:
                hi += 1
            gone[key] |= {mine[j][0] for j in range(a - lo, a + n + hi)}
    return {i: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i, text_hash(t.encode())]) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    shared = [[line(rng, rng.choice([1, 2, 5, 12, 30])) for _ in range(rng.randrange(2, 14))] for _ in range(8)]
    rows = []
    for i in range(60):
        ls = []
        for _ in range(rng.randrange(1, 5)):
            ls += rng.choice(shared) if rng.random() < 0.5 else [line(rng, rng.choice([0, 1, 4, 25])) for _ in range(3)]
        rows.append((i, "\n".join(ls)))
    rows += [(100, ""), (101, None), (102, "\n\n"), (103, "short"), (104, "\n".join([line(rng, 1)] * 80))]
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_runs_that_a_later_copy_shows(spark):
    rng = random.Random(8)
    for trial in range(4):
        g, x, y, z = line(rng, 25), line(rng, 8), line(rng, 7), line(rng, 6)
        a, b = "\n".join([g, x]), "\n".join([y, z, g, x])
        rows = [(1, g), (2, a), (3, a), (4, b), (5, b), (6, "\n".join([z, g])), (7, "\n".join([y, z, g]))]
        got = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows)).collect()}
        assert got == brute_lines(rows) == {1: g, 2: x, 3: "", 4: "\n".join([y, z]), 5: "", 6: "", 7: ""}


def test_many_documents_that_share_different_parts(spark):
    rng = random.Random(9)
    ls = [line(rng, rng.choice([2, 3, 6, 11, 22])) for _ in range(30)]
    rows = [(i, "\n".join(ls[a : a + rng.randrange(1, 16)] + [line(rng, 3)] * rng.randrange(2))) for i in range(120) for a in [rng.randrange(28)]]
    got = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_passages_go_and_clean_lines_stay(spark):
    rng = random.Random(6)
    passages = [line(rng, 60), "\n".join(line(rng, 12) for _ in range(6))]
    rows = [(i, "\n".join([line(rng, 30), passages[i % 2], line(rng, 30), "short line"])) for i in range(40)]
    out = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows)).collect()}
    for i, t in rows:
        assert (passages[i % 2] in out[i]) == (i < 2)
        assert all(x in out[i] for x in (t.split("\n")[0], "short line"))


def test_line_dedup_edge_cases(spark):
    rng = random.Random(7)
    p = line(rng, 40)
    rows = [(1, p + "\nx", "s", 9), (1, p + "\nx", "s", 9), (None, p, None, None), (2, p + "\n\n" + p, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, th string, n_removed_lines long")
    out = sorted(((r.doc_id, r.text, r.th, r.n_lines, r.n_removed_lines) for r in line_dedup.dedup(df).collect()), key=str)
    assert out == sorted([(1, "x", "s", 2, 1), (1, "x", "s", 2, 1), (None, p, None, 1, 0), (2, "", "s", 3, 2)], key=str)
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.dedup(docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
