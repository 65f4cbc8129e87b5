"""Operators that treat each row by itself: quality rules, classifier, language, tokens, packing, archives, chats, search."""

import base64
import hashlib
import io
import random
import re
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import bpe, chat_format, language_id, packing, quality_classifier, quality_rules, queries, top_k, warc
from assayer.llm._run import scratch

EN = "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
DE = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde wenn können müssen schon gegen unter zwischen während straße größe".split()


def text_of(rng, words, n):
    return " ".join(rng.choices(words, weights=[1 / (i + 1) for i in range(len(words))], k=n)).capitalize() + "."


def corpus(n=120):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        words, lang = (EN, "en") if i % 3 else (DE, "de")
        junk = i % 20 in (7, 18)
        t = text_of(rng, words, 120 if junk else rng.choice([60, 150, 400]))
        if i % 20 == 7:
            t = " ".join(w + rng.choice(["%%%", "$$$", "###"]) for w in t.split())
        if i % 20 == 18:
            t = t.upper().replace(" ", "!! ")
        rows.append((i, t, lang, 0 if junk else 1))
    return rows


SCHEMA = "doc_id long, text string, lang string, quality int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


# --- quality rules


def brute_base(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_equal_brute_force(spark, docs):
    rng = random.Random(3)
    odd = [None, "", " \n\t", "a b c a b c a b c", "x\nx\n\nx y", "é#|<>*", "  \x1c", " ".join(rng.choices("ab", k=300))]
    rows = corpus() + [(1000 + i, t, None if i % 2 else "xx", None) for i, t in enumerate(odd)]
    df = spark.createDataFrame(rows, SCHEMA)
    limits = quality_rules.Limits(min_reference_words=200)
    refs = quality_rules.build_references(df, limits)
    counts = Counter()
    for _, t, la, _ in rows:
        if la == "en":
            counts.update((t or "").encode().split())
    total = sum(counts.values())
    top = [(-n, w.decode()) for w, n in counts.items() if n >= 0.002 * total]
    assert list(refs["en"].words) == [w for _, w in sorted(top)[:50]]
    assert refs["en"].word_shares.sum() == total and "xx" not in refs
    texts = {r[0]: r[1] for r in rows}
    for r in quality_rules.judge(df, refs, limits).collect():
        base = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base, texts[r.doc_id]
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in quality_rules.judge(df, refs, limits).where("kept").collect()}
    assert kept == {i for i, _, _, q in rows if q == 1}
    assert {r.doc_id for r in quality_rules.keep(df, refs, limits).collect()} == kept


def test_quality_rules_without_a_language(spark):
    rng = random.Random(6)
    rows = corpus()
    odd = [(500 + i, t, la, q) for i, t, _, q in rows for la in (None if i % 2 else f"x{i % 7}",) if i % 3 == 1 or i % 6 == 0 or not q][:60]
    odd += [(900, "12 %% 34 $ " * 40 + "5", None, 0), (901, text_of(rng, PL, 200), None, 1), (902, text_of(rng, PL, 120), "pl", 1), (903, text_of(rng, PL, 20), "pl", 0)]
    df = spark.createDataFrame(rows + odd, SCHEMA)
    limits = quality_rules.Limits(min_reference_words=5_000)
    got = {r.doc_id: r for r in quality_rules.judge(df, None, limits).collect()}
    refs = quality_rules.build_references(df, limits)
    assert sorted(refs) == ["de", "en"]
    want = {i for i, _, _, q in rows + odd if q == 1}
    assert {i for i, r in got.items() if r.kept} == want == {r.doc_id for r in quality_rules.keep(df, None, limits).collect()}
    for i, t, *_ in odd[:-4]:  # as if the row had its language
        assert (got[i].char_distance, got[i].word_distance, got[i].kept) == (got[i - 500].char_distance, got[i - 500].word_distance, got[i - 500].kept)
    assert got[901].word_distance is None and got[902].char_distance is None and got[900].char_distance > 0.2
    labelled = quality_rules.build_references(spark.createDataFrame(rows, SCHEMA), limits)
    assert {r.doc_id for r in quality_rules.judge(df, labelled, limits).where("kept").collect()} == want
    none = quality_rules.Limits(min_reference_words=10**9)
    assert quality_rules.judge(df, None, none).where("char_distance is not null").isEmpty()


def test_rare_languages_bring_few_words(spark):
    rng = random.Random(12)
    odd = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    rows = [(i, " ".join(odd() for _ in range(200)), f"r{i % 40}", 1) for i in range(400)]
    rows += [(1_000 + i, " ".join(w for _ in range(60) for w in (odd(), "of")), "junk", 1) for i in range(40)]
    refs = quality_rules.build_references(spark.createDataFrame(rows, SCHEMA).repartition(9), quality_rules.Limits(min_reference_words=2_001))
    assert set(refs) == {"junk"}
    refs = quality_rules.build_references(spark.createDataFrame(rows, SCHEMA).repartition(9), quality_rules.Limits(min_reference_words=1_000))
    assert len(refs) == 41 and all(len(r.words) <= 50 for r in refs.values()) and list(refs["junk"].words) == ["of"]
    assert refs["junk"].word_shares.tolist() == [2_400, 2_400] and refs["r1"].chars.sum() == sum(len(t) for _, t, la, _ in rows if la == "r1")


def test_distance_is_jensen_shannon():
    p, q = np.array([1.0, 0, 3]), np.array([0.0, 2, 2])
    a, b = p / 4, q / 4
    m = (a + b) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v)
    assert abs(quality_rules.js_distance(p, q) - ((kl(a) + kl(b)) / 2) ** 0.5) < 1e-12
    assert quality_rules.js_distance(p, p) == 0


def test_many_vocabularies_of_one_language(spark):
    """Candidates for common words are bounded, whatever the texts; here no word is common."""
    rows = [(i, " ".join(f"w{i}x{j % 400}" for j in range(20_000)), "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    bounds = []
    kind, real = type(df), type(df).toArrow

    def watched(self):
        out = real(self)
        bounds.append(out.num_rows)
        return out

    kind.toArrow = watched
    try:
        refs = quality_rules.build_references(df, for_others=False)
    finally:
        kind.toArrow = real
    assert set(refs) == {"en"} and not refs["en"].words and max(bounds) <= 700


def test_quality_rules_on_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep(none).count() == 0
    one = spark.createDataFrame([(None, None, None, None)], SCHEMA)
    assert quality_rules.judge(one).first().base_failed


# --- classifier


def test_classifier_on_held_out_rows(spark, docs):
    labels = docs.select("doc_id", "quality").where(F.col("doc_id") % 4 != 0)
    model = quality_classifier.learn(docs, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    rows = [(got[i], q) for i, _, _, q in corpus() if i % 4 == 0]
    assert all((s >= 0.7) == (q == 1) for s, q in rows) and all(0 <= s <= 1 for s in got.values())


def test_classifier_edge_cases(spark, docs):
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "the %%%", "x"), (3, "\x00\x01 " * 5, "x")], "doc_id long, text string, score string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("quality")).alias("quality"))
    twice = labels.union(labels).union(spark.createDataFrame([(None, 1), (10**9, 0)], "doc_id long, quality int"))
    assert quality_classifier.score(odd, quality_classifier.learn(docs, twice)).where("score between 0 and 1").count() == 4
    one_class = quality_classifier.learn(docs, docs.select("doc_id", F.lit(1).alias("quality")))
    assert quality_classifier.score(odd, one_class).first().score > 0.9
    nothing = quality_classifier.learn(docs, labels.limit(0))
    assert quality_classifier.score(odd, nothing).first().score == 0.5
    assert quality_classifier.score(docs.limit(0), nothing).count() == 0


def test_classifier_equals_brute_force(spark, docs):
    """Tokens, word vectors, pooling, network and temperature made again by plain loops."""
    rows = [r for r in corpus() if r[0] % 3 == 0] + [(700, "Fine words! " * 9_000, "en", 1), (701, None, "en", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    size, window, most = 24, 2, 60
    model = quality_classifier.learn(df, df.select("doc_id", "quality"), size=size, window=window, most_tokens=most, steps=60)

    def tokens_of(text):
        out, lines, last = [], [], None
        for line in (text or "").split("\n"):
            if not line.split():
                continue
            out += ["\x00line"] * (line in lines)
            lines.append(line)
            for w in line.split():
                core = "".join(c for c in w if c.isalnum()).lower()
                out += ([core] if core else []) + ["\x01" + quality_classifier.shape(w)] + ["\x00word"] * (w == last)
                last = w
        return out

    streams = {i: tokens_of(t) for i, t, _, _ in rows}
    times = Counter(t for s in streams.values() for t in s)
    chosen = [t for t, n in sorted(times.items(), key=lambda x: (-x[1], x[0].encode())) if n >= 3][:most]
    assert list(model.tokens) == chosen and len(chosen) == most
    index = {t: quality_classifier.index_vector(t, size) for t in chosen}
    assert all(sorted(v[v != 0] ** 2) == [1] * 8 for v in index.values())
    around = {t: np.zeros(size) for t in chosen}
    for s in streams.values():
        for k, t in enumerate(s):
            for u in [*s[max(0, k - window) : k], *s[k + 1 : k + 1 + window]]:
                if t in around and u in index:
                    around[t] += index[u]
    unit = lambda v: v / (np.sqrt((v * v).sum()) or 1)
    vectors = {t: unit(around[t]) + unit(index[t].astype(float)) for t in chosen}
    assert np.allclose(model.vectors, [vectors[t] for t in chosen], atol=1e-5)
    for i, t, _, _ in rows:
        known = [vectors[u] for u in streams[i] if u in vectors]
        want = [*(sum(known) / len(known) if known else np.zeros(size)), 1 - len(known) / max(1, len(streams[i])), np.log(1 + len(streams[i]))]
        assert np.allclose(model.pooled(t), want, atol=1e-4)
    w1, b1, w2, b2 = model.layers
    x = {i: (model.pooled(t) - model.mean) / model.spread for i, t, _, _ in rows}
    logit = {i: sum(max(0.0, sum(v[d] * w1[d][h] for d in range(size + 2)) + b1[h]) * w2[h] for h in range(len(w2))) + b2[0] for i, v in x.items()}
    got = {r.doc_id: r.score for r in quality_classifier.score(df, model).collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(-logit[i] / model.temperature))) < 1e-4 for i in got)
    order = [r.doc_id for r in df.orderBy(F.xxhash64("doc_id")).collect()]
    label = {r[0]: r[3] for r in rows}
    kept = [i for k, i in enumerate(order) if k % 5 == 4]
    trained = np.array([model.pooled(dict((r[0], r[1]) for r in rows)[i]) for i in order if i not in kept])
    assert np.allclose(model.mean, trained.mean(0), atol=1e-5)
    loss = lambda t: np.mean([np.log1p(np.exp(-logit[i] / t if label[i] else logit[i] / t)) for i in kept])
    assert loss(model.temperature) <= min(map(loss, np.geomspace(0.25, 8, 61))) + 1e-6
    assert np.mean([(logit[i] > 0) == label[i] for i in order if i not in kept]) > 0.95


def test_classifier_gradients_lower_the_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 6)).astype(np.float32)
    y = (x[:, 0] * x[:, 1] > 0).astype(np.float32)  # no single layer tells these apart
    model = quality_classifier.Model({}, np.zeros((0, 4), np.float32), np.zeros(6, np.float32), np.ones(6, np.float32))
    model = quality_classifier.fit(model, x, y, hidden=16, steps=400)
    assert ((model.logits(x) > 0) == (y > 0)).mean() > 0.93


def test_classifier_learns_from_whole_texts_of_bounded_ids(spark, docs, monkeypatch):
    seen = []
    monkeypatch.setattr(quality_classifier, "fit", lambda model, x, y, **_: seen.append((sorted(np.round(np.expm1(x[:, -1])).tolist()), len(y))))
    some = docs.where("doc_id < 10").select("doc_id", "text").union(spark.createDataFrame([(500, "long " * 30_000)] * 3, "doc_id long, text string"))
    labels = some.select("doc_id", F.lit(1).alias("quality"))
    quality_classifier.learn(some, labels)
    assert seen[0][1] == 11 and seen[0][0][-1] == 30_000 * 3 - 1  # the word, its shape, and a mark for each repeat
    quality_classifier.learn(some, labels, sample=4)
    assert seen[1][1] == 4
    quality_classifier.learn(some, labels.limit(0))
    assert seen[2] == ([], 0)


def test_pooling_knows_the_tokens_of_the_stream():
    for t in ("The the the%% x", "a b\na b\nA1!! a", "", "\n\n", "é ÉÉ--"):
        words = Counter(quality_classifier.stream(t))
        m = quality_classifier.Model({w: i for i, w in enumerate(words)}, np.eye(max(1, len(words)), dtype=np.float32), np.zeros(1), np.ones(1))
        found = Counter(list(m._ids(t)))
        assert found == Counter({m.tokens[w]: n for w, n in words.items()})


# --- language


def brute_top(text, n, orders=3):
    runs, word = [], ""
    for c in text.lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            runs.append(word)
            word = ""
    if not runs:
        return []
    joined = " " + " ".join(runs) + " "
    times = Counter()
    for k in range(1, orders + 1):
        for i in range(len(joined) - k + 1):
            g = joined[i : i + k]
            if g.strip() and " " not in g[1:-1]:
                times[g] += 1
    code = lambda g: int("".join(f"{32 if c == ' ' else ord(c):021b}" for c in g), 2)
    return [g for g, _ in sorted(times.items(), key=lambda x: (-x[1], code(x[0])))][:n]


def test_language_profiles_equal_brute_force():
    texts = {"de": "Die Straße, die große Straße! 12 ist weiß", "en": "The other, the others: a then."}
    tops = {}
    for la, t in texts.items():
        tops[la] = language_id.most_frequent(*language_id.grams(t), 30)
    p = language_id.Profiles.of(tops, 30, 20)
    for probe in ("die anderen Straßen", "the then", "x", "Ünïcödé ω"):
        mine = brute_top(probe, 20)
        want = []
        for la in p.languages:
            ranks = {g: r for r, g in enumerate(brute_top(texts[la], 30))}
            want.append(sum(min(abs(r - ranks[g]), 30) if g in ranks else 30 for r, g in enumerate(mine)) / (30 * len(mine)))
        assert np.allclose(p.distances(probe), want)
    assert p.distances("12 !?") is None and p.distances(None) is None


def test_language_on_held_out_rows(spark, docs):
    learned = language_id.held_in("doc_id", 3, 1)
    p = language_id.learn(docs.where(learned))
    got = language_id.predict(docs, p, carry=("doc_id", "lang")).collect()
    assert all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in got)
    import zlib as z

    assert {r.doc_id for r in docs.where(~learned).collect()} == {i for i in range(120) if z.crc32(str(i).encode()) % 3 == 1}


def test_language_edge_cases(spark, docs):
    odd = spark.createDataFrame([(1, None, None, 1), (2, "123 ...", "en", 1), (None, "the water", None, 1), (3, "the " * 50_000, "en", 1)], SCHEMA)
    p = language_id.learn(docs)
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(odd, p).collect()]
    assert got == [(1, "und"), (2, "und"), (None, "en"), (3, "en")]
    kept = [(r.doc_id, r.lang) for r in language_id.keep(odd, p).collect()]
    assert kept == [(None, "en"), (3, "en")]
    empty = language_id.learn(docs.limit(0))
    assert [r.lang_pred for r in language_id.predict(odd, empty).collect()] == ["und"] * 4
    assert language_id.predict(odd.limit(0), p).count() == 0


PL = "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa każdy człowiek posiada wszystkie prawa i wolności zawarte w niniejszej deklaracji bez względu na różnice rasy koloru płci języka wyznania".split()
FI = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä jokainen on oikeutettu kaikkiin tässä julistuksessa esitettyihin oikeuksiin ja vapauksiin ilman minkäänlaista rotuun väriin sukupuoleen".split()


def test_very_many_languages(spark):
    """What comes to the driver is bounded for each language, and plans don't grow with their number."""
    rng = random.Random(11)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12)), f"l{i % 1_500}", 1) for i in range(3_000)]
    rows += [(10_000 + i, "die wege der leute", "de", 1) for i in range(50)] + [(None, "the ways of people", "en", 1)] * 50
    p = language_id.learn(spark.createDataFrame(rows, SCHEMA), size=40, document_size=30)
    assert len(p.languages) == 1_502 and len(p.ranks) <= 1_502 * 40
    assert [p.nearest(t)[0] for t in ("die wege der leute", "the ways of people")] == ["de", "en"]
    with pytest.raises(ValueError, match="n-grams"):
        language_id.learn(spark.createDataFrame(rows[:5], SCHEMA), orders=4)


def test_sampled_rows_are_those_of_the_hash(spark):
    rows = [(None if i % 2 else i, f"word{'abcdefghij'[i % 10]} number{i}", "en", 1) for i in range(4_000)] + [(7, "copy copy", "en", 1)] * 4_000
    seen = language_id.learn(spark.createDataFrame(rows, SCHEMA), sample_per_language=200, size=1_000)
    assert 10 < len(seen.values) < 400
    alone = language_id.learn(spark.createDataFrame([(7, "copy copy", "en", 1)] * 500, SCHEMA), sample_per_language=10**6, size=5)
    assert len(alone.values) == 5


def test_languages_that_were_not_learned_go(spark, docs):
    rng = random.Random(5)
    letters = lambda n: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n))
    rows = [(1000 + 10 * k + i, f(n), la, 0) for k, n in enumerate((50, 100, 400)) for i, (f, la) in enumerate(((lambda n: text_of(rng, PL, n), None), (lambda n: text_of(rng, FI, n), "en"), (letters, None), (letters, "de")))]
    short = [(2000 + i, text_of(rng, EN if i % 2 else DE, n), None, 1) for i, n in enumerate((3, 3, 5, 5, 10, 10, 20, 20))]
    p = language_id.learn(docs)
    got = {r.doc_id: r.lang for r in language_id.keep(spark.createDataFrame(rows + short, SCHEMA).union(docs), p).collect()}
    assert not got.keys() & {r[0] for r in rows}
    assert {i: got.get(i) for i, _, la, _ in corpus()} == {i: la for i, _, la, _ in corpus()}
    assert {i: got.get(i) for i, *_ in short} == {i: "en" if i % 2 else "de" for i, *_ in short}


# --- tokens


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(bpe.default_path(), bpe.default_pattern())


def odd_texts():
    rng = random.Random(8)
    alphabet = "ab'st \n\t1é,.　 日本😀\r"
    return ["", " ", "<|endoftext|>", "don't  'll\n\n x", "a" * 3000, *["".join(rng.choices(alphabet, k=rng.randrange(1, 300))) for _ in range(300)]]


def test_chunks_are_stitched_as_one_text(vocabulary):
    rng = random.Random(9)
    for t in odd_texts():
        for chunk, overlap in ((7, 3), (16, 3), (50, 20), (1, 3)):
            assert bpe.pretokenise(t, vocabulary.pattern, chunk, overlap) == vocabulary.pattern.findall(t)
    long = "".join(rng.choices("ab '\n", k=20_000))
    assert bpe.pretokenise(long, vocabulary.pattern, 500, 3) == vocabulary.pattern.findall(long)


def test_tokens_equal_the_library_and_decode_back(spark, vocabulary):
    rows = list(enumerate(odd_texts())) + [(None, None), (5, "again"), (5, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (bpe.CHUNK, 11):
        ids = bpe.encode(df, chunk=chunk, overlap=4)
        texts = dict(rows[:-3])
        for r in bpe.decode(ids).collect():
            if r.doc_id in texts and r.doc_id != 5:
                assert r.token_ids == vocabulary.library.encode_ordinary(texts[r.doc_id])
                assert bytes(r.decoded) == texts[r.doc_id].encode()
    assert bpe.decode(bpe.encode(df.limit(0))).count() == 0
    for r in bpe.digests(bpe.decode(bpe.encode(df)), block=7).collect():
        if r.doc_id in texts and r.doc_id != 5:
            told = vocabulary.library.encode_ordinary(texts[r.doc_id])
            assert (r.n_tokens, r.ids_sha256) == (len(told), hashlib.sha256(" ".join(map(str, told)).encode()).hexdigest())
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_chunks_overlap_by_more_than_the_pattern_looks_ahead(vocabulary):
    rng = random.Random(10)
    for _ in range(3_000):
        t = "".join(rng.choices("a'relvst \n1", k=rng.randrange(4, 40)))
        assert bpe.pretokenise(t, vocabulary.pattern, rng.randrange(1, 9), 3) == vocabulary.pattern.findall(t)
    with pytest.raises(ValueError, match="overlap"):
        bpe.pretokenise("a" * 99, vocabulary.pattern, 5, 2)
    with pytest.raises(ValueError, match="rename"):
        bpe.refuse_clash(("doc_id", "TOKEN_IDS"), ("token_ids",))


def test_stitching_takes_linear_time(vocabulary):
    def seconds(n):
        began = time.process_time()
        assert len("".join(bpe.pretokenise(t[:n], vocabulary.pattern))) == n
        return time.process_time() - began

    t = "some words of a text, 12 " * 400_000
    least = min(seconds(4_000_000) for _ in range(2))
    assert seconds(8_000_000) < 3 * least


# --- packing


@pytest.mark.parametrize("limit", [2048, 6])
@pytest.mark.parametrize("sizes", ["mixed", "equal", "small"])
def test_packer_keeps_every_id_once(limit, sizes):
    rng = np.random.default_rng(0)
    p, texts = packing.Packer(64, limit), []
    for i in range(1500):
        n = {"mixed": int(rng.integers(1, 200)), "equal": 40, "small": int(rng.integers(1, 20))}[sizes]
        texts.append(rng.integers(0, 1000, n).astype(np.uint32))
        p.add(i, texts[-1])
        assert p.open <= limit and p.levels.sum() == p.open
    p.finish()
    found = {}
    for w in p.closed:
        assert 0 < sum(len(x.ids) for x in w) <= 64
        for x in w:
            found.setdefault(x.document, []).append(x)
    for i, t in enumerate(texts):
        pieces = sorted(found[i], key=lambda x: x.start)
        assert [x.start for x in pieces] == [0, *np.cumsum([len(x.ids) for x in pieces])[:-1]]
        assert (np.concatenate([x.ids for x in pieces]) == t).all()
    assert sum(sum(len(x.ids) for x in w) < 64 for w in p.closed) <= 1


def test_place_minimises_the_sum_of_squares():
    rng = np.random.default_rng(1)
    for _ in range(300):
        p = packing.Packer(16)
        p.levels[1:16] = rng.integers(0, 4, 15)
        size = int(rng.integers(1, 16))

        def cost(level):
            n = p.levels.copy()
            if level:
                n[level] -= 1
            if level + size < 16:
                n[level + size] += 1
            return (n[1:16] ** 2).sum()

        options = [0] + [h for h in range(1, 16 - size + 1) if p.levels[h]]
        assert cost(p.place(size)) == min(map(cost, options))


def test_packing_documents(spark, docs):
    from tokenizers import Tokenizer
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = spark.createDataFrame([(1000, None), (1001, ""), (1002, "a<|endoftext|>b"), (1003, "日本 😀\x85"), (None, "x")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(odd)
    rows = packing.pack(df.repartition(3), with_ids=True).collect()
    windows, parts = {}, {}
    for r in rows:
        assert r.length == len(r.token_ids) and r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes())
        windows.setdefault(r.sequence_id, []).append(r)
        parts.setdefault(r.doc_id, []).append(r)
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert [r.offset for r in w] == [sum(x.length for x in w[:k]) for k in range(len(w))] and sum(r.length for r in w) <= 1024
    for r in df.collect():
        pieces = sorted(parts[r.doc_id], key=lambda x: x.start)
        ids = [i for p in pieces for i in p.token_ids]
        assert ids == library.encode(r.text or "", add_special_tokens=False).ids + [0] and all(p.doc_tokens == len(ids) for p in pieces)
    assert packing.pack(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), bpe.default_pattern())


def test_ids_equal_the_library(encoder):
    for t in [*odd_texts(), "x\u0378y \U0003d000a", "\U0001f600\u0301 1\u0662"]:
        assert encoder.encode(t).tolist() == encoder.library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("run", ["\n", " ", "\t \r", "7", "!?", "ab", "\u3000", "\x85"])
def test_ids_of_runs_of_two_million(encoder, run):
    t = run * (2_000_000 // len(run)) + "x"
    assert encoder.encode(t).tolist() == encoder.library.encode(t, add_special_tokens=False).ids


def test_long_texts_take_the_faster_engine(encoder, monkeypatch):
    """Without threads no text is cut into chunks for the slower one, but those with characters that the faster one can't class."""
    slower = []
    monkeypatch.setattr(bpe, "pretokenise", lambda t, *rest: slower.append(t) or encoder.pieces.pattern.findall(t))
    rng = random.Random(11)
    long = ["".join(rng.choices("ab'st \n\t1é,.　 日本\r", k=3 * bpe.CHUNK)), "it's a word, 12 " * 9_000, " " * bpe.CHUNK + "x"]
    for t in long:
        assert encoder.encode(t).tolist() == encoder.library.encode(t, add_special_tokens=False).ids
    assert not slower
    assert encoder.encode(long[0] + "😀").tolist() == encoder.library.encode(long[0] + "😀", add_special_tokens=False).ids and len(slower) == 1


def test_new_pieces_of_many_texts_are_encoded_together(monkeypatch):
    import public_tokenizers

    encoder = packing.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"), bpe.default_pattern(), kept=50)
    told = lambda t: encoder.library.encode(t, add_special_tokens=False).ids
    texts = [*odd_texts(), "x\u0378y", "a <|endoftext|> b<|endoftext|>", "ab" * 200, "", "ab" * 200 + " c"]
    ids_of = encoder.pieces.ids_of

    def failing(piece):
        raise MemoryError

    monkeypatch.setattr(encoder.pieces, "ids_of", failing)
    with pytest.raises(MemoryError):
        encoder.encode_all(["never a place without ids"])
    monkeypatch.setattr(encoder.pieces, "ids_of", ids_of)
    assert encoder.encode("never a place without ids").tolist() == told("never a place without ids")
    for together in (1, 100, 1 << 19):
        monkeypatch.setattr(bpe, "TOGETHER", together)
        assert [x.tolist() for x in encoder.encode_all(texts)] == [told(t) for t in texts]
        assert not encoder.pieces.known.long and all(type(x) is bytes and x for x in encoder.pieces.known.values())
    assert encoder.encode_all([]) == []


def test_texts_are_split_as_by_the_library(encoder):
    """Over every assigned character, beside letters, digits and signs."""
    from tokenizers import pre_tokenizers

    theirs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    for first in range(0, 0x110000, 4_096):
        text = "".join(f"a{c}a1{c}1!{c}! {c}" for c in map(chr, range(first, first + 4_096)) if not 0xD800 <= ord(c) < 0xE000 and not packing._unassigned()[ord(c)])
        assert [text[a:b] for _, (a, b) in theirs.pre_tokenize_str(text)] == encoder.pieces.pattern.findall(text)


def test_long_white_space_packs(spark):
    df = spark.createDataFrame([(1, "\n" * 1_000_000 + "x"), (2, None)], "doc_id long, text string")
    rows = packing.pack(df).collect()
    assert {(r.doc_id, r.doc_tokens) for r in rows} == {(1, 500_003), (2, 1)} and sum(r.length for r in rows) == 500_004
    with pytest.raises(ValueError, match="rename"):
        packing.pack(df.withColumnRenamed("doc_id", "offset"), id_column="offset")


# --- archives


def archive(rows, zip64=False):
    out = io.BytesIO()
    w = warc.ArchiveWriter(warc._Counted(out), zip64)
    for i, body in rows:
        w.add("k", warc.record("response", i, "http://x", body, len(body), warc.digest(body), None))
    w.close()
    return out


@pytest.mark.parametrize("zip64", [False, True])
def test_directory_of_a_zip_file(zip64):
    out = archive([(1, b"a"), (2, b"b" * 5000)], zip64)
    found = warc.members(out, len(out.getvalue()))
    with zipfile.ZipFile(out) as z:
        assert set(found) == set(z.namelist()) and z.testzip() is None
        for name, (at, n) in found.items():
            assert out.getvalue()[at : at + n] == z.read(name)


def test_zip64_counts_and_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(65_600):
            z.writestr(f"{i}", b"")
        z.writestr("last", b"here")
        z.comment = b"PK\x05\x06 not the end"
    found = warc.members(out, len(out.getvalue()))
    at, n = found["last"]
    assert len(found) == 65_601 and out.getvalue()[at : at + n] == b"here"
    with pytest.raises(ValueError):
        warc.members(io.BytesIO(b"no zip"), 6)


def test_archives_round_trip(spark):
    rows = [(1, "u", "same"), (5, "u", "same"), (3, None, "same"), (2, "u\r\nX: y", "é<b>"), (4, "u", None), (6, "u", ""), (None, "u", "same"), (None, "u", "alone"), (7, "u", "same7"), (7, "u", "same7")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("largest", F.lit("x"))
    for settings in ({}, {"archive_bytes": 1, "zip64": True}, {"sent": 0}):
        folder = scratch(spark, "warc")
        found = warc.read(warc.write(df, folder, **settings), with_payload=True).collect()
        got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str)
        want = []
        for i, _, t in rows:
            same = [x for x, _, y in rows if (y or "") == (t or "") and x is not None]
            top = max(same, default=None)
            b = (t or "").encode()
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == top else "revisit", None if i == top else top))
        assert got == sorted(want, key=str)
        assert {r.page_id: r.payload.decode() for r in found if r.record_type == "response"}[2] == "é<b>"
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_broken_payload_is_noticed(spark, tmp_path):
    out = archive([(1, b"abc")]).getvalue()
    bad = warc.record("response", 1, "u", b"abX", 3, warc.digest(b"abc"), None)
    blob = io.BytesIO()
    w = warc.ArchiveWriter(warc._Counted(blob))
    w.add("k", bad)
    w.close()
    (tmp_path / "bad.wacz").write_bytes(blob.getvalue())
    (tmp_path / "good.wacz").write_bytes(out)
    read = lambda n: warc.read(spark.createDataFrame([(f"file://{tmp_path}/{n}.wacz",)], "archive string")).count()
    assert read("good") == 1
    with pytest.raises(Exception, match="isn't what its record says"):
        read("bad")


# --- chats


def test_every_perspective(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob lee", "yo"), (1, 2, "ann", None), (2, None, None, "x"), (2, 5, "", "y"), (None, 0, "ann", "z"), (3, 0, "system", "s"), (1, 270, "ann", "later"), (1, 270, "ann", "later")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    start = "<|im_start|>system\nbe kind<|im_end|>\n"
    first = "<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=bob_lee\nyo<|im_end|>\n"
    later = "<|im_start|>assistant\nlater<|im_end|>\n" * 2
    got = {(r.conv_id, r.perspective): r for r in chat_format.rotate(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob_lee"), (2, "unknown"), (None, "ann")}
    r = got[1, "ann"]
    assert r.text == start + first + later and not r.opened and (r.segment, r.part, r.n_messages) == (0, 0, 6)
    assert [r.text[s.start : s.end] for s in r.spans] == ["hi < |im_end|><|im_end|>", "<|im_end|>"] + ["later<|im_end|>"] * 2
    b = got[1, "bob_lee"]
    assert [b.text[s.start : s.end] for s in b.spans] == ["yo<|im_end|>"] and "user name=ann" in b.text and b.n_target_chars == 12
    assert got[2, "unknown"].text == "<|im_start|>assistant\nx<|im_end|>\n<|im_start|>assistant\ny<|im_end|>\n"
    cut = {(r.conv_id, r.perspective, r.segment): r for r in chat_format.rotate(df, segment_turns=256).collect()}
    assert set(cut) == {(1, "ann", 0), (1, "bob_lee", 0), (1, "ann", 1), (1, "bob_lee", 1), (2, "unknown", -1), (2, "unknown", 0), (None, "ann", 0)}
    assert cut[1, "ann", 0].text == start + first and not cut[1, "ann", 0].opened
    r = cut[1, "ann", 1]  # begins with the system turn again
    assert r.n_messages == 2 and r.opened and r.text == start + later
    assert [r.text[s.start : s.end] for s in r.spans] == ["later<|im_end|>"] * 2 and not cut[1, "bob_lee", 1].spans
    assert chat_format.rotate(df.limit(0)).count() == 0 == chat_format.rotate(df.limit(0), segment_turns=3, tie_rows=2).count()
    for made in (chat_format.rotate(df), chat_format.rotate(df, segment_turns=9, tie_rows=2)):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_long_dialogues_are_whole(spark):
    rows = [(1, i, "ab"[i % 2], f"turn {i}") for i in range(1_000)] + [(1, 500, "system", "new rules")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {r.perspective: r for r in chat_format.rotate(df).collect()}
    assert set(got) == {"a", "b"}
    for p, r in got.items():
        assert r.n_messages == 1_001 and len(r.spans) == 500
        assert [r.text[s.start : s.end] for s in r.spans] == [f"turn {i}<|im_end|>" for i in range(1_000) if "ab"[i % 2] == p]


def test_a_cut_row_begins_with_the_rules_in_force(spark):
    rows = [(1, 0, "system", "old rules"), (1, 3, "a", "x"), (1, 5, "system", "new rules"), (1, 12, "a", "y"), (1, 15, "system", "newest"), (1, 16, "a", "z"), (1, 20, "system", "own"), (1, 21, "a", "w")]
    rows += [(1, 34, "a", f"tie {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(chat_format.rotate(df, segment_turns=10, tie_rows=4).collect(), key=lambda r: (r.segment, r.part))
    rules = [re.match(r"<\|im_start\|>system\n(.*?)<", r.text)[1] for r in got]
    assert [r.segment for r in got[:3]] == [0, 1, 2] and rules[:3] == ["old rules", "new rules", "own"]
    assert [r.opened for r in got[:3]] == [False, True, False]
    assert len(got) > 6 and all(r.opened for r in got[3:]) and set(rules[3:]) == {"own"}
    assert sum(r.n_messages for r in got) == len(rows)


def test_crowded_turns_are_many_rows(spark):
    rows = [(1, None, "ann", f"t{i}") for i in range(2_000)] + [(1, 3, "bob", "same")] * 1_000 + [(1, 4, "system", "late"), (1, 5, "ann", "end"), (2, 0, "ann", "short")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_format.rotate(df, segment_turns=256, tie_rows=64).where("perspective = 'ann'").collect()
    assert sum(r.n_messages for r in got) == len(rows)
    crowded = [r for r in got if r.segment == -1]
    assert len(crowded) == 32 and max(r.n_messages for r in crowded) < 128
    assert sorted(t for r in crowded for t in (r.text[s.start : s.end] for s in r.spans)) == sorted(f"t{i}<|im_end|>" for i in range(2_000))
    again = [r for r in got if r.conv_id == 1 and r.segment == 0]
    assert len(again) > 4 and max(r.n_messages for r in again) <= 6 * 64 and not any(r.opened for r in got)


def test_a_crowded_conversation_is_split(spark):
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(60_000).selectExpr("IF(id % 5 = 0, NULL, id) AS conv_id", "id AS turn", "IF(id % 2 = 0, 'a', 'b') AS role", "sha2(CAST(id AS STRING), 256) AS text")
        made = chat_format.rotate(df, segment_turns=50, tie_rows=50)
        made.collect()
        assert "skew=true" in made._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_chat_queries_equal_their_sql_on_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(600)]), rng.choice(["a", "b c", "system", "", None]), rng.choice(["x", "y <|z", "", None, "long" * 9])) for _ in range(900)]
    rows += [(4, 7, "a", f"{i % 150}") for i in range(400)] + [(5, 300, "system", "s"), (5, 301, "a", "x"), (5, 900, "a", "x"), (5, 2, "b", "y")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    import duckdb

    got = {tuple(r) for r in queries.op7_chat_formatting(spark, str(tmp_path)).select("conv_id", "perspective", "segment", "part", "n_messages", "opened", "text", "spans", "n_target_chars").collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    for _ in range(5):
        want = {tuple(r) for r in con.execute(queries.ORACLES["op7_chat_formatting"]).fetchall()}
        assert got == want and len(got) > 10


# --- search


def brute_search(vectors, ask, k=5):
    out = []
    scaled = {i: top_k.scaled(v) for i, v in vectors if i is not None}
    for q in sorted(ask):
        if scaled.get(q) is None:
            continue
        pairs = [(-int(sum(int(a) * int(b) for a, b in zip(scaled[q], v))), i) for i, v in scaled.items() if i != q and v is not None and len(v) == len(scaled[q])]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(pairs)[:k])]
    return out


def vectors(n=900, d=20, scale=1.0):
    rng = np.random.default_rng(2)
    rows = [(i, (scale * rng.normal(0, 1, d)).tolist()) for i in range(n)]
    for i in range(100, 160):
        rows[i] = (i, rows[50][1])  # ties
    return rows


@pytest.mark.parametrize("scale", [1.0, 5e5])
def test_search_equals_brute_force(spark, scale):
    rows = vectors(900 if scale == 1 else 200, scale=scale) + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20), (2004, [0.5]), (2050, [0.25]), (None, [0.1] * 20), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    ask = [i for i, _ in rows if i is not None and i % 50 == 0]
    for limit in (top_k.PASS_BYTES, 1000):
        got = sorted(tuple(r) for r in top_k.search(df, df.where("vec_id % 50 = 0"), pass_bytes=limit).collect())
        assert got == brute_search(rows, ask)
        if scale > 1:
            break


def test_search_in_many_passes(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = df.where("vec_id % 7 = 0")
    want = sorted(map(tuple, top_k.search(df, ask).collect()))
    many = top_k.search(df, ask, pass_bytes=4_000)
    assert sorted(map(tuple, many.collect())) == want
    assert "Union" not in many._jdf.queryExecution().toString() and len(many._jdf.queryExecution().toString()) < 5_000  # for any number of passes


def test_search_prunes_blocks_rightly():
    rows = vectors(3000, 64)
    ids, m = np.array([i for i, _ in rows]), np.stack([top_k.scaled(v) for _, v in rows])
    s = top_k.Searcher(ids[::50], m[::50], 5)
    for a in range(0, 3000, 700):
        s.search(ids[a : a + 700], m[a : a + 700])
    want = {(q, i, x) for q, _, i, x in brute_search(rows, ids[::50].tolist())}
    assert set(s.found()) == want


def test_search_with_few_or_no_candidates(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k.search(df, df.where("vec_id = 0")).collect()] == [(0, 1, 1, 131072)]
    assert top_k.search(df.limit(0), df).count() == 0 and top_k.search(df, df.limit(0)).count() == 0
