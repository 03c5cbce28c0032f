import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sequela.llm import perplexity as P
from sequela.llm.text import words
from sequela.sources.stages import scratch_folder


def plain_model(texts):
    """Interpolated modified Kneser-Ney of order 3 by loops; returns p(w | u, v)."""
    tri = Counter()
    for t in texts:
        toks = [P.BEGIN, P.BEGIN, *t.split(), P.END]
        tri.update(zip(toks, toks[1:], toks[2:]))
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)

    def discounts(counts):
        n = Counter(min(c, 5) for c in counts.values())
        if not all(n[k] for k in (1, 2, 3, 4)):
            return lambda c: min(c, 3) / 2
        y = n[1] / (n[1] + 2 * n[2])
        d = {k: min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), k - 0.05) for k in (1, 2, 3)}
        return lambda c: d[min(c, 3)]

    def order(counts):
        d = discounts(counts)
        total, cut = defaultdict(float), defaultdict(float)
        for g, c in counts.items():
            total[g[:-1]] += c
            cut[g[:-1]] += d(c)
        return (lambda g: (counts[g] - d(counts[g])) / total[g[:-1]] if counts.get(g) else 0.0), (
            lambda ctx: cut[ctx] / total[ctx] if ctx in total else 1.0
        )

    p3, g3 = order(dict(tri))
    p2, g2 = order(dict(bi))
    p1, g1 = order({(w,): c for w, c in uni.items()})

    def prob(u, v, w):
        low = p1((w,)) + g1(()) / (len(uni) + 1)
        return p3((u, v, w)) + g3((u, v)) * (p2((v, w)) + g2((v,)) * low)

    return prob, set(uni)


def sentences(rng, n, vocab):
    return [" ".join(rng.choices(vocab, weights=range(len(vocab), 0, -1), k=rng.randrange(15, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def fitted(spark, documents):
    rng = random.Random(5)
    vocab = {"en": [f"e{i}" for i in range(60)], "de": [f"d{i}" for i in range(60)]}
    rows = []
    for lang, words in vocab.items():
        rows += [(len(rows) + i, t, lang, "s", len(t)) for i, t in enumerate(sentences(rng, 150, words))]
    docs = documents(rows)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    sample = P.labelled_sample(docs, labels, 60).collect()
    return docs, labels, rows, P.fit(docs, labels, 60), sample


def test_model_equals_plain_loops(fitted):
    _, _, _, models, sample = fitted
    assert set(models) == {"en", "de"}
    for lang, half in [(lang, half) for lang in models for half in P.HALVES]:
        model = models[lang].halves[half]
        texts = [r.text for r in sample if r.lang == lang and r.half == half]
        prob, known = plain_model(texts)
        tests = [r.text for r in sample if r.lang == lang and r.half != half][:8] + ["e1 e2 unseen e1 d5 d6", "unseen"]
        for text in tests:
            toks = [P.BEGIN, P.BEGIN, *text.split(), P.END]
            want = [math.log(prob(*g)) for g in zip(toks, toks[1:], toks[2:])]
            total, squares, n = P.log_probs(model, [text.encode().split()])[0]
            assert n == len(want)
            assert total == pytest.approx(sum(want), rel=1e-5)
            assert squares == pytest.approx(sum(x * x for x in want), rel=1e-5)
        # probabilities of all words and of an unknown one add up to one
        u, v = texts[0].split()[:2]
        assert sum(prob(u, v, w) for w in known) + prob(u, v, "unseen") == pytest.approx(1)


def test_good_texts_stay_and_strange_ones_go(fitted, documents):
    docs, _, rows, models, _ = fitted
    kept = {r.doc_id: r.kept for r in P.judge(docs, models).collect()}
    assert all(kept.values())
    rng = random.Random(1)
    odd = [
        (1, " ".join(f"zz{rng.random()}" for _ in range(60)), "en"),
        (2, " ".join(f"d{rng.randrange(60)}" for _ in range(60)), "en"),
        (3, " ".join(f"qq{rng.random()}" for _ in range(60)), "none"),
    ]
    got = {r.doc_id: r for r in P.judge(documents(odd), models).collect()}
    assert not got[1].kept and not got[2].kept
    assert got[3].kept and got[3].perplexity is None


def test_too_predictable_texts_go_while_copies_stay(documents, spark):
    rng = random.Random(8)
    vocab = [f"e{i}" for i in range(60)]
    own = sentences(rng, 200, vocab)
    copied = " ".join(rng.choices(vocab, k=80))
    near = copied.split()
    near[40] = "other"
    texts = own + [copied] * 100  # a third of the sample is one text
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    models = P.fit(documents(rows), labels, 300)
    # the two likeliest words after each other, never five words twice: what the models expect most
    often = Counter(w for t in own for w in t.split()).most_common(4)
    dull = " ".join(rng.choices([w for w, _ in often], weights=(12, 2, 2, 1), k=400))
    judged = documents([*rows, (1000, " ".join(near), "en"), (1001, dull, "en")])
    seen = {r.doc_id: r for r in P.judge(judged, models).collect()}
    spread = models["en"].spread
    # repeats fail the plain rule too, so the band is asked itself
    assert -math.log(seen[1001].perplexity) > spread.centre + spread.tail * spread.reach(401)
    dull_means, near_means = models["en"].means([dull.encode().split(), " ".join(near).encode().split()])
    assert not models["en"].inside(dull_means, 401) and not seen[1001].kept
    assert models["en"].inside(near_means, 81)
    assert sum(seen[i].kept for i in range(len(own))) >= 0.98 * len(own)
    assert all(seen[i].kept for i in [*range(len(own), len(texts)), 1000])


def test_sample_holds_one_of_near_copies(documents):
    rng = random.Random(3)
    own = sentences(rng, 30, [f"w{i}" for i in range(500)])
    near = []
    for t in own[:10] * 5:
        words = t.split() * 3
        words[rng.randrange(len(words))] = "x"
        near.append(" ".join(words))
    docs = documents([(i, t, "en") for i, t in enumerate(own + near + own + ["", "a"])])
    got = [r.text for r in P.unlike(docs.select("lang", "text")).collect()]
    assert len(got) == len(set(got)) and set(own[10:]) <= set(got)
    assert sum(t in near for t in got) <= 12


def slow_repeat(toks, window=5):
    grams = [tuple(toks[i : i + window]) for i in range(len(toks) - window + 1)]
    often = Counter(grams)
    return len({j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + window)})


def test_repeat_words_equals_a_loop():
    rng = random.Random(2)
    for _ in range(200):
        toks = [b"%d" % rng.randrange(rng.choice((1, 2, 4, 30))) for _ in range(rng.randrange(0, 60))]
        assert P.repeat_words(toks) == slow_repeat(toks)


def test_plain_counts():
    text = "a #b*\n\n a\n a\n \na\xa0b |\n a"
    toks, chars, symbols, dup, repeated = P.plain_counts(text)
    assert toks == [b"a", b"#b*", b"a", b"a", "a\xa0b".encode(), b"|", b"a"]
    assert (chars, symbols, dup, repeated) == (11, 3, 2, 0)
    assert P.plain_counts(None) == ([], 0, 0, 0, 0)


def test_base_rule(documents):
    same = " ".join(["a b c d e"] * 3)
    nine, ten = " ".join("abcdefghi"), " ".join("abcdefghij")
    got = {r.doc_id: r for r in P.judge(documents([(1, nine), (2, ten), (3, same + " " + ten)]), {}).collect()}
    assert [got[i].base_failed for i in (1, 2, 3)] == [True, False, True]
    assert got[2].kept and got[3].n_repeat_words >= 15


def test_odd_rows(odd, documents, spark, fitted):
    rows = P.judge(odd, fitted[3]).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].n_words == 0 and by_id[1].base_failed and not by_id[1].kept
    assert by_id[6].n_words == 30_001 and by_id[6].n_repeat_words == 30_000
    assert P.judge(documents([]), {}).collect() == []
    assert P.keep_good(odd, fitted[3]).columns == odd.columns
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert P.fit(odd, empty) == {}


@pytest.fixture(scope="module")
def all_labelled(spark, documents):
    """More labelled texts than a sample takes, in more languages than there were models."""
    rng = random.Random(7)
    rows = []
    for k in range(P.MAX_LANGS + 2):
        vocab = [f"{k}e{i}" for i in range(40)]
        rows += [(len(rows) + i, t, f"l{k}", "s", len(t)) for i, t in enumerate(sentences(rng, 500 if k == 0 else 80 if k == 1 else 56, vocab))]
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows], "doc_id long, quality int, toxic int")
    return documents(rows).cache(), labels, rows


def test_every_labelled_text_of_every_language_is_counted(all_labelled):
    docs, labels, rows = all_labelled
    sample = P.labelled_texts(docs, labels).collect()
    assert sorted((r.lang, r.text) for r in sample) == sorted({(r[2], r[1]) for r in rows})
    judged = P.judge_all(docs, labels).collect()
    assert len(judged) == len(rows)
    # by chance a language may have too few texts in a half
    assert sum(r.perplexity is not None for r in judged) >= 0.95 * len(rows)
    assert sum(r.kept for r in judged) >= 0.95 * len(rows)


def test_scores_by_joins_equal_plain_loops(all_labelled, documents, spark):
    docs, labels, _ = all_labelled
    sample = P.labelled_texts(docs.filter("lang in ('l0', 'l1')"), labels).cache()
    rows = sample.collect()
    tests = [(r.lang, r.text) for r in rows[:20]] + [("l0", "0e1 0e2 unseen 0e1\n1e5 0e6"), ("l1", "unseen"), ("none", "1e1 1e2")]
    table = spark.createDataFrame(tests, "lang string, text string")
    keyed = table.select(P.text_key().alias("t"), P.language_key().alias("lang"), "text")
    names = {r.t: r.text for r in keyed.collect()}
    got = {names[r.t]: r for r in P.score_all(keyed, P.fit_all(sample)).collect()}
    assert set(got) == {t for lang, t in tests if lang != "none"}
    models = {(lang, h): plain_model([r.text for r in rows if r.lang == lang and r.half == h])[0] for lang in ("l0", "l1") for h in P.HALVES}
    for lang, text in tests[:-1]:
        toks = [P.BEGIN, P.BEGIN, *text.split(), P.END]
        for h in P.HALVES:
            want = [math.log(models[lang, h](*g)) for g in zip(toks, toks[1:], toks[2:])]
            assert got[text].n == len(want)
            assert got[text][f"total{h}"] == pytest.approx(sum(want), rel=1e-5)
            assert got[text][f"squares{h}"] == pytest.approx(sum(x * x for x in want), rel=1e-5)


def test_bands_of_all_texts_equal_those_of_one_frame(all_labelled):
    docs, labels, _ = all_labelled
    sample = P.labelled_texts(docs.filter("lang = 'l0'"), labels).cache()
    keyed = sample.select(P.text_key().alias("t"), P.language_key().alias("lang"), "text")
    scores = P.score_all(keyed, P.fit_all(sample)).cache()
    halves = {r.t: r.half for r in sample.select(P.text_key().alias("t"), "half").collect()}
    s = scores.toPandas()
    for name in ("total", "squares"):
        s[name] = [y if halves[t] == 0 else x for t, x, y in zip(s["t"], s[f"{name}0"], s[f"{name}1"])]
    want, (got,) = P._spread(s), P.bands(scores, sample).collect()
    for name in ("centre", "between", "within", "tail"):
        assert got[name] == pytest.approx(getattr(want, name), abs=2e-3), name


def test_judging_by_all_texts_bears_odd_rows(odd, documents, spark, all_labelled):
    docs, labels, rows = all_labelled
    strange = documents([(10**6, " ".join(f"zz{i}" for i in range(60)), "l0"), (10**6 + 1, " ".join(f"zz{i}" for i in range(60)), "none")])
    every = docs.filter("lang = 'l0'").unionByName(odd.select(*docs.columns)).unionByName(strange)
    judged = P.judge_all(every, labels)
    seen = judged.collect()
    assert len(seen) == every.count()
    old = {r.doc_id: r for r in P.judge(odd, {}).collect()}
    by_id = {r.doc_id: r for r in seen}
    assert not by_id[10**6].kept and by_id[10**6 + 1].kept and by_id[10**6 + 1].perplexity is None
    assert by_id[6].n_repeat_words == old[6].n_repeat_words and not by_id[1].kept and by_id[1].n_words == 0
    kept = P.keep_all(every, labels)
    assert kept.columns == every.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in seen if r.kept)
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    plain = {r.doc_id: r.kept for r in P.judge_all(odd, empty).collect()}
    assert plain == {i: r.kept for i, r in old.items()}
    assert P.judge_all(documents([]), empty).collect() == []


def test_near_copies_fall_in_one_half(documents):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        words = rng.choices(vocab, k=200)
        for _ in range(2):
            near = list(words)
            near[rng.randrange(200)] = f"x{rng.random()}"
            rows.append((i, " ".join(near), "en"))
    got = P.halved(documents(rows).select("lang", "text")).collect()
    half = {r.text: r.half for r in got}
    assert len(got) == len(rows)  # none is left out
    pairs = [(half[a[1]], half[b[1]]) for a, b in zip(rows[::2], rows[1::2])]
    assert sum(x == y for x, y in pairs) >= 58 and {x for x, _ in pairs} == {0, 1}


def test_parts_and_rounds_do_not_change_scores(all_labelled, spark):
    docs, labels, _ = all_labelled
    sample = P.labelled_texts(docs.filter("lang in ('l0', 'l1')"), labels).cache()
    table = sample.select("lang", "text").limit(60).unionByName(spark.createDataFrame([("l0", "0e1 0e2 unseen 0e1"), ("none", "0e1")], "lang string, text string"))
    keyed = table.unionByName(table).select(P.text_key().alias("t"), P.language_key().alias("lang"), "text").cache()
    models = P.fit_all(sample)
    one, many = [{r.t: r[1:] for r in P.score_all(keyed, models, parts).collect()} for parts in (1, 40)]
    assert set(one) == set(many) and len(one) == 61
    for t in one:
        assert many[t] == pytest.approx(one[t], rel=1e-6)


def test_words_of_several_parts_are_dealt_evenly():
    n, often = 8, np.array([3, 5], np.int64)
    dealt = P.Parts(n, 4, 1, often, np.array([4, 2], np.int64))
    words_ = np.array([0, 0, 1, *[2 + i % 500 for i in range(2000)]], np.int32)
    g = P.Slice(np.zeros(1, int), np.zeros(1, int), np.array([len(words_) - 1]), np.arange(3, 600, dtype=np.int64), np.zeros(597, int), words_, np.arange(len(words_)) >= 2)
    found = [dealt.of(g, [r]) for r in range(4)]
    assert sorted(np.concatenate([at for at, _ in found])) == list(range(2, len(words_)))
    assert all((part % 4 == r).all() for r, (_, part) in enumerate(found))
    for i, word in enumerate(often - 3):
        of = {int(p) for at, part in found for p in part[words_[at - 1] == word]}
        assert of <= set(dealt.all_of(i).tolist())


def test_sketches_equal_those_of_spark(spark):
    texts = ["a b c d e f g", "abcdefgh " * 6, "x" * 40 + " b c \u00e9\u6f22 d " + "y" * 32 + " " + "z" * 33, "one two", "", "a" * 31 + " 1234567 12345678 123456789012 a b"]
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (P.SKETCH_WORDS - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, P.SKETCH_WORDS)))

    def smallest(k):
        return F.array_min(F.transform("runs", lambda x: F.xxhash64(x, F.lit(k))))

    least = F.array(*[smallest(k) for k in range(P.SKETCH)])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("w", words(F.col("text"))).withColumn("runs", runs)
    want = [r.least for r in df.select("i", least.alias("least")).orderBy("i").collect()]
    assert P.run_sketches(pa.array(texts)).tolist() == want


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    arrays = [np.sort(rng.integers(0, 1 << 62, 50)), rng.integers(0, 1 << 40, 50), rng.integers(0, 300, 50).astype(np.int32), np.zeros(0, np.int64), np.zeros(3, np.int64)]
    for x, y in zip(arrays, P._unpacked(P._packed(*arrays))):
        assert x.tolist() == y.tolist()


def test_lookup_equals_a_dict():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        wanted = np.concatenate([keys, rng.integers(-(1 << 63), (1 << 63) - 1, 50), [0, -1]])
        at = {k: i for i, k in enumerate(keys.tolist())}
        assert P.Lookup(keys).find(wanted).tolist() == [at.get(k, len(keys)) for k in wanted.tolist()]


def test_no_table_of_ngrams_stays_on_disk(all_labelled, spark):
    """Tables of all n-grams took over ten times the texts' bytes."""
    docs, labels, rows = all_labelled

    def on_disk():
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_folder(spark))
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    before = on_disk()
    assert P.judge_all(docs, labels).count() == len(rows)
    assert on_disk() - before < 2 * sum(len(r[1]) for r in rows)
