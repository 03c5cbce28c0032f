import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sequela.llm import mixing
from sequela.llm.text import running_totals


def plain_targets(sizes, share=1.5, limit=2.0):
    """Water-filling by bisection on the level, apart from the operator's rounds."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    low, high = 0.0, total + 1
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(limit * sizes[s], level * weight[s]) for s in names) < total:
            low = level
        else:
            high = level
    return {s: min(limit * sizes[s], high * weight[s]) for s in names}


@pytest.mark.parametrize("seed", range(5))
def test_targets_equal_a_plain_water_filling(seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice((0, 5, 100, 3000, 90_000)) for s in ("b", "a", "é", "Z", None, "c2", "c10")}
    if not any(sizes.values()):
        sizes["a"] = 7
    got = {s["source"]: s["target"] for s in mixing.targets(list(sizes.items()))}
    want = plain_targets(sizes)
    assert got == pytest.approx(want, rel=1e-6, abs=1e-3)
    assert all(got[s] <= 2 * n + 1e-9 for s, n in sizes.items())


def test_a_share_over_the_limit_ends_at_the_limit():
    got = mixing.targets([("a", 10), ("b", 20)], share=5)
    assert [s["target"] for s in got] == [20, 40]


@pytest.mark.parametrize("n", (1, 2, 3, 64, 997))
def test_permutations_reach_every_index_once(spark, n):
    image = mixing.permuted(F.col("id"), F.lit(n).cast("long"), [F.lit(3), F.lit(1)], 5)
    got = [r.p for r in spark.range(n).select(image.alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        assert got != sorted(got)


def test_running_totals_equal_a_loop(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.randrange(9)) for k in "ab" for i in rng.sample(range(5000), 400)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {(r.k, r.i): r.before for r in running_totals(df, ["k"], "i", "v", width=8).collect()}
    for k in "ab":
        before = 0
        for _, i, v in sorted(r for r in rows if r[0] == k):
            assert got[k, i] == before
            before += v


def mixed_rows(df):
    return [tuple(r) for r in mixing.taken_words(mixing.mix(df)).collect()]


def test_words_taken_come_near_the_targets(documents):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        source = rng.choices(("a", "b", "c", "d", None), (30, 4, 3, 2, 1))[0]
        rows.append((i, " ".join("w%d" % k for k in range(rng.randrange(0, 200))), "en", source))
    got = mixed_rows(documents(rows))
    assert sorted(r[0] for r in got) == list(range(300))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for doc_id, size, source_size, goal, words in got:
        source = rows[doc_id][3]
        assert size == len(rows[doc_id][1].split()) and 0 <= words <= 2 * size
        sizes[source] += size
        taken[source] += words
        target[source] = goal
        assert source_size == sum(len(r[1].split()) for r in rows if r[3] == source)
    assert target == pytest.approx(plain_targets(dict(sizes)))
    for source, goal in target.items():
        assert abs(taken[source] - goal) <= 2 * mixing.BLOCK
    assert sorted(got) == sorted(mixed_rows(documents(rows)))


def test_odd_rows(odd, documents):
    got = mixed_rows(odd)
    assert len(got) == odd.count()
    assert all(0 <= taken <= 2 * size for _, size, _, _, taken in got)
    assert {r[0]: r[1] for r in got}[6] == 30_001
    assert mixed_rows(documents([])) == []
    assert mixed_rows(documents([(1, None, None, None)])) == [(1, 0, 0, 0.0, 0)]


def test_mixed_documents_hold_the_words_taken(documents):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(20 + i)) + "\nlast", "en", "ab"[i % 2], 1) for i in range(40)]
    docs = documents(rows)
    taken = {r[0]: r[4] for r in mixed_rows(docs)}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = defaultdict(int)
    for doc_id, text, lang, source, n_chars in out.collect():
        own = rows[doc_id][1].split()
        assert set(text.split()) <= set(own) and n_chars == len(text) and source == rows[doc_id][3]
        if len(text.split()) == len(own):
            assert text == rows[doc_id][1]
        words[doc_id] += len(text.split())
    assert {i: n for i, n in taken.items() if n} == dict(words)


def test_too_many_sources_are_refused(documents, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 2)
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(documents([(i, "x", "en", f"s{i}") for i in range(3)]))


def test_documents_may_have_the_mix_own_column_names(documents):
    names = ("n", "spans", "pass_no", "row", "words", "_row")
    docs = documents([(i, f"a{i} b c", "en", f"s{i % 3}", 8, *"uvwxyz") for i in range(30)], extra=names)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0
    assert {tuple(r[c] for c in names) for r in out.collect()} == {tuple("uvwxyz")}
