import random
from itertools import combinations

import corpus_pipeline
import pytest

from sequela.llm import setjoin
from sequela.llm.components import components


def plain(rows):
    """n_shingles and component by comparing all pairs of word shingles."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").lower().split() if text is None or text.isascii() else text.split()
        sets[doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 85 * len(x | y) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if v == high else v for i, v in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"x{rng.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"y{rng.randrange(10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


def corpus(seed, n=120):
    """Texts of many sizes with copies, near copies in chains, and shared passages."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = rng.choices(vocab, k=30)
    rows, bases = [], []
    for _ in range(n):
        kind = rng.random()
        if bases and kind < 0.5:
            words = edited(rng, rng.choice(bases), rng.randrange(0, 4))
        else:
            words = rng.choices(vocab, k=rng.choice((1, 2, 3, 4, 6, 9, 12, 15, 17, 25, 40, 90)))
            if rng.random() < 0.4:
                words += passage
        bases.append(words)
        rows.append((len(rows), " ".join(words)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_brute_force(documents, seed, monkeypatch):
    if seed == 3:  # common shingles go last; the result is the same
        monkeypatch.setattr(setjoin, "LOCAL_COUNT", 2)
        monkeypatch.setattr(setjoin, "HOT_COUNT", 3)
    rows = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join_documents(documents(rows)).collect()}
    assert got == plain(rows)
    assert got == setjoin.brute_force(rows)
    # the fixture has links, and sets on both sides of the boundary
    assert len({c for _, c in got.values()}) < len(rows) and {n > 20 for n, _ in got.values()} == {True, False}


def test_a_large_group_of_near_copies(documents):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(edited(rng, base, i % 3))) for i in range(150)] + [(900, " ".join(base[:100]))]
    got = {r.doc_id: r.component_id for r in setjoin.join_documents(documents(rows)).collect()}
    assert got == {i: c for i, (_, c) in plain(rows).items()}


def all_links(rows, percent=85):
    """Number of documents that each links with, by comparing all pairs."""
    sets = {}
    for doc_id, text in rows:
        w = text.split()
        sets[doc_id] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)}
    links = dict.fromkeys(sets, 0)
    for a, b in combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
    return links


@pytest.mark.parametrize(("sets", "shingles"), [(512, 1 << 18), (5, 1 << 18), (512, 300)])
def test_all_links_are_counted(documents, sets, shingles, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK_SETS", sets)  # the same counts when groups are cut into blocks
    monkeypatch.setattr(setjoin, "BLOCK_SHINGLES", shingles)
    monkeypatch.setattr(setjoin, "MATRIX", 2000)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = corpus(7, 80) + [(1000 + i, " ".join(edited(rng, base, i % 4))) for i in range(60)]
    rows += [(2000 + i, " ".join(base[: 100 + i % 50])) for i in range(70)]
    got = {r.doc_id: r.links for r in setjoin.join_documents(documents(rows)).collect()}
    want = all_links(rows)
    assert got == want and max(want.values()) > 30


def test_matrix_of_links_and_what_spans_it():
    sets = [{1, 2, 3, 4}, {1, 2, 3, 4, 5}, {1, 2, 3, 4, 5, 6}, {9}, {9, 10}]
    flat = setjoin.np.array([x for s in sets for x in sorted(s)], "int64")
    near = setjoin.linked_sets(flat, setjoin.np.array([len(s) for s in sets]), 80)
    assert [tuple(p) for p in setjoin.np.argwhere(near)] == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert len(setjoin.spanning(near)[0]) == 2


def test_least_overlap_and_prefix_are_exact():
    for a in range(1, 60):
        for b in setjoin.partner_sizes(a):
            o = setjoin.least_overlap(a, b)
            assert 100 * o >= 85 * (a + b - o) and 100 * (o - 1) < 85 * (a + b - o + 1)
        assert setjoin.prefix_size(a) == a - -(-85 * a // 100) + 1


def test_boundary_weighs_subsets_against_lists():
    assert setjoin.boundary({}) == 0
    assert 5 <= setjoin.boundary({n: 100 for n in range(1, 31)}) < 25


def test_odd_rows(odd, documents):
    got = [tuple(r) for r in setjoin.join_documents(odd).collect()]
    assert len(got) == odd.count()
    by_id = {r[0]: r for r in got}
    assert by_id[1][1:3] == (0, 1) and by_id[2][1:3] == (0, 2) and by_id[3][1:3] == (0, 3)
    assert by_id[5][1:3] == (1, 5) and by_id[6][1:3] == (2, 6)
    assert [r[3] for r in got if r[0] == 4] == [1, 1]
    assert setjoin.join_documents(documents([])).collect() == []


def test_one_of_each_keeps_the_smallest(documents):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(3, text), (2, text), (9, "another text of its own here"), (None, text), (4, None)]
    docs = documents(rows)
    out = setjoin.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [2, 4, 9, None]


def test_the_pipeline_takes_five_words_and_eighty_percent(spark, documents):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, *(f"x{i}" for i in range(20))]))]
    rows += [(10 + i, text) for i, text in corpus(5, 80)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} or {tuple(t.split())} for i, t in rows}
    label = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if v == high else v for i, v in label.items()}
    kept = {r.doc_id for r in corpus_pipeline.near_copies(spark, documents(rows), "").collect()}
    assert label[2] == 1 and kept == set(label.values())


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    label = {n: n for e in edges for n in e}
    for a, b in edges:
        low, high = sorted((label[a], label[b]))
        label = {n: low if v == high else v for n, v in label.items()}
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.label for r in got} == label
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
