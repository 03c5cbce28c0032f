import random

import pytest

from sequela.llm import decontaminate as D


def slow_score(a, b):
    """Smith-Waterman by the textbook's double loop."""
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = max(
                0, table[i][j] + (D.MATCH if x == y else D.MISMATCH), table[i][j + 1] + D.GAP, table[i + 1][j] + D.GAP
            )
    return max(map(max, table))


def test_alignment_equals_the_textbook():
    rng = random.Random(1)
    for _ in range(200):
        a = [str(rng.randrange(5)) for _ in range(rng.randrange(0, 25))]
        b = [str(rng.randrange(5)) for _ in range(rng.randrange(0, 15))]
        score, matches, first, last = D.smith_waterman(a, b)
        assert score == slow_score(a, b)
        if score:
            assert 0 <= first <= last < len(a) and 0 < matches <= min(len(a), len(b))


@pytest.fixture(scope="module")
def items(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"b{rng.randrange(4000)}" for _ in range(rng.choice((12, 25, 50))))) for i in range(20)]
    return spark.createDataFrame(rows, "item_id long, text string"), rows


def hidden(rng, words, passage):
    at = rng.randrange(len(words) + 1)
    return " ".join([*words[:at], *passage, *words[at:]])


def test_copies_and_edited_copies_are_found(documents, items):
    table, rows = items
    rng = random.Random(8)
    docs, want = [], set()
    for i in range(200):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(0, 300))]
        item, text = rows[rng.randrange(20)]
        passage = text.split()
        if i % 4 == 1:
            passage = [p.upper() for p in passage]
        if i % 4 == 2:  # every eighth word changed, one dropped
            passage = [f"e{k}" if k % 8 == 5 else p for k, p in enumerate(passage)]
            del passage[3]
        if i % 4 == 3:
            passage = passage[:3]  # too little to be a copy
        else:
            want.add((i, item))
        docs.append((i, hidden(rng, words, passage)))
    got = D.find_leaks(documents(docs), table).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    for r in got:
        part = docs[r.doc_id][1].lower().split()[r.first : r.last + 1]
        assert slow_score(part, rows[r.item_id][1].split()) == r.score and 0.5 <= r.share <= 1


def test_an_item_that_was_copied_often_keeps_its_seeds(documents, items):
    table, rows = items
    docs = [(i, f"x{i} " + rows[0][1]) for i in range(300)]
    assert D.find_leaks(documents(docs), table).count() == 300


def test_all_pairs_by_brute_force(documents, items):
    """Every pair that alignment of whole texts calls a leak is found from seeds."""
    table, rows = items
    rng = random.Random(11)
    docs = []
    for i in range(40):
        text = rows[i % 20][1].split()
        kept = [p if rng.random() > 0.15 else f"z{rng.randrange(99)}" for p in text]
        docs.append((i, hidden(rng, [f"w{rng.randrange(50)}" for _ in range(60)], kept)))
    want = {
        (d, i)
        for d, t in docs
        for i, b in rows
        if 2 * slow_score(t.split(), b.split()) >= D.MATCH * len(b.split())
    }
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(documents(docs), table).collect()}
    # a text without three words in a row of an item has no seed
    assert got <= want
    for d, i in want - got:
        grams = lambda t: {tuple(t[k : k + 3]) for k in range(len(t) - 2)}
        assert not grams(docs[d][1].split()) & grams(rows[i][1].split())


def test_edited_copies_beside_many_clean_ones(documents, items):
    """Every fourth word changed, from any place on, whatever the clean copies are."""
    table, rows = items
    docs = [(i, f"x{i} {rows[i % 20][1]}") for i in range(100)]
    for i in range(80):
        words = [f"e{i}" if k % 4 == i // 20 else w for k, w in enumerate(rows[i % 20][1].split())]
        docs.append((1000 + i, " ".join([f"y{i}", *words, "z"])))
    want = {(d, i) for d, t in docs for i, b in rows if slow_score(t.split(), b.split()) >= len(b.split())}
    assert len({d for d, _ in want if d >= 1000}) > 60
    assert {(r.doc_id, r.item_id) for r in D.find_leaks(documents(docs), table).collect()} == want


def test_odd_rows(odd, documents, spark, items):
    table, rows = items
    extra = spark.createDataFrame([(100, None), (101, ""), (None, "a null item of five words"), (102, "two words"), (0, rows[0][1])], table.schema)
    both = table.unionAll(extra)
    assert D.find_leaks(odd, both).collect() == []
    assert D.find_leaks(documents([]), both).collect() == []
    none = spark.createDataFrame([], table.schema)
    assert D.find_leaks(odd, none).collect() == []
    docs = documents([(1, rows[0][1]), (1, rows[0][1]), (None, rows[0][1])])
    assert [(r.doc_id, r.item_id, r.share) for r in D.find_leaks(docs, both).collect()] == [(1, 0, 1.0)]
    left = D.without_leaks(docs, both)
    assert left.columns == docs.columns and [r.doc_id for r in left.collect()] == [None]
