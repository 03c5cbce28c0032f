import random
import re
from collections import Counter

import pytest

from sequela.llm import phrases as P


def plain(rows):
    """Ranked phrases of each lang from a count of every run of one to four words."""
    counts, sizes = {}, Counter()
    for _, text, lang, *_rest in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, 5):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= P.MIN_COUNT}
        kept = []
        for p, a in found.items():
            around = (q for q in found if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
            if any(100 * found[q] >= 80 * a for q in around):
                continue
            cut = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            k = cut[1]
            kept.append((-cut[0], -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[: P.TOP], 1):
            out.append((lang, rank, p.decode(), -a, l, r, sizes[lang], -score))
    return sorted(out)


def corpus(seed, n=250):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "city", "é", "漢字", "x\u0001", "x", "a\u0000b", "rare"] + [f"w{i}" for i in range(40)]
    stock = [" ".join(rng.choices(words, k=rng.randrange(2, 6))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(stock) if rng.random() < 0.6 else " ".join(rng.choices(words, k=rng.randrange(5))) for _ in range(8)]
        text = "".join(p + rng.choice((" ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "! ")) for p in parts)
        rows.append((i, rng.choice((text, text, text.upper(), None if i % 50 == 0 else text)), rng.choice(("en", "en", "de", None, "und"))))
    return rows


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(3))
def test_phrases_equal_a_plain_count(documents, seed):
    rows = corpus(seed)
    want = plain(rows)
    assert len(want) > 20
    assert got(P.collocations(documents(rows))) == want


def test_small_budget_slices_filters_and_top(documents, monkeypatch):
    rows = corpus(4, 400)
    # pairs above the budget are extended, slices hold few texts, the filters let rare prefixes through
    for name, value in (("BUDGET", 64), ("FILTER_BITS", 1 << 6), ("BYTES", 2000), ("TOP", 9)):
        monkeypatch.setattr(P, name, value)
    want = plain(rows)
    assert any(r[1] == 9 for r in want)
    assert got(P.collocations(documents(rows), top=9)) == want


def test_ties_and_contained_phrases(documents):
    rows = [(i, "a b c d. e f! g h", "en") for i in range(30)] + [(i, "b c", "en") for i in range(8)]
    want = plain(rows)
    # "b c" has 38 occurrences, 30 of them in longer phrases: 30 * 100 < 80 * 38
    assert {r[2] for r in want} == {"a b c d", "b c", "e f", "g h"}
    assert got(P.collocations(documents(rows))) == want


def test_scores_do_not_overflow(spark):
    rows = [("en", "a", 5 * 10**18, 1), ("en", "b", 4 * 10**18, 1), ("en", "a b", 4 * 10**18, 2)]
    phrases = spark.createDataFrame(rows, "lang string, phrase string, n long, words int")
    out = P.scored(P.with_parts(phrases.filter("words = 2"), phrases, 9 * 10**18)).collect()
    assert [r.cut.score for r in out] == [2_000_000 * 4 * 10**18 // (9 * 10**18)]


def test_odd_rows(odd, documents):
    rows = [tuple(r) for r in odd.collect()]
    assert got(P.collocations(odd)) == plain(rows)
    assert got(P.collocations(documents([]))) == []
    assert got(P.collocations(documents([(1, None), (2, ""), (3, ".,; \n")]))) == []
