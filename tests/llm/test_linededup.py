import random

import pytest

from sequela.llm import linededup as L


def maximal(rows):
    """Removed line numbers of each row: whole common runs of any two places, from MIN_WORDS words on."""
    lines = []  # (place in the order of ids, row, line number, text, words)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    for row in order:
        split = (rows[row][1] or "").split("\n")
        lines += [(row, no, line.strip(" "), len(line.split())) for no, line in enumerate(split) if line.split()]
    gone = {}
    for i, (row, *_rest) in enumerate(lines):
        for j in range(i):
            k = 0
            while i + k < len(lines) and (lines[i + k][0], lines[j + k][0]) == (row, lines[j][0]) and lines[i + k][2] == lines[j + k][2]:
                k += 1
            if sum(n for *_, n in lines[i : i + k]) >= L.MIN_WORDS:
                gone.setdefault(row, set()).update(no for _, no, *_ in lines[i : i + k])
    return gone


def corpus(seed):
    rng = random.Random(seed)
    stock = [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice((1, 2, 4, 12)))) for _ in range(12)]
    rows = []
    for i in range(60):
        if rows and rng.random() < 0.3:
            rows.append((i, rng.choice(rows)[1]))
            continue
        lines = [rng.choice(stock) if rng.random() < 0.7 else f"own {i} {k} " + "x " * rng.randrange(9) for k in range(rng.randrange(0, 14))]
        for _ in range(rng.randrange(2)):
            lines.insert(rng.randrange(len(lines) + 1), "  ")
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_removed_lines_equal_a_plain_search(documents, seed):
    rows = corpus(seed)
    want = maximal(rows)
    assert sum(map(len, want.values())) > 20
    got = {r.doc_id: r for r in L.repeated_lines(documents(rows)).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        lines = text.split("\n")
        spans = [n for s in got[doc].removed for n in range(s["first"], s["last"] + 1) if lines[n].split()]
        assert sorted(spans) == sorted(want.get(i, ()))
        assert got[doc].n_removed == len(want.get(i, ())) and got[doc].n_lines == len(lines)


def test_rows_without_id_and_rows_of_one_id_equal_a_plain_search(documents):
    rows = [(None if i % 9 == 4 else i - i % 4, text) for i, text in corpus(9)]
    want = sorted(len(lines) for lines in maximal(rows).values())
    assert len(want) > 10
    # rows of one id follow the order of the table, so it has one partition here
    got = L.repeated_lines(documents(rows).coalesce(1)).collect()
    assert len(got) == len(rows) and sorted(r.n_removed for r in got if r.n_removed) == want


def test_short_last_lines_of_a_repeat_go(documents):
    run = " ".join(f"w{i}" for i in range(60)) + "\na b c d e"
    rows = [(i, f"{run}\nown line of document {i}") for i in range(4)]
    got = {r.doc_id: [tuple(s) for s in r.removed] for r in L.repeated_lines(documents(rows)).collect()}
    assert got == {0: [], 1: [(0, 1)], 2: [(0, 1)], 3: [(0, 1)]}


def test_suffix_array_is_sorted_and_groups_equal_suffixes(documents):
    rows = corpus(7)
    lines = L.line_table(documents(rows))
    table = {r["row"]: [x["id"] for x in r["lines"]] for r in lines.collect()}
    every = [i for ids in table.values() for i in ids]
    got = {(r.row, r.pos): (r["rank"], r["length"]) for r in L.suffix_array(lines).collect()}
    assert set(got) == {(d, p) for d, ids in table.items() for p, i in enumerate(ids) if every.count(i) > 1}
    suffix = {at: tuple(table[at[0]][at[1] : at[1] + n]) for at, (_, n) in got.items()}
    ordered = sorted(got, key=lambda at: got[at][0])
    assert [suffix[at] for at in ordered] == sorted(suffix.values())
    for a, b in zip(ordered, ordered[1:]):
        assert (got[a][0] == got[b][0]) == (suffix[a] == suffix[b])


def test_without_repeats(documents):
    run = "one two three four five six\nseven eight nine ten"
    docs = documents([(2, "start\n" + run + "\nend", None, None, 5), (1, run, None, None, 1), (3, None), (4, "short\nshort", None, None, 2)])
    out = L.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (run, len(run)), 2: ("start\nend", 9), 3: (None, None), 4: ("short\nshort", 11)}


def test_odd_rows(odd, documents):
    got = L.repeated_lines(odd).collect()
    assert len(got) == odd.count()
    # the second of the equal rows repeats the first
    assert sorted(r.n_removed for r in got if r.doc_id == 4) == [0, 1]
    assert L.repeated_lines(documents([])).collect() == []
    assert L.without_repeats(odd).columns == odd.columns
    # a line that repeats within one document
    line = " ".join("abcdefghijkl")
    one = L.repeated_lines(documents([(1, "\n".join([line] * 5))])).collect()[0]
    assert one.n_removed == 4 and [tuple(s) for s in one.removed] == [(1, 4)]


def test_documents_may_have_the_operator_own_column_names(documents):
    names = ("row", "removed", "lines", "_row", "_gone", "own0")
    long = " ".join(f"w{i}" for i in range(60))
    docs = documents([(i, f"head {i}\n{long}\ntail {i}", "en", "s", 1, *"uvwxyz") for i in range(3)], extra=names)
    got = {r.doc_id: r for r in L.without_repeats(docs).collect()}
    assert long in got[0].text and got[1].text == "head 1\ntail 1" and got[1].n_chars == len(got[1].text)
    assert all(tuple(r[c] for c in names) == tuple("uvwxyz") for r in got.values())
