import hashlib
import random
import zlib
from itertools import accumulate

import pytest

from sequela.llm import sharding as S


def feasible(sizes, capacity, shards):
    used, room = 1, capacity
    for size in sizes:
        if size > capacity:
            return False
        if size > room:
            used, room = used + 1, capacity
        room -= size
    return used <= shards


def plain_capacity(sizes, shards):
    return next(c for c in range(max(sizes), sum(sizes) + 1) if feasible(sizes, c, shards))


def table_of(sizes, log):
    ends = list(accumulate(sizes))

    def fetch(ranges, width):
        cells = {}
        for k, (low, high) in enumerate(ranges):
            for e in ends:
                if low <= e <= high:
                    cells.setdefault((k, (e - low) // width), []).append(e)
        log.append(len(cells))
        return [(min(c), max(c)) for c in cells.values()]

    return S.Ends(ends[-1] if ends else 0, fetch)


@pytest.mark.parametrize("seed", range(30))
def test_capacity_and_cuts_equal_a_plain_search(seed, monkeypatch):
    rng = random.Random(seed)
    shards = rng.randrange(1, 9)
    monkeypatch.setattr(S, "CELLS", rng.choice((4 * shards, 16 * shards, 1 << 16)))
    sizes = [rng.choice((1, 2, 3, rng.randrange(1, 400))) for _ in range(rng.randrange(1, 200))]
    log = []
    ends = table_of(sizes, log)
    capacity = S.minimax(ends, shards, max(sizes))
    assert capacity == plain_capacity(sizes, shards)
    found = S.cuts(ends, shards, capacity)
    assert found[-1] == sum(sizes) and set(found) <= {0, *accumulate(sizes)}
    assert all(0 <= b - a <= capacity for a, b in zip([0, *found], found))
    assert len(log) < 40


def test_rounds_are_few_for_many_bytes(monkeypatch):
    monkeypatch.setattr(S, "CELLS", 1 << 10)
    rng, log = random.Random(1), []
    sizes = [rng.randrange(1, 10**9) for _ in range(5000)]
    S.cuts(ends := table_of(sizes, log), 16, S.minimax(ends, 16, max(sizes)))
    assert len(log) < 40 and max(log) <= (1 << 10) + 64


def check(rows, got, shards=16):
    """The law, groups, slots and the least capacity of the assignment."""
    size = {}
    for _, text, *_rest in rows:
        size[text or ""] = size.get(text or "", 0) + len((text or "").encode()) + 1
    want = sorted((r[0] is None, r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert want == sorted((r.doc_id is None, r.doc_id, r["size"], r.text_crc32) for r in got)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    slots, total = {}, [0] * shards
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        total[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = {}
    for r in got:
        where.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    # groups above an even share of the rest have a shard each; the others are cut by minimax in digest order
    left, alone = sum(size.values()), []
    for text in sorted(size, key=lambda t: (-size[t], hashlib.sha256(t.encode()).hexdigest())):
        if len(alone) == shards - 1 or size[text] * (shards - len(alone)) <= left:
            break
        alone.append(text)
        left -= size[text]
    rest = [size[t] for t in sorted(size, key=lambda t: hashlib.sha256(t.encode()).hexdigest()) if t not in alone]
    assert total[: len(alone)] == [size[t] for t in alone]
    if rest:
        assert max(total[len(alone) :]) == plain_capacity(rest, shards - len(alone))
    return total


def corpus(seed, n):
    rng = random.Random(seed)
    stock = [f"copy {k} " + "é" * rng.randrange(60) for k in range(6)]
    rows = [(i, rng.choice(stock) if rng.random() < 0.2 else f"own {i} " + "x" * rng.randrange(200)) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_documents_lie_in_near_equal_shards(documents, seed):
    rows = corpus(seed, 400)
    got = S.assign(documents(rows)).collect()
    total = check(rows, got)
    assert max(total) < 1.5 * sum(total) / 16 and min(total) > 0.5 * sum(total) / 16
    again = S.assign(documents(rows[::-1]).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_a_text_of_a_third_of_all_rows(documents, monkeypatch):
    monkeypatch.setattr(S, "UNFOLD", 16)
    rows = [(i, "the same text in very many rows") for i in range(200)] + [(7, "one row many times")] * 100 + corpus(3, 200)
    total = check(rows, S.assign(documents(rows)).collect())
    assert min(total) > 0


def test_odd_tables(odd, documents):
    rows = [tuple(r) for r in odd.collect()]
    check(rows, S.assign(odd).collect())
    assert S.assign(documents([])).collect() == []
    check([(1, "a")], S.assign(documents([(1, "a")])).collect())


def test_written_shards_hold_all_documents(documents, tmp_path):
    rows = [(*r, "en", "s", 1, "x", "k") for r in corpus(5, 60) + [(None, None), (3, "twice"), (3, "twice")]]
    docs = documents(rows, extra=("shard", "key"))
    out = S.write_shards(docs, str(tmp_path / "shards"), 4)
    assert out.columns == [*docs.columns, "_shard"]
    assert sorted(map(str, out.drop("_shard").collect())) == sorted(map(str, docs.collect()))
    assert {r._shard for r in out.select("_shard").distinct().collect()} == {0, 1, 2, 3}
