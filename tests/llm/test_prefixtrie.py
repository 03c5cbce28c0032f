import hashlib
import random
import zlib

import duckdb
import pytest

from sequela.llm import prefixtrie as P
from sequela.llm.queries import ORACLES

TURNS = "conv_id long, turn long, role string, text string"


def plain(rows, rebuild=True):
    """Nodes from every prefix of every conversation."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, role, tie, text))
    convs = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in convs.items()}
    if rebuild:
        made = {}
        for c, own in convs.items():
            h = zlib.crc32(str(c).encode()) % 6
            base = c - (c % 100 if c >= 0 else -(-c % 100))
            made[c] = convs.get(base, [])[:h] + own[h:]
        convs = made
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for node, ids in members.items():
        under = [x for x in members if x[: len(node)] == node]
        kids = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(y[: len(x)] == x and len(y) == len(x) + 1 for y in under)]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in under)
        ends = ",".join(str(c) for c in sorted(ids) if tuple(convs[c]) == node)
        parent = min(members[node[:-1]]) if node else None
        out.add((min(ids), len(node), parent, len(ids), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def corpus(seed, n=60, depth=6):
    rng = random.Random(seed)
    texts = ["a", "bé", "ccc", "漢字", None, ""]
    rows = []
    for i in range(n):
        c = rng.choice((i, 100 * (i % 4) + i, -i))
        for t in range(rng.randrange(1, depth)):
            rows.append((c, rng.choice((t, t, None, 3)), rng.choice(("user", "assistant", None)), texts[min(rng.randrange(9), 5) if t else 0]))
    return rows


def nodes(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("rebuild", (True, False))
def test_nodes_equal_a_plain_search(spark, seed, rebuild):
    rows = corpus(seed)
    assert nodes(P.conversation_trie(spark.createDataFrame(rows, TURNS), rebuild)) == plain(rows, rebuild)


def test_long_conversations_need_no_round_per_turn(spark, monkeypatch):
    rows = [(1, t, "user", f"own {t}") for t in range(300)]
    rows += [(c, t, "user", f"other {t}") for c in (2, 3) for t in range(200)]
    rows += [(4, t, "user", f"other {t}") for t in range(3)] + [(5, 0, "user", "other 0"), (5, 1, "user", "x")]
    levels = []
    real = P._level
    monkeypatch.setattr(P, "_level", lambda r, d: levels.append(d) or real(r, d))
    assert nodes(P.conversation_trie(spark.createDataFrame(rows, TURNS), False)) == plain(rows, False)
    assert max(levels) == 3


def test_many_conversations_of_one_text(spark, monkeypatch):
    monkeypatch.setattr(P, "CHUNK_BITS", 4)
    rows = [(c, 0, "user", "hello") for c in range(-50, 300)] + [(c, 1, "bot", f"t{c % 3}") for c in range(0, 300, 2)]
    assert nodes(P.conversation_trie(spark.createDataFrame(rows, TURNS), False)) == plain(rows, False)


def test_odd_tables(spark):
    assert P.conversation_trie(spark.createDataFrame([], TURNS)).collect() == []
    assert P.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TURNS)).collect() == []
    rows = [(7, None, None, None), (7, None, None, None), (7, 1, "user", "long " * 20_000), (None, 1, "a", "b"), (107, 1, "", "")]
    extra = spark.createDataFrame([(*r, "p", "k", 1) for r in rows], TURNS + ", path string, `key` string, depth int")
    assert nodes(P.conversation_trie(extra)) == plain(rows)


def test_sql_twin_equals_a_plain_search(spark, tmp_path):
    rows = corpus(5)
    spark.createDataFrame(rows, TURNS).toPandas().astype({"conv_id": "Int64", "turn": "Int64"}).to_parquet(tmp_path / "c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet'")
    rel = con.sql(ORACLES["op12_prefix_trie"])
    order = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    at = [rel.columns.index(c) for c in order]
    assert {tuple(r[i] for i in at) for r in rel.fetchall()} == plain(rows)
