import random

import corpus_pipeline
from sequela.llm import perplexity, setjoin
from sequela.sources.stages import stage
from test_decontaminate import slow_score

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_their_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "near_copies", "benchmark", "source_mix", "token_records",
    ]


def test_each_stage_against_its_input(spark):
    """Each stage's rows against a plain version on what the one before it kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, (r.text or "").lower().split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    tables = [docs]
    for name, step in corpus_pipeline.STAGES:
        tables.append(stage(step(spark, tables[-1], SF), name))
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:4]]
    for t in tables[:5]:
        assert t.columns == COLUMNS
    # quality: what the plain rules reject is gone, and what is kept is unchanged
    for i, r in rows[0].items():
        toks, *_, repeated = perplexity.plain_counts(r.text)
        if len(toks) < 10 or 100 * repeated > 20 * len(toks):
            assert i not in rows[1]
    assert all(rows[0][i] == r for i, r in rows[1].items()) and len(rows[1]) > 0.6 * len(rows[0])
    # near copies: the smallest id of each component
    label = setjoin.brute_force([(i, r.text) for i, r in rows[1].items()])
    assert set(rows[2]) == {c for _, c in label.values()}
    # benchmark: the documents without a passage that aligns with half of an item
    rng = random.Random(1)
    for i in rng.sample(sorted(rows[2]), 12):
        text = (rows[2][i].text or "").lower().split()
        if len(text) < 400:
            leaks = any(slow_score(text, b) >= len(b) for _, b in items)
            assert (i in rows[3]) == (not leaks)
    # mix and records: a row per document and pass
    mixed = tables[4].collect()
    assert {r.doc_id for r in mixed} <= set(rows[3])
    words = {s: sum(len((r.text or "").split()) for r in rows[3].values() if r.source == s) for s in {r.source for r in rows[3].values()}}
    taken = sum(len(r.text.split()) for r in mixed)
    assert abs(taken - 1.5 * sum(words.values())) <= 64 * len(words)
    records = tables[5].collect()
    assert sorted(r.doc_id for r in records) == sorted(r.doc_id for r in mixed)
    at = 0
    for r in sorted(records, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
