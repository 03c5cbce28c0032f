"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

N-grams of the test items are looked up in the documents, and each that is found there is a seed,
however often the documents hold it. A seed in a document marks the passage around it. A passage
that has too few of the item's words for a sufficient score is left out; any other is aligned with
the item word by word. The alignment's score, as a share of the best one an item can have, tells
copies, edited ones included, from chance.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.text import lower_ascii, map_columns, words
from sequela.sources.stages import stage

N = 3  # words in a seed
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_SHARE = 0.5  # of an item's best score
MIN_MATCHES = 5  # words of an alignment that are equal
BROADCAST_ROWS = 300_000  # of a document, an item and the passages' places; under 50 MB


def grams(words_col: str, n: int = N):
    """Array of (hash, place) of the n-grams of an array of words."""
    gram = F.transform(
        F.sequence(F.lit(1), F.size(words_col) - (n - 1)),
        lambda i: F.struct(
            F.xxhash64(*[F.element_at(words_col, i + k) for k in range(n)]).alias("gram"), (i - 1).alias("place")
        ),
    )
    none = F.array().cast("array<struct<gram:bigint,place:int>>")
    return F.when(F.size(words_col) >= n, gram).otherwise(none)


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    min_share: float = MIN_SHARE,
    id_col: str = "doc_id",
) -> DataFrame:
    """Pairs of a document and a test item that it holds: id, item_id, score, share, first, last.

    ``docs``: an id and text; ``items``: item_id, text. A-Z are lower-cased. ``first`` and ``last``
    are the places of the best aligned passage's first and last word in the document. Null or
    shorter texts than a seed, and rows without an id, hold nothing; rows with equal ids or items
    give one pair, with the best score. Empty tables give an empty result.
    """
    item_words = stage(
        items.filter("item_id is not null").select(F.col("item_id"), words(lower_ascii(F.col("text"))).alias("w")), "items"
    )
    item_grams = stage(
        item_words.select("item_id", F.size("w").alias("size"), F.explode(grams("w")).alias("g")).select(
            F.struct("item_id", "size").alias("item"), "g.gram", F.col("g.place").alias("item_place")
        ),
        "item-grams",
    )
    raw = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "text")
    w = words(lower_ascii(F.col("text"))).alias("w")
    texts = raw.select("id", w)
    listed = item_grams.select("gram").distinct()
    places = stage(
        texts.select("id", F.explode(grams("w")).alias("g"))
        .select("id", "g.gram", "g.place")
        .join(listed, "gram"),
        "places",
    )
    # a seed puts the item's begin at place - item_place; the passage starts a quarter of the
    # item before the cell that this falls in and ends a quarter after the next cell
    passages = (
        places.join(item_grams, "gram")
        .select(
            "id",
            "item.item_id",
            "item.size",
            F.expr("floor((place - item_place) / item.size)").alias("cell"),
        )
        .distinct()
    )
    per_doc = stage(passages.groupBy("id", "item_id", "size").agg(F.collect_set("cell").alias("cells")), "passages")
    # few documents have passages: they are sent to the texts if that many rows surely fit
    few = F.broadcast(per_doc) if per_doc.count() <= BROADCAST_ROWS else per_doc
    joined = raw.join(few, "id").withColumn("w", w).select(
        "id",
        "item_id",
        F.explode(
            F.transform(
                "cells",
                lambda c: F.struct(
                    F.greatest(c * F.col("size") - F.expr("size div 4 + 2"), F.lit(0)).cast("int").alias("begin"),
                    ((c + 2) * F.col("size") + F.expr("size div 4 + 2")).cast("int").alias("end"),
                ),
            )
        ).alias("at"),
        "w",
    )
    cut = joined.select("id", "item_id", "at.begin", F.expr("slice(w, at.begin + 1, greatest(at.end - at.begin, 0))").alias("passage"))
    pairs = cut.join(item_words.select("item_id", F.col("w").alias("item")), "item_id")
    aligned = map_columns(
        pairs,
        ["id", "item_id", "begin"],
        [F.col("passage"), F.col("item")],
        "score long, matches long, from_ long, to_ long, best long",
        lambda: lambda passages, rows: aligned_batch(passages, rows, min_share),
    )
    found = aligned.filter((F.col("matches") >= F.least(F.lit(MIN_MATCHES), F.expr("best div 2"))) & (F.col("score") >= min_share * F.col("best")))
    top = found.groupBy("id", "item_id").agg(
        F.max(F.struct("score", -F.col("begin") - F.col("from_"), "to_", "begin", "from_", "best")).alias("b")
    )
    return top.select(
        F.col("id").alias(id_col),
        "item_id",
        F.col("b.score").alias("score"),
        (F.col("b.score") / F.col("b.best")).alias("share"),
        (F.col("b.begin") + F.col("b.from_")).cast("long").alias("first"),
        (F.col("b.begin") + F.col("b.to_")).cast("long").alias("last"),
    )


def aligned_batch(passages: Sequence[list[str]], items: Sequence[list[str]], min_share: float = 0.0) -> list[list[int]]:
    """Columns of the alignments' results and best scores; zeros for passages that can't reach ``min_share``."""
    rows = []
    for p, i in zip(passages, items):
        best = MATCH * len(i)
        # a score is MATCH for each equal word at most
        able = MATCH * common_words(p, i) >= min_share * best
        rows.append((*(smith_waterman(p, i) if able else (0, 0, 0, 0)), best))
    return [list(c) for c in zip(*rows)] if rows else [[] for _ in range(5)]


def common_words(a: Sequence[str], b: Sequence[str]) -> int:
    """Words that both have, repeated ones as often as both have them."""
    known = Counter(b)
    found = Counter(x for x in a if x in known)
    return sum(min(n, known[x]) for x, n in found.items())


def smith_waterman(passage: Sequence[str], item: Sequence[str]) -> tuple[int, int, int, int]:
    """Best local alignment: score, equal words, and the passage's first and last aligned place."""
    n = len(passage)
    if not n or not item:
        return 0, 0, 0, 0
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(x, len(ids)) for x in passage], np.int64)
    b = [ids.get(x, -1) for x in item]
    table = np.zeros((len(b) + 1, n + 1), np.int64)
    slope = -GAP * np.arange(n + 1)
    for i, word in enumerate(b):
        row = np.maximum(table[i, :-1] + np.where(a == word, MATCH, MISMATCH), table[i, 1:] + GAP)
        row = np.concatenate([[0], np.maximum(row, 0)])
        # gaps along the row: the best of all cells before it, less their distance
        table[i + 1] = np.maximum(np.maximum.accumulate(row + slope) - slope, 0)
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, matches, last = int(table[i, j]), 0, int(j) - 1
    while table[i, j] > 0:
        same = b[i - 1] == a[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matches += int(same)
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matches, int(j), last


def without_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no test item; documents without an id are kept."""
    leaks = find_leaks(docs, items, **options).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)
