"""Toxicity: cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 not toxic, 1 toxic, 2 strongly toxic. One weight vector serves all grades;
the grades differ by their thresholds: P(grade > k) = sigmoid(w.x - threshold_k). The result is the
expected grade.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.llm.text import map_columns, most_frequent
from sequela.sources.stages import stage

SAMPLE = 8_000  # labelled documents of either class to learn from, about
MAX_FEATURES = 4096
MIN_TOXIC_DOCS = 4
MIN_ODDS = 20.0  # a feature's rate in toxic documents over its rate in others
PREFIXES = (4, 5)  # lengths of word beginnings that are features of longer words
STEPS, RIDGE = 400, 1e-5
TOKEN = re.compile(r"\w+")

SCORED = "severity double, grade int, toxic boolean"


@dataclass
class Ordinal:
    """Weights by feature and ascending thresholds."""

    weights: dict[str, float]
    thresholds: list[float]

    def over(self, counts: dict[str, int]) -> list[float]:
        """Probabilities that the grade of a text with these feature counts is over 0, 1, ..."""
        x = sum(self.weights[f] * np.log1p(n) for f, n in counts.items())
        return [float(1 / (1 + np.exp(np.clip(t - x, -60, 60)))) for t in self.thresholds]


def features(text: str | None) -> Counter:
    """Counts of a text's words and word beginnings; the latter are marked by a final ``*``."""
    found: Counter = Counter()
    for word, n in Counter(TOKEN.findall((text or "").lower())).items():
        found[word] += n
        for size in PREFIXES:
            if len(word) > size:
                found[word[:size] + "*"] += n
    return found


def known_features(text: str | None, known: dict[str, float]) -> dict[str, int]:
    """Counts of those features of a text that the model has."""
    found: dict[str, int] = {}
    for word, n in Counter(TOKEN.findall((text or "").lower())).items():
        if word in known:
            found[word] = found.get(word, 0) + n
        for size in PREFIXES:
            if len(word) > size and (start := word[:size] + "*") in known:
                found[start] = found.get(start, 0) + n
    return found


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """About ``size`` documents of either class, by hash of the id: toxic, text.

    A document is toxic if any of its labels says so.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = known.groupBy("toxic").agg(F.count("*").alias("n"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.join(F.broadcast(counts), "toxic").filter(place * F.col("n") < size)  # a row per class
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    # about ``size`` ids of either class, whatever the table's size, so the texts stay where they are
    return texts.join(F.broadcast(picked.select("doc_id", "toxic")), "doc_id").select("toxic", "text")


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> Ordinal:
    """Learn the weights from a bounded labelled sample.

    Features that are far more frequent in toxic documents are counted and chosen by Spark, over
    distinct texts; where more have one count than there is room for, by name. A toxic
    document is of grade 2 if it has more occurrences of chosen features than the median one, else
    of grade 1. Without toxic or other labelled documents the model has no weights and grades
    everything 0.
    """
    sample = stage(labelled_sample(docs, labels, size), "labelled")
    distinct = stage(sample.distinct(), "distinct")
    totals = {int(r["toxic"] > 0): r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Ordinal({}, [60.0, 60.0])

    def present(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both: dict[str, list[int]] = {}
            for toxic, text in zip(frame["toxic"], frame["text"]):
                for f in features(text):
                    both.setdefault(f, [0, 0])[int(toxic > 0)] += 1
            yield pd.DataFrame([(f, a, b) for f, (a, b) in both.items()], columns=["feature", "clean", "toxic"])

    odds = ((F.col("toxic") + 0.5) / totals[1]) / ((F.col("clean") + 0.5) / totals[0])
    chosen = (
        distinct.mapInPandas(present, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter((F.col("toxic") >= MIN_TOXIC_DOCS) & (odds >= MIN_ODDS))
    )
    top, _ = most_frequent(stage(chosen, "features"), "toxic", MAX_FEATURES, tie="feature")
    names = sorted(r["feature"] for r in top.select("feature").collect())
    known = {f: float(i) for i, f in enumerate(names)}

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [known_features(t, known) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "toxic": (frame["toxic"] > 0).astype(int),
                    "at": [[int(known[f]) for f in x] for x in found],
                    "n": [list(x.values()) for x in found],
                }
            )

    data = sample.mapInPandas(rows, "toxic int, at array<int>, n array<int>").toPandas()
    hits = data["n"].map(sum).to_numpy()
    toxic = data["toxic"].to_numpy()
    half = np.median(hits[toxic > 0])
    grades = np.where(toxic > 0, np.where(hits > half, 2, 1), 0)
    weights, thresholds = fit_ordinal(list(data["at"]), list(data["n"]), grades, len(names))
    return Ordinal(dict(zip(names, weights.tolist())), thresholds)


def fit_ordinal(
    at: list, n: list, grades: np.ndarray, width: int, steps: int = STEPS, ridge: float = RIDGE
) -> tuple[np.ndarray, list[float]]:
    """Maximum likelihood of a cumulative-link model with a ridge on the weights (Adam steps).

    ``at`` and ``n`` hold each row's feature numbers and counts. Thresholds ascend by construction:
    each is the one before plus an exponential.
    """
    top = max(1, int(grades.max()))
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col = np.concatenate([np.asarray(a, np.int64) for a in at] or [np.zeros(0, np.int64)])
    val = np.log1p(np.concatenate([np.asarray(c, float) for c in n] or [np.zeros(0)]))
    # weights, first threshold, logs of the gaps
    p = np.concatenate([np.zeros(width), [1.0], np.zeros(top - 1)])
    m, v = np.zeros_like(p), np.zeros_like(p)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        t = np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))
        x = np.bincount(row, p[:width][col] * val, len(at))
        # cumulative probabilities P(grade >= k), with 1 before the first and 0 after the last
        up = np.column_stack([np.ones(len(at)), *[sig(x - k) for k in t], np.zeros(len(at))])
        i = np.arange(len(at))
        upper, lower = up[i, grades], up[i, grades + 1]
        like = np.maximum(upper - lower, 1e-12)
        dx = (upper * (1 - upper) - lower * (1 - lower)) / like
        grad = np.zeros_like(p)
        grad[:width] = np.bincount(col, dx[row] * val, width) / len(at) - ridge * p[:width]
        # by threshold: it is the lower bound of the grade below it and the upper of the one above
        dt = np.array(
            [
                np.where(grades == k + 1, -upper * (1 - upper), np.where(grades == k, lower * (1 - lower), 0)) @ (1 / like)
                for k in range(top)
            ]
        ) / len(at)
        tail = np.cumsum(dt[::-1])[::-1]
        grad[width] = tail[0]
        grad[width + 1 :] = tail[1:] * np.exp(p[width + 1 :])
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        p = p + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = np.cumsum(np.concatenate([p[width : width + 1], np.exp(p[width + 1 :])]))
    return p[:width], t.tolist()


def score(docs: DataFrame, model: Ordinal, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, expected grade, most likely grade, and whether it is toxic.

    Whole texts are read; a null text is empty. Toxic: the grade is over 0 with a probability of
    0.5 or more. Rows with equal or null ids are scored one by one; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda texts: list(zip(*[graded(t, shared.value) for t in texts])) or [[], [], []]

    return map_columns(docs, keep, [F.col("text")], SCORED, make)


def graded(text: str | None, model: Ordinal) -> tuple[float, int, bool]:
    """Expected grade, most likely grade, and whether a grade over 0 is as likely as not."""
    over = model.over(known_features(text, model.weights))
    each = -np.diff([1.0, *over, 0.0])
    return float(sum(over)), int(np.argmax(each)), bool(over[0] >= 0.5)
