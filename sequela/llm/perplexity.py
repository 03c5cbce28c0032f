"""Quality rules: n-gram perplexity under a modified Kneser-Ney model, with bands per language.

``judge_all`` and ``keep_all`` count the models on all documents that are labelled good, two of each
language, each on half of its texts. N-grams are counted in parts, where those of all texts meet the
counts, and parts are taken in rounds. ``fit`` and ``judge`` are the same for a bounded sample, whose models are pairs of arrays,
n-gram hashes in ascending order and their probabilities, which tasks search by bisection. A document is rejected where
both models put its perplexity above its language's band, or both below, or where a plain rule fails. A
copy of a counted text is known to one half only, so it is judged like any other; the perplexity
returned is that under the half to which a text is stranger. Plain rules and perplexity cover every word of every text.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.llm.text import byte_words, keep_rows, map_columns, release_memory, text_slices, word_codes, words
from sequela.sources.stages import dropped, shuffles_removed, stage, tasks

#: Fixed values of the plain rules.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20

BEGIN, END = "<s>", "</s>"
SAMPLE = 200  # labelled good documents per language for each of its two models
HALVES = (0, 1)
SKETCH, SKETCH_WORDS = 8, 5  # smallest hashes of runs of words by which near copies in the sample meet
NO_LANG = "und"
BAND = 4.0  # standard deviations from the centre to either bound; see ``Spread.tail``
MAX_LANGS = 50  # languages with a model, those with most documents
MIN_BAND_DOCS = 20  # a language with fewer sampled texts in a half has no model
TURN = 23  # bits by which a context's hash is turned before the next word's joins it
CHUNK_WORDS = 200_000  # scored at once
SLICE = 1 << 24  # bytes of text whose words are numbered at once
ROUNDS = 8  # of scoring: each takes a share of the parts
COUNT_ROUNDS, ASK_ROUNDS = 3, 4  # of counting; rounds of scoring whose words are asked for at once
HOT_SHARE = 4  # a word is looked at that has one in so many of a part's share of the trigrams of a slice
ROUND_GRAMS = 500_000  # trigrams that a round has at least

SCORED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, perplexity double, kept boolean"
)


@dataclass
class Spread:
    """How texts' mean log probabilities per word lie about their centre."""

    centre: float
    between: float  # variance between texts
    within: float  # variance of single words
    tail: float = 1.0  # by how much texts spread wider on the predictable side, where some share lines

    def reach(self, n: int) -> float:
        """How far the bound against too surprising texts of n words lies from the centre."""
        return BAND * math.sqrt(self.between + self.within / max(n, 1))


@dataclass
class Model:
    """A model of half a language's sample. Words are found by dictionary, longer n-grams by hash."""

    ids: dict[bytes, int]
    hashes: np.ndarray  # by id; the last is that of unknown words
    prob: np.ndarray
    gamma: np.ndarray  # weight of a word as a context
    bi_keys: np.ndarray
    bi_prob: np.ndarray
    bi_gamma: np.ndarray
    tri_keys: np.ndarray
    tri_prob: np.ndarray


@dataclass
class Judge:
    """A language's two models, and how texts that a model did not count lie under it."""

    halves: tuple[Model, Model]
    spread: Spread

    def means(self, texts: list[list[bytes]]) -> list[tuple[float, ...]]:
        """Mean log probability of each text under either half."""
        return list(zip(*[[total / n for total, _, n in log_probs(half, texts)] for half in self.halves]))

    def inside(self, means: tuple[float, ...], n: int) -> bool:
        """Whether a text of n words is in the band: it is outside where both halves put it outside on the same side."""
        reach = self.spread.reach(n)
        return max(means) >= self.spread.centre - reach and min(means) <= self.spread.centre + self.spread.tail * reach


def language(docs: DataFrame) -> Column:
    return F.coalesce(F.col("lang"), F.lit(NO_LANG))


# --- fitting ------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, per_lang: int = SAMPLE) -> DataFrame:
    """About ``2 * per_lang`` good documents of each language, by hash of the id: lang, text, half.

    A document is good if all of its labels are. Of copies and near copies one text stays, so that
    none is counted in one half and known to the other.
    """
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    texts = docs.filter("doc_id is not null and text is not null").withColumn("lang", language(docs))
    known = stage(texts.select("doc_id", "lang").join(good.select("doc_id"), "doc_id", "left_semi"), "good-ids")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    place = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1 << 30)) / float(1 << 30)
    picked = known.join(F.broadcast(counts), "lang").filter(place * F.col("n") < 2 * per_lang).distinct()
    # about ``2 * per_lang * MAX_LANGS`` ids at most, so the texts stay where they are
    found = texts.join(F.broadcast(picked.select("doc_id", "lang")), ["doc_id", "lang"]).select("lang", "text")
    return unlike(stage(found, "good-texts")).withColumn("half", F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2)).cast("int"))


def unlike(texts: DataFrame) -> DataFrame:
    """Texts (lang, text) of which no two of a language are copies or near copies.

    Texts that have one of ``SKETCH`` smallest hashes of their runs of words in common count as near
    copies, and of those with a hash in common the text with the smallest hash of its own stays.
    """
    one, sketches = _sketches(texts)
    first = sketches.groupBy("lang", "k", "least").agg(F.min("own").alias("first"))
    gone = sketches.join(first, ["lang", "k", "least"]).filter("own != first").select("lang", "own").distinct()
    return one.join(gone, ["lang", "own"], "left_anti").select("lang", "text")


def _sketches(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct texts (lang, own, text), and the smallest hashes of each: lang, own, k, least."""
    one = stage(texts.groupBy("lang", F.xxhash64("text").alias("own")).agg(F.first("text").alias("text")), "unlike-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for part in text_slices(batch.column(2), SLICE):
                own = batch.slice(first, len(part))
                first += len(part)
                least = np.ascontiguousarray(run_sketches(part).T).ravel()
                row = np.tile(np.arange(len(part)), SKETCH)
                k = np.repeat(np.arange(SKETCH, dtype=np.int32), len(part))
                columns = [own.column(0).take(pa.array(row)), own.column(1).take(pa.array(row)), pa.array(k), pa.array(least)]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "own", "k", "least"])

    return one, stage(one.select("lang", "own", "text").mapInArrow(run, "lang string, own long, k int, least long"), "sketches")


def run_sketches(texts: pa.StringArray) -> np.ndarray:
    """Of each text, for each ``k`` of ``SKETCH``, the smallest of Spark's ``xxhash64(xxhash64(run), k)`` over its runs of words."""
    distinct, code, cuts = word_codes(texts, lower=False)
    size = np.diff(cuts)
    least = np.empty((len(size), SKETCH), np.int64)
    long = np.flatnonzero(size >= SKETCH_WORDS)
    h = np.full(max(len(code) - SKETCH_WORDS + 1, 0), 42, np.uint64)
    table = _xx_table(distinct)
    for j in range(SKETCH_WORDS if len(h) else 0):
        h = _xx_words(table, code[j : j + len(h)], h)
    if len(long):
        runs = size[long] - SKETCH_WORDS + 1
        starts = np.cumsum(runs) - runs
        h = h[np.repeat(cuts[:-1][long] - starts, runs) + np.arange(runs.sum())]
        for k, x in enumerate(_xx_numbers(h)):
            least[long, k] = np.minimum.reduceat(x, starts)
    for i in np.flatnonzero(size < SKETCH_WORDS):
        x = 42
        for c in code[cuts[i] : cuts[i + 1]]:
            x = xxhash.xxh64_intdigest(distinct[int(c)].as_py(), x)
        least[i] = [x[0] for x in _xx_numbers(np.array([x], np.uint64))]
    return least


_X1, _X2, _X3, _X4, _X5 = (
    np.uint64(x)
    for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _xx_end(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _X2
    h = (h ^ (h >> np.uint64(29))) * _X3
    return h ^ (h >> np.uint64(32))


def _xx_numbers(h: np.ndarray) -> Iterator[np.ndarray]:
    """Spark's ``xxhash64(h, k)`` for each ``k`` of ``SKETCH``."""
    seed = np.uint64(42) + _X5 + np.uint64(8)
    x = _xx_end(_rotated(seed ^ (_rotated(h * _X2, 31) * _X1), 27) * _X1 + _X4)
    for k in range(SKETCH):
        y = (x + _X5 + np.uint64(4)) ^ np.array(k, np.uint64) * _X1
        yield _xx_end(_rotated(y, 23) * _X2 + _X3).view(np.int64)


def _xx_table(distinct: pa.BinaryArray) -> tuple:
    """What XXH64 takes of each word, whatever its seed: bytes, length, eights, four and tail. Words of 32 bytes or more are hashed one by one."""
    size = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct)].astype(np.int64)
    data = np.concatenate([np.frombuffer(distinct.buffers()[2] or b"", np.uint8), np.zeros(64, np.uint8)])
    eight, four = (np.lib.stride_tricks.as_strided(data, (len(data) - 8, n), (1, 1)) for n in (8, 4))
    chunks = [_rotated(np.ascontiguousarray(eight[starts + 8 * k]).view(np.uint64)[:, 0] * _X2, 31) * _X1 for k in range(3)]
    rest = starts + size // 8 * 8
    fours = np.ascontiguousarray(four[rest]).view(np.uint32)[:, 0].astype(np.uint64) * _X1
    rest = rest + size % 8 // 4 * 4
    tails = [data[rest + k].astype(np.uint64) * _X5 for k in range(3)]
    return distinct, size, chunks, fours, tails


def _xx_words(table: tuple, code: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of the words with these numbers, each with its own seed."""
    distinct, size, chunks, fours, tails = table
    n = size[code]
    h = seed + _X5 + n.astype(np.uint64)
    for k in range(3):
        if len(at := np.flatnonzero(n >= 8 * k + 8)):
            h[at] = _rotated(h[at] ^ chunks[k][code[at]], 27) * _X1 + _X4
    if len(at := np.flatnonzero(n % 8 >= 4)):
        h[at] = _rotated(h[at] ^ fours[code[at]], 23) * _X2 + _X3
    for k in range(3):
        if len(at := np.flatnonzero(n % 4 > k)):
            h[at] = _rotated(h[at] ^ tails[k][code[at]], 11) * _X1
    h = _xx_end(h)
    for i in np.flatnonzero(n >= 32):
        h[i] = xxhash.xxh64_intdigest(distinct[int(code[i])].as_py(), int(seed[i]))
    return h


def ngram_counts(sample: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trigram counts, and the continuation counts of bigrams and words, by language."""
    padded = F.concat(F.array(F.lit(BEGIN), F.lit(BEGIN)), words(F.col("text")), F.array(F.lit(END)))
    grams = sample.select("lang", padded.alias("t")).select(
        "lang",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("t") - 2),
                lambda i: F.struct(
                    F.element_at("t", i).alias("u"),
                    F.element_at("t", i + 1).alias("v"),
                    F.element_at("t", i + 2).alias("w"),
                ),
            )
        ).alias("g"),
    )
    tri = stage(grams.groupBy("lang", "g.u", "g.v", "g.w").agg(F.count("*").alias("c")), "trigrams")
    bi = stage(tri.groupBy("lang", "v", "w").agg(F.count("*").alias("c")), "bigrams")
    uni = bi.groupBy("lang", "w").agg(F.count("*").alias("c"))
    return tri, bi, uni


def discounted(counts: DataFrame, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """Discounted probabilities (prob) and context weights (gamma) of one order.

    The three discounts of a language follow from its numbers of n-grams seen one to four times;
    where one of these is 0 the discounts are 0.5, 1 and 1.5.
    """
    ones = [F.sum((F.col("c") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    whole = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0) & (F.col("n4") > 0)

    def discount(k: int) -> Column:
        d = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        return F.when(whole, F.least(F.greatest(d, F.lit(0.05)), F.lit(k - 0.05))).otherwise(F.lit(k / 2)).alias(f"d{k}")

    discounts = counts.groupBy("lang").agg(*ones).select("lang", *[discount(k) for k in (1, 2, 3)])
    own = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut = counts.join(F.broadcast(discounts), "lang").withColumn("d", own)
    totals = cut.groupBy("lang", *context).agg(
        F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("gamma")
    )
    prob = cut.join(totals.drop("gamma"), ["lang", *context]).withColumn("prob", (F.col("c") - F.col("d")) / F.col("total"))
    return prob.drop("c", "d", "d1", "d2", "d3", "total"), totals.drop("total")


def _turned(h: Column) -> Column:
    return F.shiftleft(h, TURN).bitwiseOR(F.shiftrightunsigned(h, 64 - TURN))


def _key(*names: str) -> Column:
    key = F.xxhash64(F.col(names[0]))
    for name in names[1:]:
        key = _turned(key).bitwiseXOR(F.xxhash64(F.col(name)))
    return key


def fit(docs: DataFrame, labels: DataFrame, per_lang: int = SAMPLE) -> dict[str, Judge]:
    """Models and bands by language, from the labelled sample.

    What reaches the driver is bounded by the sample: at most a row per word of ``2 * per_lang``
    documents of each language. Without labels there are no models, and only the plain rules judge.
    """
    sample = stage(labelled_sample(docs, labels, per_lang), "good")
    # a model's name is its half's number and its language
    tri, bi, uni = ngram_counts(sample.select(F.concat("half", "lang").alias("lang"), "text"))
    tri_prob, tri_ctx = discounted(tri, ["u", "v"])
    bi_prob, bi_ctx = discounted(bi, ["v"])
    uni_prob, uni_ctx = discounted(uni, [])
    spread = uni_ctx.join(uni.groupBy("lang").agg(F.count("*").alias("known")), "lang")
    spread = spread.select("lang", (F.col("gamma") / (F.col("known") + 1)).alias("unknown"))
    words_ = (
        uni_prob.join(spread, "lang")
        .select("lang", "w", (F.col("prob") + F.col("unknown")).alias("prob"))
        .join(bi_ctx.withColumnRenamed("v", "w"), ["lang", "w"], "full")
        .select("lang", "w", F.xxhash64("w").alias("h"), F.coalesce("prob", F.lit(0.0)).alias("prob"), F.coalesce("gamma", F.lit(1.0)).alias("gamma"))
    )
    pairs = (
        bi_prob.join(tri_ctx.select("lang", F.col("u").alias("v"), F.col("v").alias("w"), "gamma"), ["lang", "v", "w"], "full")
        .select("lang", _key("v", "w").alias("k"), F.coalesce("prob", F.lit(0.0)).cast("float").alias("prob"), F.coalesce("gamma", F.lit(1.0)).cast("float").alias("gamma"))
    )
    triples = tri_prob.select("lang", _key("u", "v", "w").alias("k"), F.col("prob").cast("float").alias("prob"))
    unknown = {r["lang"]: r["unknown"] for r in spread.collect()}
    found = [stage(t, "model") for t in (words_, pairs, triples)]
    models = {}
    for lang, u in unknown.items():
        own = [t.filter(F.col("lang") == lang).drop("lang") for t in found]
        w, p, t = own[0].toArrow(), own[1].sort("k").toArrow(), own[2].sort("k").toArrow()
        models[lang] = Model(
            {x: i for i, x in enumerate(w["w"].cast(pa.binary()).to_pylist())},
            np.append(w["h"].to_numpy(), np.int64(0)),
            np.append(w["prob"].to_numpy(), u),
            np.append(w["gamma"].to_numpy(), 1.0),
            p["k"].to_numpy(), p["prob"].to_numpy(), p["gamma"].to_numpy(),
            t["k"].to_numpy(), t["prob"].to_numpy(),
        )
    return _with_bands(sample, models)


def _with_bands(sample: DataFrame, models: dict[str, Model]) -> dict[str, Judge]:
    """The languages' models with their bands: each sampled text is scored by the half that did not count it."""
    shared = sample.sparkSession.sparkContext.broadcast(models)

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for lang, text, half in zip(frame["lang"], frame["text"], frame["half"]):
                if model := shared.value.get(f"{1 - half}{lang}"):
                    (total, squares, n), = log_probs(model, [byte_words(text)])
                    rows.append((lang, half, total, squares, n))
            yield pd.DataFrame(rows, columns=["lang", "half", "total", "squares", "n"])

    scores = sample.mapInPandas(score, "lang string, half int, total double, squares double, n long").toPandas()
    shared.unpersist()
    judges = {}
    for lang, s in scores.groupby("lang"):
        if min((s["half"] == half).sum() for half in HALVES) >= MIN_BAND_DOCS:
            judges[lang] = Judge(tuple(models[f"{half}{lang}"] for half in HALVES), _spread(s))
    return judges


def _spread(s: pd.DataFrame) -> Spread:
    mean = (s["total"] / s["n"]).to_numpy()
    centre = float(np.median(mean))
    within = float(s["squares"].sum() / s["n"].sum() - (s["total"].sum() / s["n"].sum()) ** 2)
    # robust variance of the means, less what their lengths explain
    whole = (1.4826 * np.median(np.abs(mean - centre))) ** 2
    found = Spread(centre, max(0.0, float(whole - np.median(within / s["n"]))), within)
    steps = (mean - centre) / np.array([found.reach(n) / BAND for n in s["n"]])
    # a normal spread has a hundredth of the texts beyond 2.326 standard deviations
    found.tail = max(1.0, float(np.quantile(steps, 0.99)) / 2.326)
    return found


# --- scoring ------------------------------------------------------------------------------


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted hashes in the sorted keys, and which of them are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def _joined(context: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hash of a context followed by a word, as ``_key`` makes it."""
    c = context.view(np.uint64)
    turned = (c << np.uint64(TURN)) | (c >> np.uint64(64 - TURN))
    return turned.view(np.int64) ^ h


def log_probs(model: Model, texts: list[list[bytes]]) -> list[tuple[float, float, int]]:
    """Sum of log probabilities, sum of their squares, and number of words with the end, of each."""
    get, unknown = model.ids.get, len(model.ids)
    begin, end = get(BEGIN.encode(), unknown), get(END.encode(), unknown)
    ids: list[int] = []
    starts = []
    for toks in texts:
        starts.append(len(ids))
        ids += (begin, begin)
        ids += [get(t, unknown) for t in toks]
        ids.append(end)
    w = np.array(ids, np.int32)
    h = model.hashes[w]
    pair = _joined(h[:-1], h[1:])  # of the words at i and i + 1
    at, there = _found(model.bi_keys, pair)
    # p(w2 | w1), for the word at i + 1
    p2 = model.gamma[w[:-1]] * model.prob[w[1:]] + np.where(there, model.bi_prob[at] if len(model.bi_prob) else 0.0, 0.0)
    context = np.where(there, model.bi_gamma[at] if len(model.bi_gamma) else 1.0, 1.0)[:-1]
    p3 = context * p2[1:]  # for the word at i + 2
    seen = np.flatnonzero(there[:-1])
    at3, there3 = _found(model.tri_keys, _joined(pair[seen], h[seen + 2]))
    p3[seen[there3]] += model.tri_prob[at3[there3]]
    logs = np.log(np.maximum(p3, 1e-300))
    out = []
    for i, start in enumerate(starts):
        stop = (starts[i + 1] if i + 1 < len(starts) else len(ids)) - 2
        part = logs[start:stop]
        out.append((float(part.sum()), float((part * part).sum()), len(part)))
    return out


def repeat_words(toks: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that lie in a window of ``window`` words found twice or more in the text."""
    n = len(toks) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(t, len(seen)) for t in toks], np.int64)
    mixed = ids[:n]
    for k in range(1, window):
        mixed = mixed * 0x5851F42D4C957F2D + ids[k : k + n]
    mixed = np.sort(mixed)
    if not (mixed[1:] == mixed[:-1]).any():
        return 0  # equal windows have equal sums
    # number equal runs of 1, 2, ... words, each from the numbers of the shorter runs
    runs = ids
    for k in range(1, window):
        code = runs[: len(ids) - k] * len(ids) + ids[k:]
        runs = np.unique(code, return_inverse=True)[1]
    twice = np.bincount(runs)[runs] > 1
    if not twice.any():
        return 0
    cover = np.zeros(len(toks) + 1, np.int64)
    hit = np.flatnonzero(twice)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def plain_counts(text: str | None) -> tuple[list[bytes], int, int, int, int]:
    """Words, characters in words, symbols, repeated lines and words in repeated windows."""
    text = text or ""
    toks = byte_words(text)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return toks, chars, symbols, dup, repeat_words(toks)


def judge(docs: DataFrame, models: dict[str, Judge], keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the counts, perplexity and verdict of each text.

    A null text is empty: no words, so the plain rules reject it. A text whose language has no
    model (a null language is ``und``) has a null perplexity and is judged by the plain rules.
    Rows with equal ids are judged one by one; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        return lambda langs, texts: _judged(langs, texts, shared.value)

    return map_columns(docs, keep, [language(docs), F.col("text")], SCORED, make)


def _judged(langs: list[str], texts: list[str | None], models: dict[str, Judge]) -> list[list]:
    n = len(texts)
    counts = np.zeros((n, 5), np.int64)
    mean: list[tuple[float, ...] | None] = [None] * n
    waiting: dict[str, list[tuple[int, list[bytes]]]] = {}
    held = 0

    def flush() -> None:
        for lang, rows in waiting.items():
            for (i, _), value in zip(rows, models[lang].means([t for _, t in rows])):
                mean[i] = value
        waiting.clear()

    for i, (lang, text) in enumerate(zip(langs, texts)):
        toks, chars, symbols, dup, repeated = plain_counts(text)
        counts[i] = len(toks), chars, symbols, dup, repeated
        if lang in models and toks:
            waiting.setdefault(lang, []).append((i, toks))
            held += len(toks)
            if held > CHUNK_WORDS:
                flush()
                held = 0
    flush()
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    kept = []
    for i, lang in enumerate(langs):
        inside = mean[i] is None or models[lang].inside(mean[i], int(counts[i, 0]) + 1)
        kept.append(bool(inside and not failed[i]))
    perplexity = [None if m is None else math.exp(min(-min(m), 700)) for m in mean]
    return [*counts.T.tolist(), failed.tolist(), perplexity, kept]


def keep_good(docs: DataFrame, models: dict[str, Judge]) -> DataFrame:
    """The documents that the rules keep, with their own columns; see ``judge`` for nulls and odd tables."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def make():
        return lambda langs, texts: _judged([NO_LANG if x is None else x for x in langs], texts, shared.value)[-1]

    return keep_rows(docs, ["lang", "text"], make)


# --- models of all labelled texts -----------------------------------------------------------

GRAMS = "t long, lang long, a long, b long, v long, w long, g long"
STEP = 4  # decimals to which values are rounded whose medians and quantiles are taken
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def text_key() -> Column:
    """Key of a text in its language; equal texts of a language have one key, null ones none."""
    return F.when(F.col("text").isNotNull(), F.xxhash64(language_key(), F.col("text")))


def language_key(half: Column | int = 0) -> Column:
    """Key of a language, or of the model of one of its halves: the last bit is the half's number."""
    name = F.coalesce(F.col("lang"), F.lit(NO_LANG))
    return F.xxhash64(name).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(half) if isinstance(half, int) else half)


def halved(texts: DataFrame) -> DataFrame:
    """The distinct texts (lang, text) with ``half``; near copies fall in one half, and none is left out.

    Sketches are those of ``unlike``: a text goes where the smallest text goes that it meets by most of them, so that
    a line shared with a third text does not part two near copies.
    """
    one, sketches = _sketches(texts)
    return one.join(_halves(sketches), ["lang", "own"]).select("lang", "text", "half")


def _halves(sketches: DataFrame) -> DataFrame:
    """The half of each text (lang, own) by its sketches."""
    first = sketches.groupBy("lang", "k", "least").agg(F.min("own").alias("first"))
    met = sketches.join(first, ["lang", "k", "least"]).groupBy("lang", "own", "first").agg(F.count("*").alias("c"))
    lead = met.groupBy("lang", "own").agg(F.min(F.struct(-F.col("c"), "first")).alias("m"))
    half = F.pmod(F.xxhash64("m.first", F.lit(5)), F.lit(2)).cast("int")
    return lead.select("lang", "own", half.alias("half"))


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every distinct text with words of documents that are labelled good: lang, text, half. A document is good if all of its labels are."""
    return halved(_labelled(docs, labels, language(docs).alias("lang"), F.col("text")))


def _labelled(docs: DataFrame, labels: DataFrame, *columns: Column) -> DataFrame:
    """Columns of the documents with words that are labelled good; nothing else is moved to join them."""
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1")
    texts = docs.filter("doc_id is not null").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return texts.select("doc_id", *columns).join(good, "doc_id", "left_semi").drop("doc_id")


#: Rows that travel between tasks: where to, what, of which slice or word, numbers, and packed arrays.
ROWS = "part long, kind int, id long, n array<long>, data binary"
TEST, ONLY_COUNTED, KEYS, SKETCHES, WORDS, ASKED, PAIRS, ANSWERS, NUMBERS, SUMS = range(10)
SCORES = "t long, lang long, n long, total0 double, total1 double, squares0 double, squares1 double"
GRAMS = 1_250_000  # trigrams in a part


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, ascending ones as steps: the lowest bytes of all numbers, the next ones, and so on, compressed."""
    parts = []
    for x in arrays:
        steps = len(x) > 1 and bool((x[1:] >= x[:-1]).all())
        y = np.ascontiguousarray(np.diff(x, prepend=x.dtype.type(0)) if steps else x)
        width = max(1, -(-int(y.max() if len(y) else 0).bit_length() // 8))
        planes = y.view(np.uint8).reshape(len(y), y.itemsize)
        parts.append((steps, width, len(y), b"".join(planes[:, i].tobytes() for i in range(width))))
    raw = pickle.dumps(parts, 5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpacked(data: bytes) -> list[np.ndarray]:
    """The arrays, in 32 or 64 bits."""
    found = []
    view = memoryview(data)
    for steps, width, n, raw in pickle.loads(pa.decompress(view[8:], int.from_bytes(view[:8], "little"), "zstd")):
        planes = np.frombuffer(raw, np.uint8).reshape(width, n)
        y = planes[0].astype(np.int32 if width < 4 else np.int64)
        for i in range(1, width):
            y |= planes[i].astype(y.dtype) << y.dtype.type(8 * i)
        found.append(np.cumsum(y, dtype=np.int64) if steps else y)
    return found


def _arrow(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary())
    columns = zip(*rows) if rows else [[]] * len(kinds)
    names = [c.split()[0] for c in ROWS.split(", ")]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _rows(table: pa.Table, kinds: Sequence[int]) -> Iterator[tuple[int, int, pa.Buffer]]:
    """Kind, id and data of the rows of these kinds; the data stay where they are."""
    for i, (kind, name) in enumerate(zip(table["kind"].to_pylist(), table["id"].to_pylist())):
        if kind in kinds:
            yield kind, name, table["data"][i].as_buffer()


def _mixed(h: np.ndarray) -> np.ndarray:
    """Hashes from 0 to a quarter of all numbers, to deal by."""
    h = h.view(np.uint64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((h ^ (h >> np.uint64(29))) >> np.uint64(2)).view(np.int64)


def _word_hashes(h: np.ndarray, lang: int) -> np.ndarray:
    """Hashes of words in a language, from 0, by those of the words."""
    h = (h ^ np.array([lang], np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(1)).view(np.int64)


ENDS = np.array([xxhash.xxh64_intdigest(x) for x in (BEGIN, END)], np.uint64)


def _coded(texts: pa.StringArray, keys: np.ndarray, langs: np.ndarray, order: np.ndarray) -> tuple[int, bytes]:
    """How many trigrams the texts have, and the texts, in an order by language, as numbers of words, packed.

    That is: languages; of each text its key, its language's place and number of words; of each word, in the order of its
    hash, this and its language's place; and the texts' words. Begins and ends are words of each language.
    """
    listed, place = np.unique(langs, return_inverse=True)
    sizes, codes, hashes, of = [], [], [], []
    for i in range(len(listed)):
        distinct, code, cuts = word_codes(texts.take(pa.array(order[place[order] == i])), lower=False)
        h = _xx_words(_xx_table(distinct), np.arange(len(distinct)), np.zeros(len(distinct), np.uint64))
        sizes.append(np.diff(cuts))
        codes.append(code.astype(np.int64) + sum(map(len, hashes)))
        hashes.append(_word_hashes(np.concatenate([h, ENDS]), int(listed[i])))
        of.append(np.full(len(h) + 2, i))
    h, number, size = np.concatenate(hashes), np.concatenate(codes), np.concatenate(sizes)
    ascending = np.argsort(h)
    new = np.empty(len(h), np.int64)
    new[ascending] = np.arange(len(h))
    split = lambda x: ((x >> 32) & 0xFFFFFFFF, x & 0xFFFFFFFF)  # noqa: E731  keys may be below 0
    columns = (*split(listed), *split(keys[order]), place[order], size, h[ascending], np.concatenate(of)[ascending], new[number])
    return int((size + (size > 0)).sum()), _packed(*columns)


@dataclass
class Fit:
    """What tasks get to know of the models: the languages that have one, and of the texts counted, by key, the slice that each is counted in and its half."""

    known: np.ndarray
    keys: np.ndarray
    slices: np.ndarray
    halves: np.ndarray


@dataclass
class Slice:
    """The words of some texts in a row, each text between two begins and an end."""

    texts: np.ndarray  # numbers in the slice
    half: np.ndarray  # 0 for texts that are not counted here, or one more than the half
    ends: np.ndarray
    listed: np.ndarray  # hashes of the distinct words, which hold the language, in ascending order
    langs: np.ndarray  # by distinct word, its language's place among the known ones
    words: np.ndarray
    last: np.ndarray  # whether a trigram ends at the word

    @staticmethod
    def of(data: bytes, name: int, fit: Fit, counted: bool = False) -> Slice:
        """All packed texts in languages with a model, or those that are counted."""
        lang0, lang1, key0, key1, place, size, listed, of, codes = _unpacked(data)
        lang, keys = [(x.astype(np.int64) << 32) | y.astype(np.int64) for x, y in ((lang0, lang1), (key0, key1))]
        lang_at, lang_there = _found(fit.known, lang)
        at, there = _found(fit.keys, keys)
        half = np.where(there & (fit.slices[at] == name), fit.halves[at] + 1, 0) if len(fit.keys) else np.zeros(len(keys), np.int64)
        some = lang_there[place] & (size > 0) & ((half > 0) | (not counted))
        if not some.all():
            codes = codes[np.repeat(some, size)]
        half, place, size = half[some], place[some], size[some].astype(np.int64)
        ends = np.cumsum(size + 3) - 1
        starts = ends - size - 2
        words_ = np.empty(int(ends[-1]) + 1 if len(ends) else 0, np.int32)
        last = np.ones(len(words_), bool)
        last[starts] = last[starts + 1] = last[ends] = False
        words_[last] = codes
        listed = listed.astype(np.int64)
        marks = np.searchsorted(listed, np.array([_word_hashes(ENDS, int(x)) for x in lang]).reshape(-1, 2))
        words_[starts] = words_[starts + 1] = marks[place, 0]
        words_[ends] = marks[place, 1]
        last[ends] = True
        return Slice(np.flatnonzero(some), half, ends, listed, lang_at[of], words_, last)

    def middle(self, mine: np.ndarray) -> np.ndarray:
        """Where trigrams end whose middle words are ``mine``, given for each distinct word."""
        return np.flatnonzero(self.last[1:] & mine[self.words[:-1]]) + 1

    def cut(self, at: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The trigrams that end at these places, packed by part, with the words of the part alone."""
        text = np.searchsorted(self.ends, at)
        used, number = np.zeros(len(self.listed), bool), np.zeros(len(self.listed), np.int32)
        order = _sorted(part)
        for p, some in _runs(part[order], order):
            ends = at[some]
            own = [self.words[ends - i] for i in (2, 1, 0)]
            for x in own:
                used[x] = True
            listed = np.flatnonzero(used)
            used[listed] = False
            number[listed] = np.arange(len(listed))
            begins = np.flatnonzero(np.diff(text[some], prepend=-1))
            of = text[some[begins]]
            counts = np.diff(begins, append=len(some))
            yield p, _packed(self.texts[of], self.half[of], counts, self.listed[listed], self.langs[listed], *[number[x] for x in own])


@dataclass
class Grams:
    """Trigrams of a slice in a part, as ``Slice.cut`` packed them: of each text its number, half and number of trigrams;
    hashes and languages of the words, and the trigrams by these."""

    texts: np.ndarray
    half: np.ndarray
    counts: np.ndarray
    words: np.ndarray
    langs: np.ndarray
    u: np.ndarray
    v: np.ndarray
    w: np.ndarray


def _sorted(part: np.ndarray) -> np.ndarray:
    top = int(part.max()) if len(part) else 0
    return np.argsort(part.astype(np.uint16) if top < 1 << 16 else part, kind="stable")


def _runs(keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple]:
    """The values of each run of equal keys."""
    cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(0, np.int64)
    for first, last in zip(cuts, cuts[1:]):
        yield int(keys[first]), *[v[first:last] for v in values]


@dataclass
class Parts:
    """How trigrams are dealt: by the middle word, and by the first one too where the middle word has more than one part can hold.

    A part has all of a context, of one word or of two; the pairs that follow a word with several parts are brought to each.
    Round r takes the parts that are r modulo ``rounds``.
    """

    n: int
    rounds: int
    count_rounds: int
    hot: np.ndarray  # hashes of the words with several parts
    spread: np.ndarray  # their numbers of parts

    @property
    def few(self) -> int:
        """Parts of a round; the words' counts are dealt to as many."""
        return -(-self.n // self.rounds)

    def of(self, g: Slice, rounds: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Where trigrams of these rounds end, and their parts."""
        place = _mixed(g.listed)
        base = (place % self.n).astype(np.int32)
        mine = np.isin(base % self.rounds, rounds)
        hot, there = _found(self.hot, g.listed)
        mine |= there
        at = g.middle(mine)
        v = g.words[at - 1]
        part = base[v]
        if there.any():
            some = np.flatnonzero(there[v])
            part[some] = (part[some] + place[g.words[at[some] - 2]] // self.n % self.spread[hot[v[some]]]) % self.n
            own = np.isin(part % self.rounds, rounds)
            at, part = at[own], part[own]
        return at, part

    def all_of(self, i: int) -> np.ndarray:
        """The parts of the word ``hot[i]``."""
        return (int(_mixed(self.hot[i : i + 1])[0] % self.n) + np.arange(self.spread[i])) % self.n


def _code(texts: DataFrame, kind: int, good: np.ndarray | None = None) -> DataFrame:
    """The texts (t, lang as a key, text, own) as slices of numbers of words; of equal keys of a slice one text stays.

    Beside them, the keys and languages of each slice's texts, and the sketches of those whose keys are among ``good``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        for batch in batches:
            first = 0
            for part in text_slices(batch.column(2), SLICE):
                some = batch.slice(first, len(part))
                first += len(part)
                keys, langs, own = (some.column(i).to_numpy() for i in (0, 1, 3))
                once = np.sort(np.unique(keys, return_index=True)[1])
                part, keys, langs, own = part.take(pa.array(once)), keys[once], langs[once], own[once]
                order = np.argsort(langs, kind="stable")
                name, done = (TaskContext.get().partitionId() << 32) + done, done + 1
                grams, data = _coded(part, keys, langs, order)
                rows = [(0, kind, name, [grams], data), (0, KEYS, name, np.column_stack([keys[order], langs[order]]).ravel().tolist(), None)]
                yield from _arrow(rows).to_batches()
                if good is not None and len(at := np.flatnonzero(_found(good, keys)[1])):
                    found = np.column_stack([keys[at], langs[at], own[at], run_sketches(part.take(pa.array(at)))])
                    yield from _arrow([(0, SKETCHES, name, x.tolist(), None) for x in found]).to_batches()
        release_memory()

    return texts.mapInArrow(run, ROWS)


def _sketched(coded: DataFrame) -> DataFrame:
    """The sketches that came with the slices (t, lang, own, least), of equal texts one, with the slice."""
    names = [F.col("n")[i].alias(c) for i, c in enumerate(("t", "lang", "own"))]
    found = coded.filter(F.col("kind") == SKETCHES).select("id", *names, F.slice("n", 4, SKETCH).alias("least"))
    return found.groupBy("t").agg(F.min("id").alias("id"), *[F.first(c).alias(c) for c in ("lang", "own", "least")])


def _from_slices(coded: DataFrame, shared: Broadcast, make: Callable[[Slice, int, int], list[tuple]], counted: bool = False) -> DataFrame:
    """The rows that ``make`` has for the texts, the number and the kind of each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                kind, name, data = (batch.column(k)[i].as_py() for k in (1, 2, 4))
                yield from _arrow(make(Slice.of(data, name, Fit(*shared.value), counted), name, kind)).to_batches()

    return coded.filter(F.col("kind").isin(TEST, ONLY_COUNTED)).mapInArrow(run, ROWS)


def _in_parts(rows: DataFrame, n: int, run: Callable[[pa.Table], pa.Table], schema: str = ROWS, key: str = "part") -> DataFrame:
    return rows.repartition(2 * n, key).groupBy(key).applyInArrow(run, schema)


def _known(halves: DataFrame) -> np.ndarray:
    """Keys of the languages of which both halves have ``MIN_BAND_DOCS`` texts (lang, half); others have no model."""
    counted = halves.groupBy("lang").agg(*[F.count(F.when(F.col("half") == i, 1)).alias(f"n{i}") for i in HALVES])
    enough = counted.filter((F.col("n0") >= MIN_BAND_DOCS) & (F.col("n1") >= MIN_BAND_DOCS)).select("lang")
    return np.sort(np.array([r["lang"] for r in enough.collect()], np.int64))


def _fit(halves: DataFrame) -> Fit:
    """Of the texts counted (t, lang as a key, half, id of a slice), what tasks get to know: 17 bytes a text."""
    found = halves.select("t", "id", F.col("half").cast("byte")).toArrow()
    keys, slices, half = (found.column(i).to_numpy() for i in (0, 1, 2))
    order = np.argsort(keys)
    return Fit(_known(halves), keys[order], slices[order], half[order].astype(np.int64))


def fit_all(sample: DataFrame) -> tuple[Fit, DataFrame]:
    """The models of all texts (lang, text, half), and the texts as numbers of words.

    N-grams are counted in ``score_all``, part by part, beside those of the texts that meet them; no table of them is ever whole.
    """
    texts = sample.select(text_key().alias("t"), language_key().alias("lang"), "text", F.lit(0).cast("long").alias("own"), "half")
    good = np.sort(texts.select("t").toArrow().column(0).to_numpy())
    coded = stage(_code(texts.drop("half"), ONLY_COUNTED, good).withColumn("id", -1 - F.col("id")), "counted-texts")
    return _fit(_sketched(coded).join(texts.select("t", "half"), "t")), coded


def score_all(texts: DataFrame, models: tuple[Fit, DataFrame], parts: int | None = None) -> DataFrame:
    """Of each text (t, lang as a key, text) under either half: t, lang, n, and total and squares of its log probabilities.

    Rows with equal t count once.
    """
    fit, counted = models
    coded = stage(_code(texts.select("t", "lang", "text", F.lit(0).cast("long").alias("own")), TEST), "texts")
    scores = _score(coded.unionByName(counted), fit, parts)
    dropped(coded)
    return scores


def _score(coded: DataFrame, fit: Fit, parts: int | None = None, squares: bool = True) -> DataFrame:
    """All trigrams meet the counts of their part; the parts are taken in rounds, so that a share of them is on disk at a time.

    Without ``squares``, these are 0 for texts that are not counted.
    """
    spark = coded.sparkSession
    if not len(fit.known):
        return spark.createDataFrame([], SCORES)
    shared = spark.sparkContext.broadcast((fit.known, fit.keys, fit.slices, fit.halves))
    words_ = follow = sums = answers = None
    with shuffles_removed(spark):
        dealt = _dealing(coded, shared, parts)
        few = dealt.few
        for r in range(dealt.count_rounds):
            pairs = _from_slices(coded, shared, lambda g, _, kind, r=r: _by_pair(g, kind, dealt, r), counted=True)
            counted = stage(_in_parts(pairs, -(-dealt.n // dealt.count_rounds), lambda t: _counted_pairs(t, dealt)), "pairs")
            words_ = _more(words_, counted.filter(F.col("kind").isin(WORDS, NUMBERS)), lambda x: _in_parts(x, few, _counted_words), "words")
            follow = _more(follow, counted.filter(F.col("kind") == PAIRS), lambda x: x, "hot-pairs")
            dropped(counted)
        fitted = _fitted(fit.known, words_)
        for r in range(dealt.rounds):
            if r % ASK_ROUNDS == 0:
                dropped(*[answers] * (r > 0))
                soon = range(r, r + ASK_ROUNDS)
                asked = _from_slices(coded.filter(F.col("kind") == TEST), shared, lambda g, name, _, soon=soon: _asked(g, name, dealt, soon))
                found = _in_parts(words_.filter(F.col("kind") == WORDS).unionByName(asked), few, _answered)
                answers = stage(_in_parts(found, few, _assembled, key="id"), "answers")
            rows = _from_slices(coded, shared, lambda g, name, kind, r=r: [(p, kind, name, None, x) for p, x in g.cut(*dealt.of(g, [r]))])
            rows = rows.unionByName(answers.filter(F.col("part") % dealt.rounds == r)).unionByName(_brought(follow, dealt, r))
            found = _in_parts(rows, few, lambda t: _scored(t, fitted, squares))
            sums = _more(sums, found, lambda x: _in_parts(x, few, _summed, key="id"), "sums")
        dropped(words_, follow, answers)
        keys = coded.filter(F.col("kind") == KEYS).select("part", "kind", "id", "n", F.lit(None).cast("binary").alias("data"))
        named = _in_parts(sums.unionByName(keys), few, _named, SCORES, "id")
        # copies in several slices have equal sums; squares may come with the counted one alone
        most = [F.max(c.split()[0]).alias(c.split()[0]) for c in SCORES.split(", ")[2:]]
        scores = stage(named.groupBy("t", "lang").agg(*most), "scores")
        dropped(sums)
    shared.unpersist()
    return scores


def _more(before: DataFrame | None, rows: DataFrame, make: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What is made of staged rows and more rows, staged in their place."""
    found = stage(make(rows if before is None else before.unionByName(rows)), name)
    if before is not None:
        dropped(before)
    return found


def _sums_packed(texts: np.ndarray, n: np.ndarray, totals: Sequence[np.ndarray], more: np.ndarray, squares: Sequence[np.ndarray]) -> bytes:
    """Numbers of texts and of trigrams, and sums of log probabilities; those of squares for the texts ``more``."""
    return pickle.dumps((_packed(texts, n, more), *totals, *[x.astype(np.float32) for x in squares]), 5)


def _summed(table: pa.Table) -> pa.Table:
    """The sums of a slice's texts."""
    packs = [pickle.loads(data) for data in table["data"].to_pylist()]
    texts, n, more = ([x.astype(np.int64) for x in c] for c in zip(*[_unpacked(x[0]) for x in packs]))
    at, of = np.concatenate(texts), np.concatenate(more)
    count = int(at.max()) + 1 if len(at) else 0
    sums = [np.bincount(i, np.concatenate([x[k] for x in packs]), count) for k, i in ((1, at), (2, at), (3, of), (4, of))]
    size = np.bincount(at, np.concatenate(n), count).astype(np.int64)
    own, counted = np.flatnonzero(size), np.flatnonzero(sums[2])
    data = _sums_packed(own, size[own], [x[own] for x in sums[:2]], counted, [x[counted] for x in sums[2:]])
    return _arrow([(0, SUMS, table["id"][0].as_py(), None, data)])


def _named(table: pa.Table) -> pa.Table:
    """The sums of a slice's texts by their keys."""
    rows = {r["kind"]: r for r in table.to_pylist()}
    columns = [np.zeros(0, k) for k in [np.int64] * 3 + [np.float64] * 4]
    if SUMS in rows and KEYS in rows:
        packed, *totals, square0, square1 = pickle.loads(rows[SUMS]["data"])
        texts, n, more = _unpacked(packed)
        keys = np.array(rows[KEYS]["n"], np.int64).reshape(-1, 2)
        squares = np.zeros((2, len(keys)))
        squares[:, more] = square0, square1
        columns = [keys[texts, 0], keys[texts, 1], n.astype(np.int64), *totals, *squares[:, texts]]
    return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in SCORES.split(", ")])


def _dealing(coded: DataFrame, shared: Broadcast, parts: int | None = None) -> Parts:
    """Numbers of parts and rounds by the number of trigrams, and the words that hold more than a part's even share.

    Only the tasks' loads depend on these words. At most one for each part reaches the driver.
    """
    spark = coded.sparkSession
    total = coded.filter(F.col("kind").isin(TEST, ONLY_COUNTED)).agg(F.sum(F.col("n")[0])).first()[0] or 0
    n = parts or max(tasks(spark), -(-total // GRAMS))
    rounds = min(n, ROUNDS) if parts else min(n, ROUNDS, max(1, total // ROUND_GRAMS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                g = Slice.of(data, name, Fit(*shared.value))
                c = np.bincount(g.words, minlength=len(g.listed))
                often = np.flatnonzero(c * (HOT_SHARE * n) > len(g.words))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (g.listed[often], c[often])], names=["word", "c"])

    coded = coded.filter(F.col("kind").isin(TEST, ONLY_COUNTED))
    seen = coded.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))
    hot = seen.filter(F.col("c") * n > total).orderBy("word").collect()
    spread = [min(n, -(-r["c"] * n // total)) for r in hot]
    return Parts(n, rounds, min(rounds, COUNT_ROUNDS), np.array([r["word"] for r in hot], np.int64), np.array(spread, np.int64))


def _by_pair(g: Slice, kind: int, dealt: Parts, r: int) -> list[tuple]:
    """Trigrams of a round to the part of their second pair, which is that of all that is counted on the way to the words."""
    at = np.flatnonzero(g.last)
    part = _mixed(_joined(g.listed[g.words[at - 1]], g.listed[g.words[at]])) % dealt.n
    own = np.flatnonzero(part % dealt.count_rounds == r)
    return [(p, kind, 0, None, x) for p, x in g.cut(at[own], part[own])]


def _asked(g: Slice, name: int, dealt: Parts, rounds: Sequence[int]) -> list[tuple]:
    """The words that the rounds' parts get as last ones of trigrams of a slice, to the part of their counts.

    Each is asked for by the parts that want it: a pair of part and word is one number.
    """
    at, part = dealt.of(g, rounds)
    pair = np.unique((part.astype(np.int64) << 32) | g.words[at])
    word = pair & 0xFFFFFFFF
    place = (_mixed(g.listed) % dealt.few)[word]
    order = _sorted(place)
    rows = []
    for p, some in _runs(place[order], pair[order]):
        own = np.unique(some & 0xFFFFFFFF)
        rows.append((p, ASKED, name, None, _packed(g.listed[own], own, some)))
    return rows


def _answered(table: pa.Table) -> pa.Table:
    """Of the words that slices ask for, the numbers of pairs that end with them, in either half."""
    listed, _, *counts = _summed_words(table)
    rows = []
    for kind, name, data in zip(*[table[c].to_pylist() for c in ("kind", "id", "data")]):
        if kind == ASKED:
            words_, own, pair = _unpacked(data)
            at, there = _found(listed, words_.astype(np.int64))
            local = np.searchsorted(own, pair & 0xFFFFFFFF)
            found = [np.where(there, c[at], 0)[local] if len(c) else np.zeros(len(local), np.int64) for c in counts]
            rows.append((0, ANSWERS, name, None, _packed(pair, *found)))
    return _arrow(rows)


def _assembled(table: pa.Table) -> pa.Table:
    """A slice's answers, a row for each part, in the order of the words' hashes."""
    pair, *found = (np.concatenate([x.astype(np.int64) for x in c]) for c in zip(*map(_unpacked, table["data"].to_pylist())))
    order = np.argsort(pair)
    name = table["id"][0].as_py()
    return _arrow([(p, ANSWERS, name, None, _packed(*c)) for p, *c in _runs(pair[order] >> 32, *[c[order] for c in found])])


def _brought(follow: DataFrame, dealt: Parts, r: int) -> DataFrame:
    """The counts of pairs whose first word has several parts, to each of these that the round has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()):
                yield from _arrow([(int(p), PAIRS, int(dealt.hot[i]), None, data) for p in dealt.all_of(i) if p % dealt.rounds == r]).to_batches()

    return follow.mapInArrow(run, ROWS)


def _counted_pairs(table: pa.Table, dealt: Parts) -> pa.Table:
    """Of a part by second pairs: numbers of n-grams by count, the words' pairs, and the pairs of words with several parts."""
    u, v, w, half, lang = _whole(table)
    _, first, c3 = _counts(_joined(_joined(u, v), w), [half == h for h in HALVES])
    v, w, lang = v[first], w[first], lang[first]
    rows = _numbers(3, c3, lang)
    _, first, c2 = _counts(_joined(v, w), [c > 0 for c in c3])
    v, w, lang = v[first], w[first], lang[first]
    rows += _numbers(2, c2, lang)
    at, there = _found(dealt.hot, v)
    order = np.flatnonzero(there)[np.argsort(at[there], kind="stable")]
    rows += [(0, PAIRS, i, None, _packed(w[some], lang[some], *[c[some] for c in c2])) for i, some in _runs(at[order], order)]
    listed, first, c1 = _counts(w, [c > 0 for c in c2])
    place = _mixed(listed) % dealt.few
    order = _sorted(place)
    for p, some in _runs(place[order], order):
        rows.append((p, WORDS, 0, None, _packed(listed[some], lang[first][some], *[c[some] for c in c1])))
    return _arrow(rows)


def _whole(table: pa.Table) -> list[np.ndarray]:
    """Words, half and language of all trigrams of texts that are counted."""
    found = [[np.zeros(0, np.int64)] * 5]
    for _, _, data in _rows(table, (TEST, ONLY_COUNTED)):
        g = Grams(*_unpacked(data))
        at = np.repeat(g.half > 0, g.counts)
        u, v, w = g.u[at], g.v[at], g.w[at]
        found.append([g.words[u], g.words[v], g.words[w], np.repeat(g.half, g.counts)[at] - 1, g.langs[v]])
    return [np.concatenate(x).astype(np.int64, copy=False) for x in zip(*found)]


def _counts(keys: np.ndarray, hits: list[np.ndarray]) -> tuple:
    """Distinct keys in ascending order, where each stands first, and how often each is hit."""
    listed, first, number = np.unique(keys, return_index=True, return_inverse=True)
    return listed, first, [np.bincount(number, x, len(listed)).astype(np.int64) for x in hits]


def _numbers(order: int, counts: list[np.ndarray], lang: np.ndarray) -> list[tuple]:
    """By language and half: the numbers of n-grams seen one to four times, the sum of counts, and the number of n-grams."""
    rows = []
    for h, c in enumerate(counts):
        for i in np.unique(lang[c > 0]):
            own = c[(lang == i) & (c > 0)]
            rows.append((2 * order + h, NUMBERS, int(i), [*np.bincount(np.minimum(own, 5), minlength=6)[1:5].tolist(), int(own.sum()), len(own)], None))
    return rows


def _summed_words(table: pa.Table) -> tuple:
    packs = [_unpacked(d) for k, d in zip(table["kind"].to_pylist(), table["data"].to_pylist()) if k == WORDS]
    words_, langs, *counts = [np.concatenate([x.astype(np.int64) for x in c]) for c in zip(*packs)] or [np.zeros(0, np.int64)] * 4
    listed, first, sums = _counts(words_, counts)
    return listed, langs[first], *sums


def _counted_words(table: pa.Table) -> pa.Table:
    """Of a part of the words: each with the number of pairs that end with it in either half; numbers of n-grams go as they are."""
    rows = [tuple(x.values()) for x in table.filter(pc.equal(table["kind"], NUMBERS)).to_pylist()]
    listed, langs, *counts = _summed_words(table)
    return _arrow([*rows, *[(table["part"][0].as_py(), WORDS, 0, None, _packed(listed, langs, *counts))] * bool(len(listed))])


@dataclass
class Fitted:
    """By half and language: the discounts of each order, the sum of the words' counts, and the probability of an unknown word."""

    known: np.ndarray
    cuts: np.ndarray  # by order, half, language and count, from 0
    total: np.ndarray
    unknown: np.ndarray

    def cut(self, order: int, half: int, counts: np.ndarray, lang: np.ndarray) -> np.ndarray:
        return self.cuts[order, half, lang, np.minimum(counts, 3)]


def _fitted(known: np.ndarray, rows: DataFrame) -> Fitted:
    """A row for each order, half and language reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist()):
                if kind == WORDS:
                    _, langs, *counts = _unpacked(data)
                    yield from _arrow(_numbers(1, counts, langs)).to_batches()
            yield batch.filter(pc.equal(batch.column(1), NUMBERS))

    sums = [F.sum(F.col("n")[i]).alias(f"n{i + 1}") for i in range(6)]
    found = np.zeros((4, len(HALVES), len(known), 6))
    for row in rows.mapInArrow(run, ROWS).groupBy("part", "id").agg(*sums).collect():
        found[row["part"] // 2, row["part"] % 2, row["id"]] = row[2:]
    n = found[..., :4]
    whole = (n > 0).all(-1)
    cuts = np.zeros((*n.shape[:-1], 4))
    with np.errstate(invalid="ignore", divide="ignore"):
        y = n[..., 0] / (n[..., 0] + 2 * n[..., 1])
        for k in (1, 2, 3):
            d = k - (k + 1) * y * n[..., k] / n[..., k - 1]
            cuts[..., k] = np.where(whole, np.clip(d, 0.05, k - 0.05), k / 2)
        total, known_words = found[1, ..., 4], found[1, ..., 5]
        gone = (cuts[1, ..., 1:3] * n[1, ..., :2]).sum(-1) + cuts[1, ..., 3] * (known_words - n[1, ..., 0] - n[1, ..., 1])
        unknown = (gone / total / (known_words + 1)).astype(np.float32)
    return Fitted(known, cuts, total, unknown)


def _order(fitted: Fitted, order: int, counts: list[np.ndarray], lang: np.ndarray, context: np.ndarray) -> tuple:
    """Of n-grams with their contexts: discounted probabilities; and the contexts with their weights; of either half."""
    listed, number = np.unique(context, return_inverse=True)
    probs, weights = [], []
    for h, c in enumerate(counts):
        cut = fitted.cut(order, h, c, lang)
        total, gone = np.bincount(number, c, len(listed)), np.bincount(number, cut, len(listed))
        probs.append(np.divide(c - cut, total[number], out=np.zeros(len(c)), where=c > 0).astype(np.float32))
        weights.append(np.divide(gone, total, out=np.ones(len(listed)), where=total > 0).astype(np.float32))
    return probs, listed, weights


def _scored(table: pa.Table, fitted: Fitted, squares: bool) -> pa.Table:
    """Of a part: its n-grams are counted, and those of each text meet the counts."""
    u, v, w, half, lang = _whole(table)
    triples, first, counts = _counts(_joined(_joined(u, v), w), [half == h for h in HALVES])
    u, v, w, lang = u[first], v[first], w[first], lang[first]
    prob3, contexts, gamma3 = _order(fitted, 3, counts, lang, _joined(u, v))
    pairs, first, counts = _counts(_joined(v, w), [c > 0 for c in counts])
    v, lang = v[first], lang[first]
    more = [(word, *_unpacked(data)) for _, word, data in _rows(table, [PAIRS])]
    if more:
        hot = np.array([name for name, *_ in more], np.int64)
        own = ~np.isin(v, hot)
        brought = [np.concatenate([np.full(len(x[1]), x[0]) for x in more]), *[np.concatenate([x[i].astype(np.int64) for x in more]) for i in (1, 2, 3, 4)]]
        pairs = np.concatenate([pairs[own], _joined(brought[0], brought[1])])
        v, lang = np.concatenate([v[own], brought[0]]), np.concatenate([lang[own], brought[2]])
        counts = [np.concatenate([c[own], x]) for c, x in zip(counts, brought[3:])]
        order = np.argsort(pairs)
        pairs, v, lang, counts = pairs[order], v[order], lang[order], [c[order] for c in counts]
    prob2, words_, gamma2 = _order(fitted, 2, counts, lang, v)
    triples, contexts, pairs, words_ = (Lookup(x) for x in (triples, contexts, pairs, words_))
    answers = {name: _unpacked(data) for _, name, data in _rows(table, [ANSWERS])}

    def met(listed: Lookup, values: list[np.ndarray], keys: np.ndarray, default: float) -> list[np.ndarray]:
        at = listed.find(keys)
        return [np.append(x, np.float32(default))[at].astype(np.float64) for x in values]

    out = []
    for _, name, data in _rows(table, [TEST]):
        g = Grams(*_unpacked(data))
        listed, langs, u, v, w = g.words.astype(np.int64), g.langs, g.u, g.v, g.w
        last = np.unique(w)
        low = []
        for h in HALVES:
            c = np.zeros(len(listed), np.int64)
            c[last] = answers[name][h]
            one = np.divide(c - fitted.cut(1, h, c, langs), fitted.total[h, langs], out=np.zeros(len(c)), where=c > 0)
            low.append(one.astype(np.float32).astype(np.float64) + fitted.unknown[h, langs].astype(np.float64))
        hv, hw = listed[v], listed[w]
        a, b = _joined(listed[u], hv), _joined(hv, hw)
        parts = zip(
            met(triples, prob3, _joined(a, hw), 0.0), met(contexts, gamma3, a, 1.0), met(pairs, prob2, b, 0.0),
            [x[v] for x in met(words_, gamma2, listed, 1.0)], [x[w] for x in low],
        )
        logs = [np.log(np.maximum(p3 + g3 * (p2 + g2 * p1).astype(np.float32), 1e-300)) for p3, g3, p2, g2, p1 in parts]
        text = np.repeat(np.arange(len(g.texts)), g.counts)
        squared = np.flatnonzero((g.half > 0) | squares)
        sums = [np.bincount(text, x, len(g.texts)) for x in logs]
        second = [np.bincount(text, x * x, len(g.texts))[squared] for x in logs]
        out.append((0, SUMS, name, None, _sums_packed(g.texts, g.counts, sums, g.texts[squared], second)))
    release_memory()
    return _arrow(out)


class Lookup:
    """Places of hashes in ascending order, which are found by their first bits: about one hash has the same ones."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, 0)
        self.bits = max(len(keys), 2).bit_length()
        self.starts = np.searchsorted(self._first(keys), np.arange((1 << self.bits) + 1)).astype(np.int32)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.int64(64 - self.bits)) + (1 << (self.bits - 1))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of the wanted hashes, past all keys for those that are not there."""
        first = self._first(wanted)
        at, stop = self.starts[first], self.starts[first + 1]
        found = np.full(len(wanted), len(self.keys) - 1, np.int32)
        left = np.flatnonzero(at < stop)
        at, stop, wanted = at[left], stop[left], wanted[left]
        while len(left):
            hit = self.keys[at] == wanted
            found[left[hit]] = at[hit]
            at += 1
            go = np.flatnonzero(~hit & (at < stop))
            left, at, stop, wanted = left[go], at[go], stop[go], wanted[go]
        return found


def bands(scores: DataFrame, sample: DataFrame) -> DataFrame:
    """The bands of the languages, as ``_spread`` has them, from all texts counted (lang, text, half), each under the half that did not count it."""
    return _bands(scores, sample.select(text_key().alias("t"), "half"))


def _bands(scores: DataFrame, halves: DataFrame) -> DataFrame:
    """Values are rounded to ``STEP`` decimals and counted first, so what a task holds does not grow with the texts."""
    own = halves.select("t", "half").join(scores, "t")
    other = lambda name: F.when(F.col("half") == 0, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    seen = stage(own.select("lang", "n", other("total").alias("total"), other("squares").alias("squares"), (other("total") / F.col("n")).alias("mean")), "means")
    mean = F.sum("total") / F.sum("n")
    within = seen.groupBy("lang").agg((F.sum("squares") / F.sum("n") - mean * mean).alias("within"))

    def quantile(rows: DataFrame, value: Column, q: float, name: str) -> DataFrame:
        binned = rows.groupBy("lang", value.alias("x")).agg(F.count("*").alias("k"))
        return binned.groupBy("lang").agg(F.percentile("x", F.lit(q), F.col("k")).alias(name))

    centre = quantile(seen, F.round("mean", STEP), 0.5, "centre")
    about = seen.join(F.broadcast(centre), "lang")
    apart = quantile(about, F.round(F.abs(F.col("mean") - F.col("centre")), STEP), 0.5, "apart")
    share = quantile(seen, 1 / F.col("n"), 0.5, "share")
    wide = centre.join(within, "lang").join(apart, "lang").join(share, "lang")
    between = F.greatest(F.pow(1.4826 * F.col("apart"), 2) - F.col("within") * F.col("share"), F.lit(0.0))
    wide = stage(wide.select("lang", "centre", between.alias("between"), "within"), "spreads")
    step = (F.col("mean") - F.col("centre")) / F.sqrt(F.col("between") + F.col("within") / F.col("n"))
    tail = quantile(seen.join(F.broadcast(wide), "lang"), F.round(step, STEP), 0.99, "q")
    return stage(wide.join(tail, "lang").select("lang", "centre", "between", "within", F.greatest(F.col("q") / 2.326, F.lit(1.0)).alias("tail")), "bands")


def text_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of each distinct text of a language with a model: t, perplexity, and whether it is ``inside`` the band.

    The models and bands are of all labelled good texts, and all documents are scored; see ``_score``.
    """
    spark = docs.sparkSession
    with shuffles_removed(spark):
        good = _labelled(docs, labels, text_key().alias("t")).distinct().toArrow()
        texts = docs.filter("text is not null").select(text_key().alias("t"), language_key().alias("lang"), "text", F.xxhash64("text").alias("own"))
        coded = stage(_code(texts, TEST, np.sort(good.column(0).to_numpy())), "texts")
        found = stage(_sketched(coded), "sketches")
        halves = _halves(found.select("lang", "own", F.posexplode("least").alias("k", "least")))
        halves = stage(halves.join(found, ["lang", "own"]).select("t", "lang", "half", "id"), "halves")
        scores = _score(coded, _fit(halves), squares=False)
        known = scores.join(F.broadcast(_bands(scores, halves)), "lang")
        dropped(coded, found, halves)
    means = [F.col(f"total{i}") / F.col("n") for i in HALVES]
    low, high = F.least(*means), F.greatest(*means)
    reach = BAND * F.sqrt(F.col("between") + F.col("within") / F.col("n"))
    inside = (high >= F.col("centre") - reach) & (low <= F.col("centre") + F.col("tail") * reach)
    return known.select("t", F.exp(F.least(-low, F.lit(700.0))).alias("perplexity"), inside.alias("inside"))


def judge_all(docs: DataFrame, labels: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``judge`` with models of all labelled good texts of every language."""
    names = [f"k{i}" for i in range(len(keep))]
    keyed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], text_key().alias("t"), "text")
    counted = map_columns(keyed, [*names, "t"], [F.col("text")], COUNTS, lambda: _counted)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    judged = counted.withColumn("base_failed", failed).join(text_verdicts(docs, labels), "t", "left")
    kept = ~F.col("base_failed") & F.coalesce("inside", F.lit(True))
    counts = [c.split()[0] for c in COUNTS.split(", ")]
    return judged.select(*names, *counts, "base_failed", "perplexity", kept.alias("kept")).toDF(
        *keep, *counts, "base_failed", "perplexity", "kept"
    )


def _counted(texts: list[str | None]) -> list[list[int]]:
    counts = [(len(toks), *rest) for toks, *rest in map(plain_counts, texts)]
    return [list(c) for c in zip(*counts)] or [[]] * 5


def keep_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``judge_all`` keeps, with their own columns."""
    plain = keep_good(docs, {})  # what the plain rules keep
    gone = text_verdicts(docs, labels).filter("not inside").select(F.col("t").alias("gone"))
    return plain.join(gone, text_key() == F.col("gone"), "left_anti")
