"""LM scoring: a gated recurrent language model with a class-factored output.

Spark counts all training tokens. The most frequent words are units of their own; every other word
belongs to a tail class, by its language or its ending. A gated recurrent network in numpy predicts
a unit in two steps, its class and then the unit within the class. A word in a tail class has, in
its class, the share (count + 1) / (tokens + words + 1), counts being exact: words beyond the
dictionary that tasks hold get theirs by a join.

Training is data-parallel. In each round, every task goes on from the shared weights through its
part of that round's documents, and Spark averages the tasks' weights. States are carried across
windows through whole documents, and gradients reach back to their window's begin.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.llm.text import coded_words, most_frequent, text_slices, word_codes
from sequela.sources.stages import stage

END = b" "  # no word holds a space
HELD_OUT = (7, 2)  # a document is held out if crc32 of its id, as text, leaves 2 modulo 7

UNITS = 2048  # words that the network predicts one by one
CLASS_SIZE = 64  # words in a class of units
DICTIONARY = 131_072  # words with counts that every task holds
SUFFIX = 3  # bytes of a word's ending
SUFFIXES = 20_000
GROUPS = 15  # languages, or what the group column holds, with classes of their own; others share one

HIDDEN = 16
LANES = 256  # documents that are read side by side
WINDOW = 32  # steps that gradients reach back
ROUNDS = 3
RATE = 0.1
BLOCK = 4096  # weights that are averaged as one row


# --- counting -----------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    modulus, rest = HELD_OUT
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == rest


def token_counts(docs: DataFrame) -> DataFrame:
    """Counts of the lower-cased tokens of ``docs`` (text, group): token, group, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = batch.column(1).dictionary_encode()
            named, group = groups.dictionary, groups.indices.to_numpy(zero_copy_only=False)
            first = 0
            for part in text_slices(batch.column(0), 1 << 26):
                own = group[first : first + len(part)]
                first += len(part)
                listed, code, cuts = word_codes(part)
                code, cuts = with_ends(len(listed), code, cuts)
                listed = pa.concat_arrays([listed, pa.array([END], pa.binary())])
                both = np.repeat(own, np.diff(cuts)).astype(np.int64) * len(listed) + code
                if len(listed) * len(named) <= 8 * len(both):
                    n = np.bincount(both)
                    pair = np.flatnonzero(n)
                    n = n[pair]
                else:
                    pair, n = np.unique(both, return_counts=True)
                tokens = listed.take(pa.array(pair % len(listed)))
                yield pa.RecordBatch.from_arrays(
                    [tokens, named.take(pa.array(pair // len(listed))), pa.array(n)], names=["token", "group", "n"]
                )

    raw = docs.select("text", "group").mapInArrow(run, "token binary, group string, n long")
    return raw.groupBy("token", "group").agg(F.sum("n").alias("n"))


def with_ends(end: int, code: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with the end token, of number ``end``, after each text."""
    n = len(cuts) - 1
    out = np.full(len(code) + n, end, np.int64)
    out[np.arange(len(code)) + np.repeat(np.arange(n), np.diff(cuts))] = code
    return out, cuts + np.arange(n + 1)


# --- vocabulary ---------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """What tasks know of words. Units are numbered words first, then tail classes."""

    ids: dict[bytes, int]  # dictionary
    unit: np.ndarray  # by dictionary id
    count: np.ndarray  # by dictionary id
    suffixes: dict[bytes, int]  # unit of the tail class of words outside the dictionary
    other: int  # unit of the tail class for all else
    unit_class: np.ndarray  # by unit
    start: np.ndarray  # initial log weight of each unit
    n_words: int  # units that are words
    least: int  # smallest count in the dictionary; words outside have a smaller one
    tokens: int = 0
    distinct: int = 0
    tail_log: np.ndarray | None = None  # log10(tokens + words + 1) of each tail class, by unit

    def tail_unit(self, token: bytes) -> int:
        return self.suffixes.get(token[-SUFFIX:], self.other)


def word_counts(counts: DataFrame) -> DataFrame:
    """Counts of words in all groups, with the group that has most of each: token, n, group."""
    return counts.groupBy("token").agg(F.sum("n").alias("n"), F.max(F.struct("n", "group"))["group"].alias("group"))


def vocabulary(counts: DataFrame, by_word: DataFrame) -> Vocabulary:
    """The dictionary with units, classes and tail classes, from token counts (token, group, n) and ``word_counts``.

    What reaches the driver is bounded by ``DICTIONARY``, ``SUFFIXES`` and ``GROUPS``.
    """
    groups = [r["group"] for r in counts.groupBy("group").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "group").limit(GROUPS).collect()]
    place = {g: i for i, g in enumerate(groups)}
    main = F.max(F.struct("n", "group"))
    rows, least = most_frequent(by_word, "n", DICTIONARY)
    top = rows.toPandas().sort_values(["n", "token"], ascending=[False, True])
    ending = F.expr(f"substring(token, greatest(length(token) - {SUFFIX - 1}, 1), {SUFFIX})")
    by_ending = (
        counts.select(ending.alias("ending"), "group", "n")
        .groupBy("ending", "group")
        .agg(F.sum("n").alias("n"))
        .groupBy("ending")
        .agg(F.sum("n").alias("n"), main["group"].alias("group"))
    )
    by_ending = most_frequent(stage(by_ending, "endings"), "n", SUFFIXES)[0].toPandas()
    tokens = [bytes(t) for t in top["token"]]
    count = top["n"].to_numpy(np.int64)
    group = [place.get(g, len(groups)) for g in top["group"]]
    n_words = min(UNITS, len(tokens))
    # classes of units: the words of a group in order of frequency, CLASS_SIZE at a time
    classes: dict[tuple[int, int], int] = {}
    filled: Counter = Counter()
    unit_class = []
    for i in range(n_words):
        key = (-1, 0) if tokens[i] == END else (group[i], filled[group[i]] // CLASS_SIZE)
        filled[group[i]] += 1
        unit_class.append(classes.setdefault(key, len(classes)))
    tails = len(groups) + 1
    unit_class += [len(classes) + g for g in range(tails)]
    unit = np.array([i if i < n_words else n_words + group[i] for i in range(len(tokens))], np.int32)
    tail_mass = np.bincount(unit, count, n_words + tails)[n_words:] + 1.0
    start = np.log(np.concatenate([count[:n_words] + 0.0, tail_mass]))
    suffixes = {bytes(t): n_words + place.get(g, len(groups)) for t, g in zip(by_ending["ending"], by_ending["group"])}
    ids = {t: i for i, t in enumerate(tokens)}
    return Vocabulary(ids, unit, count, suffixes, n_words + len(groups), np.array(unit_class), start, n_words, least)


def with_totals(vocab: Vocabulary, by_word: DataFrame) -> Vocabulary:
    """Add the numbers of tokens and words, in all and in each tail class."""
    shared = by_word.sparkSession.sparkContext.broadcast(vocab)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        v = shared.value
        for frame in frames:
            ids = [v.ids.get(bytes(t), -1) for t in frame["token"]]
            units = [int(v.unit[i]) if i >= 0 else v.tail_unit(bytes(t)) for i, t in zip(ids, frame["token"])]
            grouped = frame.assign(unit=units).groupby("unit")["n"].agg(["sum", "size"]).reset_index()
            yield grouped.rename(columns={"sum": "tokens", "size": "words"})

    by_unit = (
        by_word.select("token", "n").mapInPandas(run, "unit int, tokens long, words long")
        .groupBy("unit")
        .agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
        .toPandas()
    )
    vocab.tokens, vocab.distinct = int(by_unit["tokens"].sum()), int(by_unit["words"].sum())
    size = len(vocab.unit_class)
    vocab.tail_log = np.full(size, 0.0)
    total = np.zeros(size)
    np.add.at(total, by_unit["unit"].to_numpy(np.int64), (by_unit["tokens"] + by_unit["words"]).to_numpy(float))
    vocab.tail_log[vocab.n_words :] = np.log10(total[vocab.n_words :] + 1)
    return vocab


UNITED = (
    "doc_id long, held_out boolean, n_tokens long, known long, counts_log double, tail_log double, "
    "units binary, rest array<binary>, times array<int>"
)


def united_part(v: Vocabulary, texts: pa.StringArray) -> list[pa.Array]:
    """The computed columns of ``united`` for some texts."""
    listed, code, cuts = coded_words(texts)
    code, cuts = with_ends(len(listed), code, cuts)
    listed.append(END)
    n, sizes = len(texts), np.diff(cuts)
    doc = np.repeat(np.arange(n), sizes)
    # by distinct word
    ids = np.array([v.ids.get(x, -1) for x in listed], np.int64)
    far = ids < 0
    unit = np.where(far, 0, v.unit[ids] if len(v.unit) else 0)
    for i in np.flatnonzero(far).tolist():
        unit[i] = v.tail_unit(listed[i])
    logs = np.where(far, 0.0, np.log10(v.count[ids] + 1.0) if len(v.count) else 0.0)
    tail = np.where(unit >= v.n_words, logs - v.tail_log[unit], 0.0)
    # by document
    outside = far[code]
    pair, times = np.unique(doc[outside] * len(listed) + code[outside], return_counts=True)
    rest = pa.array(listed, pa.binary()).take(pa.array(pair % len(listed)))
    rest_cuts = pa.array(np.searchsorted(pair // len(listed), np.arange(n + 1)).astype(np.int32))
    return [
        pa.array(sizes.astype(np.int64)),
        pa.array(np.bincount(doc, ~outside, n).astype(np.int64)),
        pa.array(np.bincount(doc, logs[code], n)),
        pa.array(np.bincount(doc, tail[code], n)),
        _bytes(unit[code].astype(np.int16), cuts),
        pa.ListArray.from_arrays(rest_cuts, rest),
        pa.ListArray.from_arrays(rest_cuts, pa.array(times.astype(np.int32))),
    ]


def _bytes(values: np.ndarray, cuts: np.ndarray) -> pa.BinaryArray:
    """Runs of 16-bit numbers as binary values, which Spark carries whole, not number by number."""
    cuts = (cuts * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(values)])


def united(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """A row per document: its units, sums over dictionary words, and its words beyond them.

    ``counts_log`` sums log10(count + 1) of all dictionary words, ``tail_log`` what the tail
    classes' shares add; ``rest`` and ``times`` are the distinct words outside the dictionary.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    names = [f.split()[0] for f in UNITED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            for part in text_slices(batch.column(2)):
                own = [batch.column(i)[first : first + len(part)] for i in (0, 1)]
                first += len(part)
                yield pa.RecordBatch.from_arrays([*own, *united_part(shared.value, part)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, UNITED)


# --- network ------------------------------------------------------------------------------


class Network:
    """Gated recurrent network over units; all weights lie in one flat array.

    Inside, states are columns (steps x hidden x lanes), so that gates, candidates and each class's logits are
    contiguous rows, and the words of a window are sorted by class once.
    """

    def __init__(self, unit_class: np.ndarray, start: np.ndarray, flat: np.ndarray | None = None):
        self.unit_class = np.asarray(unit_class, np.int64)
        units, classes, h = len(self.unit_class), int(self.unit_class.max()) + 1, HIDDEN
        shapes = {"x": (units, 3 * h), "zr": (h, 2 * h), "n": (h, h), "c": (h, classes), "cb": (classes,), "o": (units, h), "ob": (units,)}
        total = sum(math.prod(s) for s in shapes.values())
        if flat is None:
            rng = np.random.default_rng(7)
            flat = (rng.standard_normal(total) * 0.1).astype(np.float32)
        self.flat = flat.astype(np.float32)
        self.w: dict[str, np.ndarray] = {}
        self.at: dict[str, slice] = {}
        place = 0
        for name, shape in shapes.items():
            size = math.prod(shape)
            self.at[name] = slice(place, place + size)
            self.w[name] = self.flat[self.at[name]].reshape(shape)
            place += size
        self.members = [np.flatnonzero(self.unit_class == c) for c in range(classes)]
        self.by_class = np.concatenate(self.members)
        self.class_cuts = np.cumsum([0, *map(len, self.members)]).tolist()
        self.inside = np.zeros(units, np.int64)
        for m in self.members:
            self.inside[m] = np.arange(len(m))
        self.rooms: dict[str, np.ndarray] = {}
        if start is not None:
            mass = np.exp(start - start.max())
            by_class = np.array([mass[m].sum() for m in self.members])
            self.w["cb"][:] = np.log(by_class / by_class.sum())
            self.w["ob"][:] = start - np.log(by_class[self.unit_class]) - start.max()

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that the next window uses again: fresh memory for each costs more than the sums in it."""
        size = math.prod(shape)
        if name not in self.rooms or len(self.rooms[name]) < size:
            self.rooms[name] = np.empty(size, np.float32)
        return self.rooms[name][:size].reshape(shape)

    def run(self, units: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """States before each step of a window (steps x hidden x lanes), its gates and candidates, and the state after it (hidden x lanes)."""
        w, n = self.w, HIDDEN
        steps, width = units.shape
        by_word = np.ascontiguousarray(w["x"].T)
        by_word[: 2 * n] *= -1
        to_gates, to_new = -w["zr"].T, np.ascontiguousarray(w["n"].T)
        x, before = self.room("x", steps, 3 * n, width), self.room("before", steps, n, width)
        for t in range(steps):
            h = np.multiply(h, fresh[t], out=before[t])  # a new document begins without a state
            np.take(by_word, units[t], axis=1, out=x[t], mode="clip")
            gates, new = x[t, : 2 * n], x[t, 2 * n :]
            gates += to_gates @ h
            np.exp(gates, out=gates)
            gates += 1
            np.reciprocal(gates, out=gates)
            new += to_new @ (gates[n:] * h)
            np.tanh(new, out=new)
            h = h - new
            h *= gates[:n]
            h += new
        return before, x, h

    def columns(self, by_step: np.ndarray) -> np.ndarray:
        """Steps x rows x lanes as rows x (steps and lanes)."""
        steps, rows, width = by_step.shape
        out = self.room(f"columns {rows}", rows, steps, width)
        out[:] = by_step.transpose(1, 0, 2)
        return out.reshape(rows, -1)

    def steps(self, units: np.ndarray, fresh: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States before each step of a window (steps x lanes x hidden), and the state after it (lanes x hidden)."""
        before, _, after = self.run(units, fresh, h.T)
        return before.transpose(0, 2, 1).copy(), after.T

    def log_probs(self, states: np.ndarray, units: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """``likelihoods`` of states in rows."""
        out, back = self.likelihoods(states.T, units, np.arange(len(units)), grads)
        return out, None if back is None else back.T.copy()

    def likelihoods(self, states: np.ndarray, units: np.ndarray, at: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log probability of each unit in the places ``at`` after its state, a column; with ``grads``, puts gradients into it.

        The second result is the gradient of the log likelihood by the states, 0 for those in other places.
        """
        w, n = self.w, HIDDEN
        goal = self.unit_class[units[at]]
        order = np.argsort(goal.astype(np.int16), kind="stable")
        goal, at = goal[order], at[order]
        mine, k = self.inside[units[at]], np.arange(len(at))
        s = self.room("states", n + 1, len(at))
        s[n] = 1  # for the biases
        for i in range(n):
            np.take(states[i], at, out=s[i], mode="clip")
        weights = np.vstack([w["c"], w["cb"]]).T
        share, out, total = _shares(weights, s, goal, k, self.room("classes", len(weights), len(at)), _large(weights))
        out -= np.log(total)
        if grads is not None:
            share[goal, k] -= total  # so that share / -total is the gradient by the logits
            by_class = (s / -total) @ share.T
            grads["c"][:] = by_class[:n]
            grads["cb"][:] = by_class[n]
            back = self.room("back", n, len(at) + 1)
            back[:, -1] = 0
            np.matmul(w["c"], share, out=back[:, :-1])
            back[:, :-1] /= -total
            by_unit = np.zeros((len(self.unit_class), n + 1), np.float32)
        weights = np.column_stack([w["o"], w["ob"]])[self.by_class]
        large, totals = _large(weights), np.ones(len(at), np.float32)
        cuts = np.searchsorted(goal, np.arange(len(self.members) + 1)).tolist()
        for first, last, a, b in zip(self.class_cuts, self.class_cuts[1:], cuts, cuts[1:]):
            if a == b or last == first + 1:
                continue
            weight, part = weights[first:last], s[:, a:b]
            share, own, total = _shares(weight, part, mine[a:b], k[: b - a], self.room("units", last - first, b - a), large)
            out[a:b] += own
            totals[a:b] = total
            if grads is not None:
                share[mine[a:b], k[: b - a]] -= total
                total = -1 / total
                by_unit[first:last] = share @ (part * total).T
                inner = weight[:, :n].T @ share
                inner *= total
                back[:, a:b] += inner
        out -= np.log(totals)
        logs = np.empty_like(out)
        logs[order] = out
        if grads is None:
            return logs, None
        grads["o"][self.by_class] = by_unit[:, :n]
        grads["ob"][self.by_class] = by_unit[:, n]
        place = np.full(states.shape[1], len(at))
        place[at] = k
        whole = self.room("whole", n, len(place))
        for i in range(n):
            np.take(back[i], place, out=whole[i], mode="clip")
        return logs, whole

    def gradients(self, units: np.ndarray, fresh: np.ndarray, live: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """State after a window, and the window's gradients, by backpropagation to its begin."""
        w, n = self.w, HIDDEN
        before, x, after = self.run(units, fresh, h.T)
        z, r, new = x[:, :n], x[:, n : 2 * n], x[:, 2 * n :]
        grads = {k: np.empty_like(v) for k, v in w.items()}
        _, by_state = self.likelihoods(self.columns(before), units.ravel(), np.flatnonzero(live), grads)
        by_state = by_state.reshape(n, *units.shape)
        # what the state's gradient is multiplied by on its way to candidates, z and r
        to_new, to_z, to_r, rest = (self.room(name, *before.shape) for name in ("to new", "to z", "to r", "rest"))
        np.subtract(1, z, out=to_new)
        np.subtract(before, new, out=to_z)
        to_z *= z
        to_z *= to_new
        np.multiply(new, new, out=rest)
        np.subtract(1, rest, out=rest)
        to_new *= rest
        seen = np.multiply(before, r, out=self.room("seen", *before.shape))
        np.subtract(1, r, out=rest)
        np.multiply(seen, rest, out=to_r)
        by_x = self.room("by x", *x.shape)
        dh = np.zeros(before.shape[1:], np.float32)
        for t in range(len(units) - 1, -1, -1):
            d_new, d_gates = by_x[t, 2 * n :], by_x[t, : 2 * n]
            np.multiply(dh, to_new[t], out=d_new)
            d_rh = w["n"] @ d_new
            np.multiply(dh, to_z[t], out=d_gates[:n])
            np.multiply(d_rh, to_r[t], out=d_gates[n:])
            dh *= z[t]
            d_rh *= r[t]
            dh += d_rh
            dh += w["zr"] @ d_gates
            dh += by_state[:, t]
            dh *= fresh[t]
        grads["n"][:] = (seen @ by_x[:, 2 * n :].transpose(0, 2, 1)).sum(0)
        grads["zr"][:] = (before @ by_x[:, : 2 * n].transpose(0, 2, 1)).sum(0)
        number, by_word = units.ravel(), np.zeros(w["x"].shape[::-1], np.float32)
        for to, row in zip(by_word, self.columns(by_x)):
            np.add.at(to, number, row)
        grads["x"][:] = by_word.T
        return after.T, grads


def _large(weights: np.ndarray) -> bool:
    """Whether exponentials of logits may overflow; a state's numbers are between -1 and 1."""
    return bool(np.abs(weights).sum(1).max() > 80)


def _shares(
    weight: np.ndarray, states: np.ndarray, goal: np.ndarray, k: np.ndarray, share: np.ndarray, large: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of all choices (choices x states, written to ``share``), the logit of each state's ``goal``, and the shares' totals."""
    np.matmul(weight, states, out=share)
    if large:
        share -= share.max(0)
    out = share[goal, k]
    np.exp(share, out=share)
    return share, out, share.sum(0)


def lanes(sizes: np.ndarray, width: int = LANES) -> list[list[int]]:
    """Documents dealt to lanes of about equal length, long ones first."""
    heap = [(0, i) for i in range(min(width, max(1, len(sizes))))]
    dealt: list[list[int]] = [[] for _ in heap]
    for doc in np.argsort(-sizes, kind="stable").tolist():
        length, lane = heapq.heappop(heap)
        dealt[lane].append(doc)
        heapq.heappush(heap, (length + int(sizes[doc]), lane))
    return dealt


@dataclass
class Laid:
    """Documents side by side (steps x lanes): units, 0 where a document begins, and its number."""

    units: np.ndarray
    fresh: np.ndarray
    doc: np.ndarray  # -1 beyond a lane's end

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same of each window, without the lanes that have ended before it."""
        for at in range(0, len(self.doc), WINDOW):
            there = slice(at, at + WINDOW), slice(0, int((self.doc[at] >= 0).sum()))
            yield self.units[there].astype(np.int64), self.fresh[there], self.doc[there]


def laid(values: np.ndarray, offsets: np.ndarray) -> Laid:
    sizes = np.diff(offsets)
    # long lanes first, so that lanes that have ended are the last ones
    dealt = sorted(lanes(sizes), key=lambda d: -sizes[d].sum())
    length = int(sizes[dealt[0]].sum()) if dealt else 0
    units = np.zeros((length, len(dealt)), np.int16)
    fresh = np.ones((length, len(dealt)), np.float32)
    doc = np.full((length, len(dealt)), -1, np.int32)
    for lane, docs in enumerate(dealt):
        at = 0
        for d in docs:
            n = int(sizes[d])
            units[at : at + n, lane] = values[offsets[d] : offsets[d + 1]]
            doc[at : at + n, lane] = d
            if n:
                fresh[at, lane] = 0
            at += n
    return Laid(units, fresh, doc)


def _lists(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all of the column's values, and where each value begins and ends among them."""
    wide = isinstance(column, pa.LargeBinaryArray)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    values = np.frombuffer(data, np.uint8)[: int(offsets[-1])].view(np.int16) if data is not None else np.zeros(0, np.int16)
    return values, offsets // 2


PART_TOKENS = 2_000_000  # that are laid out at once


def _parts(column: pa.BinaryArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A batch's documents in parts of bounded size: first document, values, offsets."""
    values, offsets = _lists(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + PART_TOKENS, "right")) - 1)
        yield first, values, offsets[first : last + 1]
        first = last


def score_batch(net: Network, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log likelihood of each document; the state goes on from window to window."""
    n = len(offsets) - 1
    total = np.zeros(n)
    page = laid(values, offsets)
    h = np.zeros((HIDDEN, page.units.shape[1]), np.float32)
    for units, fresh, doc in page.windows():
        before, _, h = net.run(units, fresh, h[:, : doc.shape[1]])
        doc = doc.ravel()
        live = np.flatnonzero(doc >= 0)
        logs, _ = net.likelihoods(net.columns(before), units.ravel(), live)
        total += np.bincount(doc[live], logs, n)
    return total


def train_batch(net: Network, seen: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> int:
    """Go through the documents once, with an Adagrad step for each window; returns the tokens read."""
    page = laid(values, offsets)
    h = np.zeros((page.units.shape[1], HIDDEN), np.float32)
    for units, fresh, doc in page.windows():
        live = doc >= 0
        h, grads = net.gradients(units, fresh, live, h[: doc.shape[1]])
        scale = 1 / max(1, int(live.sum()))
        for name, part in net.at.items():
            g, square = grads[name].ravel(), seen[part]
            g *= scale * 100
            square += g * g
            g *= RATE
            g /= np.sqrt(square) + 1e-4
            net.flat[part] += g
    return int(offsets[-1] - offsets[0])


def train(units: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after ``rounds`` rounds over the documents of ``units`` (round, units)."""
    spark = units.sparkSession
    flat = Network(vocab.unit_class, vocab.start).flat
    for r in range(rounds):
        shared = spark.sparkContext.broadcast((vocab.unit_class, flat))
        flat = _averaged(units.filter(F.col("round") == r).select("units"), shared, flat)
        shared.unpersist()
    return flat


def _averaged(units: DataFrame, shared, flat: np.ndarray) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_class, weights = shared.value
        net = Network(unit_class, None, weights.copy())
        seen, tokens = np.full(len(weights), 1e-8, np.float32), 0
        for batch in batches:
            for _, values, offsets in _parts(batch.column(0)):
                tokens += train_batch(net, seen, values, offsets)
        if tokens:
            blocks = [net.flat[i : i + BLOCK] * float(tokens) for i in range(0, len(net.flat), BLOCK)]
            n = len(blocks)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(n), pa.int32()),
                    pa.array([TaskContext.get().partitionId()] * n, pa.int32()),
                    pa.array([float(tokens)] * n),
                    pa.array([b.astype(np.float64) for b in blocks], pa.list_(pa.float64())),
                ],
                names=["block", "task", "weight", "values"],
            )

    schema = "block int, task int, weight double, values array<double>"

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.stack(frame["values"].to_numpy()), axis=0)
        return pd.DataFrame(
            {"block": [frame["block"].iloc[0]], "task": [frame["task"].iloc[0]], "weight": [frame["weight"].sum()], "values": [total]}
        )

    trained = units.mapInArrow(run, schema)
    # sums of up to 64 tasks each, then of those
    some = trained.withColumn("task", F.expr("task div 64")).groupBy("block", "task").applyInPandas(add, schema)
    total = some.withColumn("task", F.lit(0)).groupBy("block", "task").applyInPandas(add, schema).toPandas()
    if not len(total):
        return flat
    total = total.sort_values("block")
    return np.concatenate([np.asarray(v) / w for v, w in zip(total["values"], total["weight"])]).astype(np.float32)


def network_scores(units: DataFrame, vocab: Vocabulary, flat: np.ndarray) -> DataFrame:
    """Log likelihood of each document's units: row, network."""
    shared = units.sparkSession.sparkContext.broadcast((vocab.unit_class, flat))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit_class, weights = shared.value
        net = Network(unit_class, None, weights)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, values, offsets in _parts(batch.column(1)):
                scores[first : first + len(offsets) - 1] = score_batch(net, values, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["row", "network"])

    return units.select("row", "units").mapInArrow(run, "row long, network double")


def score_documents(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of whole texts, the end included. The model learns from all
    documents that are not held out; ``lang``, if the table has it, groups the classes of words. A
    null text is empty (its end is still scored), a null id counts as an empty text for the
    split, and rows with equal ids are documents of their own. An empty table gives an empty result.
    """
    group = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    training = docs.filter(~held_out(F.col("doc_id"))).select("text", group.alias("group"))
    counts = stage(token_counts(training), "token-counts")
    by_word = stage(word_counts(counts), "words")
    vocab = with_totals(vocabulary(counts, by_word), by_word)
    made = united(docs, vocab).withColumns(
        {"row": F.monotonically_increasing_id(), "round": F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(ROUNDS))}
    )
    made = stage(made, "units")
    flat = train(made.filter("not held_out"), vocab)
    network = network_scores(made, vocab, flat)
    words = made.select("row", F.explode(F.arrays_zip("rest", "times")).alias("w")).select(
        "row", F.col("w.rest").alias("token"), F.col("w.times").alias("times")
    )
    known = by_word.select("token", "n").filter(F.col("n") < vocab.least)
    far = (
        words.join(known, "token")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("far_log"), F.sum("times").alias("far_known"))
    )
    all_log = math.log10(vocab.tokens + vocab.distinct + 1)
    far_log = F.coalesce("far_log", F.lit(0.0))
    joined = made.drop("units", "rest", "times").join(network, "row").join(far, "row", "left")
    return joined.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("far_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"),
        (F.col("counts_log") + far_log - F.col("n_tokens") * all_log).alias("base_score"),
        (F.col("network") / math.log(10) + F.col("tail_log") + far_log).alias("score"),
    )
