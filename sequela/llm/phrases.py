"""Phrase collocations from depth-truncated suffix subtrees, by vertical partitioning.

The suffix tree of the corpus, cut off at four words, is never built whole. Word prefixes are counted
first: single words, then pairs of frequent words. Prefixes that can hold no candidate are left out,
the others are dealt into groups of about one memory budget of occurrences; a pair that alone passes the
budget is extended by a word and its subtree dealt over several groups. The text is read again, each
place's suffix goes to the group of its prefix, counted where it was read, and every group builds
its subtrees alone: its suffixes, in order, are the leaves, and the totals of leaves under a node are its
count. A sorted run of suffixes is a subtree walked from left to right, so a group takes the memory of one
path, whatever its size.

Filters sent to tasks are bitmaps of fixed size over hashes of frequent words and pairs: a bit that is set
by accident lets a rare prefix through, which costs time, and its counts are as exact as any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sequela.llm.text import text_slices
from sequela.sources.stages import stage

MIN_COUNT, MIN_WORDS, MAX_WORDS = 30, 2, 4
#: A candidate goes if a longer one around it has this share of its occurrences, in hundredths.
COVER = 80
SCALE, TOP = 2_000_000, 2000
#: Occurrences in a group of prefixes, at least; it grows with the corpus, so that there are GROUPS at most.
BUDGET, GROUPS = 1 << 20, 1 << 16
#: Bits of the filters.
FILTER_BITS = 1 << 25
#: Bytes of text that are counted at once in a task.
BYTES = 1 << 22
SPREAD = 64

_LETTER, _SPACE, _BREAK = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[list(b".,;:!?") + [0x0A, 0x0B, 0x0C, 0x0D]] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

COUNTS = "lang string, phrase binary, n long"


def _runs(letter: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words, and the bytes after their last ones."""
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | fresh[1:-1]
    ends[:-1] &= ~letter[1:] | fresh[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Slice:
    """Words of some texts: numbers of distinct (lang, word), and pieces.

    ``word[i]`` is the number of word i, ``piece[i]`` that of its piece; ``lang`` and ``names`` give the
    language and bytes of a number.
    """

    def __init__(self, langs: pa.StringArray, texts: pa.StringArray):
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary.to_pylist()
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        first, last = int(offsets[0]), int(offsets[-1])
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[first:last] if data is not None else np.zeros(0, np.uint8)
        cuts = offsets[:-1].astype(np.int64) - first
        kind = _KIND[raw]
        fresh = np.zeros(len(raw) + 1, bool)  # where a text begins, or all texts have ended
        fresh[cuts] = True
        fresh[-1] = True
        letter = kind == _LETTER
        at, end = _runs(letter, fresh)
        self.piece = np.searchsorted(np.flatnonzero((kind == _BREAK) | fresh[:-1]), at, "right")
        text = np.searchsorted(cuts, at, "right") - 1
        bounds = np.zeros(len(at) + 1, np.int32)
        np.cumsum(end - at, out=bounds[1:])
        letters = _LOWER[raw[letter]]
        del kind, letter, fresh
        words = pa.BinaryArray.from_buffers(
            pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(letters)]
        ).dictionary_encode()
        self.distinct = words.dictionary
        width = max(len(self.distinct), 1)
        lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[text]
        pair = lang * width + words.indices.to_numpy(zero_copy_only=False)
        self.both, self.word = np.unique(pair, return_inverse=True)
        self.lang, self.name = self.both // width, self.both % width

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each number's (lang, word)."""
        heads = [xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")) for lang in self.langs]
        tails = self.distinct.to_pylist()
        made = (xxhash.xxh64_intdigest(tails[n], heads[k]) for k, n in zip(self.lang.tolist(), self.name.tolist()))
        return np.fromiter(made, np.uint64, len(self.lang))

    def batch(self, numbers: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        """Rows (lang, phrase, n) for phrases whose words have these numbers; -1 where a phrase has ended."""
        lang = pa.array(self.langs, pa.string()).take(pa.array(self.lang[numbers[0]]))
        phrase = self.distinct.take(pa.array(self.name[numbers[0]]))
        for number in numbers[1:]:
            there = number >= 0
            word = self.distinct.take(pa.array(np.where(there, self.name[number], 0)))
            longer = pc.binary_join_element_wise(phrase, word, pa.scalar(b" ", pa.binary()))
            phrase = pc.if_else(pa.array(there), longer, phrase)
        return pa.RecordBatch.from_arrays([lang, phrase, pa.array(n, pa.int64())], names=["lang", "phrase", "n"])


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of pairs of hashes, in order."""
    with np.errstate(over="ignore"):
        mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + (a >> np.uint64(29)))
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return mixed ^ (mixed >> np.uint64(32))


def _bit(h: np.ndarray, size: int) -> np.ndarray:
    return (h % np.uint64(size)).astype(np.int64)


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _bit(h, 8 * len(bits))
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def word_rows(part: Slice) -> Iterator[pa.RecordBatch]:
    """Each (lang, word) with its occurrences in the slice."""
    yield part.batch([np.arange(len(part.both))], np.bincount(part.word, minlength=len(part.both)))


def pair_rows(part: Slice, words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of words that pass the filter ``words``, with their occurrences in the slice."""
    a, b, _ = _pairs(part, _passes(words, part.hashes()))
    width = len(part.both)
    code, n = np.unique(a * width + b, return_counts=True)
    yield part.batch([code // max(width, 1), code % max(width, 1)], n)


def _pairs(part: Slice, good: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second word of the pairs of good words within a piece, and where they are."""
    w, p = part.word, part.piece
    if len(w) < 2:
        nothing = np.zeros(0, np.int64)
        return nothing, nothing, nothing
    at = np.flatnonzero((p[1:] == p[:-1]) & good[w[1:]] & good[w[:-1]])
    return w[at], w[at + 1], at


def suffix_rows(part: Slice, words: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Suffixes of three or four words, cut before the first pair that the filter stops, with their occurrences."""
    h = part.hashes()
    a, b, at = _pairs(part, _passes(words, h))
    width = max(len(part.both), 1)
    code, pair = np.unique(a * width + b, return_inverse=True)
    first, second = code // width, code % width
    good = _passes(pairs, _mixed(h[first], h[second]))
    number = np.full(len(part.word) + 2, -1, np.int64)  # of the pair that begins at a word
    at, pair = at[good[pair]], pair[good[pair]]
    number[at] = pair
    begin = at[number[at + 1] >= 0]
    lead, follow, last = number[begin], number[begin + 1], number[begin + 2]
    # a pair number fits two words, so that lead with last names four words
    wide = np.where(last >= 0, last, len(code) + second[follow])
    key, n = np.unique(lead * (len(code) + width) + wide, return_counts=True)
    lead, wide = key // (len(code) + width), key % (len(code) + width)
    full = wide < len(code)
    inner = np.where(full, wide, 0)
    third = np.where(full, first[inner] if len(code) else 0, wide - len(code))
    fourth = np.where(full, second[inner] if len(code) else 0, -1)
    yield part.batch([first[lead], second[lead], third, fourth], n)


def _one(arrays: list[pa.Array]) -> pa.Array:
    return arrays[0] if len(arrays) == 1 else pa.concat_arrays(arrays)


def _counted(docs: DataFrame, rows: Callable[[Slice], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Rows (lang, phrase, n) that ``rows`` makes of slices of the texts."""
    picked = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            langs, texts = (_one([b.column(i) for b in held]) for i in range(2))
            held.clear()
            first = 0
            for some in text_slices(texts, BYTES):
                yield from rows(Slice(langs[first : first + len(some)], some))
                first += len(some)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= BYTES:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return picked.mapInArrow(run, COUNTS)


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _places(phrases: DataFrame) -> DataFrame:
    """Place, from 1, of each phrase of one or two words in the filter, by the tasks' own hash."""

    size = FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.zeros(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                head = xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"))
                h = [np.uint64(xxhash.xxh64_intdigest(w, head)) for w in phrase.split(b" ")]
                bits[i] = h[0] if len(h) == 1 else _mixed(np.array(h[:1]), np.array(h[1:]))[0]
            yield pa.RecordBatch.from_pydict({"place": _bit(bits, size) + 1}, schema=pa.schema([("place", pa.int64())]))

    return phrases.select("lang", "phrase").mapInArrow(run, "place long")


def _filter(frequent: DataFrame) -> np.ndarray:
    """Bitmap of the phrases' bits: built in Spark, ``FILTER_BITS`` bits on the driver whatever the table's size."""
    maps = _places(frequent).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    # buckets count from 1 and hold 32,768 bits
    rows = maps.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")).collect()
    out = np.zeros(-(-FILTER_BITS // 32768) * 4096, np.uint8)
    for row in rows:
        out[(row["bucket"] - 1) * 4096 : row["bucket"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out[: FILTER_BITS // 8]


def _lead(n: int) -> Column:
    """The first n words of a suffix, as text."""
    return F.substring_index(F.col("phrase").cast("string"), " ", n)


def subtree_counts(suffixes: DataFrame, pairs: DataFrame, total: int) -> DataFrame:
    """Counts (lang, phrase, n) of phrases of three and four words, from the leaves of their subtrees.

    ``suffixes`` are (lang, phrase, n), a row per slice of text and suffix; ``pairs`` the counted
    prefixes of two words. A group takes pairs of a budget of occurrences, so there are at most ``GROUPS``
    groups, and at most as many pairs above the budget, which are told by broadcast.
    """
    budget = max(BUDGET, -(-total // GROUPS))
    groups = max(1, -(-total // budget))
    heavy = pairs.filter(F.col("n") > budget).select("lang", F.col("phrase").cast("string").alias("lead"))
    dealt = (
        suffixes.withColumn("lead", _lead(2))
        .join(F.broadcast(heavy.withColumn("wide", F.lit(True))), ["lang", "lead"], "left")
        .withColumn("prefix", F.when(F.col("wide"), _lead(3)).otherwise(F.col("lead")))
        .withColumn("group", F.pmod(F.xxhash64("lang", "prefix"), F.lit(groups)))
        .select("lang", "phrase", "n", "group", _lead(3).alias("node"))
    )
    # words may hold bytes below a space's, so the node comes before the suffix
    ordered = dealt.repartition(groups, "group").sortWithinPartitions("lang", "node", "phrase")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])
        path: list[tuple] = [(None, None), (None, None)]  # the open node of three words and of four
        total = [0, 0]
        for batch in batches:
            done: list[tuple] = []
            columns = (batch.column(i).to_pylist() for i in range(3))
            for lang, phrase, n in zip(*columns):
                words = phrase.split(b" ")
                at = [(lang, b" ".join(words[:3])), (lang, phrase if len(words) > 3 else None)]
                for i in range(2):
                    if at[i] != path[i]:
                        if path[i][1] and total[i] >= MIN_COUNT:
                            done.append((*path[i], total[i]))
                        path[i], total[i] = at[i], 0
                    total[i] += n
            yield _batch(done, schema)
        yield _batch([(*path[i], total[i]) for i in range(2) if path[i][1] and total[i] >= MIN_COUNT], schema)

    return ordered.select("lang", "phrase", "n").mapInArrow(walk, COUNTS)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def frequent_phrases(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(lang, phrase, words, n) for phrases of one to four words with MIN_COUNT occurrences, words per lang, and all words."""
    words = stage(_summed(_counted(docs, word_rows)), "words")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("words_in_lang"))
    total = words.agg(F.sum("n")).first()[0] or 0
    words = words.filter(F.col("n") >= MIN_COUNT)
    spark = docs.sparkSession.sparkContext
    known = spark.broadcast(_filter(words))
    pairs = _summed(_counted(docs, lambda s: pair_rows(s, known.value))).filter(F.col("n") >= MIN_COUNT)
    pairs = stage(pairs, "pairs")
    leads = spark.broadcast(_filter(pairs))
    suffixes = _counted(docs, lambda s: suffix_rows(s, known.value, leads.value))
    longer = subtree_counts(suffixes, pairs, total)
    every = words.unionByName(pairs).unionByName(longer)
    every = every.select("lang", F.col("phrase").cast("string").alias("phrase"), "n")
    every = every.withColumn("words", F.size(F.split("phrase", " ")))
    return stage(every, "phrases"), sizes, total


def _joined(words: Column, first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def with_parts(candidates: DataFrame, phrases: DataFrame, total: int) -> DataFrame:
    """Each candidate's cuts (k, l, r) beside the counts of their parts.

    A part with n occurrences is in at most n / 10 candidates: those of a length have 30 occurrences each and
    share none. So the at most 3 * GROUPS parts above a budget are told by broadcast, and the
    join on the others meets few rows of a key.
    """
    budget = max(BUDGET, -(-total // GROUPS))
    w = F.split("phrase", " ")
    k = F.col("k")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    for name, part in (("l", _joined(w, F.lit(1), k)), ("r", _joined(w, k + 1, F.col("words") - k))):
        counts = phrases.select("lang", F.col("phrase").alias("_part"), F.col("n").alias("_n"))
        heavy = counts.filter(F.col("_n") > budget).withColumnRenamed("_n", "_heavy")
        asked = cuts.withColumn("_part", part).join(F.broadcast(heavy), ["lang", "_part"], "left")
        light = asked.filter("_heavy is null").join(counts.filter(F.col("_n") <= budget), ["lang", "_part"])
        found = asked.filter("_heavy is not null").withColumn("_n", F.col("_heavy"))
        cuts = light.unionByName(found).withColumnRenamed("_n", name).drop("_part", "_heavy")
    return cuts


def scored(cuts: DataFrame) -> DataFrame:
    """Each candidate's cut (score, k, l, r) of the lowest score, in whole numbers that cannot overflow."""
    score = F.expr(f"cast({SCALE}BD * cast(n as decimal(19,0)) div (cast(l as decimal(19,0)) + r) as long)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "n").agg(best)


def _inside(candidates: DataFrame) -> DataFrame:
    """(lang, phrase, most): phrases that lie within longer candidates, and the largest count of those."""
    w = F.split("phrase", " ")
    spans = [(m, at, n) for m in (3, 4) for n in range(MIN_WORDS, m) for at in range(1, m - n + 2)]
    parts = F.array(*[F.when(F.col("words") == m, _joined(w, F.lit(at), F.lit(n))) for m, at, n in spans])
    return (
        candidates.filter("words > 2")
        .select("lang", F.explode(F.array_compact(parts)).alias("phrase"), F.col("n").alias("longer"))
        .groupBy("lang", "phrase")
        .agg(F.max("longer").alias("most"))
    )


def _ranked(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each lang, in parts first, so that no task orders a whole lang."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))
    some = rows.withColumn("_part", part)
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order)))
    some = some.filter(F.col("rank") <= top).drop("_part", "rank")
    every = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    return every.filter(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best phrases of each lang: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, pieces into words at spaces and
    tabs. A candidate has two to four words and ``a`` >= 30 occurrences within pieces; of its cuts into two
    parts, with ``l`` and ``r`` occurrences, the one with the lowest floor(2000000 * a / (l + r)) counts, the
    first of equal ones. Candidates within a longer one that has 80 percent of their occurrences go. ``n`` is
    the number of words of the lang. Order: score, a, both descending, then phrase by its bytes.

    A null lang is ``und`` (as a lang of that name), a null text empty. Rows are counted one by one, equal ones
    too; doc_id and further columns are not read. An empty table, or one without candidates, gives no rows.
    """
    phrases, sizes, total = frequent_phrases(docs)
    candidates = phrases.filter(F.col("words") >= MIN_WORDS)
    best = scored(with_parts(candidates, phrases, total))
    kept = (
        best.join(_inside(candidates), ["lang", "phrase"], "left")
        .filter(F.col("most").isNull() | (F.expr(f"most * 100BD < n * {COVER}BD")))
        .select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    )
    return (
        _ranked(kept, top)
        .join(sizes, "lang")
        .select("lang", "rank", "phrase", "a", "l", "r", F.col("words_in_lang").alias("n"), "score")
    )
