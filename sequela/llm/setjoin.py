"""N-gram Jaccard join: a size-aware join, by subsets for small sets and by inverted lists for large.

Documents with equal shingle sets form a class; classes are joined. Two sets of sizes a and b link
when they share o(a, b) shingles or more, the least overlap that their sizes allow.

* Small sets: two linked sets share a subset of exactly o(a, b) shingles. A small set lists all of
  its subsets of the sizes that o can have for it, and linked sets meet in one of them.
* Large sets: shingles are put in one order, common ones last. Linked sets share a shingle among
  the first |A| - ceil(percent |A|) + 1 of both, so only these stand in inverted lists. Scanning the
  lists counts how many of them two sets share, and a pair that shares too few can't link.

The size at which sets count as large is where listing subsets costs more than scanning lists.

All links are found and counted. First each class is put beside one centre of its lists, which
groups the classes; a group's sets are compared in tiles, blocks of sets that a task holds as
matrices. So a group of near copies makes a row per set and block, not per pair. Then the lists
give the pairs of different groups. Every link is confirmed on the whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sequela.llm.components import components
from sequela.llm.text import coded_words, most_frequent, text_slices
from sequela.sources.stages import stage

SHINGLE, PERCENT = 4, 85  # of op5, the defaults
SCAN_COST = 8  # of a shingle in an inverted list, in listed subsets
MAX_SMALL = 30  # sizes up to which the cost of subsets is looked at
LOCAL_COUNT, HOT_COUNT = 8, 64  # sets of a batch, and of all, that make a shingle common
MAX_HOT = 1_000_000  # common shingles sent to the tasks (16 MB); others rank as rare ones
BROADCAST_IDS = 1_000_000  # of documents, under 64 MB
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 18  # of a block, on the average; a task compares two blocks
MATRIX = 1 << 22  # cells of a block's matrix at a time (16 MB)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def least_overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """Shingles that sets of sizes a and b must share: 100 * shared >= percent * (a + b - shared)."""
    return -(-percent * (a + b) // (100 + percent))


def partner_sizes(a: int, percent: int = PERCENT) -> range:
    return range(-(-percent * a // 100), 100 * a // percent + 1)


def prefix_size(a: int, percent: int = PERCENT) -> int:
    return a + percent * -a // 100 + 1


def subset_sizes(a: int, percent: int = PERCENT) -> list[int]:
    """Sizes of the subsets that a small set of size a lists, one for each overlap it may need."""
    needed = ((least_overlap(a, b, percent), b) for b in partner_sizes(a, percent))
    return sorted({k for k, b in needed if k <= min(a, b)})


def boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """Largest size of a small set: where listing subsets and scanning lists cost least together."""
    subsets = {a: sum(math.comb(a, k) for k in subset_sizes(a, percent)) for a in range(1, MAX_SMALL + 1)}
    small = {a: sizes.get(a, 0) * subsets[a] for a in subsets}
    large = {a: sizes.get(a, 0) * prefix_size(a, percent) * SCAN_COST for a in subsets}
    cost = [sum(small[a] for a in subsets if a <= x) + sum(large[a] for a in subsets if a > x) for x in range(MAX_SMALL + 1)]
    return int(np.argmin(cost))


# --- sets ---------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.StringArray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the ascending distinct hashes of its shingles, or of all words if they are fewer.

    Each distinct word of a slice is hashed once.
    """
    for part in text_slices(texts):
        listed, code, cuts = coded_words(part)
        w = np.array([xxhash.xxh64_intdigest(x) for x in listed], np.uint64)[code]
        cuts = cuts.tolist()
        whole = _hashed(w, size)  # also over texts' borders; those are left out below
        for a, b in zip(cuts, cuts[1:]):
            yield np.unique(whole[a : b - size + 1] if b - a >= size else _hashed(w[a:b], b - a))


def _hashed(w: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of k words."""
    n = len(w) - k + 1
    if k == 0 or n <= 0:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        s = np.full(n, k, np.uint64)
        for i in range(k):
            s = s * _A + w[i : i + n]
        return _mixed(s).view(np.int64)


def class_id(shingles: np.ndarray) -> int:
    """64-bit hash of a set; with the set's size it names the class of equal sets."""
    with np.errstate(over="ignore"):
        return int(_mixed(shingles.view(np.uint64) + _A).sum(dtype=np.uint64).astype(np.int64))


SETS = "doc_id long, n int, cid long, shingle long, times long"


def document_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Two kinds of rows: a document's doc_id, n, cid; and a shingle common in a batch, times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cid, every = [], [], []
            for s in shingle_sets(batch.column(1), size):
                n.append(len(s))
                cid.append(class_id(s) if len(s) else None)
                every.append(s)
            values, counts = np.unique(np.concatenate(every or [np.zeros(0, np.int64)]), return_counts=True)
            common = counts >= LOCAL_COUNT
            yield _batch(SETS, batch.column(0), n, cid, None, None)
            if common.any():
                yield _batch(SETS, None, None, None, values[common], counts[common])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SETS)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    length = next(len(c) for c in columns if c is not None)
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "array<long>": pa.list_(pa.int64())}
    arrays = [
        pa.nulls(length, kinds[kind]) if c is None else c.cast(kinds[kind]) if isinstance(c, pa.Array) else pa.array(c, kinds[kind])
        for c, (_, kind) in zip(columns, fields)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


# --- candidates ---------------------------------------------------------------------------

KEYS = "kind byte, key long, cid long, n int"
SUBSET, LIST = 0, 1


def subset_keys(shingles: np.ndarray, percent: int = PERCENT) -> list[int]:
    """Hashes of the subsets that a small set lists."""
    keys = []
    with np.errstate(over="ignore"):
        mixed = _mixed(shingles.view(np.uint64) ^ _C)
        for k in subset_sizes(len(shingles), percent):
            for subset in combinations(range(len(shingles)), k):
                total = mixed[list(subset)].sum(dtype=np.uint64) + np.uint64(k) * _A
                keys.append(int(_mixed(total[None])[0].astype(np.int64)))
    return keys


def prefix(shingles: np.ndarray, hot: np.ndarray, times: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set in the common order: rare before common, then by hash."""
    size = prefix_size(len(shingles), percent)
    if not len(hot):
        return shingles[:size]
    at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
    often = np.where(hot[at] == shingles, times[at], 0)
    return shingles[np.argsort(often, kind="stable")[:size]]


def candidate_keys(
    docs: DataFrame, small: int, hot: tuple[np.ndarray, np.ndarray], size: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """Subset keys of small sets and list entries of large ones, and of those that may link to them."""
    shared = docs.sparkSession.sparkContext.broadcast(hot)
    from_size = partner_sizes(small + 1, percent).start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple[int, np.ndarray, int, int]] = []
            for s in shingle_sets(batch.column(0), size):
                if not len(s):
                    continue
                cid = class_id(s)
                if len(s) <= small:
                    parts.append((SUBSET, np.array(subset_keys(s, percent), np.int64), cid, len(s)))
                if len(s) >= from_size:
                    parts.append((LIST, prefix(s, *shared.value, percent), cid, len(s)))
            if parts:
                sizes = [len(p[1]) for p in parts]
                yield _batch(
                    KEYS,
                    np.repeat([p[0] for p in parts], sizes),
                    np.concatenate([p[1] for p in parts]),
                    np.repeat(np.array([p[2] for p in parts], np.int64), sizes),
                    np.repeat([p[3] for p in parts], sizes),
                )

    return docs.select("text").mapInArrow(run, KEYS)


def shared_keys(keys: DataFrame) -> DataFrame:
    """Entries of the keys that two classes or more have: kind, key, cid, n, lo (the smallest class)."""
    several = keys.groupBy("kind", "key").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).filter("lo < hi")
    return stage(keys.join(several.select("kind", "key", "lo"), ["kind", "key"]).distinct(), "shared")


def subset_links(shared: DataFrame) -> DataFrame:
    """Candidate links of small sets: a, b.

    Sets with a common subset of size k link if k is enough for their sizes. The smallest set in
    the list of a subset needs no more than any other two in it, so linking all to it keeps what
    is connected.
    """
    entries = shared.filter(F.col("kind") == SUBSET).select("key", "cid", "n")
    least = entries.groupBy("key").agg(F.min(F.struct("n", "cid")).alias("m"))
    pairs = entries.join(least, "key").filter("cid != m.cid")
    return pairs.select(F.col("m.cid").alias("a"), F.col("cid").alias("b")).distinct()


def _needed(n_a, n_b, percent: int):
    return F.ceil((percent * (n_a + n_b)) / (100 + percent))


def _spare(n, percent: int):
    """Shingles of a set that stand in no list: n less its prefix."""
    return F.ceil(percent * n / 100) - 1


def first_links(entries: DataFrame, sizes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """For each class the centre of a list with which it shares most lists: a, b.

    The centre of a list is its member with most entries in shared lists: the one with least of its
    own is likeliest to link to the others.
    """
    own = entries.groupBy("cid").agg(F.count("*").alias("e"))
    centres = entries.join(own, "cid").groupBy("key").agg(F.max(F.struct("e", "cid")).alias("m"))
    met = entries.join(centres.select("key", F.col("m.cid").alias("centre")), "key").filter("cid != centre")
    counted = met.groupBy("cid", "centre", "n").agg(F.count("*").alias("c"))
    known = counted.join(sizes.select(F.col("cid").alias("centre"), F.col("n").alias("n_centre")), "centre")
    # what shares too few entries with the centre is left to the scan of the lists
    likely = known.filter(_may_link(F.col("c"), F.col("n"), F.col("n_centre"), percent))
    best = likely.groupBy("cid").agg(F.max(F.struct("c", "centre")).alias("m"))
    return best.select(F.col("m.centre").alias("a"), F.col("cid").alias("b"))


def _may_link(c, n_a, n_b, percent: int):
    """Whether sets that share c entries of the lists can link.

    All entries of the set whose last one comes first in the common order, but for those shared,
    are missing in the other set. So the sets share c and what stands in no list, at most.
    """
    sizes = (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (c > 0)
    return sizes & (c >= _least_count(n_a, n_b, percent))


def _least_count(n_a, n_b, percent: int):
    """Entries of the lists that sets of these sizes share at least if they link."""
    return _needed(n_a, n_b, percent) - F.greatest(_spare(n_a, percent), _spare(n_b, percent))


def scanned(entries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The entries by which a class can be met: key, cid, n.

    A class with e entries that must share t of them with a partner is met in one of its first
    e - t + 1, if all classes take their entries in one order, short lists first.
    """
    lists = entries.groupBy("key").agg(F.count("*").alias("k"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    known = entries.select("key", "cid", "n").join(lists, "key")
    by_class = known.groupBy("cid", "n").agg(F.count("*").alias("e"), F.min("least_n").alias("lo"), F.max("most_n").alias("hi"))
    n = F.col("n")
    lo = F.greatest("lo", F.ceil(percent * n / 100))
    hi = F.least("hi", F.floor(100 * n / percent))
    # the count falls with the distance of the sizes; one less, as both terms are rounded
    t = F.greatest(F.least(*[_least_count(n, other, percent) for other in (lo, n, hi)]) - 1, F.lit(1))
    order = F.row_number().over(W.partitionBy("cid").orderBy("k", "key"))  # the entries of a class
    return (
        known.withColumn("at", order)
        .join(by_class.select("cid", "e", t.alias("t")), "cid")
        .filter(F.col("at") <= F.col("e") - F.col("t") + 1)
        .select("key", "cid", "n")
    )


def other_links(entries: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Candidate pairs in the lists whose classes are of different ``groups`` (node, label): a, b.

    In each list the group with most entries is left out as first partner: its members need
    not be compared among themselves. The pairs' shared entries are counted in the end.
    """
    marked = (
        scanned(entries, percent)
        .join(groups.withColumnRenamed("node", "cid"), "cid", "left")
        .select("key", "cid", "n", F.coalesce("label", "cid").alias("label"))
    )
    parts = marked.groupBy("key", "label").agg(F.count("*").alias("k"))
    bulk = parts.groupBy("key").agg(F.max(F.struct("k", "label")).alias("bulk"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = stage(marked.join(bulk.select("key", F.col("bulk.label").alias("most")), "key"), "open-lists")

    def side(x: str) -> list:
        return [F.col("cid").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "label")]]

    left = open_.filter("label != most").select("key", "most", *side("x"))
    right = open_.select("key", *side("y"))
    # a pair of two that are both not in the bulk would be met from either side
    once = (F.col("label_x") != F.col("label_y")) & ((F.col("label_y") == F.col("most")) | (F.col("x") < F.col("y")))
    fits = (100 * F.least("n_x", "n_y")) >= (percent * F.greatest("n_x", "n_y"))
    met = left.join(right, "key").filter(once & fits)
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    lists = entries.groupBy("cid").agg(F.first("n").alias("n"), F.collect_list("key").alias("keys"))
    both = pairs.join(lists.toDF("a", "n_a", "keys_a"), "a").join(lists.toDF("b", "n_b", "keys_b"), "b")
    c = F.size(F.array_intersect("keys_a", "keys_b"))
    return both.filter(_may_link(c, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


# --- links --------------------------------------------------------------------------------


def class_sets(docs: DataFrame, reps: DataFrame, size: int = SHINGLE) -> DataFrame:
    """The sets of the classes in ``reps`` (cid, doc_id of a member): cid, shingles.

    Other rows with a member's id, or without one like it, are read too; their classes are dropped.
    """
    ids = bounded(reps.select(F.col("doc_id").alias("member")).distinct())
    picked = docs.join(ids, docs["doc_id"].eqNullSafe(F.col("member")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sets = [], []
            for s in shingle_sets(batch.column(0), size):
                if len(s):
                    cids.append(class_id(s))
                    sets.append(s)
            yield _batch("cid long, shingles array<long>", cids, sets)

    sets = picked.select("text").mapInArrow(run, "cid long, shingles array<long>")
    return sets.join(reps.select("cid"), "cid", "left_semi").dropDuplicates(["cid"])


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of what their sets share and hold together: common, whole."""
    one = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("s_a"))
    two = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("s_b"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", common.alias("common"), (F.size("s_a") + F.size("s_b")).alias("sum"))
    return both.select("a", "b", "common", (F.col("sum") - F.col("common")).alias("whole"))


def linked(pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    return pairs.filter(100 * F.col("common") >= percent * F.col("whole")).select("a", "b")


def tiles(groups: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The tiles in which the classes of each group are compared: cid, members, side, tile.

    A small group (node, label) is one tile. The classes of others are dealt over blocks, by bands of
    sizes such that sets of links lie in one band or in two next to each other; a tile is a block with
    itself (side -1), or one block (side 0) with another (side 1).
    """
    width = 1.001 * max(math.log(100 / percent), 0.01)  # a little wider, as logarithms are rounded
    nodes = groups.join(classes.select(F.col("cid").alias("node"), "n", "members"), "node").select(
        F.col("node").alias("cid"), "label", "n", "members", F.floor(F.log("n") / width).alias("band")
    )
    nodes = stage(nodes, "nodes")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks")
    large = nodes.groupBy("label").agg(blocks).filter("blocks > 1").select("label")
    # at most a row per block of sets, whatever the number of classes
    dealt = stage(nodes.join(F.broadcast(large), "label").groupBy("label", "band").agg(blocks), "blocks")
    of_small = nodes.join(F.broadcast(large), "label", "left_anti").select(
        "cid", "members", F.lit(-1).alias("side"), F.struct("label", F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y")).alias("tile")
    )
    listed = dealt.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    listed = listed.select("label", "band", "part", F.xxhash64("band", "part").alias("block"))
    x, y = (listed.select("label", *[F.col(c).alias(f"{c}_{s}") for c in ("band", "part", "block")]) for s in "xy")
    order = (F.col("band_y") == F.col("band_x") + 1) | ((F.col("band_y") == F.col("band_x")) & (F.col("part_y") >= F.col("part_x")))
    met = stage(x.join(y, "label").filter(order), "tiles")
    tile = F.struct("label", F.col("block_x").alias("x"), F.col("block_y").alias("y")).alias("tile")
    side = F.when(F.col("block_x") == F.col("block_y"), -1).otherwise(0).alias("side")
    sides = met.select("label", F.col("band_x").alias("band"), F.col("part_x").alias("part"), side, tile).unionByName(
        met.filter("block_x != block_y").select("label", F.col("band_y").alias("band"), F.col("part_y").alias("part"), F.lit(1).alias("side"), tile)
    )
    of_large = nodes.join(F.broadcast(dealt), ["label", "band"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    return of_small.unionByName(of_large.join(sides, ["label", "band", "part"]).select("cid", "members", "side", "tile"))


TILE_LINKS = "a long, b long, links long"


def tile_links(placed: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """All links within tiles, in two kinds of rows: links (a, b) that connect what is connected in a
    tile; and a class (a) with the number of documents that it links with in a tile (links)."""

    def run(table: pa.Table) -> pa.Table:
        cids, members, side = (table.column(c).to_numpy() for c in ("cid", "members", "side"))
        shingles = table.column("shingles").combine_chunks()
        sizes = np.diff(shingles.offsets.to_numpy())
        near = linked_sets(shingles.flatten().to_numpy(), sizes, percent)
        near &= (side[:, None] < 0) | (side[:, None] != side[None, :])
        count = near @ members
        some = np.flatnonzero(count)
        a, b = spanning(near)
        return pa.table(
            {
                "a": pa.array(np.concatenate([cids[a], cids[some]]), pa.int64()),
                "b": pa.concat_arrays([pa.array(cids[b], pa.int64()), pa.nulls(len(some), pa.int64())]),
                "links": pa.concat_arrays([pa.nulls(len(a), pa.int64()), pa.array(count[some], pa.int64())]),
            }
        )

    return placed.join(sets, "cid").groupBy("tile").applyInArrow(run, TILE_LINKS)


def linked_sets(shingles: np.ndarray, sizes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Which of the sets link, as a matrix; ``shingles`` holds one set after the other."""
    k = len(sizes)
    values, code, times = np.unique(shingles, return_inverse=True, return_counts=True)
    common = np.zeros((k, k), np.int64)
    column = np.cumsum(times > 1) - 1  # a shingle of one set is shared by none
    row = np.repeat(np.arange(k), sizes)
    several = times[code] > 1
    row, column = row[several], column[code[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(MATRIX // max(k, 1), 1)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        start, stop = np.searchsorted(column, (first, first + width))
        part = np.zeros((k, min(width, int(column[-1]) + 1 - first)), np.float32)
        part[row[start:stop], column[start:stop] - first] = 1
        common += (part @ part.T).astype(np.int64)  # under 2 ** 24, so exact
    whole = sizes[:, None] + sizes[None, :] - common
    near = (common > 0) & (100 * common >= percent * whole)
    np.fill_diagonal(near, False)
    return near


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all that the matrix of links connects, one less than nodes in a component."""
    fresh = near.any(axis=1)
    a: list[int] = []
    b: list[int] = []
    for root in np.flatnonzero(fresh).tolist():
        if not fresh[root]:
            continue
        fresh[root] = False
        waiting = [root]
        while waiting:
            node = waiting.pop()
            found = np.flatnonzero(near[node] & fresh).tolist()
            fresh[found] = False
            a += [node] * len(found)
            b += found
            waiting += found
    return np.array(a, np.int64), np.array(b, np.int64)


def join_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, links.

    Sets are of ``size`` words; they link from a Jaccard index of ``percent`` hundredths on.

    ``component_id`` is the smallest id in the document's component of links; ``links`` counts all
    other documents that the document links with, copies one by one. A document without words links with nothing and is its own component.
    Rows without an id take part, and count for no smallest id; equal rows are linked to each other.
    An empty table gives an empty result.
    """
    found = stage(document_sets(docs, size), "sets")
    members = found.filter("shingle is null").select("doc_id", "n", "cid")
    common = found.filter("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    common = stage(common.filter(F.col("times") >= HOT_COUNT), "common")
    hot_rows = most_frequent(common, "times", MAX_HOT)[0].toPandas().sort_values("shingle")
    hot = hot_rows["shingle"].to_numpy(np.int64), hot_rows["times"].to_numpy(np.int64)
    classes = stage(
        members.filter("n > 0").groupBy("cid", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("members")), "classes"
    )
    sizes = {r["n"]: r["k"] for r in classes.filter(F.col("n") <= MAX_SMALL).groupBy("n").agg(F.count("*").alias("k")).collect()}
    keys = stage(candidate_keys(docs, boundary(sizes, percent), hot, size, percent), "keys")
    shared = shared_keys(keys)
    entries = shared.filter(F.col("kind") == LIST).select("key", "cid", "n", "lo")
    first = stage(subset_links(shared).union(first_links(entries, classes, percent)).distinct(), "first")
    groups = stage(components(first), "groups")
    sets = _sets_of(groups.select(F.col("node").alias("cid")), docs, classes, size)
    inner = stage(tile_links(tiles(groups, classes, percent), sets, percent), "tile-links")
    second = stage(other_links(entries, groups, percent), "second")
    outer = stage(linked(_confirm(second, docs, classes, size), percent), "outer")
    labels = stage(components(inner.filter("b is not null").select("a", "b").union(outer)), "labels")
    members_of = classes.select(F.col("cid").alias("b"), "members")
    both = outer.unionByName(outer.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(members_of, "b").select("a", F.col("members").alias("links"))
    counted = counted.unionByName(inner.filter("links is not null").select("a", "links"))
    degree = counted.groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("degree"))
    named = classes.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_class = named.join(smallest, "label").join(degree, "cid", "left").select(
        "cid", "n", "component_id", (F.coalesce("degree", F.lit(0)) + F.col("members") - 1).alias("links")
    )
    return members.join(by_class, ["cid", "n"], "left").select(
        "doc_id",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
    )


def _sets_of(wanted: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    reps = stage(classes.join(wanted, "cid", "left_semi").select("cid", "doc_id"), "reps")
    return stage(class_sets(docs, reps, size), "class-sets")


def _confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    return stage(measured(pairs, _sets_of(wanted, docs, classes, size)), "measured")


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The document with the smallest id of each component, and those without an id.

    Of rows with equal ids one stays.
    """
    joined = stage(join_documents(docs, size, percent).filter("doc_id is not null"), "joined")
    gone = joined.filter("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(bounded(gone), "doc_id", "left_anti").select(*docs.columns)
    repeated = joined.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    again = kept.join(bounded(repeated), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(bounded(repeated), "doc_id", "left_anti").select(*docs.columns).unionByName(again.select(*docs.columns))


def bounded(ids: DataFrame) -> DataFrame:
    """The ids, marked for broadcast if they are few enough to be held by every task."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def brute_force(
    texts: Sequence[tuple[int, str | None]], size: int = SHINGLE, percent: int = PERCENT
) -> dict[int, tuple[int, int]]:
    """n_shingles and component_id by comparing all pairs; for tests on a few documents."""
    found = shingle_sets(pa.array([t for _, t in texts], pa.string()), size)
    sets = {i: set(s.tolist()) for (i, _), s in zip(texts, found)}
    label = {i: i for i in sets}
    for a, b in combinations(sets, 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]) and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    return {i: (len(sets[i]), label[i]) for i in sets}
