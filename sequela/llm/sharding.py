"""Shards of near equal bytes, cut from an ordered sequence of atomic groups.

Documents of equal text are a group and stay together. Groups lie in the order of their text's digest, so
that a shard is a fair draw of the corpus; those larger than an even share of what is left come first and
have a shard each. The rest is cut by minimax: the smallest capacity is searched for with which a greedy
check, that closes a shard where the next group would pass the capacity, gets by with the shards there
are.

The check needs "the last group that ends at or before byte x" alone. The driver holds these ends as cells (lowest
and highest end of a range of bytes), at most ``CELLS`` of them. A cell gives a bound from below and one from
above, hence a capacity that is too small for certain and one that is large enough for certain; the
ranges in which cuts between these two can lie are told apart in finer cells by one Spark job, and so on.
Each round narrows them by thousands, so a few suffice at any size.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sequela.sources.stages import stage

SHARDS = 16
#: Cells that the driver holds at once.
CELLS = 1 << 16
#: A group's rows are numbered in so many parts.
PARTS = 256
#: Rows of one id and text are unfolded in steps of this many.
UNFOLD = 1 << 16


class Ends:
    """What is known of the bytes at which groups end, from 0 to ``total``: disjoint cells in order.

    ``fetch(ranges, width)`` gives the (lowest, highest) ends within steps of ``width`` bytes of each range.
    """

    def __init__(self, total: int, fetch: Callable):
        self.total, self.fetch, self.asked = total, fetch, []
        self.lows, self.highs = [0], [0]
        if total:
            self._put(fetch([(1, total)], max(1, -(-total // CELLS))))

    def _put(self, cells: list[tuple[int, int]]) -> None:
        merged = dict(zip(self.lows, self.highs)) | dict(cells)
        self.lows = sorted(merged)
        self.highs = [merged[low] for low in self.lows]

    def below(self, x: int) -> tuple[int, int]:
        """Bounds of the last end at or before x; they are equal where it is known."""
        x = min(x, self.total)
        i = bisect.bisect_right(self.lows, x) - 1
        if x >= self.highs[i]:
            return self.highs[i], self.highs[i]
        if self.lows[i] == x:
            return x, x
        self.asked.append(i)
        return self.lows[i], x

    def above(self, x: int) -> tuple[int, int]:
        """Bounds of the first end at or after x."""
        x = max(x, 0)
        i = bisect.bisect_left(self.highs, x)
        if i == len(self.highs):
            return self.total, self.total
        if self.lows[i] >= x:
            return self.lows[i], self.lows[i]
        if self.highs[i] == x:
            return x, x
        self.asked.append(i)
        return x, self.highs[i]

    def refine(self, windows: list[tuple[int, int]]) -> None:
        """Tell the ends apart in finer cells where they lie in one of the windows of bytes."""
        spans: list[list[int]] = []  # first and last cell of each stretch of cells to replace
        for low, high in sorted(windows):
            first = min(bisect.bisect_left(self.highs, low), len(self.lows) - 1)
            last = max(bisect.bisect_right(self.lows, high) - 1, first)
            if spans and first <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], last)
            else:
                spans.append([first, last])
        ranges = [(self.lows[i], self.highs[j]) for i, j in spans if self.lows[i : j + 1] != self.highs[i : j + 1]]
        if not ranges:
            return
        for i, j in reversed(spans):
            if self.lows[i : j + 1] != self.highs[i : j + 1]:
                del self.lows[i : j + 1], self.highs[i : j + 1]
        width = max(1, -(-sum(high - low + 1 for low, high in ranges) // CELLS))
        self._put([*self.fetch(ranges, width), (0, 0)])

    def refine_asked(self) -> None:
        """Tell the cells apart that gave bounds instead of an end."""
        self.refine([(self.lows[i], self.highs[i]) for i in set(self.asked)])
        self.asked = []


def greedy(ends: Ends, capacity: int, shards: int, bound: int) -> list[int]:
    """Where shards of this capacity end, by the lower (0) or upper (1) bounds of the ends; it stops where it cannot go on."""
    path = [0]
    for _ in range(shards):
        path.append(ends.below(path[-1] + capacity)[bound])
        if path[-1] <= path[-2] or path[-1] >= ends.total:
            break
    return path[1:]


def smallest(holds: Callable[[int], bool], low: int, high: int) -> int:
    """The smallest capacity from low to high that holds, by halving; high is known to hold."""
    while low < high:
        middle = (low + high) // 2
        if holds(middle):
            high = middle
        else:
            low = middle + 1
    return low


def minimax(ends: Ends, shards: int, least: int = 1) -> int:
    """The smallest capacity with which the greedy check needs at most ``shards`` shards."""
    if not ends.total:
        return 0
    low, high = max(least, -(-ends.total // shards)), ends.total
    while True:
        low = smallest(lambda c: greedy(ends, c, shards, 1)[-1] >= ends.total, low, high)
        high = smallest(lambda c: greedy(ends, c, shards, 0)[-1] >= ends.total, low, high)
        if low == high:
            ends.asked = []
            return high
        # the cuts of every capacity between the two lie between these paths
        lowest, highest = greedy(ends, low, shards, 0), greedy(ends, high, shards, 1)
        highest += [ends.total] * (len(lowest) - len(highest))
        ends.refine(list(zip(lowest, highest)))


def cuts(ends: Ends, shards: int, capacity: int) -> list[int]:
    """The bytes at which shards end: within the capacity, each as near its even share of the rest as can be."""
    while True:
        ends.asked = []
        least = [ends.total]  # where a shard has to end at least, for those after it to take the rest
        for _ in range(shards - 1):
            least.append(ends.above(least[-1] - capacity)[0] if least[-1] > capacity else 0)
        least.reverse()
        found, at = [], 0
        for k in range(shards):
            want = at + (ends.total - at) // (shards - k)
            before, after = ends.below(want)[0], ends.above(want)[0]
            near = before if want - before <= after - want and before > at else after
            at = min(max(near, least[k]), ends.below(at + capacity)[0])
            found.append(at)
        if not ends.asked:
            return found
        ends.refine_asked()


def text_rows(docs: DataFrame) -> DataFrame:
    """One row per id and text: doc_id, size, text_crc32, its text's digest ``key``, and ``n`` equal rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
        )
        .groupBy("doc_id", "size", "text_crc32", "key")
        .agg(F.count("*").alias("n"))
        .withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    )


def _running(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``df`` with ``before_<value>``: the values of the rows before, in the order, within the keys."""
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumns({f"before_{v}": F.coalesce(F.sum(v).over(window), F.lit(0)) for v in values})


def group_ends(groups: DataFrame) -> DataFrame:
    """(key, bytes, before_rows, end): rows of all smaller keys, and the byte at which a group ends after them.

    A key is a digest in hex: its first three digits deal the groups into 4,096 ranges, and the next two each of
    these into 256, so that a window holds a millionth of the groups, or the sums of these ranges.
    """
    values = ["bytes", "rows"]
    groups = groups.withColumns({"range": F.substring("key", 1, 3), "step": F.substring("key", 1, 5)})
    sums = [F.sum(v).alias(v) for v in values]
    steps = groups.groupBy("range", "step").agg(*sums)
    ranges = steps.groupBy("range").agg(*sums)
    inside = _running(groups, ["step"], ["key"], values)

    def named(df: DataFrame, at: str, mark: str) -> DataFrame:
        return df.select(at, *[F.col(f"before_{v}").alias(f"{mark}_{v}") for v in values])

    ranges = named(_running(ranges.withColumn("all", F.lit(0)), ["all"], ["range"], values), "range", "r")
    steps = named(_running(steps, ["range"], ["step"], values), "step", "s")
    whole = {f"before_{v}": F.col(f"before_{v}") + F.col(f"s_{v}") + F.col(f"r_{v}") for v in values}
    return (
        inside.join(steps, "step")
        .join(F.broadcast(ranges), "range")  # at most 4,096 rows
        .withColumns(whole)
        .select("key", "bytes", "before_rows", (F.col("before_bytes") + F.col("bytes")).alias("end"))
    )


def _fetcher(ends: DataFrame) -> Callable:
    """Ends of groups as cells, by one Spark job over the table of groups."""

    def fetch(ranges: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
        end = F.col("end")
        number = F.lit(None).cast("long")
        first, starts = 0, []
        for low, high in ranges:
            starts.append((low, high, first))
            first += -(-(high - low + 1) // width)
        for low, high, at in reversed(starts):
            number = F.when(end.between(low, high), F.lit(at) + F.floor((end - low) / F.lit(width))).otherwise(number)
        within = F.lit(False)
        for low, high in ranges:
            within = within | end.between(low, high)
        cells = ends.filter(within).groupBy(number.alias("cell")).agg(F.min(end).alias("low"), F.max(end).alias("high"))
        return [(r["low"], r["high"]) for r in cells.collect()]

    return fetch


def giants(groups: DataFrame, shards: int) -> list[tuple[str, int, int]]:
    """(key, bytes, rows) of the groups larger than an even share of what is left, the largest first."""
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    top = groups.orderBy(F.desc("bytes"), "key").limit(shards).collect()
    found = []
    for row in top:
        if len(found) == shards - 1 or row["bytes"] * (shards - len(found)) <= total:
            break
        found.append((row["key"], row["bytes"], row["rows"]))
        total -= row["bytes"]
    return found


def placed_groups(rows: DataFrame, shards: int) -> DataFrame:
    """Per group its shard and ``first``, the slot of its first row: (key, shard, first)."""
    groups = stage(rows.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("bytes"), F.sum("n").alias("rows")), "groups")
    alone = giants(groups, shards)
    rest = groups.filter(~F.col("key").isin([k for k, *_ in alone])) if alone else groups
    ends = stage(group_ends(rest), "ends")
    spark = rows.sparkSession
    known = ends.agg(F.max("end"), F.max("bytes")).first()
    held = Ends(known[0] or 0, _fetcher(ends))
    left = shards - len(alone)
    at = cuts(held, left, minimax(held, left, known[1] or 1))
    shard = F.lit(len(alone))
    for cut in at[:-1]:
        shard = shard + (F.col("end") > cut).cast("int")
    ends = ends.withColumn("shard", shard)
    starts = ends.groupBy("shard").agg(F.min("before_rows").alias("start"))
    placed = ends.join(F.broadcast(starts), "shard")  # a row per shard
    placed = placed.select("key", "shard", (F.col("before_rows") - F.col("start")).alias("first"))
    if alone:
        own = spark.createDataFrame([(k, i, 0) for i, (k, *_) in enumerate(alone)], "key string, shard int, first long")
        placed = placed.unionByName(own)
    return placed


def placed_parts(rows: DataFrame, shards: int) -> DataFrame:
    """Per group and part of its rows the shard and the first slot: (key, part, shard, first)."""
    parts = rows.groupBy("key", "part").agg(F.sum("n").alias("n"))
    placed = placed_groups(rows, shards)
    # a group has at most PARTS parts
    return _running(parts.join(placed, "key"), ["key"], ["part"], ["n"]).select(
        "key", "part", "shard", (F.col("first") + F.col("before_n")).alias("first")
    )


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of each document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``bytes``: a document's size is its text's bytes in UTF-8 plus 1, equal texts lie in one shard, and
    the largest shard is as small as the order of groups allows (see the module). ``slot`` numbers a shard's
    rows from 0 by group, and within a group in parts by a hash of doc_id, then by doc_id. ``grown_shard`` is
    null: under this law one more shard moves the cuts.

    A null text is empty. Rows of one id and text are rows of their own with slots in a row; a null doc_id is an id
    like others. An empty table gives no rows; with fewer groups than shards some shards stay empty. Further
    columns are ignored. All results depend on the rows alone, not on their order or partitions.
    """
    rows = stage(text_rows(docs), "rows")
    parts = placed_parts(rows, shards)
    slots = _running(rows.join(parts, ["key", "part"]), ["key", "part"], ["doc_id"], ["n"])
    at = F.col("first") + F.col("before_n")
    last = F.col("n") - 1
    return (
        slots.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / UNFOLD))))
        .withColumn("_to", F.least(F.lit(UNFOLD - 1).cast("long"), last - F.col("_step") * UNFOLD))
        .withColumn("_in", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_to"))))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (at + F.col("_step") * UNFOLD + F.col("_in")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> DataFrame:
    """Write the documents with all their columns as Parquet to ``folder``/shard=k and read them back.

    A shard that the documents' own column is called so is renamed ``_shard``. Files of a shard
    are written by as many tasks as its groups have parts, at most.
    """
    rows = stage(text_rows(docs), "rows")
    parts = placed_parts(rows, shards).select("key", "part", F.col("shard").alias("_to"))
    names = [f"_own{i}" for i in range(len(docs.columns))]
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)], "doc_id", "text")
    own = own.withColumns(
        {
            "key": F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256),
            "part": F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(PARTS)).cast("int"),
        }
    )
    mark = "shard" if "shard" not in docs.columns else "_shard"
    out = own.join(parts, ["key", "part"]).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], F.col("_to").alias(mark))
    out.write.partitionBy(mark).parquet(folder)
    return docs.sparkSession.read.parquet(folder)
