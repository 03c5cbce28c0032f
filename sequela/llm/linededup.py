"""Line dedup: a suffix array over line ids by distributed prefix doubling.

The lines of all documents are one long sequence of ids with a break after each document. Only
lines that occur twice or more can start a repeat, so the array holds their suffixes, each up to
the next line that occurs once. Ranks come from doubling: the rank of a suffix by its first 2k
lines follows from the ranks, by k lines, of itself and of the suffix k lines on. Equal suffixes
share a rank. Neighbours in the finished array that share a run long enough form an interval of
the longest-common-prefix array; of each interval the earliest copy stays and later ones go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sequela.llm.text import WORD
from sequela.sources.stages import stage

MIN_WORDS = 10  # in a run of lines that is a repeat
LAST = (1 << 63) - 1


def line_table(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """A row per document: row, doc_id, n_lines, lines (line_no, id, n_words of lines with a word).

    The id of a line is a 64-bit hash of it without the spaces around it.
    """
    split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    lines = F.filter(
        F.transform(
            split,
            lambda x, i: F.struct(
                i.alias("line_no"), F.xxhash64(F.trim(x)).alias("id"), F.regexp_count(x, F.lit(WORD)).alias("n_words")
            ),
        ),
        lambda s: s["n_words"] > 0,
    )
    row = F.monotonically_increasing_id() if row is None else row
    return stage(
        docs.select(row.alias("row"), "doc_id", F.size(split).alias("n_lines"), lines.alias("lines")), "lines"
    )


def _ranked(pairs: DataFrame, cols: list[str]) -> DataFrame:
    """Distinct pairs with ascending whole numbers as ranks, in the pairs' order."""
    spread = pairs.distinct().repartitionByRange(*cols).sortWithinPartitions(*cols)
    return stage(spread.withColumn("rank", F.monotonically_increasing_id()), "ranks")


def suffix_array(lines: DataFrame, depth: int = LAST) -> DataFrame:
    """Suffixes that start at repeated lines: row, place, pos, length, rank.

    ``length`` counts lines up to the break. Suffixes that agree in their first ``depth`` lines, or
    in all, have equal ranks; those that differ there are in order.
    """
    place = F.coalesce("doc_id", F.lit(LAST)).alias("place")  # documents without an id come last
    flat = lines.select("row", place, F.posexplode("lines").alias("pos", "line")).select(
        "row", "place", "pos", F.col("line.id").alias("id")
    )
    twice = flat.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    names = _ranked(twice.select("id"), ["id"])
    in_doc = W.partitionBy("row").orderBy("pos")  # a document's lines
    run = F.col("pos") - F.row_number().over(in_doc)
    to_break = F.max("pos").over(W.partitionBy("row", "run")) - F.col("pos") + 1
    now = flat.join(names, "id").withColumn("run", run).select("row", "place", "pos", to_break.alias("length"), "rank")
    now = stage(now, "suffixes")
    classes, step = names.count(), 1
    while step < depth:
        # within a run the suffix ``step`` lines on is the step-th next; past the break is -1
        ahead = F.when(F.col("length") > step, F.lead("rank", step).over(in_doc)).otherwise(F.lit(-1))
        pairs = stage(now.withColumn("second", ahead).withColumnRenamed("rank", "first"), "pairs")
        names = _ranked(pairs.select("first", "second"), ["first", "second"])
        now = stage(pairs.join(names, ["first", "second"]).select("row", "place", "pos", "length", "rank"), "suffixes")
        found = names.count()
        if found == classes:
            break
        classes, step = found, 2 * step
    return now


def neighbours(suffixes: DataFrame, lines: DataFrame) -> DataFrame:
    """Distinct suffixes in order: part, rank, first, n, shared, need, most.

    ``first`` is the earliest of a suffix's ``n`` copies. ``need``: lines from the suffix's first on
    that have ``MIN_WORDS`` words; null if its run has fewer. ``most``: lines up to where those after
    the first one have ``MIN_WORDS`` words themselves, or ``need`` if that is more. ``shared``: the
    longest common prefix with the suffix before it, in lines.

    A line lies in a repeated run of ``MIN_WORDS`` words or more if and only if it lies in a repeated
    run of ``need`` to ``most`` lines: in the one that starts at the line, or, where the long run ends
    too early for that, in the one of fewest lines that ends where the long run does. As a line has a
    word or more, ``most`` is at most ``MIN_WORDS``, and no more lines are compared.
    """
    reps = suffixes.groupBy("rank").agg(
        F.min(F.struct("row", "pos", "length")).alias("at"), F.min(F.struct("place", "row", "pos")).alias("first"), F.count("*").alias("n")
    )
    body = reps.select("rank", "first", "n", "at.row", "at.pos", "at.length").join(lines.select("row", "lines"), "row")
    own = F.slice("lines", F.col("pos") + 1, F.least("length", F.lit(MIN_WORDS)))
    runs = body.select(
        "rank", "first", "n", F.transform(own, lambda s: s["id"]).alias("ids"), F.transform(own, lambda s: s["n_words"]).alias("sizes")
    )
    runs = runs.repartitionByRange("rank").sortWithinPartitions("rank").withColumn("part", F.spark_partition_id())
    runs = stage(runs, "runs")
    inside = W.partitionBy("part").orderBy("rank")
    before = runs.withColumn("prev", F.lag("ids").over(inside))
    # the suffix before a part's first one is the last of the part before; a row per part here
    ends = runs.groupBy("part").agg(F.max("rank").alias("rank")).withColumn("next", F.lead("part").over(W.orderBy("part")))
    last = runs.join(ends.filter("next is not null").select("rank", "next"), "rank").select(
        F.col("next").alias("part"), F.col("ids").alias("prev_part")
    )
    none = F.array().cast("array<bigint>")
    both = before.join(last, "part", "left").withColumn("prev", F.coalesce("prev", "prev_part", none))
    same = F.zip_with("ids", "prev", lambda a, b: F.coalesce(a == b, F.lit(False)))
    differ = F.array_position(same, False)
    shared = F.when(differ == 0, F.size("ids")).otherwise(differ - 1)
    upto = F.aggregate(
        "sizes",
        F.struct(F.lit(0).alias("lines"), F.lit(0).alias("words")),
        lambda acc, n: F.when(acc["words"] >= MIN_WORDS, acc).otherwise(
            F.struct((acc["lines"] + 1).alias("lines"), (acc["words"] + n).alias("words"))
        ),
    )
    after = F.aggregate(
        F.slice("sizes", 2, MIN_WORDS),
        F.struct(F.lit(1).alias("lines"), F.lit(0).alias("words")),
        lambda acc, n: F.struct(
            (acc["lines"] + F.when(acc["words"] + n < MIN_WORDS, 1).otherwise(0)).alias("lines"), (acc["words"] + n).alias("words")
        ),
    )
    return both.select("part", "rank", "first", "n", shared.cast("int").alias("shared"), upto.alias("upto"), after.alias("after")).select(
        "part",
        "rank",
        "first",
        "n",
        "shared",
        F.when(F.col("upto.words") >= MIN_WORDS, F.col("upto.lines")).alias("need"),
        F.greatest("after.lines", "upto.lines").alias("most"),
    )


def intervals(order: DataFrame) -> DataFrame:
    """Intervals of neighbours that share ``size`` lines, for each size from need to most: rank, first, n, size, interval."""
    sizes = range(1, MIN_WORDS + 1)
    order = stage(order, "order")
    cut = {k: F.when(F.col("shared") >= k, 0).otherwise(1) for k in sizes}
    # a row per part of the array
    parts = order.groupBy("part").agg(*[F.sum(cut[k]).alias(f"c{k}") for k in sizes])
    upto = W.orderBy("part")
    before = parts.select("part", F.array(*[F.sum(f"c{k}").over(upto) - F.col(f"c{k}") for k in sizes]).alias("before"))
    inside = W.partitionBy("part").orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    counted = order.withColumn("inside", F.array(*[F.sum(cut[k]).over(inside) for k in sizes])).filter("need is not null")
    return (
        counted.join(before, "part")
        .withColumn("size", F.explode(F.sequence("need", "most")))
        .select("rank", "first", "n", "size", (F.element_at("before", F.col("size")) + F.element_at("inside", F.col("size"))).alias("interval"))
    )


def repeated_lines(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_lines, n_removed, removed (spans first, last of line numbers).

    A run of lines with ``MIN_WORDS`` words or more that occurs earlier, in a document with a
    smaller id or before in the same one, is removed. Lines without a word neither count nor part
    a run. Documents without an id come last, equal ids in the order of the table; a null text is
    one empty line. An empty table gives an empty result.
    """
    return _removed(line_table(docs)).drop("row")


def _removed(lines: DataFrame) -> DataFrame:
    # no more lines are compared below, so the array need not tell longer runs apart
    suffixes = suffix_array(lines, MIN_WORDS)
    runs = stage(intervals(neighbours(suffixes, lines)), "intervals")
    firsts = runs.groupBy("size", "interval").agg(F.min("first").alias("earliest"))
    known = (
        runs.join(firsts, ["size", "interval"])
        .filter("n > 1 or earliest < first")
        .groupBy("rank")
        .agg(F.collect_list(F.struct("size", "earliest")).alias("firsts"))
    )
    # of each copy go the most lines that stand earlier too
    at = F.struct("place", "row", "pos")
    size = F.array_max(F.transform(F.filter("firsts", lambda f: f["earliest"] < at), lambda f: f["size"]))
    later = suffixes.join(known, "rank").select("row", "pos", size.alias("size")).filter("size is not null")
    gone = later.select("row", F.explode(F.expr("sequence(pos, pos + size - 1)")).alias("pos"))
    island = F.col("pos") - F.row_number().over(W.partitionBy("row").orderBy("pos"))
    spans = gone.distinct().withColumn("island", island).groupBy("row", "island").agg(
        F.min("pos").alias("a"), F.max("pos").alias("b"), F.count("*").alias("n")
    )
    per_doc = spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans"), F.sum("n").alias("n"))
    line_no = lambda pos: F.element_at("lines", pos + 1)["line_no"]
    removed = F.transform("spans", lambda s: F.struct(line_no(s["a"]).alias("first"), line_no(s["b"]).alias("last")))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return lines.join(per_doc, "row", "left").select(
        "row",
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(removed, none).alias("removed"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of their texts; ``n_chars``, if any, is counted anew.

    The table's own columns may have any names: they are renamed by place while the lines meet them.
    """
    own = {c: f"own{i}" for i, c in enumerate(docs.columns)}
    named = docs.toDF(*own.values()).withColumn("row", F.monotonically_increasing_id())
    kept = stage(named, "dedup-docs")
    texts = kept.select(F.col("row"), F.col(own["doc_id"]).alias("doc_id"), F.col(own["text"]).alias("text"))
    spans = _removed(line_table(texts, F.col("row"))).select("row", "removed")
    text = F.col(own["text"])
    begins = F.concat(F.array(F.lit(0)), F.transform("removed", lambda s: s["last"] + 1))
    ends = F.concat(F.transform("removed", lambda s: s["first"]), F.array(F.size("lines")))
    left = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(F.col("lines"), a + 1, b - a)))
    out = kept.join(spans, "row").withColumn("lines", F.split(text, "\n", -1))
    out = out.withColumn(own["text"], F.when(F.size("removed") == 0, text).otherwise(F.array_join(left, "\n")))
    if "n_chars" in own:
        out = out.withColumn(own["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(new).alias(c) for c, new in own.items()])
