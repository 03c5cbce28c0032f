"""Mixing sources to target weights (DataFrame functions only).

The words of a source, document after document, are packed into blocks of a fixed length. Every
slot of an output shard draws its source from the target weights, so a shard's source counts are
multinomial. The n-th slot of a source takes the block to which a pseudorandom permutation of the
source's block indexes maps n; each pass over a source has its own permutation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sequela.llm.text import running_totals, word_count, words
from sequela.sources.stages import stage

#: Fixed values of the mix that the query asks for.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_PASSES = 2

BLOCK = 64  # words in a block
SLOTS = 1024  # slots of an output shard
SEED = 20
ROUNDS = 16  # of the permutation
MAX_SOURCES = 10_000
TASK_SLOTS = 100_000  # slots that a task places
BUCKETS = 1 << 20  # of a source, in which its documents are laid one after the other


@dataclass
class Mix:
    """``sized``: a row per document; ``sources``: the plan; ``spans``: what the mix takes.

    A row of ``spans`` is a run of words of one document in one slot of one output shard:
    shard, slot_key (orders the slots of a shard), source_id, pass_no, block, row, word_from,
    n_words.
    """

    sized: DataFrame
    sources: list[dict]
    spans: DataFrame


def targets(
    sizes: list[tuple[str | None, int]],
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_passes: int = MAX_PASSES,
) -> list[dict]:
    """Target of each source: ``share`` of all sizes, dealt by weight, at most ``max_passes`` sizes.

    Sources are taken by code point, null last, and weigh ``weights`` in turn. What would exceed a
    source's limit is dealt to the others by weight until none is above. With ``share`` over
    ``max_passes`` every source ends at its limit.
    """
    # UTF-8 bytes sort like code points
    ordered = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    plan = [
        {"source_id": i, "source": name, "size": size, "weight": weights[i % len(weights)]}
        for i, (name, size) in enumerate(ordered)
    ]
    left, open_ = share * sum(s["size"] for s in plan), plan
    while True:
        weight = sum(s["weight"] for s in open_)
        for s in open_:
            s["target"] = left * s["weight"] / weight
        above = [s for s in open_ if s["target"] > max_passes * s["size"]]
        for s in above:
            s["target"] = float(max_passes * s["size"])
        left -= sum(s["target"] for s in above)
        open_ = [s for s in open_ if s not in above]
        if not above or not open_:
            return plan


def quotas(plan: list[dict], block: int = BLOCK) -> list[dict]:
    """Slots of each source: its whole passes, then blocks for the rest, the last one cut."""
    for s in plan:
        s["blocks"] = math.ceil(s["size"] / block)
        wanted = math.floor(s["target"] + 0.5)
        passes, rest = divmod(wanted, s["size"]) if s["size"] else (0, 0)
        s["slots"] = passes * s["blocks"] + math.ceil(rest / block)
        s["last_words"] = (rest - 1) % block + 1 if rest else block
    return plan


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    max_passes: int = MAX_PASSES,
    block: int = BLOCK,
    slots: int = SLOTS,
    seed: int = SEED,
) -> Mix:
    """Mix ``docs`` (doc_id, source, text; other columns are not read).

    A null text has no words, a null source is a source of its own, and rows with equal or null
    ids are documents of their own. Empty tables give empty results. The plan holds a row per
    source; a table with over ``MAX_SOURCES`` sources is refused, since weights are set per source.
    """
    sized = stage(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col("doc_id"),
            F.col("source"),
            word_count(F.col("text")).alias("size"),
        ),
        "sized",
    )
    return _mix_sized(sized, weights, share, max_passes, block, slots, seed)


def _mix_sized(sized, weights, share, max_passes, block, slots, seed) -> Mix:
    totals = sized.groupBy("source").agg(F.sum("size").alias("size")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"over {MAX_SOURCES} sources; group them before they are weighed")
    plan = quotas(targets([(r["source"], r["size"]) for r in totals], weights, share, max_passes), block)
    pieces = _pieces(sized, plan, block, seed)
    taken = _slots(sized.sparkSession, plan, slots, seed)
    spans = (
        taken.join(pieces, ["source_id", "block"])
        # the last slot of a source takes only what its target still lacks
        .withColumn("n_words", F.least("n_words", F.col("take") - F.col("block_pos")))
        .filter("n_words > 0")
        .select("shard", "slot_key", "source_id", "pass_no", "block", "row", "word_from", "n_words")
    )
    return Mix(sized, plan, spans)


def _source_table(spark, plan: list[dict]) -> DataFrame:
    """The plan as a table, made of literals."""
    rows = [
        F.struct(
            F.lit(s["source"]).cast("string").alias("source"),
            F.lit(s["source_id"]).alias("source_id"),
            F.lit(s["size"]).cast("long").alias("source_size"),
            F.lit(s["target"]).cast("double").alias("target"),
        )
        for s in plan
    ]
    empty = "array<struct<source:string,source_id:int,source_size:bigint,target:double>>"
    table = F.array(*rows) if rows else F.array().cast(empty)
    return spark.range(1).select(F.inline(table))


def with_source(df: DataFrame, plan: list[dict]) -> DataFrame:
    """Add the plan's source_id, source_size and target; a null source meets the null source."""
    table = _source_table(df.sparkSession, plan).withColumnRenamed("source", "_source")
    return df.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def _pieces(sized: DataFrame, plan: list[dict], block: int, seed: int) -> DataFrame:
    """Runs of words by (source_id, block): block_pos, row, word_from, n_words.

    A source's documents lie one after the other by bucket, a hash of the id, so that the running
    sums of one source are spread over many windows, those of one id included.
    """
    bucket = F.pmod(F.xxhash64("doc_id", "row", F.lit(seed)), F.lit(BUCKETS))
    docs = with_source(sized.filter("size > 0"), plan).withColumn("bucket", bucket)
    inside = (
        W.partitionBy("source_id", "bucket")
        .orderBy("doc_id", "size", "row")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = running_totals(docs, ["source_id"], "bucket", "size")
    laid = (
        docs.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(offsets, ["source_id", "bucket"])
        .withColumn("start", F.col("before") + F.col("inside"))
    )
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}")
    begin = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    return laid.withColumn("block", F.explode(F.sequence(first, last))).select(
        "source_id",
        "block",
        (begin - F.col("block") * block).alias("block_pos"),
        "row",
        (begin - F.col("start")).alias("word_from"),
        (end - begin).alias("n_words"),
    )


def _slots(spark, plan: list[dict], slots: int, seed: int) -> DataFrame:
    """Slots with the block that each takes: shard, slot_key, source_id, pass_no, block, take.

    The draws of a source can miss its number of slots by chance. The surplus draws of some
    sources are handed, in order, to the sources that lack as many.
    """
    total = sum(s["slots"] for s in plan)
    bounds, upto = [], 0
    for s in plan:
        upto += s["slots"]
        bounds.append(upto)
    if not total:
        return spark.range(0).select(
            *[F.col("id").alias(c) for c in ("shard", "slot_key", "pass_no", "block", "take")],
            F.col("id").cast("int").alias("source_id"),
        )
    draw = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total))
    drawn = (
        spark.range(total)
        .select(F.expr(f"id div {slots}").alias("shard"), _interval(draw, bounds).alias("source_id"))
        .groupBy("shard", "source_id")
        .agg(F.count("*").alias("n"))
    )
    drawn = stage(drawn, "draws")
    got = dict(drawn.groupBy("source_id").agg(F.sum("n")).collect())
    surplus, lack, places = {}, [], 0
    for s in plan:
        n = got.get(s["source_id"], 0)
        if n > s["slots"]:
            surplus[s["source_id"]] = places
            places += n - s["slots"]
    upto = 0
    for s in plan:
        if (n := got.get(s["source_id"], 0)) < s["slots"]:
            lack.append((s["source_id"], n, upto))
            upto += s["slots"] - n
    before = running_totals(drawn, ["source_id"], "shard", "n")
    numbered = (
        drawn.join(before, ["source_id", "shard"])
        # few rows, each of many slots: spread by the slots that they unfold to
        .repartition(math.ceil(total / TASK_SLOTS), "shard", "source_id")
        .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .select("shard", "source_id", (F.col("before") + F.col("k")).alias("j"))
    )
    by_source = {key: F.array(*[F.lit(s[key]).cast("long") for s in plan]) for key in ("slots", "blocks", "last_words")}

    def of(key: str) -> Column:
        return F.element_at(by_source[key], F.col("source_id") + 1)

    over = F.col("j") - of("slots")
    numbered = numbered.withColumn("over", over)
    if lack:
        starts = F.array(*[F.lit(surplus.get(s["source_id"], 0)).cast("long") for s in plan])
        pick = [F.element_at(F.array(*[F.lit(x[i]).cast("long") for x in lack]), F.col("at") + 1) for i in range(3)]
        moved = F.col("over") >= 0
        # columns one after the other: a lambda takes a name for the select's own new column
        numbered = (
            numbered.withColumn("place", F.element_at(starts, F.col("source_id") + 1) + F.col("over"))
            .withColumn("at", _interval(F.col("place"), [u for _, _, u in lack][1:]))
            .select(
                "shard",
                F.when(moved, pick[0].cast("int")).otherwise(F.col("source_id")).alias("source_id"),
                F.when(moved, pick[1] + F.col("place") - pick[2]).otherwise(F.col("j")).alias("j"),
            )
        )
    numbered = numbered.withColumn("blocks", of("blocks")).withColumn("pass_no", F.expr("j div blocks"))
    image = permuted(F.pmod("j", "blocks"), F.col("blocks"), [F.col("source_id"), F.col("pass_no")], seed)
    return numbered.select(
        "shard",
        F.xxhash64("source_id", "j", F.lit(seed + 1)).alias("slot_key"),
        "source_id",
        "pass_no",
        image.alias("block"),
        F.when(F.col("j") == of("slots") - 1, of("last_words")).otherwise(F.lit(1 << 31)).alias("take"),
    )


def _interval(value: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` at or under the value."""
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b).cast("long") for b in bounds]), lambda b: b <= value))


def permuted(x: Column, n: Column, key: list[Column], seed: int) -> Column:
    """Image of ``x`` under a keyed permutation of 0 .. n-1, for any n (swap-or-not shuffle).

    In each round x and its mirror (shift - x) mod n are one pair, and a hash of the pair's larger
    member says whether they change places; so each round is its own inverse.
    """

    def step(y: Column, r: Column) -> Column:
        shift = F.pmod(F.xxhash64(r, *key, F.lit(seed)), n)
        mirror = F.pmod(shift - y, n)
        swap = F.pmod(F.xxhash64(F.greatest(y, mirror), r, *key, F.lit(seed)), F.lit(2)) == 1
        return F.when(swap, mirror).otherwise(y)

    return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), x, step)


def taken_words(mixed: Mix) -> DataFrame:
    """A row per document: doc_id, size, source_size, target, taken."""
    by_row = mixed.spans.groupBy("row").agg(F.sum("n_words").alias("taken"))
    return with_source(mixed.sized, mixed.sources).join(by_row, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row per document and pass over its source, with ``docs``' columns.

    A document of which a pass takes every word keeps its text as it is; of others the words taken
    are joined by one space, in their order. ``n_chars``, where there is one, is counted anew. What
    the mix does not take, and texts without words, are left out.
    """
    own = {c: f"own{i}" for i, c in enumerate(docs.columns)}  # the table's columns may have any names
    kept = stage(docs.toDF(*own.values()).withColumn("row", F.monotonically_increasing_id()), "mix-docs")
    whole = F.col(own["text"])
    sized = kept.select(
        "row", F.col(own["doc_id"]).alias("doc_id"), F.col(own["source"]).alias("source"), word_count(whole).alias("size")
    )
    defaults = {"weights": WEIGHTS, "share": SHARE, "max_passes": MAX_PASSES, "block": BLOCK, "slots": SLOTS, "seed": SEED}
    mixed = _mix_sized(stage(sized, "sized"), **(defaults | options))
    # a document's spans are bounded by its own length
    passes = mixed.spans.groupBy("row", "pass_no").agg(
        F.sum("n_words").alias("n"), F.sort_array(F.collect_list(F.struct("word_from", "n_words"))).alias("spans")
    )
    joined = kept.join(passes, "row").withColumn("words", words(whole))
    part = F.array_join(
        F.flatten(
            F.transform("spans", lambda s: F.slice("words", (s["word_from"] + 1).cast("int"), s["n_words"].cast("int")))
        ),
        " ",
    )
    out = joined.withColumn(own["text"], F.when(F.col("n") == F.size("words"), whole).otherwise(part))
    if "n_chars" in own:
        out = out.withColumn(own["n_chars"], F.length(whole).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(new).alias(c) for c, new in own.items()])
