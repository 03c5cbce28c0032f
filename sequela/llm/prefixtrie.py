"""Prefix trie of conversations by truncation peeling.

A node at depth d is a distinct sequence of d turns, known by a digest chained over its turns. The
trie is peeled from its deepest shared level up: the conversations that end at a level meet the nodes
that survive from the level below, each stripped of its last turn, and one grouping by digest finds
the level's nodes and adds up what lies under them. A tail that one distinct sequence has alone needs
no grouping: its nodes follow from its lengths. So the rounds are as many as turns that two
different conversations share, however long the longest one is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.sources.stages import stage

ROOT = ""
#: Conversation ids of a node meet in chunks of 2 ** CHUNK_BITS consecutive numbers.
CHUNK_BITS = 12
#: Nodes with more than 1 / WIDE of all nodes as children, so at most WIDE of them, are joined by broadcast.
WIDE = 1024
HEAD_MODULUS, MAX_HEAD = 100, 6

#: Types of a conversation's turns and of the nodes on its path.
TURNS = "array<struct<turn: bigint, role: string, digest: string, chars: int>>"
PATH = "array<struct<key: string, chars: int, total: bigint>>"
NODE = ("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_turns(turns: DataFrame) -> DataFrame:
    """One row per conv_id with its turns in order: (turn, role, digest, chars).

    Null turns come first; equal turns follow by role and digest, and a repeated row is a turn of
    its own. A null role or text is empty. Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)))
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        digest.alias("digest"),
        F.length(text).alias("chars"),
    )
    return (
        turns.filter("conv_id is not null")
        .select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
    )


def rebuilt(convs: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % 100.

    h is crc32(decimal c) % 6. The head has fewer turns where that conversation has, none where it
    is absent; c's own turns follow from its turn h on. At most 199 conversations share a head.
    """
    c = F.col("conv_id")
    heads = convs.filter(c % HEAD_MODULUS == 0).select(
        c.alias("_head"), F.slice("turns", 1, MAX_HEAD).alias("_turns")
    )
    h = F.crc32(c.cast("string")) % MAX_HEAD
    head = F.coalesce(F.slice("_turns", F.lit(1), F.col("_h")), F.array().cast(TURNS))
    own = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return (
        convs.withColumn("_h", h.cast("int"))
        .withColumn("_head", c - c % HEAD_MODULUS)
        .join(heads, "_head", "left")
        .select("conv_id", F.concat(head, own).alias("turns"))
    )


def sequences(convs: DataFrame) -> DataFrame:
    """Per conversation the path of its nodes: digest, the last turn's code points, and their sum so far."""

    def longer(path: Column, turn: Column) -> Column:
        last = F.get(path, F.size(path) - 1)
        node = F.struct(
            F.md5(F.concat(F.coalesce(last["key"], F.lit(ROOT)), turn["digest"])).alias("key"),
            turn["chars"].alias("chars"),
            (F.coalesce(last["total"], F.lit(0).cast("long")) + turn["chars"]).alias("total"),
        )
        return F.concat(path, F.array(node))

    return convs.select("conv_id", F.aggregate("turns", F.array().cast(PATH), longer).alias("path"))


def _key_at(path: Column, depth: Column) -> Column:
    return F.when(depth > 0, F.get(path, depth - 1)["key"]).otherwise(F.lit(ROOT))


def end_digests(seqs: DataFrame) -> DataFrame:
    """SHA-256 of the comma-joined ascending conv_ids of each distinct sequence: (key, ends_sha256).

    Ids are put in order and joined in chunks of consecutive numbers first, in parallel. The digest
    itself is sequential by definition: the chunks of a key stream through one task, which holds
    a batch of them at a time.
    """
    chunks = (
        seqs.groupBy("key", F.shiftright("conv_id", CHUNK_BITS).alias("chunk"))
        .agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
        .select("key", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            keys, made = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if key != last:
                    if state is not None:
                        keys.append(last)
                        made.append(state.hexdigest())
                    last, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pydict({"key": keys, "ends_sha256": made}, schema=out)
        if state is not None:
            yield pa.RecordBatch.from_pydict({"key": [last], "ends_sha256": [state.hexdigest()]}, schema=out)

    out = pa.schema([("key", pa.string()), ("ends_sha256", pa.string())])
    ordered = chunks.repartition("key").sortWithinPartitions("key", "chunk")
    return ordered.mapInArrow(digest, "key string, ends_sha256 string")


def distinct_sequences(seqs: DataFrame) -> DataFrame:
    """One row per distinct sequence: members that end there, and the depth ``own`` of the first node it has alone.

    ``own`` is null where every node is shared, that is where another sequence goes on from its end.
    """
    keyed = stage(seqs.withColumn("key", _key_at(F.col("path"), F.size("path"))), "sequences")
    merged = keyed.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("path").alias("path")
    )
    merged = stage(merged.join(end_digests(keyed), "key"), "distinct")
    steps = merged.select(F.col("key").alias("owner"), F.posexplode("path.key").alias("depth", "node"))
    alone = (
        steps.groupBy("node")
        .agg(F.count("*").alias("m"), F.min("owner").alias("key"), F.min("depth").alias("depth"))
        .filter("m = 1")
        .groupBy("key")
        .agg((F.min("depth") + 1).alias("own"))
    )
    return merged.join(alone, "key", "left")


def _entering(distinct: DataFrame) -> DataFrame:
    """Distinct sequences as they enter the peeling: at their end, or as the child that begins their own tail."""
    own = F.col("own")
    tail = own.isNotNull()
    size = F.size("path")
    under = F.get("path", F.size("path") - 1)["total"] - F.coalesce(F.get("path", own - 2)["total"], F.lit(0))
    depth = F.when(tail, own - 1).otherwise(size)
    return distinct.select(
        depth.alias("depth"),
        _key_at(F.col("path"), depth).alias("key"),
        F.when(depth > 0, F.slice("path", F.lit(1), depth)).otherwise(F.slice("path", 1, 0)).alias("path"),
        "conv_id",
        "n_convs",
        tail.cast("long").alias("n_children"),
        tail.cast("long").alias("n_leaves"),
        F.when(tail, (F.col("n_convs") - 1) * under).otherwise(F.lit(0)).cast("long").alias("saved_tokens"),
        F.when(~tail, F.col("ends_sha256")).alias("ends_sha256"),
    )


def _stripped(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes of a level as children of the level ``depth`` above it."""
    path = F.slice("path", 1, depth)
    return nodes.select(
        _key_at(F.col("path"), F.lit(depth)).alias("key"),
        path.alias("path"),
        "conv_id",
        "n_convs",
        F.lit(1).cast("long").alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.lit(None).cast("string").alias("ends_sha256"),
    )


def _level(rows: DataFrame, depth: int) -> DataFrame:
    chars = F.get("path", F.lit(depth - 1))["chars"] if depth else F.lit(0)
    return (
        rows.groupBy("key")
        .agg(
            F.first("path").alias("path"),
            F.min("conv_id").alias("conv_id"),
            F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("saved_tokens"),
            F.max("ends_sha256").alias("ends_sha256"),
        )
        .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long"))
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * chars)
        .withColumn("depth", F.lit(depth).cast("long"))
    )


def _tails(distinct: DataFrame) -> DataFrame:
    """Nodes that one distinct sequence has alone; ``parent`` is null below the first of a tail."""
    depth, size = F.col("d"), F.size("path")
    before = F.coalesce(F.get("path", depth - 2)["total"], F.lit(0))
    total = F.get("path", F.size("path") - 1)["total"]
    return (
        distinct.filter("own is not null")
        .withColumn("d", F.explode(F.sequence(F.col("own"), size)))
        .select(
            "conv_id",
            depth.cast("long").alias("depth"),
            "n_convs",
            (depth < size).cast("long").alias("n_children"),
            F.lit(1).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * (total - before)).alias("saved_tokens"),
            F.when(depth == size, F.col("ends_sha256")).alias("ends_sha256"),
            F.when(depth == F.col("own"), _key_at(F.col("path"), depth - 1)).alias("parent"),
        )
    )


def trie_of(seqs: DataFrame) -> DataFrame:
    """Nodes of the trie of ``seqs`` (conv_id, path); see ``conversation_trie`` for the columns."""
    distinct = stage(distinct_sequences(seqs), "tails")
    entering = stage(_entering(distinct), "entering")
    deepest = entering.agg(F.max("depth")).first()[0]
    levels = []
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        rows = entering.filter(F.col("depth") == depth).drop("depth")
        if levels:
            rows = rows.unionByName(_stripped(levels[-1], depth))
        levels.append(stage(_level(rows, depth), "level"))
    tails = _tails(distinct)
    if not levels:
        return tails.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns())
    shared = levels[0]
    for level in levels[1:]:
        shared = shared.unionByName(level)
    above = _key_at(F.col("path"), F.col("depth").cast("int") - 1)
    nodes = shared.withColumn("parent", F.when(F.col("depth") > 0, above)).select(*NODE, "parent").unionByName(tails)
    parents = shared.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    return _with_parents(nodes, parents).select(*columns())


def _with_parents(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``nodes`` beside their parent's conv_id.

    A node below the first of its tail has its parent's conv_id itself. Of the others those under a node with
    very many children look it up in a table of at most ``WIDE`` rows; the rest share a parent with few others.
    """
    n = parents.agg(F.sum("n_children")).first()[0] or 0
    wide = F.col("n_children") * WIDE > n
    known = nodes.filter("parent is null").withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id"))
    )
    asked = nodes.filter("parent is not null")
    few = parents.filter(wide).select("parent", F.col("parent_conv_id").alias("_wide"))
    joined = asked.join(F.broadcast(few), "parent", "left")
    narrow = joined.filter("_wide is null").drop("_wide").join(parents.filter(~wide).drop("n_children"), "parent")
    found = joined.filter("_wide is not null").withColumnRenamed("_wide", "parent_conv_id")
    return known.unionByName(found).unionByName(narrow)


def columns() -> list:
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return [
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    ]


def conversation_trie(turns: DataFrame, rebuild: bool = True) -> DataFrame:
    """Nodes of the prefix trie of the conversations in ``turns`` (conv_id, turn, role, text).

    One row per distinct sequence of first turns (role and text), the textless root included:
    ``conv_id`` the smallest member, ``depth``, ``parent_conv_id`` (root: null), ``n_convs`` members,
    ``n_children``, ``n_leaves`` and ``saved_tokens`` over the subtree, its top included (each node's
    members but one times its last text's code points), ``ends_sha256`` of the members that end there.
    With ``rebuild`` heads are first taken from other conversations (see ``rebuilt``); without it the
    turns stay as they are.

    An empty table, or one without any conv_id, has no members and so no nodes. Nulls, equal turns and
    repeated rows are as ``conversation_turns`` says; further columns are ignored.
    """
    convs = conversation_turns(turns)
    if rebuild:
        convs = rebuilt(stage(convs, "turns"))
    return trie_of(sequences(convs))
