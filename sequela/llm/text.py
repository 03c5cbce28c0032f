"""Words of a text, and running totals that no task holds whole."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
LARGEST = (1 << 63) - 1
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(col: Column) -> Column:
    """Array of the words of a text; empty for null."""
    found = F.regexp_extract_all(col, F.lit(WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def word_count(col: Column) -> Column:
    """Number of words as a long; 0 for null."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, UPPER.lower())


def byte_words(text: str | None) -> list[bytes]:
    """The same words in Python: ``bytes.split`` cuts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def running_totals(
    df: DataFrame, keys: Sequence[str], index: str, value: str, width: int = 1024
) -> DataFrame:
    """One row per (keys, index) with ``before``: the values of smaller indexes of the keys.

    ``index`` is a whole number from 0. Totals are taken over runs of ``width`` indexes, over
    runs of those runs, and over what is left, so that a window holds ``width`` rows, and the
    last one a row per ``width`` squared indexes.
    """
    keys = list(keys)
    fine = df.groupBy(*keys, index).agg(F.sum(value).alias("_v"))
    fine = fine.withColumn("_run", F.expr(f"{index} div {width}"))
    fine = fine.withColumn("_part", F.expr(f"_run div {width}"))
    runs = fine.groupBy(*keys, "_part", "_run").agg(F.sum("_v").alias("_v"))
    parts = runs.groupBy(*keys, "_part").agg(F.sum("_v").alias("_v"))
    return (
        _before(fine, [*keys, "_run"], index, "_b0")
        .join(_before(runs, [*keys, "_run"][:-1] + ["_part"], "_run", "_b1").drop("_part", "_v"), [*keys, "_run"])
        .join(_before(parts, keys, "_part", "_b2").drop("_v"), [*keys, "_part"])
        .select(*keys, index, (F.col("_b0") + F.col("_b1") + F.col("_b2")).alias("before"))
    )


def _before(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    window = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum("_v").over(window), F.lit(0)))


def map_columns(
    df: DataFrame,
    keep: Sequence[str],
    inputs: Sequence[Column],
    extra: str,
    make: Callable[[], Callable[..., Sequence[Sequence]]],
) -> DataFrame:
    """``keep`` columns of ``df``, untouched, beside new columns computed in Python.

    ``make()`` is called once in a task. What it returns gets the inputs of a batch of rows as
    lists and returns the columns of the schema ``extra`` as lists of the same length.
    """
    kept = df.select(*keep).schema if keep else StructType()
    added = StructType.fromDDL(extra)
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = [f"k{i}" for i in range(len(keep))] + [f"x{i}" for i in range(len(added))]
    picked = df.select(
        *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
        *[c.alias(f"i{i}") for i, c in enumerate(inputs)],
    )
    schema = StructType()
    for field, name in zip([*kept.fields, *added.fields], names):
        schema.add(name, field.dataType)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            made = f(*[c.to_pylist() for c in columns[n_keep:]])
            arrays = [pa.array(v, k) for v, k in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*columns[:n_keep], *arrays], names=names)

    return picked.mapInArrow(run, schema).toDF(*keep, *added.names)


def keep_rows(
    df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable[..., Sequence[bool]]], size: int = 1 << 20
) -> DataFrame:
    """The rows of ``df`` for which a function in Python holds; the last of ``inputs`` is a text.

    ``make()`` is called once in a task. What it returns gets the inputs of some rows, whose texts have about ``size``
    bytes, as lists. Other columns stay in Arrow, and rows that go are not sent back.
    """
    at = [df.columns.index(c) for c in inputs]
    names = [f"c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            first = 0
            for texts in text_slices(batch.column(at[-1]), size):
                some = batch.slice(first, len(texts))
                first += len(texts)
                holds = f(*[some.column(i).to_pylist() for i in at])
                yield some.filter(pa.array(holds, pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*df.columns)


def text_slices(texts: pa.StringArray, size: int = 1 << 24) -> Iterator[pa.StringArray]:
    """The texts, nulls as empty ones, in slices of about ``size`` bytes."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + size, "right")))
        yield texts[first:last]
        first = last


def coded_words(texts: pa.StringArray, lower: bool = True) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, with A-Z lower-cased if ``lower``, all words as numbers of these, and the texts' cuts.

    Text i has the words ``codes[cuts[i]:cuts[i + 1]]``.
    """
    distinct, code, cuts = word_codes(texts, lower)
    return distinct.to_pylist(), code, cuts


def word_codes(texts: pa.StringArray, lower: bool = True) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """``coded_words`` with the distinct words as an array."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary())
    code = coded.indices.to_numpy(zero_copy_only=False)
    # a text's first and last pieces are empty where it begins or ends in white space
    word = (pc.binary_length(distinct).to_numpy(zero_copy_only=False) > 0)[code] if len(code) else np.zeros(0, bool)
    offsets = lists.offsets.to_numpy()
    before = np.concatenate([[0], np.cumsum(word)])
    return distinct, code[word], before[offsets - offsets[0]]


def release_memory() -> None:
    """Give freed memory back to the system: a worker that waits for its next task holds no more than it needs."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def most_frequent(counts: DataFrame, n: str, limit: int, tie: str | None = None) -> tuple[DataFrame, int]:
    """Rows of the largest counts, ``limit`` at most, and the smallest count of the bins taken whole.

    Counts are binned by their logarithm, so that the driver gets a number per bin, not each
    task's candidates. Of a bin that does not fit whole nothing is taken, or, with ``tie``, the largest
    counts, equal ones in the order of that column; each task's candidates are then sorted.
    """
    bin_ = F.floor(F.log2(n) * 64)
    top = counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("k"), F.min(n).alias("least"))
    rest, least = limit, LARGEST
    for row in sorted(top.collect(), key=lambda r: -r["bin"]):
        if row["k"] > rest:
            if tie is None or not rest:
                break
            some = counts.filter(bin_ == row["bin"]).orderBy(F.desc(n), tie).limit(rest)
            return counts.filter(F.col(n) >= least).unionByName(some), least
        rest, least = rest - row["k"], row["least"]
    return counts.filter(F.col(n) >= least), least
