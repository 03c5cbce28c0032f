"""Small Column builders: rule chains, bands, dates and keyed random numbers."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def when_chain(rules: Iterable[tuple[Column, Any]], default: Any = None) -> Column:
    """CASE over the rules; the first rule that holds wins."""
    chain = None
    for condition, value in rules:
        chain = (
            F.when(condition, lit(value))
            if chain is None
            else chain.when(condition, lit(value))
        )
    if chain is None:
        return lit(default)
    return chain if default is None else chain.otherwise(lit(default))


def last_rule(rules: Sequence[tuple[Column, Any]], default: Any) -> Column:
    """CASE for overwriting rules, where the last rule that holds wins."""
    return when_chain(reversed(list(rules)), default)


def left_closed(col: Column, bands: Sequence[tuple[str, int | None, int | None]]) -> Column:
    """Label of the band with from <= value < below."""
    rules = []
    for label, lo, hi in bands:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (col >= lo)
        if hi is not None:
            cond = cond & (col < hi)
        rules.append((col.isNotNull() & cond, label))
    return when_chain(rules)


def right_closed(col: Column, bands: Sequence[tuple[str, int | None, int | None]]) -> Column:
    """Label of the band with over < value <= up to."""
    rules = []
    for label, lo, hi in bands:
        cond = F.lit(True)
        if lo is not None:
            cond = cond & (col > lo)
        if hi is not None:
            cond = cond & (col <= hi)
        rules.append((col.isNotNull() & cond, label))
    return when_chain(rules)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return F.datediff(later, earlier)


def key_hash(*parts: Column | str, seed: str, hex_digits: int = 15) -> Column:
    """Non-negative number fixed by the seed and the key, whatever the partitioning."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    text = F.concat_ws("|", F.lit(seed), *[c.cast("string") for c in cols])
    digits = F.substring(F.md5(text), 1, hex_digits)
    return F.conv(digits, 16, 10).cast("long")


def key_uniform(*parts: Column | str, seed: str) -> Column:
    """Uniform on [0, 1) from the first 32 bits of the key hash."""
    return key_hash(*parts, seed=seed, hex_digits=8) / F.lit(float(2**32))


def first_struct(order: Sequence[str], carry: Sequence[str] = ()) -> Column:
    """Smallest row by ``order``, as an aggregate that combines before the shuffle."""
    return F.min(F.struct(*order, *[c for c in carry if c not in order]))


def short_number(col: Column | str, digits: int = 2) -> Column:
    """Text of a rounded number without trailing zeros: 1, 0.5, 2.25."""
    return F.regexp_replace(F.format_string(f"%.{digits}f", col), r"\.?0+$", "")
