"""Counts and series that describe a study table."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, cols: Sequence[str], keep_null: bool = False) -> DataFrame:
    """Counts over one to three factors in long form; missing values optional."""
    kept = df if keep_null else df.dropna(subset=list(cols))
    return count_by(kept, cols)


def freq_of_freq(df: DataFrame, id_col: str, by: Sequence[str] = ("endpoint",)) -> DataFrame:
    """How many ids occur once, twice, and so on."""
    per_id = df.groupBy(*by, id_col).agg(F.count("*").alias("times"))
    return per_id.groupBy(*by, "times").agg(F.count("*").alias("n"))


def daily_series(ev: DataFrame, ends: DataFrame, start: date) -> DataFrame:
    """Events per day and endpoint from ``start`` to the endpoint's end, zeros filled in."""
    counts = ev.groupBy("endpoint", "start_date").agg(F.count("*").alias("n"))
    spine = ends.filter(F.col("a_end") >= F.lit(start)).select(
        "endpoint", F.explode(F.sequence(F.lit(start), F.col("a_end"))).alias("start_date")
    )
    return (
        spine.join(counts, ["endpoint", "start_date"], "left")
        .fillna(0, ["n"])
        .withColumn("days", F.datediff("start_date", F.lit(start)))
        .withColumn("month", F.date_format("start_date", "MMMM"))
    )


def crude_table(sets: DataFrame, by: str) -> DataFrame:
    """People, events and percent per exposure level."""
    counts = sets.groupBy("endpoint", by).agg(
        F.count("*").alias("n"), F.sum("event").cast("long").alias("events")
    )
    return counts.withColumn("percent", F.col("events") / F.col("n") * 100)
