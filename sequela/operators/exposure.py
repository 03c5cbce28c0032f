"""Exposure preparation: from dose records to one wide row per person.

Records carry ``person_id, occurrence_time, rec_id, type, stage``; the wide
table carries ``person_id, vacc_type, date_vacc_1, vacc_type_2, date_vacc_2``.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.functions.columns import first_struct, when_chain

WIDE = ["person_id", "vacc_type", "date_vacc_1", "vacc_type_2", "date_vacc_2"]


def classify_product(
    records: DataFrame, rules: Sequence[tuple[str, str, str]], unknown: str = "UNK"
) -> DataFrame:
    """Add ``date`` and ``vacc_type``; the first rule that fits names the product."""
    tests = {"contains": F.col("type").contains, "equals": F.col("type").__eq__}
    named = when_chain([(tests[kind](text), product) for kind, text, product in rules], unknown)
    return records.withColumns({"date": F.to_date("occurrence_time"), "vacc_type": named})


def recorded_since(records: DataFrame, day: date) -> DataFrame:
    """Records of a dose given on or after ``day``; a plain bound that reaches the scan."""
    return records.filter(F.col("occurrence_time") >= F.lit(day).cast("timestamp_ntz"))


def normalise_dose(records: DataFrame, first: Sequence[int] = (0, 3)) -> DataFrame:
    """Add ``dose``: the listed stages count as dose 1."""
    stage = F.col("stage")
    return records.withColumn("dose", F.when(stage.isin(*first), 1).otherwise(stage).cast("int"))


def first_per_dose(records: DataFrame, doses: Sequence[int] = (1, 2)) -> DataFrame:
    """Earliest record per person and dose, ties by record id."""
    picked = (
        records.filter(F.col("dose").isin(*doses))
        .groupBy("person_id", "dose")
        .agg(first_struct(["date", "rec_id", "vacc_type"]).alias("r"))
    )
    return picked.select("person_id", "dose", "r.date", "r.vacc_type", "r.rec_id")


def widen_doses(records: DataFrame) -> DataFrame:
    """One row per person with a dose 1, dose 2 beside it.

    Takes the earliest record of each dose itself, so it needs one shuffle on
    raw records and gives the same answer on the output of ``first_per_dose``.
    """
    pick = F.struct("date", "rec_id", "vacc_type")
    wide = records.groupBy("person_id").agg(
        F.min(F.when(F.col("dose") == 1, pick)).alias("d1"),
        F.min(F.when(F.col("dose") == 2, pick)).alias("d2"),
    )
    return wide.filter(F.col("d1").isNotNull()).select(
        "person_id",
        F.col("d1.vacc_type").alias("vacc_type"),
        F.col("d1.date").alias("date_vacc_1"),
        F.col("d2.vacc_type").alias("vacc_type_2"),
        F.col("d2.date").alias("date_vacc_2"),
    )


def drop_inconsistent(vacc: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Keep people whose products are known and the same for both doses."""
    first, second = F.col("vacc_type"), F.col("vacc_type_2")
    return vacc.filter(first.isin(*allowed) & (second.isNull() | (second == first)))


def _without_dose2(vacc: DataFrame, drop: Column) -> DataFrame:
    drop = F.coalesce(drop, F.lit(False))
    return vacc.withColumns(
        {
            "vacc_type_2": F.when(~drop, F.col("vacc_type_2")),
            "date_vacc_2": F.when(~drop, F.col("date_vacc_2")),
        }
    )


def collapse_same_day(vacc: DataFrame) -> DataFrame:
    """A second dose on the day of the first is the same dose."""
    return _without_dose2(vacc, F.col("date_vacc_2") == F.col("date_vacc_1"))


def min_gap(vacc: DataFrame, days: int = 18) -> DataFrame:
    """Drop people whose second dose is not more than ``days`` after the first."""
    second = F.col("date_vacc_2")
    return vacc.filter(second.isNull() | (second > F.date_add("date_vacc_1", days)))


def exclude_product(vacc: DataFrame, product: str) -> DataFrame:
    return vacc.filter(F.col("vacc_type") != product)


def by_endpoint(df: DataFrame, ends: DataFrame) -> DataFrame:
    """Repeat each row once per endpoint with that endpoint's ``a_end``.

    ``ends`` has one row per endpoint of the dictionary, so the map that is
    unfolded here is as small as the dictionary.
    """
    folded = ends.agg(
        F.map_from_entries(F.collect_list(F.struct("endpoint", "a_end"))).alias("m")
    ).scalar()
    return df.withColumn("_ends", folded).select(
        F.explode("_ends").alias("endpoint", "a_end"), *df.columns
    )


def cut_at_end(df: DataFrame) -> DataFrame:
    """On rows that carry ``a_end``: drop dose 1, or blank dose 2, from then on."""
    kept = df.filter(F.col("date_vacc_1") < F.col("a_end"))
    return _without_dose2(kept, F.col("date_vacc_2") >= F.col("a_end"))


def truncate_exposure(vacc: DataFrame, ends: DataFrame) -> DataFrame:
    """Exposures known at each endpoint's study end, one row per endpoint and person."""
    return cut_at_end(by_endpoint(vacc, ends)).select("endpoint", *WIDE, "a_end")


def exposure_until(vacc: DataFrame, end: date) -> DataFrame:
    return vacc.filter(F.col("date_vacc_1") <= F.lit(end))


def require_dose2(df: DataFrame) -> DataFrame:
    return df.filter(F.col("date_vacc_2").isNotNull())
