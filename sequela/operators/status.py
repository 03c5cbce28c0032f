"""Exposure, hospital, test and covariate status at an index date.

Sets carry ``endpoint, case_id, person_id, event_time`` among their columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.config import DOSE1_STATUS, DOSE2_STATUS, LATE_STATUS
from sequela.functions.columns import days_between, right_closed, when_chain


def vacc_status(
    df: DataFrame, vacc: DataFrame, ends: DataFrame, index_date: str = "event_time"
) -> DataFrame:
    """Dose bands on the index date; a dose-2 band overrides the dose-1 band.

    Doses on or after the endpoint's study end do not count. The bands have
    open ends, so their labels never depend on the range of the data.
    """
    joined = df.join(vacc, "person_id", "left").join(
        F.broadcast(ends), "endpoint", "left"  # one row per endpoint
    )
    known1 = F.col("date_vacc_1") < F.col("a_end")
    known2 = known1 & (F.col("date_vacc_2") < F.col("a_end"))
    cut = joined.withColumns(
        {
            "product": F.when(known1, F.col("vacc_type")),
            "day_1": F.when(known1, days_between(F.col(index_date), F.col("date_vacc_1"))),
            "day_2": F.when(known2, days_between(F.col(index_date), F.col("date_vacc_2"))),
        }
    )
    status = F.coalesce(
        right_closed(F.col("day_2"), DOSE2_STATUS),
        right_closed(F.col("day_1"), DOSE1_STATUS),
        F.lit("uv"),
    )
    return cut.withColumn("vacc_status", status).select(
        *df.columns, "product", "day_1", "day_2", "vacc_status"
    )


def product_at_index(df: DataFrame) -> DataFrame:
    """Product given by the index date, ``uv`` where no dose counts yet."""
    uv = F.col("vacc_status") == "uv"
    return df.withColumn(
        "vacc_type", F.when(uv, "uv").otherwise(F.coalesce("product", F.lit("uv")))
    )


def collapse_status(df: DataFrame) -> DataFrame:
    """Merge the late bands and cross product with band."""
    status = F.col("vacc_status")
    vs = F.when(status.isin(*LATE_STATUS), "v1_28+_v2").otherwise(status)
    uv = (F.col("vacc_type") == "uv") & (vs == "uv")
    return df.withColumns(
        {"vs": vs, "vs_type": F.when(uv, "uv").otherwise(F.concat_ws("_", "vacc_type", vs))}
    )


def _spell_kind(lookback: int) -> Column:
    """Where a spell lies relative to ``event_time``; the names are fixed values."""
    admitted, left, index = F.col("admission_date"), F.col("discharge_date"), F.col("event_time")
    return when_chain(
        [
            (admitted.isNull() & left.isNull(), "no_adm"),
            (left < F.date_sub(index, lookback), "no_adm"),
            ((left >= F.date_sub(index, lookback)) & (left < index), "before"),
            ((left >= index) & (admitted <= index), "in_hosp"),
            (left.isNull() & (admitted <= index), "in_hosp"),
            (admitted > index, "after"),
        ],
        "check",
    )


def person_index(df: DataFrame) -> DataFrame:
    """Index date of each person: that of the first set it appears in."""
    return (
        df.groupBy("endpoint", "person_id")
        .agg(F.min(F.struct("case_id", -F.col("event"), "event_time")).alias("r"))
        .select("endpoint", "person_id", F.col("r.event_time").alias("event_time"))
    )


def spell_part(salts: int) -> Column:
    """Part of its person's spells that a spell belongs to."""
    return F.pmod(F.xxhash64("admission_date", "discharge_date"), F.lit(salts)).cast("int")


def hospital_status(
    df: DataFrame, spells: DataFrame, begin: date, lookback: int = 14, salts: int = 8
) -> DataFrame:
    """Add ``hosp``: in hospital, discharged shortly before, or no admission.

    People without a spell, with later spells or long past ones have no
    admission. Found once per person, at the person's first index date, and shared by all
    of the person's rows.
    """
    people = person_index(df)
    left = F.col("discharge_date")
    recent = spells.filter(left.isNull() | (left >= F.lit(begin - timedelta(days=lookback))))
    # spells in parts, so that a person with very many is spread over tasks; the parts are no
    # grouping by person, so each task's result is combined before the rows meet per person
    parts = recent.select("person_id", "admission_date", "discharge_date", spell_part(salts).alias("part"))
    spread = people.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    kinds = spread.join(parts, ["person_id", "part"]).select(
        "endpoint", "person_id", _spell_kind(lookback).alias("kind")
    )
    per_person = kinds.groupBy("endpoint", "person_id").agg(
        F.max(F.col("kind") == "in_hosp").alias("inside"),
        F.max(F.col("kind") == "before").alias("before"),
    )
    hosp = when_chain([(F.col("inside"), "in_hosp"), (F.col("before"), "before")], "no_adm")
    return df.join(per_person, ["endpoint", "person_id"], "left").select(
        *df.columns, hosp.alias("hosp")
    )


def test_timing(df: DataFrame, tests: DataFrame) -> DataFrame:
    """Add ``positive_before_event``: when the first positive test was taken (POSITIVE_LEVELS).

    ``tests`` are positive tests; the first one of a person is used.
    """
    first = tests.groupBy("person_id").agg(F.min("specimen_date").alias("specimen_date"))
    gap = days_between(F.col("event_time"), F.col("specimen_date"))
    timing = when_chain(
        [
            (F.col("specimen_date").isNull(), "never"),
            (gap >= 28, "28+ days"),
            (gap >= 14, "14-27 days"),
            (gap >= 0, "0-13 days"),
            (gap >= -6, "1-6 post event"),
        ],
        "7+ post event",
    )
    return df.join(first, "person_id", "left").select(
        *df.columns, timing.alias("positive_before_event")
    )


def attach_covariates(
    df: DataFrame,
    cohort: DataFrame,
    household: DataFrame,
    ev: DataFrame,
    covariates: Sequence[str],
) -> DataFrame:
    """Cohort covariates, care-home flag, and the person's own event code if any."""
    codes = ev.select("endpoint", "person_id", F.col("code").alias("event_code"))
    return (
        df.join(cohort.select("person_id", *covariates), "person_id", "left")
        .join(household.select("person_id", "care_home"), "person_id", "left")
        .join(codes, ["endpoint", "person_id"], "left")
    )


def cut_bands(df: DataFrame, col: str, breaks: Sequence[int], out: str) -> DataFrame:
    """Right-closed bands ``(a,b]`` between the breaks, null outside."""
    bands = [(f"({a},{b}]", a, b) for a, b in zip(breaks, breaks[1:])]
    return df.withColumn(out, right_closed(F.col(col), bands))


def days_since_first(df: DataFrame, col: str = "event_time", out: str = "days") -> DataFrame:
    """Days since the endpoint's first date in ``col``."""
    first = df.groupBy("endpoint").agg(F.min(col).alias("_first"))
    return df.join(F.broadcast(first), "endpoint").withColumn(  # one row per endpoint
        out, days_between(F.col(col), F.col("_first"))
    ).drop("_first")
