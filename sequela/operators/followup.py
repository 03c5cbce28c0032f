"""What happens around an event: exposure, death, hospital, a second outcome."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.functions.columns import days_between, when_chain
from sequela.operators.outcome import age_band, first_event, one_death
from sequela.operators.status import spell_part


def event_exposure(ev: DataFrame, vacc: DataFrame) -> DataFrame:
    """First event per person with the product given by then and the days since.

    A dose on the event day counts as given.
    """
    first = first_event(ev).join(
        vacc.select("person_id", "vacc_type", "date_vacc_1"), "person_id", "left"
    )
    given = F.coalesce(F.col("date_vacc_1") <= F.col("start_date"), F.lit(False))
    days = F.when(given, days_between(F.col("start_date"), F.col("date_vacc_1"))).otherwise(0)
    typed = first.withColumn("days_vacc_event", days).withColumn(
        "vacc_type", F.when(given, F.col("vacc_type")).otherwise("uv")
    )
    return age_band(typed, "age", "coarse")


def attach_death(df: DataFrame, deaths: DataFrame) -> DataFrame:
    return df.join(one_death(deaths), "person_id", "left")


def attach_admissions(df: DataFrame, spells: DataFrame, begin: date, salts: int = 8) -> DataFrame:
    """Emergency spells not over by ``begin``, with days from event to admission.

    Admissions up to a week before the event count as day 0, earlier ones have
    no day. People without a spell keep one row. The spells of a person are
    joined in parts, so that one with very many is spread over tasks.
    """
    left = F.col("discharge_date")
    open_or_later = spells.filter(
        F.col("emergency") & (left.isNull() | (left > F.lit(begin)))
    ).select("person_id", "admission_date", "discharge_date", spell_part(salts).alias("_part"))
    have = open_or_later.select("person_id").distinct().withColumn("_any", F.lit(True))
    parts = F.when(F.col("_any"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(-1)))
    spread = df.join(have, "person_id", "left").withColumn("_part", F.explode(parts))
    joined = spread.join(open_or_later.withColumn("_hit", F.lit(True)), ["person_id", "_part"], "left")
    days = days_between(F.col("admission_date"), F.col("start_date"))
    return (
        joined.filter(F.col("_any").isNull() | F.col("_hit"))
        .withColumn("days_adm", F.when(days >= 0, days).when(days >= -7, 0))
        .select(*df.columns, "admission_date", "discharge_date", "days_adm")
    )


def admission_status(df: DataFrame) -> DataFrame:
    """Discharge status, and admission status within 7 days of the event; names are fixed values."""
    admitted, left, start = F.col("admission_date"), F.col("discharge_date"), F.col("start_date")
    no_adm = (admitted.isNull() & left.isNull(), "no_adm")
    discharge = [
        no_adm,
        (left < start, "dis_before_event"),
        (left >= start, "dis_on_after_event"),
        (admitted.isNotNull() & left.isNull(), "in_hosp"),
    ]
    admission = [
        no_adm,
        (admitted < F.date_sub(start, 7), "adm_before_event"),
        (admitted <= F.date_add(start, 7), "adm_on_event"),
        (admitted > F.date_add(start, 7), "adm_after_event"),
    ]
    return df.withColumns(
        {
            "dis_status": when_chain(discharge, "rest"),
            "adm_status": when_chain(admission, "rest"),
        }
    )


def first_spell(df: DataFrame) -> DataFrame:
    """The spell with the fewest days to admission per person, unknown days last.

    Ties go to the earlier admission, then the earlier discharge with open
    spells last. An aggregate, so a person with very many spells combines
    before the shuffle.
    """
    keys = ["endpoint", "person_id"]
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(
        F.col("days_adm").isNull().alias("_no_day"),
        F.col("days_adm").alias("_day"),
        F.col("admission_date").alias("_adm"),
        F.col("discharge_date").isNull().alias("_open"),
        F.col("discharge_date").alias("_dis"),
        F.struct(*rest).alias("row"),
    )
    picked = df.groupBy(*keys).agg(F.min(row).alias("r"))
    return picked.select(*keys, "r.row.*")


def hospital_summary(df: DataFrame) -> DataFrame:
    """Add ``hosp_event``: no admission, in hospital at the event, or other."""
    adm, dis = F.col("adm_status"), F.col("dis_status")
    at_event = (adm == "adm_on_event") | (
        (adm == "adm_before_event") & (dis == "dis_on_after_event")
    )
    rules = [((adm == "no_adm") & (dis == "no_adm"), "no_adm"), (at_event, "in_hosp_at_event")]
    return df.withColumn("hosp_event", when_chain(rules, "other"))


def incident_cases(sets: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The cases of matched sets as events again."""
    return sets.filter(F.col("event") == 1).select(
        "endpoint", "person_id", F.col("event_time").alias("start_date"), *columns
    )


def product_at_event(ev: DataFrame, vacc: DataFrame) -> DataFrame:
    """Product ever given, and the product given by the event."""
    doses = vacc.select("person_id", "vacc_type", "date_vacc_1", "date_vacc_2")
    ever = F.coalesce("vacc_type", F.lit("uv"))
    later = F.coalesce(F.col("date_vacc_1") > F.col("start_date"), F.lit(False))
    return (
        ev.join(doses, "person_id", "left")
        .withColumn("vacc_type", ever)
        .withColumn("vt_at_event", F.when(later, "uv").otherwise(F.col("vacc_type")))
    )


def cooccurrence(primary: DataFrame, other: DataFrame) -> DataFrame:
    """Beside each primary event: the person's first ever event of the other endpoint.

    ``primary`` has one event per person; ``other`` has all events of the other
    endpoint. ``other_week`` classes the other event by weeks after the primary.
    """
    firsts = other.groupBy("person_id").agg(F.min("start_date").alias("other_date"))
    gap = days_between(F.col("other_date"), F.col("start_date"))
    rules = [
        (F.col("other_date").isNull(), "no_other_event"),
        (gap < 0, "before"),
        (gap <= 7, "other_1_week"),
        (gap <= 14, "other_2_weeks"),
        (gap <= 21, "other_3_weeks"),
    ]
    return primary.join(firsts, "person_id", "left").withColumn(
        "other_week", when_chain(rules, "other_later")
    )
