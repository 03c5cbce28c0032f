"""Self-controlled case series: windows, intervals, time splitting and rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.config import SCCS_LEVELS, StudyParams
from sequela.functions.columns import days_between, when_chain
from sequela.sources.stages import tasks_for

EVENT_KEY = ["endpoint", "person_id", "start_date", "code", "age", "sex"]


def event_rows(ev: DataFrame) -> DataFrame:
    """Fold exact copies of an event row into one row with its multiplicity ``n``.

    Every copy counts as an own event row in the interval design, so ``n``
    weights counts and person-time and no row needs an artificial id.
    """
    return ev.groupBy(*EVENT_KEY).agg(F.count("*").alias("n"))


def sccs_events(
    rows: DataFrame, vacc: DataFrame, ends: DataFrame, include_uv: bool = False
) -> DataFrame:
    """Event rows beside the first dose and the endpoint's study end."""
    dose = vacc.select("person_id", "vacc_type", "date_vacc_1")
    joined = rows.join(dose, "person_id", "left" if include_uv else "inner")
    typed = joined.withColumn(
        "vacc_type", F.when(F.col("date_vacc_1").isNull(), "uv").otherwise(F.col("vacc_type"))
    )
    return typed.join(F.broadcast(ends), "endpoint")  # one row per endpoint


def sccs_windows(events: DataFrame, p: StudyParams, fixed: bool = False) -> DataFrame:
    """Observation windows around dose 1, clipped to the study end.

    The moving form keeps events inside the person's own window and exposures
    before the study end; the fixed form observes everyone from the same day
    to the study end. People without a dose keep null windows.
    """
    d1, end = F.col("date_vacc_1"), F.col("a_end")

    def clip(day: Column) -> Column:
        return F.when(day > end, end).otherwise(day)

    marks = {
        "pre_start": F.date_sub(d1, p.pre_from),
        "pre_end": F.date_sub(d1, p.pre_to),
        "risk_start": F.date_add(d1, p.risk_from),
        "risk_end": clip(F.date_add(d1, p.risk_to)),
        "post_start": clip(F.date_add(d1, p.post_from)),
        "post_end": clip(F.date_add(d1, p.post_to)),
    }
    if fixed:
        marks["pre_start"] = F.lit(p.shift(-p.pre_from))
        marks["risk_start"] = clip(F.date_add(d1, p.risk_from))
        marks["post_end"] = end
        return events.withColumns(marks)
    start = F.col("start_date")
    inside = (start >= F.date_sub(d1, p.pre_from)) & (start <= F.date_add(d1, p.post_to))
    kept = events.filter(d1.isNull() | (inside & (d1 < end)))
    return kept.withColumns(marks)


def intervals_array(windows: DataFrame) -> DataFrame:
    """Pre / Clearance / Risk intervals ``(start, stop]`` of each event row as an array."""
    marks = ["pre_start", "pre_end", "risk_start", "risk_end"]
    parts = []
    for level, (lo, hi) in zip(SCCS_LEVELS, zip(marks, marks[1:])):
        inside = (F.col("start_date") > F.col(lo)) & (F.col("start_date") <= F.col(hi))
        parts.append(
            F.struct(
                F.lit(level).alias("expgr"),
                F.col(lo).alias("t_start"),
                F.col(hi).alias("t_stop"),
                days_between(F.col(hi), F.col(lo)).alias("interval"),
                F.when(inside, 1).otherwise(0).alias("event"),
            )
        )
    listed = F.filter(F.array(*parts), lambda x: x["interval"] > 0)
    return windows.filter(F.col("date_vacc_1").isNotNull()).withColumn("intervals", listed)


def split_intervals(windows: DataFrame) -> DataFrame:
    """One row per event row and interval; nothing is shuffled."""
    return (
        intervals_array(windows)
        .select(
            "endpoint", "person_id", "start_date", "code", "vacc_type", "n",
            F.inline("intervals"),
        )
    )


def interval_rates(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Events, person-days and weekly rate; ``n`` weights the rows where present."""
    n = F.col("n") if "n" in intervals.columns else F.lit(1)
    rates = intervals.groupBy(*by).agg(
        F.sum(F.col("event") * n).cast("long").alias("event"),
        F.sum(F.col("interval") * n).cast("long").alias("interval"),
    )
    return rates.withColumn("rate_week", F.try_divide(F.col("event"), F.col("interval")) * 7)


def calendar_cuts(windows: DataFrame) -> DataFrame:
    """Per endpoint: start of the calendar and four cuts of equal length."""
    spans = windows.groupBy("endpoint").agg(
        F.min("pre_start").alias("cal_start"),
        F.max("post_end").alias("cal_stop"),
        F.max("a_end").alias("a_end"),
    )
    length = F.bround(days_between(F.col("cal_stop"), F.col("cal_start")) / F.lit(5.0)).cast("int")
    cuts = F.transform(
        F.sequence(F.lit(1), F.lit(4)), lambda i: F.date_add(F.col("cal_start"), i * length)
    )
    return spans.select("endpoint", "cal_start", "a_end", cuts.alias("periods"))


def by_person(rows: DataFrame) -> DataFrame:
    """The rows dealt by endpoint and person, to as many tasks as their number asks for.

    Windows compress so well that tasks cut by bytes would hold a multiple of their share.
    """
    return rows.repartition(tasks_for(rows.count(), rows.sparkSession), "endpoint", "person_id")


def exposed_spans(windows: DataFrame, cuts: DataFrame) -> DataFrame:
    """One span per exposed person with the cuts that change its covariates."""
    marks = ["vacc_type", "pre_start", "pre_end", "risk_start", "risk_end"]
    people = (
        by_person(windows.select("endpoint", "person_id", *marks)).filter(F.col("vacc_type") != "uv")
        .groupBy("endpoint", "person_id")
        .agg(
            F.min(F.struct(*marks)).alias("w")
        )
        .join(F.broadcast(cuts.select("endpoint", "periods")), "endpoint")  # one row per endpoint
    )
    return people.select(
        "endpoint",
        "person_id",
        F.col("w.vacc_type").alias("vacc_type"),
        F.col("w.pre_start").alias("span_start"),
        F.col("w.risk_end").alias("span_stop"),
        F.array("w.pre_end", "w.risk_start").alias("marks"),
        "periods",
    )


def unexposed_spans(windows: DataFrame, cuts: DataFrame) -> DataFrame:
    """One span per never-exposed person over the whole calendar."""
    people = (
        by_person(windows.select("endpoint", "person_id", "vacc_type"))
        .filter(F.col("vacc_type") == "uv")
        .select("endpoint", "person_id")
        .distinct()
    )
    return people.join(F.broadcast(cuts), "endpoint").select(  # one row per endpoint
        "endpoint",
        "person_id",
        F.lit("uv").alias("vacc_type"),
        F.col("cal_start").alias("span_start"),
        F.col("a_end").alias("span_stop"),
        F.array().cast("array<date>").alias("marks"),
        "periods",
    )


def event_days_in_window(ev: DataFrame, spans: DataFrame) -> DataFrame:
    """Distinct event days per person inside ``(span_start, span_stop]``."""
    days = by_person(ev.select("endpoint", "person_id", "start_date")).distinct()
    day = F.col("start_date")
    return (
        days.join(
            spans.select("endpoint", "person_id", "span_start", "span_stop"),
            ["endpoint", "person_id"],
        )
        .filter((day > F.col("span_start")) & (day <= F.col("span_stop")))
        .select("endpoint", "person_id", "start_date")
    )


def time_split(spans: DataFrame, ev: DataFrame) -> DataFrame:
    """Split each span at its marks, the calendar cuts and its event days.

    Covariates count the cuts reached by the start of an interval; an interval
    has an event when it stops on an event day. The list of event days of a
    person holds at most one entry per calendar day of the span.
    """
    days = (
        event_days_in_window(ev, spans)
        .groupBy("endpoint", "person_id")
        .agg(F.sort_array(F.collect_list("start_date")).alias("days"))
    )
    joined = spans.join(days, ["endpoint", "person_id"], "left").withColumn(
        "days", F.coalesce("days", F.array().cast("array<date>"))
    )
    lo, hi = F.col("span_start"), F.col("span_stop")
    inner = F.filter(
        F.array_union(F.array_union(F.col("marks"), F.col("periods")), F.col("days")),
        lambda d: (d > lo) & (d < hi),
    )
    ticks = F.array_sort(F.array_union(F.array_union(F.array(lo), inner), F.array(hi)))
    pairs = F.filter(
        F.zip_with(
            F.col("ticks"),
            F.slice(F.col("ticks"), 2, F.size("ticks")),
            lambda a, b: F.struct(a.alias("t_start"), b.alias("t_stop")),
        ),
        lambda x: x["t_stop"].isNotNull(),
    )

    def reached(cuts: str) -> Column:
        return F.size(F.filter(F.col(cuts), lambda d: d <= F.col("t_start")))

    return (
        joined.filter(lo < hi)
        .withColumn("ticks", ticks)
        .select(
            "endpoint", "person_id", "vacc_type", "marks", "periods", "days",
            F.inline(pairs),
        )
        .select(
            "endpoint",
            "person_id",
            "vacc_type",
            "t_start",
            "t_stop",
            F.when(F.array_contains("days", F.col("t_stop")), 1).otherwise(0).alias("event"),
            reached("marks").alias("expgr"),
            reached("periods").alias("period"),
        )
    )


def censor_at(intervals: DataFrame, deaths: DataFrame) -> DataFrame:
    """End person-time at death; an event on the day of death still counts."""
    death = F.col("death_date")
    joined = intervals.join(deaths, "person_id", "left")
    return (
        joined.filter(death.isNull() | (F.col("t_start") < death))
        .withColumn("event", F.when(death < F.col("t_stop"), 0).otherwise(F.col("event")))
        .withColumn("t_stop", F.least(F.col("t_stop"), death))
        .select(*intervals.columns)
    )


def label_sccs(exposed: DataFrame, unexposed: DataFrame) -> DataFrame:
    """Stack both groups and name the levels."""
    both = exposed.unionByName(unexposed)
    code = F.col("expgr")
    name = when_chain([(code == i, level) for i, level in enumerate(SCCS_LEVELS)])
    vt = F.when(code == 0, "uv").otherwise(F.col("vacc_type"))
    return both.select(
        "endpoint",
        "person_id",
        "vacc_type",
        "t_start",
        "t_stop",
        "event",
        vt.alias("vt"),
        name.alias("expgr"),
        "period",
        F.greatest(F.col("period") - 1, F.lit(0)).alias("period2"),
        F.when(code == 0, name).otherwise(F.concat_ws("_", vt, name)).alias("vt_expgr"),
        days_between(F.col("t_stop"), F.col("t_start")).alias("interval"),
    )
