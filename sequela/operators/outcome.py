"""Outcome events: ``person_id, start_date, code, age, sex`` and, once resolved, ``endpoint``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.config import AGE_SCHEMES
from sequela.functions.columns import first_struct, left_closed, when_chain


def calendar_labels(ev: DataFrame, split: date) -> DataFrame:
    """Add study year, calendar month and year, and the season label."""
    month = F.month("start_date")
    return ev.withColumns(
        {
            "study_year": F.when(F.col("start_date") < F.lit(split), "Year1").otherwise("Year2"),
            "month": month,
            "season": when_chain(
                [(month.isin(9, 10, 11), "P1"), (month.isin(12, 1, 2, 3), "P2")], "P3"
            ),
            "calendar_year": F.year("start_date"),
        }
    )


def age_band(df: DataFrame, col: str, scheme: str, out: str = "age_grp") -> DataFrame:
    return df.withColumn(out, left_closed(F.col(col), AGE_SCHEMES[scheme]))


def trim_future(
    ev: DataFrame, today: date | None = None, extract_col: str | None = None
) -> DataFrame:
    """Drop events after ``today``, or after the latest extract date on record."""
    limit = (
        F.lit(today)
        if extract_col is None
        else ev.agg(F.max(extract_col).alias("latest")).scalar()
    )
    return ev.filter(F.col("start_date") <= limit)


def with_listed_codes(ev: DataFrame, endpoints: Mapping[str, Sequence[str]]) -> DataFrame:
    """Events whose code belongs to some endpoint, each once."""
    return ev.filter(F.col("code").isin(*{code: None for codes in endpoints.values() for code in codes}))


def resolve_endpoints(ev: DataFrame, endpoints: Mapping[str, Sequence[str]]) -> DataFrame:
    """Fan each event out to the endpoints its code belongs to.

    The dictionary is study configuration, so it becomes a literal map and no
    join is needed.
    """
    by_code: dict[str, list[str]] = {}
    for endpoint, codes in endpoints.items():
        for code in dict.fromkeys(codes):
            by_code.setdefault(code, []).append(endpoint)
    entries: list[Column] = []
    for code, names in by_code.items():
        entries += [F.lit(code), F.array(*[F.lit(n) for n in names])]
    listed = F.try_element_at(F.create_map(*entries), F.col("code"))
    return ev.filter(F.col("code").isin(*by_code)).select(
        F.explode(listed).alias("endpoint"), *ev.columns
    )


def latest_start(register: DataFrame) -> Column:
    """Latest event date over the whole register, as a scalar subquery."""
    return register.agg(F.max("start_date").alias("latest")).scalar()


def study_window(ev: DataFrame, begin: date, latest: Column, lag: int = 7) -> DataFrame:
    """Events from ``begin`` on, without the last ``lag`` days of reporting."""
    start = F.col("start_date")
    return ev.filter((start >= F.lit(begin)) & (start <= F.date_sub(latest, lag)))


def prior_events(ev: DataFrame, begin: date, lookback: int | None = None) -> DataFrame:
    """Events before ``begin``, all of them or those at most ``lookback`` days before."""
    start = F.col("start_date")
    prior = ev.filter(start < F.lit(begin))
    if lookback is None:
        return prior
    return prior.filter(start >= F.lit(begin - timedelta(days=lookback)))


def washout(ev: DataFrame, prior: DataFrame) -> DataFrame:
    """Drop people with a prior event of the same endpoint."""
    people = prior.select("endpoint", "person_id").distinct()
    return ev.join(people, ["endpoint", "person_id"], "left_anti")


def min_age(ev: DataFrame, years: int = 16) -> DataFrame:
    return ev.filter(F.col("age") >= years)


def first_event(ev: DataFrame) -> DataFrame:
    """First event per endpoint and person, ties by code.

    An aggregate, not a window: it combines before the shuffle, so a person
    with very many events costs one row per task.
    """
    carry = [c for c in ev.columns if c not in ("endpoint", "person_id", "start_date", "code")]
    picked = ev.groupBy("endpoint", "person_id").agg(
        first_struct(["start_date", "code"], carry).alias("r")
    )
    return picked.select("endpoint", "person_id", "r.*")


def person_history(
    ev: DataFrame,
    begin: date,
    latest: Column,
    lag: int = 7,
    lookback: int | None = None,
    years: int = 16,
) -> DataFrame:
    """Per endpoint and person: whether a prior event exists, and the first adult study event.

    One aggregate in place of study window, wash-out join, age limit and first
    event, so the events are shuffled once and combine before that.
    """
    start = F.col("start_date")
    is_prior = start < F.lit(begin)
    if lookback is not None:
        # a plain lower bound reaches the scan, the combined condition does not
        ev = ev.filter(start >= F.lit(begin - timedelta(days=lookback)))
    in_study = (
        (start >= F.lit(begin)) & (start <= F.date_sub(latest, lag)) & (F.col("age") >= years)
    )
    carry = [c for c in ev.columns if c not in ("endpoint", "person_id", "start_date", "code")]
    row = F.struct("start_date", "code", *carry)
    people = (
        ev.filter(is_prior | in_study)
        .groupBy("endpoint", "person_id")
        .agg(F.max(is_prior).alias("had_prior"), F.min(F.when(in_study, row)).alias("r"))
    )
    return people.select("endpoint", "person_id", "had_prior", "r.*")


def first_incident(history: DataFrame) -> DataFrame:
    """First incident events, as ``first_event`` gives them after the wash-out."""
    kept = history.filter(~F.col("had_prior") & F.col("start_date").isNotNull())
    return kept.drop("had_prior")


def study_end(ev: DataFrame) -> DataFrame:
    """Last event date per endpoint, one row per endpoint."""
    return ev.groupBy("endpoint").agg(F.max("start_date").alias("a_end"))


def attrition(
    ev: DataFrame, prior: DataFrame, cohort: DataFrame, unmatched: DataFrame
) -> DataFrame:
    """Per endpoint: events, people, people outside the cohort, people without a control.

    ``ev`` are the study events before wash-out and choice of the first one. Events are counted
    per person first, which combines before the shuffle; the wash-out then meets one row a person.
    """
    people = washout(ev.groupBy("endpoint", "person_id").agg(F.count("*").alias("n")), prior)
    linked = people.join(
        cohort.select("person_id").distinct().withColumn("linked", F.lit(1)), "person_id", "left"
    )
    counts = linked.groupBy("endpoint").agg(
        F.sum("n").alias("total_events"),
        F.count("*").alias("total_unique_events"),
        F.sum(F.when(F.col("linked").isNull(), 1).otherwise(0)).alias("no_link_to_cohort"),
    )
    missing = unmatched.groupBy("endpoint").agg(F.count("*").alias("no_match"))
    return counts.join(missing, "endpoint", "left").fillna(0, ["no_match"])


def first_test_in(tests: DataFrame, begin: date, end: date) -> DataFrame:
    """First positive test day per person between two dates."""
    day = F.col("specimen_date")
    return (
        tests.filter((day >= F.lit(begin)) & (day <= F.lit(end)))
        .groupBy("person_id")
        .agg(F.min("specimen_date").alias("specimen_date"))
    )


def one_death(deaths: DataFrame) -> DataFrame:
    """One row per person; the earliest date where a person has several."""
    return deaths.groupBy("person_id").agg(F.min("death_date").alias("death_date"))


def analysis_set(
    ev: DataFrame,
    vacc: DataFrame,
    deaths: DataFrame,
    tests: DataFrame,
    begin: date,
    end: date,
) -> DataFrame:
    """Exposed people with an incident event, their death and first positive test."""
    return (
        ev.join(vacc, "person_id")
        .join(one_death(deaths), "person_id", "left")
        .join(first_test_in(tests, begin, end), "person_id", "left")
    )
