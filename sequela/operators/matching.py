"""Matched case-control sets without ever forming all case-control pairs.

People of one stratum are numbered by death date, latest first, so the
controls still alive on a given day are exactly the ranks ``0 .. n-1``. A case
then draws ``k`` distinct ranks, and one equi-join on (stratum, rank) fetches
the controls: work grows with the pool plus ``k`` per case, however large a
stratum is. A stratum is numbered in ``salts`` parts, so no single task sorts
a whole one.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sequela.functions.columns import key_hash, when_chain

# Stands for "no death on record" where death dates are ordered.
NEVER = date(9999, 12, 31)


def matching_age(cohort: DataFrame) -> DataFrame:
    """Age one year on, with the oldest ages grouped so that they can be matched."""
    age = F.col("age_year") + 1
    grouped = when_chain(
        [
            (age >= 100, 100),
            (age >= 95, 97),
            (age >= 90, 92),
            (age >= 80, F.expr("(age_year + 1) div 2 * 2")),
        ],
        age,
    )
    return cohort.withColumn("match_age", grouped.cast("int"))


def alive_at(cohort: DataFrame, deaths: DataFrame, begin: date) -> DataFrame:
    """Cohort with ``death_date``, without people who died before ``begin``."""
    death = F.col("death_date")
    return cohort.join(deaths, "person_id", "left").filter(
        death.isNull() | (death >= F.lit(begin))
    )


def link_cases(ev: DataFrame, cohort: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events beside their cohort row; ``linked`` is false where there is none."""
    people = cohort.select("person_id", *keys, F.lit(True).alias("linked"))
    sides = ev.select("endpoint", "person_id", "start_date", "code")
    return sides.join(people, "person_id", "left").withColumn(
        "linked", F.coalesce("linked", F.lit(False))
    )


def linked_cases(ev: DataFrame, cohort: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cases: the linked events, keyed by ``case_id`` and ``event_time``."""
    return (
        link_cases(ev, cohort, keys)
        .filter("linked")
        .select(
            "endpoint",
            F.col("person_id").alias("case_id"),
            F.col("start_date").alias("event_time"),
            *keys,
        )
    )


def control_pool(
    cohort: DataFrame, prior: DataFrame, cases: DataFrame, endpoints: Sequence[str]
) -> DataFrame:
    """Cohort members without a prior event, per endpoint.

    ``event`` marks those who are or become cases and ``event_time`` is the day
    they do. Prior events and cases arrive in one join per person, as a map with
    at most one entry per endpoint; only then is the person repeated for the
    endpoint names, which are study configuration.
    """
    marks = (
        prior.select("endpoint", "person_id", F.lit(None).cast("date").alias("event_time"))
        .unionByName(cases.select("endpoint", F.col("case_id").alias("person_id"), "event_time"))
        .groupBy("endpoint", "person_id")
        .agg(F.max("event_time").alias("event_time"))
        .groupBy("person_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("endpoint", "event_time"))).alias("marks"))
    )
    names = F.array(*[F.lit(e) for e in endpoints])
    spread = cohort.join(marks, "person_id", "left").select(
        F.explode(names).alias("endpoint"), *cohort.columns, "marks"
    )
    day = F.try_element_at("marks", F.col("endpoint"))
    prior_only = F.map_contains_key("marks", F.col("endpoint")) & day.isNull()
    return spread.filter(~F.coalesce(prior_only, F.lit(False))).select(
        "endpoint", *cohort.columns, day.alias("event_time"), day.isNotNull().cast("int").alias("event")
    )


def _salt(salts: int) -> Column:
    return (key_hash("person_id", seed="salt") % salts).cast("int")


def number_pool(pool: DataFrame, keys: Sequence[str], salts: int = 32) -> DataFrame:
    """Pool members with their ``rank`` in the stratum, latest death first.

    The parts of a stratum are numbered apart and shifted by the running size
    of the parts before them. The matching steps read the result three times:
    stage it.
    """
    stratum = ["endpoint", *keys]
    cell = [*stratum, "last_day", "salt"]
    marked = pool.select(
        *stratum,
        "person_id",
        "event_time",
        F.coalesce("death_date", F.lit(NEVER)).alias("last_day"),
        _salt(salts).alias("salt"),
    )
    before = W.partitionBy(*stratum).orderBy(F.desc("last_day"), "salt")
    offsets = (
        marked.groupBy(*cell)
        .agg(F.count("*").alias("n"))
        .withColumn("offset", F.sum("n").over(before.rowsBetween(W.unboundedPreceding, -1)))
        .select(*cell, F.coalesce("offset", F.lit(0)).alias("offset"))
    )
    place = F.row_number().over(W.partitionBy(*cell).orderBy("person_id"))
    return (
        marked.withColumn("place", place)
        .join(offsets, cell)
        .withColumn("rank", F.col("offset") + F.col("place") - 1)
        .select(*stratum, "rank", "person_id", "event_time", "last_day")
    )


def _alive_counts(cases: DataFrame, sizes: DataFrame, stratum: Sequence[str]) -> DataFrame:
    """Per stratum and case day: members who die later or never.

    A running sum over distinct days, so a partition is never longer than twice
    the calendar.
    """
    asked = cases.select(*stratum, F.col("event_time").alias("day")).distinct()
    both = asked.select(*stratum, "day", F.lit(0).alias("n"), F.lit(True).alias("asked")).unionByName(
        sizes.select(*stratum, F.col("last_day").alias("day"), "n", F.lit(False).alias("asked"))
    )
    later = W.partitionBy(*stratum).orderBy(F.desc("day"), F.desc("asked"))
    summed = both.withColumn(
        "alive", F.sum("n").over(later.rowsBetween(W.unboundedPreceding, W.currentRow))
    )
    return summed.filter("asked").select(*stratum, F.col("day").alias("event_time"), "alive")


def match_candidates(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pool's cases with the number ``n_candidates`` of controls that fit.

    A control fits when it agrees on all keys, is alive on the event day and is
    not the case itself. ``self_rank`` is the case's own rank when it is among
    the living members of its stratum.
    """
    stratum = ["endpoint", *keys]
    cases = ranked.filter(F.col("event_time").isNotNull())
    sizes = ranked.groupBy(*stratum, "last_day").agg(F.count("*").alias("n"))
    days = _alive_counts(cases, sizes, stratum)
    inside = F.col("rank") < F.col("alive")
    return cases.join(days, [*stratum, "event_time"]).select(
        *stratum,
        F.col("person_id").alias("case_id"),
        "event_time",
        F.when(inside, F.col("rank")).alias("self_rank"),
        (F.col("alive") - inside.cast("long")).alias("n_candidates"),
    )


def _draws(k: int, seed: str) -> Column:
    """``k`` distinct numbers below ``n_candidates``, every subset equally likely.

    Floyd's method: for j = n-k .. n-1 take a number up to j, or j itself where
    that number is taken.
    """
    none = F.array().cast("array<bigint>")

    def step(taken: Column, j: Column) -> Column:
        pick = key_hash("endpoint", "case_id", j, seed=seed) % (j + 1)
        return F.concat(
            taken, F.array(F.when(F.array_contains(taken, pick), j).otherwise(pick))
        )

    n = F.col("n_candidates")
    steps = F.sequence(F.greatest(n - k, F.lit(0)), n - 1)
    return F.when(n > 0, F.aggregate(steps, none, step)).otherwise(none)


def sample_controls(
    ranked: DataFrame, keys: Sequence[str], k: int = 10, seed: str = "sequela"
) -> DataFrame:
    """Up to ``k`` random controls per case, without replacement within the case.

    Cases with fewer than ``k`` candidates get all of them. The draw depends on
    the seed and the ids only, so a lost task draws the same controls again.
    ``pick`` numbers the controls of a case from 0.
    """
    asked = match_candidates(ranked, keys)
    drawn = asked.select("*", F.posexplode(_draws(k, seed)).alias("pick", "draw"))
    past_self = F.coalesce(F.col("draw") >= F.col("self_rank"), F.lit(False))
    chosen = drawn.withColumn("rank", F.col("draw") + past_self.cast("long"))
    controls = ranked.select(
        "endpoint",
        *keys,
        "rank",
        F.col("person_id").alias("control_id"),
        F.col("event_time").isNotNull().cast("int").alias("future_case"),
    )
    return chosen.join(controls, ["endpoint", *keys, "rank"]).select(
        "endpoint", "case_id", "control_id", "event_time", *keys, "future_case", "pick"
    )


def unmatched(cases: DataFrame, matched: DataFrame) -> DataFrame:
    """Cases without any control."""
    have = matched.select("endpoint", "case_id").distinct()
    return cases.join(have, ["endpoint", "case_id"], "left_anti")


def matched_sets(matched: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each matched case and one for each of its controls.

    The case row comes with the first control, so the sets need no second pass.
    Controls have ``event`` 0 even when they become cases later, and take the
    case's event date as index date.
    """
    shared = ["endpoint", "case_id", "event_time", *keys]

    def member(person: str, event: int) -> Column:
        return F.struct(F.col(person).alias("person_id"), F.lit(event).alias("event"))

    control = member("control_id", 0)
    members = F.when(F.col("pick") == 0, F.array(member("case_id", 1), control)).otherwise(
        F.array(control)
    )
    return matched.select(*shared, F.inline(members))


def match_diagnostics(matched: DataFrame) -> DataFrame:
    """How often controls are re-used, controls per case, and future cases among controls."""

    def frequency(measure: str, id_col: str) -> DataFrame:
        sizes = matched.groupBy("endpoint", id_col).agg(F.count("*").alias("value"))
        return sizes.groupBy("endpoint", "value").agg(F.count("*").alias("n")).select(
            "endpoint", F.lit(measure).alias("measure"), "value", "n"
        )

    future = matched.groupBy("endpoint", F.col("future_case").cast("long").alias("value")).agg(
        F.count("*").alias("n")
    )
    return (
        frequency("uses_per_control", "control_id")
        .unionByName(frequency("controls_per_case", "case_id"))
        .unionByName(
            future.select("endpoint", F.lit("future_case").alias("measure"), "value", "n")
        )
    )
