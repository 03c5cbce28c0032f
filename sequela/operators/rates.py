"""Observed against expected events, with simulated intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequela.config import FOLLOW_BANDS, StudyParams
from sequela.functions.columns import days_between, key_uniform, short_number
from sequela.functions.stats import poisson_limits, poisson_quantiles
from sequela.operators.exposure import by_endpoint, cut_at_end
from sequela.operators.outcome import age_band, one_death


def first_post_exposure(ev: DataFrame, vacc: DataFrame, ends: DataFrame) -> DataFrame:
    """First event after dose 1 per endpoint and person, with flags for 7 to 28 days.

    The day of the dose itself does not count as after.
    """
    doses = vacc.select("person_id", "vacc_type", "date_vacc_1")
    days = days_between(F.col("start_date"), F.col("date_vacc_1"))
    after = (
        # distinct days first: a person then has at most a row per endpoint and calendar day
        ev.select("endpoint", "person_id", "start_date")
        .distinct()
        .join(doses, "person_id")
        .join(F.broadcast(ends), "endpoint")  # one row per endpoint
        .filter(
            (F.col("date_vacc_1") < F.col("a_end")) & (F.col("start_date") > F.col("date_vacc_1"))
        )
    )
    first = after.groupBy("endpoint", "person_id", "vacc_type", "date_vacc_1").agg(
        F.min(days).alias("days_1")
    )
    flags = {f"days_{d:02d}": F.when(F.col("days_1") <= d, 1).otherwise(0) for d in (7, 14, 21, 28)}
    return first.withColumns(flags)


def exposure_followup(
    vacc: DataFrame, cohort: DataFrame, post: DataFrame, ends: DataFrame
) -> DataFrame:
    """Everyone exposed, followed to their event or the study end; ``n`` is 1 per person."""
    ages = cohort.select("person_id", "age_year")
    exposed = cut_at_end(by_endpoint(vacc.join(ages, "person_id", "left"), ends))
    joined = exposed.join(
        post.select("endpoint", "person_id", F.col("days_1").alias("event_day")),
        ["endpoint", "person_id"],
        "left",
    )
    followed = joined.select(
        "endpoint",
        "person_id",
        "vacc_type",
        "age_year",
        F.coalesce("event_day", days_between(F.col("a_end"), F.col("date_vacc_1"))).alias("days_1"),
        F.when(F.col("event_day").isNotNull(), 1).otherwise(0).alias("event"),
        F.lit(1).cast("long").alias("n"),
    )
    return age_band(followed, "age_year", "coarse")


def followup_cells(
    vacc: DataFrame, cohort: DataFrame, post: DataFrame, ends: DataFrame
) -> DataFrame:
    """``exposure_followup`` counted by product, age band, follow-up and event.

    Exposed people are counted by product, age and dose date first, and only
    those counts are repeated per endpoint; people with an event move from
    their count to an own cell. The person table is shuffled once, not once
    per endpoint.
    """
    ages = age_band(cohort.select("person_id", "age_year"), "age_year", "coarse")
    people = vacc.select("person_id", "vacc_type", "date_vacc_1", "date_vacc_2", "vacc_type_2").join(
        ages.select("person_id", "age_grp"), "person_id", "left"
    )
    cells = people.groupBy("vacc_type", "age_grp", "date_vacc_1").agg(F.count("*").alias("n"))
    spread = by_endpoint(cells, ends).filter(F.col("date_vacc_1") < F.col("a_end"))
    keys = ["endpoint", "vacc_type", "age_grp", "date_vacc_1"]
    with_event = post.select(
        "endpoint", "person_id", "vacc_type", "date_vacc_1", "days_1"
    ).join(ages.select("person_id", "age_grp"), "person_id", "left")
    everyone = spread.select(
        *keys[:3], days_between(F.col("a_end"), F.col("date_vacc_1")).alias("days_1"),
        F.lit(0).alias("event"), "n",
    )
    events = with_event.groupBy(*keys, "days_1").agg(F.count("*").alias("n"))
    moved = events.join(F.broadcast(ends), "endpoint").select(  # one row per endpoint
        *keys[:3], days_between(F.col("a_end"), F.col("date_vacc_1")).alias("days_1"),
        F.lit(0).alias("event"), (-F.col("n")).alias("n"),
    )
    own = events.select(*keys[:3], "days_1", F.lit(1).alias("event"), "n")
    return (
        everyone.unionByName(moved)
        .unionByName(own)
        .groupBy(*keys[:3], "days_1", "event")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") != 0)
    )


def person_time(
    followed: DataFrame,
    by: Sequence[str] = ("endpoint", "vacc_type", "age_grp"),
    bands: Sequence[tuple[str, int, int | None]] = FOLLOW_BANDS,
) -> DataFrame:
    """People, events and person-days per band of days since the dose.

    An event belongs to the band in which follow-up ends. Rows without an age
    band are left out.
    """
    days, weight = F.col("days_1"), F.col("n")
    pieces = []
    for label, lo, hi in bands:
        upper = days if hi is None else F.least(days, F.lit(hi))
        ends_here = (days > lo) if hi is None else (days > lo) & (days <= hi)
        pieces.append(
            F.struct(
                F.lit(label).alias("period"),
                F.when(days > lo, weight).otherwise(0).alias("n_in"),
                F.when(ends_here, F.col("event") * weight).otherwise(0).alias("event_in"),
                (F.greatest(F.lit(0), upper - lo) * weight).alias("days_in"),
            )
        )
    spread = followed.filter(F.col("age_grp").isNotNull()).select(*by, F.inline(F.array(*pieces)))
    return spread.groupBy(*by, "period").agg(
        F.sum("n_in").cast("long").alias("n"),
        F.sum("event_in").cast("long").alias("event"),
        F.sum("days_in").cast("long").alias("pdays"),
    ).filter(F.col("n") > 0)


def historical_events(ev: DataFrame, p: StudyParams) -> DataFrame:
    """People with a first event in the historical window, by endpoint and age band.

    The window has both ends inside, one day more than the rate is divided by.
    """
    lo, hi = p.shift(-p.hist_from), p.shift(-p.hist_to)
    start = F.col("start_date")
    earlier = start < F.lit(lo)
    if p.lookback_days is not None:
        earlier = earlier & (start >= F.lit(lo - timedelta(days=p.lookback_days)))
    inside = (start >= F.lit(lo)) & (start <= F.lit(hi))
    people = (
        ev.filter(start <= F.lit(hi))
        .groupBy("endpoint", "person_id")
        .agg(
            F.max(earlier).alias("had_earlier"),
            F.min(F.when(inside, F.struct("start_date", "code", "age"))).alias("r"),
        )
        .filter(~F.col("had_earlier") & (F.col("r.age") >= p.min_age))
        .select("endpoint", F.col("r.age").alias("age"))
    )
    return age_band(people, "age", "coarse").groupBy("endpoint", "age_grp").agg(
        F.count("*").alias("events_pre")
    )


def weighted_population(cohort: DataFrame) -> DataFrame:
    """Weighted population by age band, rounded half to even."""
    banded = age_band(cohort, "age_year", "coarse")
    return banded.groupBy("age_grp").agg(F.bround(F.sum("weight")).alias("population"))


def expected_events(
    person_days: DataFrame, hist: DataFrame, population: DataFrame, days: int = 28
) -> DataFrame:
    """Events expected from the historical rate.

    Without history the cell counts 0 events in a population of 1, which later
    steps read as "nothing expected".
    """
    history = hist.join(population, "age_grp", "left")
    joined = person_days.join(history, ["endpoint", "age_grp"], "left").fillna(
        {"events_pre": 0, "population": 1.0}
    )
    return joined.withColumn(
        "exp_events", F.col("pdays") * (F.col("events_pre") / F.lit(float(days))) / F.col("population")
    )


def oe_summary(oe: DataFrame) -> DataFrame:
    """Observed and expected by endpoint, product and age band."""
    first_band = F.when(F.col("period") == FOLLOW_BANDS[0][0], F.col("n")).otherwise(0)
    cells = oe.groupBy("endpoint", "vacc_type", "age_grp").agg(
        F.sum("event").alias("event"),
        F.sum("exp_events").alias("exp_events"),
        F.sum("pdays").alias("pdays"),
        F.sum(first_band).alias("n"),
        F.avg("events_pre").alias("events_pre"),
        F.avg("population").alias("population"),
    )
    return cells.withColumns(
        {
            "data_oe": F.try_divide(F.col("event"), F.col("exp_events")),
            "data_o_minus_e": F.col("event") - F.col("exp_events"),
        }
    )


@F.pandas_udf(T.LongType())
def _poisson_draw(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for uniform, mean in pairs:
        yield pd.Series(poisson_quantiles(uniform.to_numpy(), mean.to_numpy()))


def simulate_oe(cells: DataFrame, n_sims: int, seed: str, chunk: int = 1000) -> DataFrame:
    """Poisson draws of the observed and historical counts of every cell.

    The work is cells times draws whatever the data; it is spread in chunks of
    draws. A historical draw of 0 counts as 0.5.
    """
    keys = ["endpoint", "vacc_type", "age_grp"]
    starts = F.sequence(F.lit(0), F.lit(n_sims - 1), F.lit(chunk))
    spread = cells.withColumn("_from", F.explode(starts)).repartition(*keys, "_from")
    draws = spread.withColumn(
        "sim",
        F.explode(
            F.sequence(F.col("_from") + 1, F.least(F.col("_from") + chunk, F.lit(n_sims)))
        ),
    ).drop("_from")

    def draw(kind: str, mean: str) -> Column:
        return _poisson_draw(
            key_uniform(F.lit(kind), *keys, "sim", seed=seed), F.col(mean).cast("double")
        )

    drawn = draws.withColumns({"sim_obs": draw("obs", "event"), "_pre": draw("pre", "events_pre")})
    pre = F.when(F.col("_pre") == 0, 0.5).otherwise(F.col("_pre").cast("double"))
    missing = F.col("population") == 1
    expected = F.when(missing, 0.0).otherwise(F.col("pdays") * (pre / 28.0) / F.col("population"))
    return (
        drawn.withColumn("sim_obs_pre", pre)
        .withColumn("sim_exp_pre", expected)
        .withColumn(
            "o_e",
            F.when(missing, 1.0).otherwise(F.try_divide(F.col("sim_obs"), F.col("sim_exp_pre"))),
        )
        .withColumn("o_minus_e", F.col("sim_obs") - F.col("sim_exp_pre"))
        .drop("_pre")
    )


def oe_interval(sim: DataFrame, by: Sequence[str]) -> DataFrame:
    """Median, mean and 95 % limits of simulated ratio and difference, beside the observed ones.

    Exact percentiles: a group holds one value per simulation.
    """
    aggs = []
    for col, name in (("o_e", "oe"), ("o_minus_e", "o_minus_e")):
        aggs += [
            F.percentile(col, F.lit(0.5)).alias(f"med_{name}"),
            F.avg(col).alias(f"mean_{name}"),
            F.percentile(col, F.lit(0.025)).alias(f"q025_{name}"),
            F.percentile(col, F.lit(0.975)).alias(f"q975_{name}"),
            F.max(f"data_{name}").alias(f"data_{name}"),
        ]
    return sim.groupBy(*by).agg(*aggs)


def oe_interval_overall(sim: DataFrame) -> DataFrame:
    """Totals over the ages within each simulation, then the interval by product."""
    totals = sim.groupBy("endpoint", "vacc_type", "sim").agg(
        *[F.sum(c).alias(c) for c in ("event", "exp_events", "sim_obs", "sim_exp_pre")]
    )
    ratios = totals.withColumns(
        {
            "o_e": F.try_divide(F.col("sim_obs"), F.col("sim_exp_pre")),
            "o_minus_e": F.col("sim_obs") - F.col("sim_exp_pre"),
            "data_oe": F.try_divide(F.col("event"), F.col("exp_events")),
            "data_o_minus_e": F.col("event") - F.col("exp_events"),
        }
    )
    return oe_interval(ratios, ["endpoint", "vacc_type"])


def oe_table(summary: DataFrame, by_age: DataFrame, overall: DataFrame) -> DataFrame:
    """Age rows with their limits, and an all-ages row per product."""
    limits = ["q025_oe", "q975_oe", "q025_o_minus_e", "q975_o_minus_e"]
    shown = ["endpoint", "vacc_type", "age_grp", "n", "event", "exp_events", "data_oe"]
    shown += ["q025_oe", "q975_oe", "data_o_minus_e", "q025_o_minus_e", "q975_o_minus_e"]
    ages = (
        summary.withColumn("data_oe", F.coalesce("data_oe", F.lit(1.0)))
        .join(
            by_age.select("endpoint", "vacc_type", "age_grp", *limits),
            ["endpoint", "vacc_type", "age_grp"],
            "left",
        )
        .select(*shown)
    )
    totals = summary.groupBy("endpoint", "vacc_type").agg(
        F.sum("n").alias("n"), F.sum("event").alias("event"), F.sum("exp_events").alias("exp_events")
    )
    everyone = (
        totals.withColumns(
            {
                "age_grp": F.lit("All Ages"),
                "data_oe": F.try_divide(F.col("event"), F.col("exp_events")),
                "data_o_minus_e": F.col("event") - F.col("exp_events"),
            }
        )
        .join(overall.select("endpoint", "vacc_type", *limits), ["endpoint", "vacc_type"], "left")
        .select(*shown)
    )
    return ages.unionByName(everyone)


def _dose2_follow_up(df: DataFrame, end: date) -> DataFrame:
    """Ends of the whole and the 28-day follow-up after dose 2."""
    stop = F.coalesce(F.col("death_date"), F.lit(end))
    return df.filter(F.col("date_vacc_2") <= F.lit(end)).withColumns(
        {"stop": stop, "stop_28": F.least(F.date_add("date_vacc_2", 27), stop)}
    )


def dose2_denominator(vacc: DataFrame, deaths: DataFrame, end: date) -> DataFrame:
    """One row: second doses given, and person-days of both windows (first day included)."""
    followed = _dose2_follow_up(vacc.join(one_death(deaths), "person_id", "left"), end)
    return followed.agg(
        F.count("*").alias("doses"),
        F.sum(days_between(F.col("stop"), F.col("date_vacc_2")) + 1).alias("pdays"),
        F.sum(days_between(F.col("stop_28"), F.col("date_vacc_2")) + 1).alias("pdays_28"),
    )


def dose2_events(analysis: DataFrame, end: date) -> DataFrame:
    """Events after dose 2 per endpoint, in the whole and the 28-day window."""
    start, d2 = F.col("start_date"), F.col("date_vacc_2")
    return _dose2_follow_up(analysis, end).groupBy("endpoint").agg(
        F.sum(F.when((start >= d2) & (start <= F.col("stop")), 1).otherwise(0)).alias("events"),
        F.sum(F.when((start >= d2) & (start <= F.col("stop_28")), 1).otherwise(0)).alias("events_28"),
    )


def _per_window(
    analysis: DataFrame, vacc: DataFrame, deaths: DataFrame, end: date
) -> DataFrame:
    """Events, doses and person-days, one row per endpoint and window."""
    total = dose2_denominator(vacc, deaths, end).select(F.struct("*").alias("t")).scalar()
    wide = dose2_events(analysis, end).withColumn("t", total)
    rows = F.array(
        F.struct(
            F.lit("all").alias("follow_up"),
            F.col("events").alias("n_events"),
            F.col("t.pdays").alias("pdays"),
        ),
        F.struct(
            F.lit("28 days").alias("follow_up"),
            F.col("events_28").alias("n_events"),
            F.col("t.pdays_28").alias("pdays"),
        ),
    )
    return wide.select("endpoint", F.col("t.doses").alias("doses"), F.inline(rows))


@F.pandas_udf(T.StructType().add("lower", "double").add("upper", "double"))
def _poisson_interval(events: pd.Series) -> pd.DataFrame:
    limits = [poisson_limits(int(x)) for x in events]
    return pd.DataFrame(limits, columns=["lower", "upper"])


def dose2_incidence(
    analysis: DataFrame, vacc: DataFrame, deaths: DataFrame, end: date
) -> DataFrame:
    """Events after dose 2 per 100,000 doses with exact Poisson limits."""
    rows = _per_window(analysis, vacc, deaths, end)
    pt = F.col("doses") / F.lit(100_000.0)
    scaled = rows.withColumn("ci", _poisson_interval("n_events")).select(
        "endpoint",
        "follow_up",
        "n_events",
        "doses",
        F.round(F.try_divide(F.col("n_events"), pt), 2).alias("rate"),
        F.round(F.try_divide(F.col("ci.lower"), pt), 2).alias("lower"),
        F.round(F.try_divide(F.col("ci.upper"), pt), 2).alias("upper"),
    )
    rate, lower, upper = (short_number(c) for c in ("rate", "lower", "upper"))
    text = F.concat(rate, F.lit(" ("), lower, F.lit(","), upper, F.lit(")"))
    return scaled.withColumn("rate_ci", text)


def crude_rate(analysis: DataFrame, vacc: DataFrame, deaths: DataFrame, end: date) -> DataFrame:
    """Events after dose 2 per 10 million person-days, for both windows."""
    rows = _per_window(analysis, vacc, deaths, end)
    return rows.withColumn(
        "rate", F.try_divide(F.col("n_events"), F.col("pdays")) * F.lit(10_000_000.0)
    ).select("endpoint", "follow_up", "n_events", "pdays", "rate")
