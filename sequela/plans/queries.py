"""Registry of runnable queries, one per operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sequela.config import HOSP_LEVELS, POSITIVE_LEVELS, PRODUCT_LEVELS, VS_LEVELS, VS_TYPE_LEVELS
from sequela.models import effects, selfcontrolled
from sequela.models.clogit import coef_table, fit, strata_table
from sequela.models.kernel import Term
from sequela.models.poisson import its_poisson, smooth_trend
from sequela.operators import (
    describe,
    exposure,
    followup,
    matching,
    outcome,
    persondays,
    rates,
    report,
    sccs,
    status,
)
from sequela.plans.studies import COVARIATES, Study
from sequela.sources import registers
from sequela.sources.stages import new_folder, stage
from sequela.sources.testdata import PRODUCT_RULES, PRODUCTS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SERIES_START = date(1997, 9, 1)
SIMD_LEVELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
BMI_BREAKS = (10, 19, 24, 29, 34, 39, 50)
DAY_BREAKS = (-1, 25, 50, 75, 110, 400)
VS_TYPE = Term("vs_type", VS_TYPE_LEVELS)
PRODUCT = Term("vacc_type", PRODUCT_LEVELS)
STATUS = Term("vs", VS_LEVELS)
EXPOSED = Term("exposed")
BASE = (Term("n_risk_gps"), Term("simd", SIMD_LEVELS), Term("n_tests_gp"))


#: Digits that numbers are compared to; iterated and simulated ones differ sooner between engines.
DIGITS, FITTED_DIGITS = 8, 6
FITTED = {
    "r8_simulate_oe", "r9_oe_interval", "r10_oe_interval_overall", "r11_oe_table", "r12_dose2_incidence",
    "r13_crude_rate", "l2_clogit", "l2_clogit_product", "l3_clogit_exact", "l3_clogit_exact_risk",
    "l4_effect_table", "l8_lr_test", "l9_effectiveness", "l10_its_steps", "k5_sccs_fit", "p9_pd_model_binary", "l5_nested_models", "l5_nested_models_product", "l6_screen_covariates",
    "l7_extra_models", "p9_pd_model", "p10_pd_model_joint", "p11_rr_table", "b1_report_table", "b1_report_product",
}


def tidy(df: DataFrame, digits: int = FITTED_DIGITS) -> DataFrame:
    """Whole numbers as BIGINT, other numbers to ``digits`` decimals."""
    cols = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("long")
        elif isinstance(f.dataType, T.DoubleType):
            col = F.round(col, digits) + F.lit(0.0)
        cols.append(col.alias(f.name))
    return df.select(*cols)


def query(build: Callable[[Study], DataFrame]) -> Callable[[Study], DataFrame]:
    digits = FITTED_DIGITS if build.__name__ in FITTED else DIGITS
    QUERIES[build.__name__] = lambda spark, folder: tidy(build(Study.over(spark, folder)), digits)
    return build


# sources and sinks


@query
def s1_load_register(s: Study) -> DataFrame:
    return s.reg.cohort()


@query
def s2_positive_tests(s: Study) -> DataFrame:
    return registers.positive_tests(s.reg.tests(), s.p.begin)


@query
def s3_positive_test_days(s: Study) -> DataFrame:
    return registers.positive_test_days(s.reg.tests())


@query
def s4_write_stage(s: Study) -> DataFrame:
    spark = s.reg.spark
    first = outcome.first_incident(s.history)
    path = registers.write_stage(first, new_folder(spark))
    return registers.read_stage(spark, path, first.schema)


@query
def s5_stack_results(s: Study) -> DataFrame:
    spark = s.reg.spark
    root = new_folder(spark)
    table = tidy(sccs.interval_rates(s.intervals, ["endpoint", "vacc_type", "expgr"]))
    paths = [
        registers.write_results(table.filter(F.col("vacc_type") == v), f"{root}/{v}")
        for v in PRODUCTS
    ]
    return registers.stack_results(spark, paths, table.schema)


# exposure preparation


@query
def e1_classify_product(s: Study) -> DataFrame:
    named = exposure.classify_product(s.reg.vaccination_records(), PRODUCT_RULES)
    return named.select("person_id", "rec_id", "type", "date", "vacc_type")


@query
def e2_normalise_dose(s: Study) -> DataFrame:
    return exposure.normalise_dose(s.reg.vaccination_records()).select("rec_id", "stage", "dose")


@query
def e3_first_per_dose(s: Study) -> DataFrame:
    return exposure.first_per_dose(s.records)


@query
def e4_widen_doses(s: Study) -> DataFrame:
    return s.wide


@query
def e5_drop_inconsistent(s: Study) -> DataFrame:
    return exposure.drop_inconsistent(s.wide, PRODUCTS)


@query
def e6_collapse_same_day(s: Study) -> DataFrame:
    return exposure.collapse_same_day(exposure.drop_inconsistent(s.wide, PRODUCTS))


@query
def e7_min_gap(s: Study) -> DataFrame:
    return s.vacc


@query
def e8_exclude_product(s: Study) -> DataFrame:
    return exposure.exclude_product(s.vacc, "AZ")


@query
def e9_truncate_exposure(s: Study) -> DataFrame:
    return exposure.truncate_exposure(s.vacc, s.oe_ends)


@query
def e10_exposure_until(s: Study) -> DataFrame:
    return exposure.exposure_until(s.vacc, s.p.end)


@query
def e11_require_dose2(s: Study) -> DataFrame:
    return exposure.require_dose2(s.vacc)


# outcome events


@query
def v1_calendar_labels(s: Study) -> DataFrame:
    labelled = outcome.calendar_labels(s.reg.consultations(), s.p.begin)
    return describe.count_by(labelled, ["study_year", "month", "season", "calendar_year"])


@query
def v2_age_band(s: Study) -> DataFrame:
    fine = outcome.age_band(s.reg.consultations(), "age", "fine", "fine")
    return describe.count_by(outcome.age_band(fine, "age", "coarse", "coarse"), ["fine", "coarse"])


@query
def v3_trim_future(s: Study) -> DataFrame:
    kept = outcome.trim_future(s.reg.consultations(), today=s.p.extract)
    return describe.count_by(kept, ["start_date"])


@query
def v3_trim_extract(s: Study) -> DataFrame:
    """The extract reaches three days past the last record taken before the extract date."""
    start = F.col("start_date")
    dated = s.reg.consultations().withColumn(
        "extract_date", F.when(start <= F.lit(s.p.extract), F.date_add(start, 3))
    )
    return describe.count_by(outcome.trim_future(dated, extract_col="extract_date"), ["start_date"])


@query
def v4_resolve_endpoints(s: Study) -> DataFrame:
    return describe.count_by(s.events, ["endpoint", "code", "start_date"])


@query
def v5_study_window(s: Study) -> DataFrame:
    return describe.count_by(s.in_window, ["endpoint", "start_date"])


@query
def v6_washout(s: Study) -> DataFrame:
    """With the bounded look-back of the dose-2 study."""
    kept = outcome.washout(s.in_window, s.recent_prior)
    return describe.count_by(kept, ["endpoint", "person_id", "start_date"])


@query
def v6_washout_unbounded(s: Study) -> DataFrame:
    kept = outcome.washout(s.in_window, s.prior)
    return describe.count_by(kept, ["endpoint", "person_id", "start_date"])


@query
def v7_min_age(s: Study) -> DataFrame:
    return describe.count_by(s.incident, ["endpoint", "person_id", "age"])


@query
def v8_first_event(s: Study) -> DataFrame:
    """First, then wash-out: the same people, and the aggregate meets the unshuffled events."""
    return outcome.washout(outcome.first_event(s.adult_events), s.prior)


@query
def v8_first_incident(s: Study) -> DataFrame:
    return outcome.first_incident(s.history)


@query
def v9_study_end(s: Study) -> DataFrame:
    return outcome.study_end(s.incident)


@query
def v10_attrition(s: Study) -> DataFrame:
    return s.lost


@query
def v11_analysis_set(s: Study) -> DataFrame:
    return s.analysis


# cohort and matching


@query
def c1_matching_age(s: Study) -> DataFrame:
    return describe.count_by(matching.matching_age(s.reg.cohort()), ["age_year", "match_age"])


@query
def c2_alive_at(s: Study) -> DataFrame:
    deaths = outcome.one_death(s.reg.deaths())
    return matching.alive_at(s.reg.cohort(), deaths, s.p.shift(90)).select("person_id", "death_date")


@query
def c3_link_cases(s: Study) -> DataFrame:
    return matching.link_cases(s.first, s.late_cohort, s.p.match_keys)


@query
def c4_control_pool(s: Study) -> DataFrame:
    return s.pool.select("endpoint", "person_id", *s.p.match_keys, "death_date", "event")


@query
def m1_match_candidates(s: Study) -> DataFrame:
    found = matching.match_candidates(s.ranked, s.p.match_keys)
    return found.drop("self_rank")


@query
def m2_sample_controls(s: Study) -> DataFrame:
    return s.matched.drop("pick")


@query
def m3_unmatched(s: Study) -> DataFrame:
    return matching.unmatched(s.cases, s.matched)


@query
def m4_matched_sets(s: Study) -> DataFrame:
    return matching.matched_sets(s.matched, s.p.match_keys)


@query
def m5_match_diagnostics(s: Study) -> DataFrame:
    return matching.match_diagnostics(s.matched)


# status at the index date

SET_KEY = ["endpoint", "case_id", "person_id", "event"]


@query
def x1_vacc_status(s: Study) -> DataFrame:
    banded = status.vacc_status(s.sets, s.vacc, s.cc_ends)
    return banded.select(*SET_KEY, "day_1", "day_2", "vacc_status")


@query
def x2_product_at_index(s: Study) -> DataFrame:
    banded = status.vacc_status(s.sets, s.vacc, s.cc_ends)
    return status.product_at_index(banded).select(*SET_KEY, "vacc_status", "vacc_type")


@query
def x3_collapse_status(s: Study) -> DataFrame:
    return s.exposed_sets.select(*SET_KEY, "vs", "vs_type")


@query
def x4_hospital_status(s: Study) -> DataFrame:
    found = status.hospital_status(s.sets, s.reg.spells(), s.p.begin, s.p.hospital_lookback)
    return found.select(*SET_KEY, "hosp")


@query
def x5_test_timing(s: Study) -> DataFrame:
    tests = registers.positive_tests(s.reg.tests(), s.p.begin)
    return status.test_timing(s.sets, tests).select(*SET_KEY, "positive_before_event")


@query
def x6_attach_covariates(s: Study) -> DataFrame:
    found = status.attach_covariates(
        s.sets, s.reg.cohort(), s.reg.household(), s.first, COVARIATES
    )
    return found.select(*SET_KEY, *COVARIATES, "care_home", "event_code")


@query
def x7_cut_bands(s: Study) -> DataFrame:
    sets = s.sets.join(s.reg.cohort().select("person_id", "bmi"), "person_id", "left")
    banded = status.cut_bands(sets, "bmi", BMI_BREAKS, "bmi_gp")
    dated = status.cut_bands(status.days_since_first(banded), "days", DAY_BREAKS, "days_gp")
    return dated.select(*SET_KEY, "bmi_gp", "days", "days_gp")


# observed and expected


@query
def r1_first_post_exposure(s: Study) -> DataFrame:
    return s.post


@query
def r2_exposure_followup(s: Study) -> DataFrame:
    return rates.exposure_followup(s.doses, s.reg.cohort(), s.post, s.oe_ends)


@query
def r3_person_time(s: Study) -> DataFrame:
    cells = rates.followup_cells(s.doses, s.reg.cohort(), s.post, s.oe_ends)
    return rates.person_time(cells)


@query
def r4_historical_events(s: Study) -> DataFrame:
    return s.hist


@query
def r5_weighted_population(s: Study) -> DataFrame:
    return rates.weighted_population(s.reg.cohort())


@query
def r6_expected_events(s: Study) -> DataFrame:
    return s.oe


@query
def r7_oe_summary(s: Study) -> DataFrame:
    return rates.oe_summary(s.oe)


def _simulated(s: Study) -> DataFrame:
    return rates.simulate_oe(s.oe_cells, s.p.n_sims, s.p.seed)


@query
def r8_simulate_oe(s: Study) -> DataFrame:
    return _simulated(s).groupBy("endpoint", "vacc_type", "age_grp").agg(
        F.count("*").alias("n_sims"),
        F.sum("sim_obs").alias("sum_obs"),
        F.max("sim_obs").alias("max_obs"),
        F.sum("sim_obs_pre").alias("sum_pre"),
        F.sum("sim_exp_pre").alias("sum_exp"),
    )


@query
def r9_oe_interval(s: Study) -> DataFrame:
    return rates.oe_interval(_simulated(s), ["endpoint", "vacc_type", "age_grp"])


@query
def r10_oe_interval_overall(s: Study) -> DataFrame:
    return rates.oe_interval_overall(_simulated(s))


@query
def r11_oe_table(s: Study) -> DataFrame:
    summary, sim = s.oe_cells, stage(_simulated(s))
    by_age = rates.oe_interval(sim, ["endpoint", "vacc_type", "age_grp"])
    return rates.oe_table(summary, by_age, rates.oe_interval_overall(sim))


@query
def r12_dose2_incidence(s: Study) -> DataFrame:
    return rates.dose2_incidence(s.staged_analysis, s.doses, s.reg.deaths(), s.p.end)


@query
def r13_crude_rate(s: Study) -> DataFrame:
    return rates.crude_rate(s.staged_analysis, s.doses, s.reg.deaths(), s.p.end)


# models


def _ever_exposed(s: Study) -> DataFrame:
    return s.exposed_sets.withColumn("exposed", (F.col("vacc_type") != "uv").cast("int"))


def _exposed_fits(s: Study) -> list:
    strata = strata_table(_ever_exposed(s), ["endpoint"], ["case_id"], [EXPOSED])
    return fit(strata, [EXPOSED], {"raw": ["exposed"]})


def _fit_rows(spark: SparkSession, fits: list, by: list[str]) -> DataFrame:
    sizes = spark.createDataFrame(
        [(*f.group, f.n_strata, f.n_events, f.loglik) for f in fits],
        ", ".join(f"{b} string" for b in by) + ", n_strata long, n_events long, loglik double",
    )
    return coef_table(spark, fits, by).join(sizes, by)


@query
def l1_crude_table(s: Study) -> DataFrame:
    by_status = describe.crude_table(s.exposed_sets, "vs_type").withColumnRenamed("vs_type", "level")
    by_product = describe.crude_table(s.exposed_sets, "vacc_type").withColumnRenamed(
        "vacc_type", "level"
    )
    return by_status.withColumn("var", F.lit("vs_type")).unionByName(
        by_product.withColumn("var", F.lit("vacc_type"))
    )


@query
def l2_clogit(s: Study) -> DataFrame:
    return _fit_rows(s.reg.spark, _exposed_fits(s), ["endpoint"])


@query
def l2_clogit_product(s: Study) -> DataFrame:
    strata = strata_table(s.exposed_sets, ["endpoint"], ["case_id"], [PRODUCT])
    fits = fit(strata, [PRODUCT], {"raw": ["vacc_type"]})
    return coef_table(s.reg.spark, fits, ["endpoint"])


@query
def l3_clogit_exact(s: Study) -> DataFrame:
    exposed = s.labelled.filter(F.col("vacc_type") != "uv")
    log_days = F.log(F.col("interval").cast("double"))
    expgr = selfcontrolled.EXPGR
    strata = strata_table(exposed, ["endpoint"], ["person_id"], [expgr], offset=log_days)
    return _fit_rows(s.reg.spark, fit(strata, [expgr], {"expgr": ["expgr"]}, "exact"), ["endpoint"])


@query
def l3_clogit_exact_risk(s: Study) -> DataFrame:
    """Risk time against all other time of exposed people, several events per person."""
    risk = Term("risk")
    exposed = s.labelled.filter(F.col("vacc_type") != "uv").withColumn(
        "risk", (F.col("expgr") == "Risk").cast("int")
    )
    log_days = F.log(F.col("interval").cast("double"))
    strata = strata_table(exposed, ["endpoint"], ["person_id"], [risk], offset=log_days)
    return coef_table(s.reg.spark, fit(strata, [risk], {"risk": ["risk"]}, "exact"), ["endpoint"])


@query
def l4_effect_table(s: Study) -> DataFrame:
    strata = strata_table(s.exposed_sets, ["endpoint"], ["case_id"], [PRODUCT])
    fits = fit(strata, [PRODUCT], {"raw": ["vacc_type"]})
    return effects.effect_table(coef_table(s.reg.spark, fits, ["endpoint"]))


@query
def l5_nested_models(s: Study) -> DataFrame:
    return effects.nested_models(s.model_sets, VS_TYPE, SIMD_LEVELS)


@query
def l5_nested_models_product(s: Study) -> DataFrame:
    return effects.nested_models(s.model_sets, PRODUCT, SIMD_LEVELS)


def _screen_sets(s: Study) -> tuple[DataFrame, list[Term]]:
    banded = status.cut_bands(s.full_sets, "bmi", BMI_BREAKS, "bmi_gp")
    labels = tuple(f"({a},{b}]" for a, b in zip(BMI_BREAKS, BMI_BREAKS[1:]))
    flagged = banded.withColumn("care_home", F.col("care_home").cast("int"))
    dated = status.cut_bands(status.days_since_first(flagged), "days", DAY_BREAKS, "days_gp")
    weeks = tuple(f"({a},{b}]" for a, b in zip(DAY_BREAKS, DAY_BREAKS[1:]))
    candidates = [
        Term("bmi_gp", labels),
        Term("days_gp", weeks),
        Term("hosp", HOSP_LEVELS),
        Term("positive_before_event", POSITIVE_LEVELS),
        *[Term(c) for c in ("age_year", "diag_chd", "diag_stroke", "care_home")],
    ]
    return dated, candidates


@query
def l6_screen_covariates(s: Study) -> DataFrame:
    sets, candidates = _screen_sets(s)
    return effects.screen_covariates(sets, PRODUCT, BASE, candidates)


@query
def l7_extra_models(s: Study) -> DataFrame:
    return effects.extra_models(s.full_sets, PRODUCT, STATUS, BASE)


@query
def l8_lr_test(s: Study) -> DataFrame:
    strata = strata_table(_ever_exposed(s), ["endpoint"], ["case_id"], [EXPOSED])
    fits = fit(strata, [EXPOSED], {"raw": ["exposed"], "none": []})
    return effects.lr_table(s.reg.spark, fits, "raw", "none", ["endpoint"])


@query
def l9_effectiveness(s: Study) -> DataFrame:
    coefs = coef_table(s.reg.spark, _exposed_fits(s), ["endpoint"])
    return effects.effectiveness(effects.effect_table(coefs, effects.Z_EXACT), "raw")


def _series(s: Study) -> DataFrame:
    recent = outcome.study_window(s.events, SERIES_START, s.latest, s.p.lag_days)
    adults = outcome.min_age(recent, s.p.min_age)
    return describe.daily_series(adults, outcome.study_end(adults), SERIES_START)


def _steps(s: Study) -> dict[str, date]:
    return {"post_pb": s.p.begin, "post_az": s.p.shift(28)}


@query
def l10_its_poisson(s: Study) -> DataFrame:
    return its_poisson(_series(s), _steps(s))[0]


@query
def l10_its_steps(s: Study) -> DataFrame:
    """The steps alone, without trend and months."""
    return its_poisson(_series(s), _steps(s), trend=False, months=False)[0]


@query
def l10_smooth_trend(s: Study) -> DataFrame:
    """A smooth trend and the steps."""
    return smooth_trend(_series(s), _steps(s))[0]


# self-controlled, interval and time-split forms


@query
def k1_sccs_windows(s: Study) -> DataFrame:
    return s.windows()


@query
def k2_sccs_windows_fixed(s: Study) -> DataFrame:
    return s.windows(fixed=True)


@query
def k3_split_intervals(s: Study) -> DataFrame:
    return s.intervals


@query
def k4_sccs_rates(s: Study) -> DataFrame:
    return sccs.interval_rates(s.intervals, ["endpoint", "vacc_type", "expgr"])


@query
def k4_time_split_rates(s: Study) -> DataFrame:
    return sccs.interval_rates(s.labelled, ["endpoint", "vt", "period", "expgr"])


@query
def k4_never_exposed_rates(s: Study) -> DataFrame:
    """Never-exposed people by calendar period."""
    never = s.labelled.filter(F.col("vacc_type") == "uv")
    return sccs.interval_rates(never, ["endpoint", "period"])


@query
def k4_level_rates(s: Study) -> DataFrame:
    """Levels, and product by level, over all periods."""
    return sccs.interval_rates(s.labelled, ["endpoint", "expgr", "vt_expgr"])


@query
def k5_sccs_fit(s: Study) -> DataFrame:
    return selfcontrolled.sccs_fit(s.exposed_windows, sccs.split_intervals(s.exposed_windows))


@query
def k6_time_split(s: Study) -> DataFrame:
    return sccs.time_split(s.spans, s.all_windows)


@query
def k7_event_days_in_window(s: Study) -> DataFrame:
    return sccs.event_days_in_window(s.all_windows, s.spans)


@query
def k8_censor_at(s: Study) -> DataFrame:
    split = sccs.time_split(s.spans, s.all_windows)
    return sccs.censor_at(split, outcome.one_death(s.reg.deaths()))


@query
def k9_time_split_unexposed(s: Study) -> DataFrame:
    return sccs.time_split(s.uv_spans, s.all_windows)


@query
def k10_label_sccs(s: Study) -> DataFrame:
    return s.labelled


@query
def k11_sccs_models(s: Study) -> DataFrame:
    return selfcontrolled.sccs_models(s.labelled)


@query
def k11_period_test(s: Study) -> DataFrame:
    """Likelihood-ratio test of the period in the joint time-split models."""
    return selfcontrolled.time_split_tests(s.labelled)


# self-controlled, person-day form


@query
def p1_date_spine(s: Study) -> DataFrame:
    """Consultations on each day of the spine."""
    spine = persondays.date_spine(s.reg.spark, s.p.begin, s.p.end, s.p.period_days)
    per_day = describe.count_by(s.consults, ["start_date"]).withColumnRenamed("start_date", "date")
    return spine.join(per_day, "date", "left").fillna(0, ["n"])


@query
def p2_person_days(s: Study) -> DataFrame:
    days = persondays.person_days(s.two_dose, s.p.begin, s.p.end, s.p.period_days)
    return days.groupBy("endpoint", "person_id", "period").agg(
        F.count("*").alias("n_days"),
        F.sum("days").alias("sum_days"),
        F.sum("days2").alias("sum_days2"),
        F.sum("days3").alias("sum_days3"),
    )


@query
def p3_dose_levels(s: Study) -> DataFrame:
    days = persondays.person_days(s.two_dose, s.p.begin, s.p.end, s.p.period_days)
    pb = persondays.dose_levels(days, "PB", "expgr")
    return describe.count_by(
        persondays.dose_levels(pb, "AZ", "expgr2"), ["endpoint", "person_id", "expgr", "expgr2"]
    )


@query
def p4_infection_levels(s: Study) -> DataFrame:
    days = persondays.person_days(s.two_dose, s.p.begin, s.p.end, s.p.period_days)
    return describe.count_by(
        persondays.infection_levels(days), ["endpoint", "person_id", "expgr3"]
    )


@query
def p5_until_death(s: Study) -> DataFrame:
    days = persondays.person_days(s.two_dose, s.p.begin, s.p.end, s.p.period_days)
    return (
        persondays.until_death(days)
        .groupBy("endpoint", "person_id")
        .agg(F.count("*").alias("n_days"), F.max("date").alias("last_day"))
    )


@query
def p6_attach_event(s: Study) -> DataFrame:
    days = persondays.person_days(s.two_dose, s.p.begin, s.p.end, s.p.period_days)
    marked = persondays.attach_event(persondays.until_death(days))
    return marked.groupBy("endpoint", "date").agg(
        F.count("*").alias("n"), F.sum("event").alias("events")
    )


@query
def p7_merge_levels(s: Study) -> DataFrame:
    merged = persondays.merge_levels(s.panel).groupBy("endpoint", "expgr", "expgr2", "expgr3", "event")
    return merged.agg(F.sum("interval").alias("n"))


@query
def p8_level_rates(s: Study) -> DataFrame:
    return persondays.level_rates(s.panel, s.n_periods)


@query
def p8_baseline_rates(s: Study) -> DataFrame:
    """All exposed people, those with one dose included."""
    return persondays.level_rates(s.exposed_panel, s.n_periods)


@query
def p8_merged_rates(s: Study) -> DataFrame:
    """The same with one risk level per dose and infection."""
    return persondays.level_rates(persondays.merge_levels(s.exposed_panel), s.n_periods, merged=True)


def _panel_terms(s: Study, names: Sequence[str], merged: bool = False) -> list[Term]:
    available = selfcontrolled.panel_terms(s.n_periods, merged)
    return [available[n] for n in names]


JOINT = ("expgr", "expgr2", "expgr3", "period")


@query
def p9_pd_model(s: Study) -> DataFrame:
    """One exposure and period; levels are counted over the people that the model is fitted on."""
    return selfcontrolled.pd_model(s.panel, _panel_terms(s, ["expgr", "period"]), s.n_periods, everyone=True)


@query
def p9_pd_model_binary(s: Study) -> DataFrame:
    """One exposure only: any risk day of either dose."""
    risk = F.col("expgr").rlike("[0-9]+-[0-9]+$") | F.col("expgr2").rlike("[0-9]+-[0-9]+$")
    panel = s.panel.withColumn("at_risk", risk.cast("int"))
    return selfcontrolled.pd_model(panel, [Term("at_risk")], s.n_periods, everyone=True)


@query
def p10_pd_model_joint(s: Study) -> DataFrame:
    return selfcontrolled.pd_model(s.panel, _panel_terms(s, JOINT), s.n_periods)


@query
def p11_rr_table(s: Study) -> DataFrame:
    merged = persondays.merge_levels(s.panel)
    table = selfcontrolled.pd_model(merged, _panel_terms(s, JOINT, True), s.n_periods, merged=True)
    return persondays.rr_table(table, 0.95).select(
        "endpoint", "term", "level", "event", "personday", "rate_week",
        "rate_ratio", "ci_lower", "ci_upper", "rr_ci", "p", "converged",
    )


@query
def p12_event_days(s: Study) -> DataFrame:
    return persondays.event_days(s.exposed_panel).select(
        "endpoint", "person_id", "date", "period", "expgr_combined", "expgr3"
    )


# follow-up, co-occurrence, description, report


@query
def f1_event_exposure(s: Study) -> DataFrame:
    return followup.event_exposure(s.adult_events, s.vacc)


@query
def f2_attach_death(s: Study) -> DataFrame:
    first = outcome.first_event(s.adult_events)
    return followup.attach_death(first, s.reg.deaths())


@query
def f3_attach_admissions(s: Study) -> DataFrame:
    first = outcome.first_event(s.adult_events)
    return followup.attach_admissions(first, s.reg.spells(), s.p.begin)


@query
def f4_admission_status(s: Study) -> DataFrame:
    first = outcome.first_event(s.adult_events)
    spells = followup.attach_admissions(first, s.reg.spells(), s.p.begin)
    return followup.admission_status(spells)


@query
def f5_first_spell(s: Study) -> DataFrame:
    first = outcome.first_event(s.adult_events)
    spells = followup.attach_admissions(first, s.reg.spells(), s.p.begin)
    return followup.first_spell(followup.admission_status(spells))


@query
def f6_hospital_summary(s: Study) -> DataFrame:
    return s.followed.select(
        "endpoint", "person_id", "vacc_type", "adm_status", "dis_status", "hosp_event"
    )


@query
def f7_incident_cases(s: Study) -> DataFrame:
    return followup.incident_cases(s.exposed_sets, ["sex", "zone", "vacc_type", "vs"])


@query
def f8_product_at_event(s: Study) -> DataFrame:
    return followup.product_at_event(s.first, s.vacc)


def _cooccurring(s: Study) -> DataFrame:
    def of(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col("endpoint") == name)

    return followup.cooccurrence(of(s.first, "any_a"), of(s.events, "any_b"))


@query
def o1_cooccurrence(s: Study) -> DataFrame:
    return _cooccurring(s)


@query
def o1_cooccurrence_status(s: Study) -> DataFrame:
    """Second outcome by exposure status at the first outcome."""
    banded = status.vacc_status(_cooccurring(s), s.vacc, s.cc_ends, "start_date")
    return describe.crosstab(
        status.product_at_index(banded), ["vacc_status", "vacc_type", "other_week"]
    )


@query
def q1_crosstab(s: Study) -> DataFrame:
    kept = describe.crosstab(s.followed, ["endpoint", "vacc_type", "days_adm"], keep_null=True)
    dropped = describe.crosstab(s.followed, ["endpoint", "vacc_type", "days_adm"])
    return kept.withColumn("nulls", F.lit("kept")).unionByName(
        dropped.withColumn("nulls", F.lit("dropped"))
    )


@query
def q2_freq_of_freq(s: Study) -> DataFrame:
    return describe.freq_of_freq(s.adult_events, "person_id")


@query
def q3_count_by(s: Study) -> DataFrame:
    days = F.datediff("start_date", "date_vacc_1")
    ev = s.windows().withColumn("days", days)
    return ev.groupBy("endpoint", "vacc_type", "days").agg(F.sum("n").alias("n"))


def _window_counts(s: Study, by: list[str]) -> DataFrame:
    return s.windows().groupBy("endpoint", *by).agg(F.sum("n").alias("n"))


@query
def q3_count_by_day(s: Study) -> DataFrame:
    return _window_counts(s, ["start_date"])


@query
def q3_count_by_age(s: Study) -> DataFrame:
    return _window_counts(s, ["age"])


@query
def q3_count_by_dose_date(s: Study) -> DataFrame:
    return _window_counts(s, ["vacc_type", "date_vacc_1"])


@query
def q4_daily_series(s: Study) -> DataFrame:
    return _series(s)


@query
def b1_report_table(s: Study) -> DataFrame:
    nested = effects.nested_models(s.model_sets, VS_TYPE, SIMD_LEVELS)
    return report.report_table(nested, "vs_type", hide_unfitted=True)


@query
def b1_report_product(s: Study) -> DataFrame:
    """By product, with every model shown."""
    return report.report_table(effects.nested_models(s.model_sets, PRODUCT, SIMD_LEVELS), "vacc_type")


@query
def b2_report_counts(s: Study) -> DataFrame:
    return report.report_counts(s.lost)
