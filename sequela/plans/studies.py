"""The study flows: registers in, analysis tables out, all endpoints in one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sequela.config import StudyParams
from sequela.operators import (
    exposure,
    followup,
    matching,
    outcome,
    persondays,
    rates,
    sccs,
    status,
)
from sequela.sources.registers import positive_test_days, positive_tests
from sequela.sources.stages import stage, tasks
from sequela.sources.testdata import PRODUCT_RULES, PRODUCTS, STUDY, Registers

COVARIATES = ("age_year", "n_risk_gps", "n_tests_gp", "simd", "bmi", "diag_chd", "diag_stroke")


@dataclass(frozen=True)
class Study:
    """Tables of one study over one set of registers, built when they are first asked for.

    Tables that several flows read are staged: asking for them, or for what is built on
    them, runs Spark jobs.
    """

    reg: Registers
    p: StudyParams = STUDY

    @classmethod
    def over(cls, spark: SparkSession, folder: str, **changes) -> Study:
        return cls(Registers(spark, folder), replace(STUDY, **changes))

    # exposures

    @cached_property
    def records(self) -> DataFrame:
        raw = exposure.recorded_since(self.reg.vaccination_records(), self.p.begin)
        return exposure.normalise_dose(exposure.classify_product(raw, PRODUCT_RULES))

    @cached_property
    def wide(self) -> DataFrame:
        return exposure.widen_doses(self.records)

    @cached_property
    def vacc(self) -> DataFrame:
        kept = exposure.drop_inconsistent(self.wide, PRODUCTS)
        return exposure.min_gap(exposure.collapse_same_day(kept), self.p.min_gap_days)

    @cached_property
    def doses(self) -> DataFrame:
        """The wide table, staged for flows that join it more than once."""
        return stage(self.vacc)

    # outcomes

    @cached_property
    def consults(self) -> DataFrame:
        """The cleaned register, as it is read."""
        return outcome.trim_future(self.reg.consultations(), today=self.p.extract)

    @cached_property
    def coded(self) -> tuple[DataFrame, date | None]:
        """The cleaned register's rows of listed codes, staged, and the last day of all its rows.

        The day is observed while the rows are written, so the register is read once and only what
        the endpoints need is written.
        """
        seen = Observation("register")
        whole = self.consults.observe(seen, F.max("start_date").alias("latest"))
        listed = stage(outcome.with_listed_codes(whole, self.p.endpoint_codes()))
        return listed, seen.get["latest"]

    @cached_property
    def latest(self) -> Column:
        return F.lit(self.coded[1]).cast("date")

    @cached_property
    def events(self) -> DataFrame:
        return outcome.resolve_endpoints(self.coded[0], self.p.endpoint_codes())

    @cached_property
    def in_window(self) -> DataFrame:
        return outcome.study_window(self.events, self.p.begin, self.latest, self.p.lag_days)

    @cached_property
    def prior(self) -> DataFrame:
        return outcome.prior_events(self.events, self.p.begin, self.p.lookback_days)

    @cached_property
    def recent_prior(self) -> DataFrame:
        """Prior events of the dose-2 study, which looks back a fixed time."""
        return outcome.prior_events(self.events, self.p.begin, self.p.dose2_lookback_days)

    @cached_property
    def incident(self) -> DataFrame:
        """Study events of adults without a prior event; later events included."""
        return outcome.min_age(outcome.washout(self.in_window, self.prior), self.p.min_age)

    @cached_property
    def history(self) -> DataFrame:
        return outcome.person_history(
            self.events, self.p.begin, self.latest,
            self.p.lag_days, self.p.lookback_days, self.p.min_age,
        )

    @cached_property
    def staged_history(self) -> DataFrame:
        return stage(self.history)

    @cached_property
    def first(self) -> DataFrame:
        """First incident event per endpoint and person."""
        return outcome.first_incident(self.staged_history)

    @cached_property
    def prior_people(self) -> DataFrame:
        return self.staged_history.filter("had_prior")

    # observed and expected

    @cached_property
    def oe_events(self) -> DataFrame:
        return stage(self.incident.select("endpoint", "person_id", "start_date"))

    @cached_property
    def oe_ends(self) -> DataFrame:
        return outcome.study_end(self.oe_events)

    @cached_property
    def post(self) -> DataFrame:
        return rates.first_post_exposure(self.oe_events, self.doses, self.oe_ends)

    @cached_property
    def hist(self) -> DataFrame:
        return rates.historical_events(self.events, self.p)

    @cached_property
    def oe(self) -> DataFrame:
        cells = rates.followup_cells(self.doses, self.reg.cohort(), self.post, self.oe_ends)
        population = rates.weighted_population(self.reg.cohort())
        return rates.expected_events(
            rates.person_time(cells), self.hist, population, self.p.hist_days
        )

    @cached_property
    def oe_cells(self) -> DataFrame:
        """Observed and expected per endpoint, product and age band."""
        return stage(rates.oe_summary(self.oe))

    # matched case-control

    def cohort_at(self, day: date) -> DataFrame:
        """Cohort with matching ages, without people who died before ``day``."""
        deaths = outcome.one_death(self.reg.deaths())
        return matching.alive_at(matching.matching_age(self.reg.cohort()), deaths, day)

    @cached_property
    def alive(self) -> DataFrame:
        return self.cohort_at(self.p.begin)

    @cached_property
    def late_cohort(self) -> DataFrame:
        """The cohort as a linkage 90 days into the study finds it."""
        return self.cohort_at(self.p.shift(90))

    @cached_property
    def lost(self) -> DataFrame:
        """Events, people, people without a cohort row and cases without a control."""
        adults = outcome.min_age(self.in_window, self.p.min_age)
        unmatched = matching.unmatched(self.cases, self.matched)
        return outcome.attrition(adults, self.prior, self.late_cohort, unmatched)

    @cached_property
    def cases(self) -> DataFrame:
        return matching.linked_cases(self.first, self.alive, self.p.match_keys)

    @cached_property
    def pool(self) -> DataFrame:
        return matching.control_pool(
            self.alive, self.prior_people, self.cases, list(self.p.endpoint_codes())
        )

    @cached_property
    def ranked(self) -> DataFrame:
        return stage(matching.number_pool(self.pool, self.p.match_keys, self.p.salts))

    @cached_property
    def matched(self) -> DataFrame:
        return matching.sample_controls(
            self.ranked, self.p.match_keys, self.p.controls_per_case, self.p.seed
        )

    @cached_property
    def sets(self) -> DataFrame:
        return stage(matching.matched_sets(self.matched, self.p.match_keys))

    @cached_property
    def cc_ends(self) -> DataFrame:
        return outcome.study_end(self.first)

    @cached_property
    def exposed_sets(self) -> DataFrame:
        """Matched sets with exposure status at the index date."""
        banded = status.vacc_status(self.sets, self.vacc, self.cc_ends)
        return stage(status.collapse_status(status.product_at_index(banded)))

    @cached_property
    def model_sets(self) -> DataFrame:
        """Matched sets with exposure status and cohort covariates."""
        return self.exposed_sets.join(
            self.reg.cohort().select("person_id", *COVARIATES), "person_id", "left"
        )

    @cached_property
    def full_sets(self) -> DataFrame:
        """Matched sets with every status and covariate."""
        with_hosp = status.hospital_status(
            self.exposed_sets, self.reg.spells(), self.p.begin, self.p.hospital_lookback
        )
        tested = status.test_timing(with_hosp, positive_tests(self.reg.tests(), self.p.begin))
        return status.attach_covariates(
            tested, self.reg.cohort(), self.reg.household(), self.first, COVARIATES
        )

    # self-controlled, intervals and time split

    @cached_property
    def sccs_study(self) -> DataFrame:
        """Adult events from the longest look-back before the study on."""
        recent = outcome.study_window(
            self.events, self.p.shift(-self.p.pre_from), self.latest, self.p.lag_days
        )
        return outcome.min_age(recent, self.p.min_age)

    @cached_property
    def sccs_rows(self) -> DataFrame:
        return stage(sccs.event_rows(self.sccs_study))

    @cached_property
    def sccs_ends(self) -> DataFrame:
        return outcome.study_end(self.sccs_rows)

    def windows(self, include_uv: bool = False, fixed: bool = False) -> DataFrame:
        joined = sccs.sccs_events(self.sccs_rows, self.vacc, self.sccs_ends, include_uv)
        return sccs.sccs_windows(joined, self.p, fixed)

    @cached_property
    def all_windows(self) -> DataFrame:
        """Windows of exposed people, and never-exposed people beside them."""
        return stage(self.windows(include_uv=True))

    @cached_property
    def exposed_windows(self) -> DataFrame:
        return self.all_windows.filter(F.col("vacc_type") != "uv")

    @cached_property
    def intervals(self) -> DataFrame:
        return sccs.split_intervals(self.windows())

    @cached_property
    def cuts(self) -> DataFrame:
        return sccs.calendar_cuts(self.all_windows)

    @cached_property
    def spans(self) -> DataFrame:
        return sccs.exposed_spans(self.all_windows, self.cuts)

    @cached_property
    def uv_spans(self) -> DataFrame:
        return sccs.unexposed_spans(self.all_windows, self.cuts)

    @cached_property
    def labelled(self) -> DataFrame:
        return sccs.label_sccs(
            sccs.time_split(self.spans, self.all_windows),
            sccs.time_split(self.uv_spans, self.all_windows),
        )

    # self-controlled, person-days

    @cached_property
    def dose2_events(self) -> DataFrame:
        """First event in the study dates per person, without a recent prior event."""
        start = F.col("start_date")
        dated = self.events.filter(
            (start >= F.lit(self.p.begin)) & (start <= F.lit(self.p.end))
        )
        return outcome.washout(outcome.first_event(dated), self.recent_prior)

    @cached_property
    def analysis(self) -> DataFrame:
        joined = outcome.analysis_set(
            self.dose2_events,
            exposure.exposure_until(self.doses, self.p.end),
            self.reg.deaths(),
            positive_test_days(self.reg.tests()),
            self.p.begin,
            self.p.end,
        )
        return outcome.min_age(joined, self.p.min_age)

    @cached_property
    def two_dose(self) -> DataFrame:
        return exposure.require_dose2(self.analysis)

    @cached_property
    def staged_analysis(self) -> DataFrame:
        return stage(self.analysis)

    def panel_of(self, people: DataFrame) -> DataFrame:
        # a row becomes some seventy pieces, which later groupings by person find in place
        dealt = people.repartition(tasks(self.reg.spark), "endpoint", "person_id")
        return persondays.full_pieces(dealt, self.p.begin, self.p.end, self.p.period_days)

    @cached_property
    def panel(self) -> DataFrame:
        """Pieces of the two-dose people's time; cut anew by each reader, from staged people."""
        return self.panel_of(exposure.require_dose2(self.staged_analysis))

    @cached_property
    def exposed_panel(self) -> DataFrame:
        """Pieces of all exposed people's time, those with one dose included."""
        return self.panel_of(self.staged_analysis)

    @property
    def n_periods(self) -> int:
        return -(-((self.p.end - self.p.begin).days + 1) // self.p.period_days)

    # follow-up

    @cached_property
    def adult_events(self) -> DataFrame:
        """Adult events of the study window, prior events allowed."""
        return outcome.min_age(self.in_window, self.p.min_age)

    @cached_property
    def followed(self) -> DataFrame:
        """First events with exposure, death, first hospital spell and its summary."""
        exposed = followup.event_exposure(self.adult_events, self.vacc)
        died = followup.attach_death(exposed, self.reg.deaths())
        spells = followup.attach_admissions(died, self.reg.spells(), self.p.begin)
        return followup.hospital_summary(followup.first_spell(followup.admission_status(spells)))
