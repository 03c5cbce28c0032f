from dataclasses import replace
from datetime import date

from pyspark.sql import functions as F

from sequela.operators import outcome
from sequela.plans.studies import Study
from sequela.sources.testdata import STUDY

D = date
EV = "endpoint string, person_id long, start_date date, code string, age int, sex string"


def _ev(spark, rows):
    return spark.createDataFrame([(*r, "F") for r in rows], EV)


def test_age_bands_at_their_edges(spark, collect):
    ages = [14, 15, 16, 19, 20, 39, 40, 59, 60, 79, 80, None]
    df = spark.createDataFrame([(a,) for a in ages], "age int")
    both = outcome.age_band(outcome.age_band(df, "age", "fine", "f"), "age", "coarse", "c")
    got = {r.age: (r.f, r.c) for r in both.collect()}
    assert got[14] == ("0-15", "0-15") and got[15] == ("15-19", "16-39")
    assert got[19] == ("15-19", "16-39") and got[20] == ("20-39", "16-39")
    assert got[39] == ("20-39", "16-39") and got[40] == ("40-59", "40-59")
    assert got[79] == ("60-79", "60-79") and got[80] == ("80+", "80+")
    assert got[None] == (None, None)


def test_seasons(spark, collect):
    df = spark.createDataFrame([(D(2020, m, 1),) for m in range(1, 13)], "start_date date")
    got = dict(collect(outcome.calendar_labels(df, D(2020, 9, 1)), "month", "season"))
    assert [got[m] for m in range(1, 13)] == ["P2"] * 3 + ["P3"] * 5 + ["P1"] * 3 + ["P2"]


def test_an_event_fans_out_to_all_its_endpoints(spark, collect):
    ev = _ev(spark, [("", 1, D(2021, 1, 1), "x", 40), ("", 2, D(2021, 1, 1), "y", 40),
                     ("", 3, D(2021, 1, 1), "z", 40)]).drop("endpoint")
    got = outcome.resolve_endpoints(ev, {"any": ("x", "y"), "x": ("x",), "none": ("q",)})
    assert collect(got, "endpoint", "person_id") == [("any", 1), ("any", 2), ("x", 1)]


def test_lag_uses_the_whole_register_and_end_the_endpoint(spark, collect):
    begin = D(2021, 1, 1)
    register = _ev(spark, [("a", 1, D(2021, 3, 1), "x", 40), ("b", 2, D(2021, 3, 31), "y", 40)])
    kept = outcome.study_window(register, begin, outcome.latest_start(register), 7)
    assert collect(kept, "person_id") == [(1,)]
    assert collect(outcome.study_end(kept)) == [("a", D(2021, 3, 1))]


def test_history_equals_the_step_by_step_flow(spark, collect):
    begin = D(2021, 1, 1)
    ev = _ev(
        spark,
        [
            ("a", 1, D(2020, 12, 31), "x", 40), ("a", 1, D(2021, 2, 1), "x", 40),
            ("a", 2, D(2020, 1, 1), "x", 40), ("a", 2, D(2021, 2, 2), "y", 40),
            ("a", 2, D(2021, 2, 2), "x", 40), ("a", 3, D(2021, 1, 1), "x", 15),
            ("a", 3, D(2021, 1, 9), "x", 16), ("a", 4, D(2021, 3, 25), "x", 50),
            ("b", 1, D(2021, 2, 1), "x", 40), ("b", 9, D(2021, 3, 31), "x", 40),
        ],
    )
    latest = outcome.latest_start(ev)
    for lookback in (None, 180):
        prior = outcome.prior_events(ev, begin, lookback)
        steps = outcome.first_event(
            outcome.min_age(outcome.washout(outcome.study_window(ev, begin, latest), prior))
        )
        fused = outcome.first_incident(outcome.person_history(ev, begin, latest, lookback=lookback))
        assert collect(steps) == collect(fused)
    # bounded wash-out keeps person 2, whose first tie goes to the smaller code
    assert ("a", 2, D(2021, 2, 2), "x", 40, "F") in collect(fused)


def test_attrition(spark, collect):
    ev = _ev(spark, [("a", 1, D(2021, 1, 1), "x", 40), ("a", 1, D(2021, 1, 2), "x", 40),
                     ("a", 2, D(2021, 1, 1), "x", 40)])
    cohort = spark.createDataFrame([(1,)], "person_id long")
    lost = spark.createDataFrame([("a", 1)], "endpoint string, case_id long")
    prior = ev.limit(0)
    assert collect(outcome.attrition(ev, prior, cohort, lost)) == [("a", 3, 2, 1, 1)]
    washed = outcome.attrition(ev, ev.filter("person_id = 1"), cohort, lost)
    assert collect(washed, "total_unique_events") == [(1,)]
    none = outcome.attrition(ev, prior, cohort, lost.filter(F.lit(False)))
    assert collect(none, "no_match") == [(0,)]


def test_analysis_set_takes_the_first_test_in_the_window(spark, collect):
    ev = _ev(spark, [("a", 1, D(2021, 2, 1), "x", 40), ("a", 2, D(2021, 2, 1), "x", 40)])
    vacc = spark.createDataFrame([(1, "PB")], "person_id long, vacc_type string")
    deaths = spark.createDataFrame(
        [(1, D(2021, 9, 1)), (1, D(2021, 8, 1))], "person_id long, death_date date"
    )
    tests = spark.createDataFrame(
        [(1, D(2020, 1, 1)), (1, D(2021, 5, 1)), (1, D(2021, 4, 1))],
        "person_id long, specimen_date date",
    )
    got = outcome.analysis_set(ev, vacc, deaths, tests, D(2021, 1, 1), D(2021, 12, 31))
    assert collect(got, "person_id", "death_date", "specimen_date") == [
        (1, D(2021, 8, 1), D(2021, 4, 1))
    ]


def test_the_last_day_is_of_the_whole_register(spark, collect):
    """Rows of other codes are not staged, but their days count for the reporting lag."""
    ev = spark.createDataFrame(
        [(1, D(2021, 1, 1), "a"), (2, D(2021, 1, 20), "b"), (3, D(2021, 2, 1), "other"), (4, D(2021, 6, 1), "a"), (5, D(2021, 1, 5), None)],
        "person_id long, start_date date, code string",
    )

    class Register:
        def consultations(self):
            return ev

    p = replace(STUDY, extract=D(2021, 3, 1), endpoint_names=("x", "y"), endpoint_groups={"x": ("a", "b"), "y": ("b",)})
    study = Study(Register(), p)
    coded, latest = study.coded
    assert latest == D(2021, 2, 1) and collect(coded, "person_id") == [(1,), (2,)]
    assert collect(study.events, "endpoint", "person_id") == [("x", 1), ("x", 2), ("y", 2)]
    none = Study(type("Empty", (), {"consultations": lambda self: ev.limit(0)})(), p)
    assert none.coded[1] is None and none.in_window.count() == 0
