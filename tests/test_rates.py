import math
from datetime import date, timedelta

import numpy as np
import pytest

from sequela.functions.stats import chi2_tail, gamma_p, poisson_limits, poisson_quantiles
from sequela.operators import rates
from sequela.sources.testdata import STUDY

D, T = date, timedelta
END = D(1998, 12, 1)


def _tables(spark):
    vacc = spark.createDataFrame(
        [
            (1, "PB", END - T(100), None, None), (2, "PB", END - T(7), None, None),
            (3, "PB", END - T(8), None, None), (4, "AZ", END, None, None),
            (5, "AZ", END - T(30), None, None), (6, "AZ", END - T(30), None, None),
        ],
        "person_id long, vacc_type string, date_vacc_1 date, vacc_type_2 string, date_vacc_2 date",
    )
    cohort = spark.createDataFrame(
        [(i, 50) for i in range(1, 6)], "person_id long, age_year int"
    )
    ends = spark.createDataFrame([("a", END)], "endpoint string, a_end date")
    ev = spark.createDataFrame(
        [("a", 1, END - T(100)), ("a", 1, END - T(93)), ("a", 1, END - T(50)),
         ("a", 5, END - T(2)), ("a", 4, END)],
        "endpoint string, person_id long, start_date date",
    )
    return vacc, cohort, ends, ev


def test_day_0_is_not_after_exposure_and_the_first_event_counts(spark, collect):
    vacc, _, ends, ev = _tables(spark)
    post = rates.first_post_exposure(ev, vacc, ends)
    assert collect(post, "person_id", "days_1", "days_07", "days_28") == [(1, 7, 1, 1), (5, 28, 0, 1)]


def test_bands_sum_to_follow_up(spark, collect):
    vacc, cohort, ends, ev = _tables(spark)
    post = rates.first_post_exposure(ev, vacc, ends)
    followed = rates.exposure_followup(vacc, cohort, post, ends)
    assert collect(followed, "person_id", "days_1", "event", "age_grp") == [
        (1, 7, 1, "40-59"), (2, 7, 0, "40-59"), (3, 8, 0, "40-59"),
        (5, 28, 1, "40-59"), (6, 30, 0, None),
    ]
    bands = rates.person_time(followed)
    got = {(r.vacc_type, r.period): (r.n, r.event, r.pdays) for r in bands.collect()}
    assert got == {
        ("PB", "0-7"): (3, 1, 21), ("PB", "8-14"): (1, 0, 1), ("AZ", "0-7"): (1, 0, 7),
        ("AZ", "8-14"): (1, 0, 7), ("AZ", "15-21"): (1, 0, 7), ("AZ", "22-28"): (1, 1, 7),
    }
    cells = rates.followup_cells(vacc, cohort, post, ends)
    assert collect(rates.person_time(cells)) == collect(bands)


def test_history_window_has_29_days_and_drops_earlier_events(spark, collect):
    lo, hi = STUDY.shift(-68), STUDY.shift(-40)
    ev = spark.createDataFrame(
        [
            ("a", 1, lo, "x", 20), ("a", 2, hi, "x", 20), ("a", 3, hi + T(1), "x", 20),
            ("a", 4, lo - T(1), "x", 20), ("a", 4, lo, "x", 20), ("a", 5, lo, "x", 15),
            ("a", 1, hi, "x", 20),
        ],
        "endpoint string, person_id long, start_date date, code string, age int",
    )
    assert (hi - lo).days + 1 == 29
    assert collect(rates.historical_events(ev, STUDY)) == [("a", "16-39", 2)]


def test_missing_history_expects_nothing(spark):
    days = spark.createDataFrame(
        [("a", "PB", "40-59", "0-7", 10, 2, 70), ("a", "PB", "80+", "0-7", 10, 1, 70)],
        "endpoint string, vacc_type string, age_grp string, period string, n long, event long, pdays long",
    )
    hist = spark.createDataFrame([("a", "40-59", 4)], "endpoint string, age_grp string, events_pre long")
    pop = spark.createDataFrame([("40-59", 100.0), ("80+", 7.0)], "age_grp string, population double")
    oe = rates.expected_events(days, hist, pop)
    got = {r.age_grp: r for r in rates.oe_summary(oe).collect()}
    assert got["40-59"].exp_events == pytest.approx(70 * (4 / 28) / 100)
    assert got["80+"].population == 1 and got["80+"].exp_events == 0 and got["80+"].data_oe is None
    sim = rates.simulate_oe(rates.oe_summary(oe), 50, "s", chunk=20)
    rows = sim.collect()
    assert len(rows) == 100 and sorted({r.sim for r in rows}) == list(range(1, 51))
    assert all(r.o_e == 1 and r.sim_exp_pre == 0 for r in rows if r.age_grp == "80+")
    assert all(r.sim_obs_pre >= 0.5 for r in rows)
    table = rates.oe_table(
        rates.oe_summary(oe), rates.oe_interval(sim, ["endpoint", "vacc_type", "age_grp"]),
        rates.oe_interval_overall(sim),
    )
    ages = {r.age_grp: r for r in table.collect()}
    assert ages["80+"].data_oe == 1 and ages["All Ages"].event == 3 and ages["All Ages"].n == 20


def test_simulation_does_not_depend_on_partitions(spark, collect):
    cells = spark.createDataFrame(
        [("a", "PB", "40-59", 9, 3.0, 700, 50.0)],
        "endpoint string, vacc_type string, age_grp string, event long, events_pre double, pdays long, population double",
    )
    one = rates.simulate_oe(cells, 200, "s", chunk=200).select("sim", "sim_obs", "sim_obs_pre")
    assert collect(one) == collect(rates.simulate_oe(cells, 200, "s", chunk=7).select(*one.columns))
    draws = [r.sim_obs for r in rates.simulate_oe(cells, 4000, "s").collect()]
    assert np.mean(draws) == pytest.approx(9, abs=0.2) and np.var(draws) == pytest.approx(9, abs=0.9)


def test_poisson_limits_solve_the_tails():
    assert poisson_limits(0) == (0.0, pytest.approx(-math.log(0.025)))
    for x in (1, 2, 10, 75, 400, 20_000):
        lo, hi = poisson_limits(x)
        assert gamma_p(x, lo) == pytest.approx(0.025, abs=1e-9)
        assert 1 - gamma_p(x + 1, hi) == pytest.approx(0.025, abs=1e-9)
    # published limits for ten events
    assert poisson_limits(10) == (pytest.approx(4.795, abs=1e-3), pytest.approx(18.390, abs=1e-3))


def test_poisson_quantiles_equal_the_definition():
    u = np.linspace(0, 0.999999, 200)
    for m in (0.0, 0.3, 4.0, 50.0, 1e6):
        got = poisson_quantiles(u, np.full(len(u), m))
        if m == 0:
            assert not got.any()
        for x, k in zip(u[1:], got[1:]):
            if m > 0:
                assert 1 - gamma_p(k + 1, m) >= x - 1e-9
                assert k == 0 or 1 - gamma_p(k, m) <= x + 1e-9


def test_chi_square_tail():
    assert chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert chi2_tail(9.487729036781154, 4) == pytest.approx(0.05)
    assert chi2_tail(0, 3) == 1


def test_dose_2_incidence(spark):
    vacc = spark.createDataFrame(
        [(i, "PB", D(1998, 1, 1), "PB", D(1998, 3, 1)) for i in range(1, 5)]
        + [(5, "PB", D(1998, 1, 1), "PB", D(1998, 12, 9)), (6, "PB", D(1998, 1, 1), None, None)],
        "person_id long, vacc_type string, date_vacc_1 date, vacc_type_2 string, date_vacc_2 date",
    )
    deaths = spark.createDataFrame([(2, D(1998, 3, 10))], "person_id long, death_date date")
    ev = spark.createDataFrame(
        [("a", 1, D(1998, 3, 1), D(1998, 3, 1), None), ("a", 2, D(1998, 3, 28), D(1998, 3, 1), D(1998, 3, 10)),
         ("a", 3, D(1998, 3, 29), D(1998, 3, 1), None), ("a", 4, D(1998, 2, 27), D(1998, 3, 1), None)],
        "endpoint string, person_id long, start_date date, date_vacc_2 date, death_date date",
    )
    end = D(1998, 12, 8)
    got = {r.follow_up: r for r in rates.dose2_incidence(ev, vacc, deaths, end).collect()}
    assert got["all"].n_events == 2 and got["28 days"].n_events == 1 and got["all"].doses == 4
    assert got["all"].rate == 50_000.0 and got["28 days"].rate_ci.startswith("25000 (")
    crude = {r.follow_up: r for r in rates.crude_rate(ev, vacc, deaths, end).collect()}
    whole = (end - D(1998, 3, 1)).days + 1
    assert crude["all"].pdays == 3 * whole + 10 and crude["28 days"].pdays == 3 * 28 + 10
