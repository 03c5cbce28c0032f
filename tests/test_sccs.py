from datetime import date, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sequela.operators import sccs
from sequela.sources.testdata import STUDY

D, T = date, timedelta
VACC = D(1998, 5, 1)
EV = "endpoint string, person_id long, start_date date, code string, age int, sex string"
WIDE = "person_id long, vacc_type string, date_vacc_1 date, vacc_type_2 string, date_vacc_2 date"


def _windows(spark, events, end, vacc=VACC, include_uv=False, fixed=False):
    ev = spark.createDataFrame([("a", p, d, "x", 40, "F") for p, d in events], EV)
    doses = spark.createDataFrame([(1, "PB", vacc, None, None)], WIDE)
    ends = spark.createDataFrame([("a", end)], "endpoint string, a_end date")
    joined = sccs.sccs_events(sccs.event_rows(ev), doses, ends, include_uv)
    return sccs.sccs_windows(joined, STUDY, fixed)


def test_intervals_of_each_day(spark):
    days = [-104, -103, -14, -13, 0, 1, 28, 29, 119]
    win = _windows(spark, [(1, VACC + T(d)) for d in [-105, *days, 120]], D(1999, 1, 1))
    got = {}
    for r in sccs.split_intervals(win).collect():
        if r.event:
            got[(r.start_date - VACC).days] = r.expgr
    # day 0 is clearance, the first day of the window and days past the risk end have no interval
    assert got == {
        -103: "Pre.Vacc", -14: "Pre.Vacc", -13: "Clearance", 0: "Clearance", 1: "Risk", 28: "Risk",
    }
    # rows outside 104 days before to 119 after are gone, the others count person-time
    assert win.count() == len(days)
    rates = {r.expgr: r for r in sccs.interval_rates(sccs.split_intervals(win), ["expgr"]).collect()}
    assert [rates[k].interval for k in ("Pre.Vacc", "Clearance", "Risk")] == [90 * 9, 14 * 9, 28 * 9]


def test_two_events_count_person_time_twice(spark):
    win = _windows(spark, [(1, VACC - T(50)), (1, VACC + T(3)), (1, VACC + T(3))], D(1999, 1, 1))
    rates = {r.expgr: r for r in sccs.interval_rates(sccs.split_intervals(win), ["expgr"]).collect()}
    assert rates["Risk"].event == 2 and rates["Risk"].interval == 28 * 3


def test_clipping_at_the_study_end(spark):
    win = _windows(spark, [(1, VACC - T(50))], VACC + T(10)).collect()[0]
    assert win.risk_end == win.post_start == win.post_end == VACC + T(10)
    assert _windows(spark, [(1, VACC - T(50))], VACC).count() == 0
    fixed = _windows(spark, [(1, VACC - T(50))], VACC - T(5), fixed=True).collect()[0]
    assert fixed.risk_start == VACC - T(5) and fixed.pre_start == STUDY.shift(-104)


def test_unexposed_people_keep_null_windows(spark):
    win = _windows(spark, [(1, VACC), (2, VACC)], D(1999, 1, 1), include_uv=True)
    got = {r.person_id: (r.vacc_type, r.pre_start) for r in win.collect()}
    assert got == {1: ("PB", VACC - T(104)), 2: ("uv", None)}


def _split(spark, events, deaths=()):
    win = _windows(spark, events, D(1998, 12, 1), include_uv=True)
    cuts = sccs.calendar_cuts(win)
    iv = sccs.time_split(sccs.exposed_spans(win, cuts), win)
    uv = sccs.time_split(sccs.unexposed_spans(win, cuts), win)
    if deaths:
        df = spark.createDataFrame(list(deaths), "person_id long, death_date date")
        iv, uv = sccs.censor_at(iv, df), sccs.censor_at(uv, df)
    return iv, uv


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-104, 119), min_size=1, max_size=8))
def test_split_tiles_the_span_and_keeps_events_inside(spark, offsets):
    events = [(1, VACC + T(d)) for d in offsets]
    rows = sorted(_split(spark, events)[0].collect(), key=lambda r: r.t_start)
    assert rows[0].t_start == VACC - T(104) and rows[-1].t_stop == VACC + T(28)
    assert all(a.t_stop == b.t_start for a, b in zip(rows, rows[1:]))
    assert all(r.t_start < r.t_stop for r in rows)
    assert sum(r.event for r in rows) == len({d for d in offsets if -104 < d <= 28})
    for r in rows:
        day = (r.t_start - VACC).days
        assert r.expgr == (day >= -14) + (day >= 0)


def test_death_ends_person_time(spark):
    events = [(1, VACC + T(5)), (1, VACC + T(9)), (2, D(1998, 3, 1))]
    iv, uv = _split(spark, events, [(1, VACC + T(5)), (2, D(1997, 1, 1))])
    rows = sorted(iv.collect(), key=lambda r: r.t_start)
    assert rows[-1].t_stop == VACC + T(5) and rows[-1].event == 1
    assert sum(r.event for r in rows) == 1 and uv.count() == 0
    earlier = _split(spark, events, [(1, VACC + T(4))])[0].collect()
    assert sum(r.event for r in earlier) == 0


def test_labels(spark):
    iv, uv = _split(spark, [(1, VACC), (2, VACC)])
    rows = sccs.label_sccs(iv, uv).collect()
    assert {(r.expgr, r.vt, r.vt_expgr) for r in rows} == {
        ("Pre.Vacc", "uv", "Pre.Vacc"), ("Clearance", "PB", "PB_Clearance"), ("Risk", "PB", "PB_Risk"),
    }
    assert all(r.period2 == max(r.period - 1, 0) for r in rows)
    assert all(r.interval == (r.t_stop - r.t_start).days for r in rows)


def test_spans_are_dealt_by_rows_not_by_bytes(spark, monkeypatch):
    monkeypatch.setattr("sequela.sources.stages.tasks", lambda spark: 1)
    monkeypatch.setattr("sequela.sources.stages.tasks_for.__defaults__", (100,))
    rows = spark.range(2000).selectExpr("concat('e', id div 5000) endpoint", "id person_id", "'uv' vacc_type", "date'1998-01-01' start_date")
    cuts = spark.sql("select 'e0' endpoint, date'1997-01-01' cal_start, date'1999-01-01' a_end, array(date'1998-01-01') periods")
    spans = sccs.unexposed_spans(rows, cuts)
    assert spans.rdd.getNumPartitions() == 20 and spans.count() == 2000
    assert sccs.event_days_in_window(rows, spans).rdd.getNumPartitions() == 20
