import math
from datetime import date, timedelta

import pytest

from sequela.operators import describe, followup

D, T = date, timedelta
DAY = D(1998, 6, 1)
EV = "endpoint string, person_id long, start_date date, code string, age int, sex string"


def _ev(spark, rows, endpoint="a"):
    return spark.createDataFrame([(endpoint, p, d, "x", 40, "F") for p, d in rows], EV)


def test_day_0_counts_as_exposed(spark):
    vacc = spark.createDataFrame(
        [(1, "PB", DAY), (2, "PB", DAY + T(1)), (3, "AZ", DAY - T(9))],
        "person_id long, vacc_type string, date_vacc_1 date",
    )
    ev = _ev(spark, [(i, DAY) for i in (1, 2, 3, 4)] + [(1, DAY + T(5))])
    got = {r.person_id: (r.vacc_type, r.days_vacc_event) for r in followup.event_exposure(ev, vacc).collect()}
    assert got == {1: ("PB", 0), 2: ("uv", 0), 3: ("AZ", 9), 4: ("uv", 0)}


def test_admissions(spark):
    spells = spark.createDataFrame(
        [
            (1, DAY - T(8), None, True), (2, DAY - T(7), DAY - T(1), True),
            (3, DAY + T(7), DAY + T(9), True), (4, DAY + T(8), DAY + T(9), True),
            (5, DAY - T(30), DAY + T(2), True), (6, DAY, DAY + T(1), False),
            (7, D(1997, 1, 1), D(1998, 1, 1), True), (8, DAY + T(3), None, True),
            (8, DAY - T(2), DAY + T(1), True),
        ],
        "person_id long, admission_date date, discharge_date date, emergency boolean",
    )
    ev = _ev(spark, [(i, DAY) for i in range(1, 9)])
    joined = followup.attach_admissions(ev, spells, D(1998, 1, 1))
    assert joined.count() == 9
    first = followup.hospital_summary(followup.first_spell(followup.admission_status(joined)))
    got = {r.person_id: (r.days_adm, r.adm_status, r.dis_status, r.hosp_event) for r in first.collect()}
    assert got == {
        1: (None, "adm_before_event", "in_hosp", "other"),
        2: (0, "adm_on_event", "dis_before_event", "in_hosp_at_event"),
        3: (7, "adm_on_event", "dis_on_after_event", "in_hosp_at_event"),
        4: (8, "adm_after_event", "dis_on_after_event", "other"),
        5: (None, "adm_before_event", "dis_on_after_event", "in_hosp_at_event"),
        6: (None, "no_adm", "no_adm", "no_adm"),
        7: (None, "no_adm", "no_adm", "no_adm"),
        8: (0, "adm_on_event", "dis_on_after_event", "in_hosp_at_event"),
    }


def test_weeks_to_the_other_event(spark):
    gaps = {1: -1, 2: 0, 3: 7, 4: 8, 5: 14, 6: 15, 7: 21, 8: 22}
    primary = _ev(spark, [(i, DAY) for i in [*gaps, 9]])
    other = _ev(spark, [(i, DAY + T(g)) for i, g in gaps.items()] + [(1, DAY + T(5))], "b")
    got = {r.person_id: r.other_week for r in followup.cooccurrence(primary, other).collect()}
    assert got == {
        1: "before", 2: "other_1_week", 3: "other_1_week", 4: "other_2_weeks", 5: "other_2_weeks",
        6: "other_3_weeks", 7: "other_3_weeks", 8: "other_later", 9: "no_other_event",
    }


def test_counts(spark, collect):
    df = spark.createDataFrame(
        [("a", 1, "x"), ("a", 1, None), ("a", 2, "x"), ("a", 3, "x")], "endpoint string, id int, v string"
    )
    assert collect(describe.freq_of_freq(df, "id")) == [("a", 1, 2), ("a", 2, 1)]
    assert collect(describe.crosstab(df, ["v"])) == [("x", 3)]
    assert describe.crosstab(df, ["v"], keep_null=True).count() == 2


def test_series_fills_empty_days(spark, collect):
    ev = _ev(spark, [(1, DAY), (2, DAY), (3, DAY + T(2))])
    ends = spark.createDataFrame([("a", DAY + T(2))], "endpoint string, a_end date")
    got = collect(describe.daily_series(ev, ends, DAY - T(1)), "days", "n", "month")
    assert got == [(0, 0, "May"), (1, 2, "June"), (2, 0, "June"), (3, 1, "June")]


def test_a_person_with_very_many_spells_keeps_them_all(spark):
    spells = spark.range(500).selectExpr(
        "cast(1 as long) person_id", "date_add(date'1998-02-01', cast(id as int)) admission_date",
        "cast(null as date) discharge_date", "true emergency",
    )
    ev = _ev(spark, [(1, DAY), (2, DAY)])
    joined = followup.attach_admissions(ev, spells, D(1998, 1, 1))
    assert joined.filter("person_id = 1").count() == 500
    assert joined.filter("person_id = 2 and admission_date is null").count() == 1
    first = followup.first_spell(followup.admission_status(joined)).collect()
    assert {r.person_id: r.days_adm for r in first} == {1: 0, 2: None}
    # day 0 covers the week before the event; its earliest admission is taken
    assert [r.admission_date for r in first if r.person_id == 1] == [DAY - T(7)]
