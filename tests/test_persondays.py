import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from sequela.models import selfcontrolled
from sequela.operators import persondays

D, T = date, timedelta
START, END = D(2020, 12, 1), D(2021, 11, 7)
PEOPLE = (
    "endpoint string, person_id long, vacc_type string, date_vacc_1 date, date_vacc_2 date,"
    " specimen_date date, death_date date, start_date date"
)
V1, V2 = D(2021, 2, 1), D(2021, 4, 1)


def _panel(spark, people):
    return persondays.full_panel(spark.createDataFrame(people, PEOPLE), START, END)


def _random_people(seed, n=60):
    rng = random.Random(seed)

    def day(chance, a=-40, b=380):
        return START + T(rng.randrange(a, b)) if rng.random() < chance else None

    return [
        (rng.choice("ab"), i, rng.choice(("PB", "AZ")), day(0.95), day(0.6), day(0.4), day(0.3, -5), day(0.9))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(3))
def test_pieces_are_the_days(spark, seed):
    people = spark.createDataFrame(_random_people(seed), PEOPLE)
    for length in (7, 28):
        days = persondays.full_panel(people, START, END, length)
        pieces = persondays.full_pieces(people, START, END, length)
        keep = ["endpoint", "person_id", "period", "expgr", "expgr2", "expgr3", "event"]
        unfolded = pieces.withColumn("date", F.explode(F.expr("sequence(date, date_add(date, interval - 1))")))
        assert sorted(unfolded.select("date", *keep).collect(), key=str) == sorted(days.select("date", *keep).collect(), key=str)
        assert pieces.count() < days.count() / (3 if length == 7 else 8)
        want = persondays.level_rates(days, 49).orderBy("endpoint", "term", "level").collect()
        assert persondays.level_rates(pieces, 49).orderBy("endpoint", "term", "level").collect() == want


def test_model_of_pieces_is_that_of_days(spark):
    people = spark.createDataFrame(_random_people(7, 150), PEOPLE)
    terms = [selfcontrolled.panel_terms(12)[n] for n in ("expgr", "expgr3", "period")]
    both = [
        selfcontrolled.pd_model(make(people, START, END, 30), terms, 12).orderBy("endpoint", "term", "level").collect()
        for make in (persondays.full_panel, persondays.full_pieces)
    ]
    assert len(both[0]) == len(both[1]) > 40
    for a, b in zip(*both):
        assert (a.term, a.level, a.event, a.personday) == (b.term, b.level, b.event, b.personday)
        assert a.coef == pytest.approx(b.coef, abs=1e-6) and a.se == pytest.approx(b.se, abs=1e-6)


def test_last_period_is_short(spark):
    spine = persondays.date_spine(spark, START, END, 7).groupBy("period").count().collect()
    sizes = {r.period: r["count"] for r in spine}
    assert len(sizes) == 49 and sizes[49] == 6 and all(sizes[i] == 7 for i in range(1, 49))


def test_levels_follow_the_later_rule(spark):
    # dose 2 comes 31 days after dose 1, so its clearance begins on day 28 only
    people = [("a", 1, "PB", V1, V1 + T(31), D(2021, 3, 20), None, V1)]
    got = {(r.date - V1).days: r for r in _panel(spark, people).collect()}
    level = {d: r.expgr for d, r in got.items()}
    assert level[-15] == "PB Baseline" and level[-14] == level[-1] == "PB Dose1 clearance"
    assert level[0] == level[6] == "PB Dose1 0-6" and level[7] == "PB Dose1 7-13"
    assert level[17] == level[20] == "PB Dose1 14-20" and level[27] == "PB Dose1 21-27"
    assert level[28] == level[30] == "PB Dose2 clearance" and level[31] == "PB Dose2 0-6"
    assert level[31 + 27] == "PB Dose2 21-27" and level[31 + 28] == "PB Baseline"
    assert {r.expgr2 for r in got.values()} == {"AZ Baseline"}
    infection = (D(2021, 3, 20) - V1).days
    assert got[infection - 14].expgr3 == "infection clearance"
    assert got[infection].expgr3 == "infection 0-6" and got[infection + 20].expgr3 == "infection 14-20"


def test_dose_2_risk_overrides_dose_1_risk(spark):
    people = [("a", 1, "AZ", V1, V1 + T(20), None, None, V1)]
    got = {(r.date - V1).days: r.expgr2 for r in _panel(spark, people).collect()}
    assert got[19] == "AZ Dose1 14-20" and got[20] == "AZ Dose2 0-6" and got[27] == "AZ Dose2 7-13"


def test_follow_up_ends_with_the_day_of_death_and_events_are_marked(spark):
    died = D(2021, 3, 1)
    people = [
        ("a", 1, "PB", V1, V2, None, died, died), ("a", 2, "PB", V1, V2, None, died, died + T(1)),
        ("a", 3, "AZ", V1, V2, None, None, V2 + T(3)),
    ]
    rows = _panel(spark, people).collect()
    assert max(r.date for r in rows if r.person_id == 1) == died
    assert {(r.person_id, r.date) for r in rows if r.event} == {(1, died), (3, V2 + T(3))}
    days = {r.person_id: r.expgr_combined for r in persondays.event_days(_panel(spark, people)).collect()}
    assert days == {1: "Baseline", 3: "AZ Dose2 0-6"}


def test_merged_levels_and_full_level_list(spark):
    people = [("a", 1, "PB", V1, V2, None, None, V1)]
    panel = persondays.merge_levels(_panel(spark, people))
    rows = persondays.level_rates(panel, 49, merged=True).collect()
    got = {(r.term, r.level): r for r in rows}
    assert got["expgr", "PB Dose1 0-27"].personday == 28 and got["expgr", "PB Dose1 0-27"].event == 1
    assert got["expgr2", "AZ Dose1 0-27"].personday == 0
    assert got["expgr2", "AZ Dose1 0-27"].rate_week is None
    assert got["expgr3", "infection 0-27"].personday == 0
    assert sum(r.personday for r in rows if r.term == "period") == 342
    assert len(rows) == 5 + 5 + 3 + 49


def test_rate_ratio_text(spark):
    coefs = spark.createDataFrame(
        [("ref", 0.0, None), ("x", 0.6931471805599453, 0.5), ("none", None, None)],
        "level string, coef double, se double",
    )
    got = {r.level: r for r in persondays.rr_table(coefs).collect()}
    assert got["ref"].rr_ci == "1 (, )"
    assert got["x"].rr_ci == "2 (0.75, 5.33)"
    assert got["none"].rate_ratio is None and got["none"].rr_ci is None


def test_levels_of_one_exposure_add_up_to_the_periods(spark):
    people = [
        ("a", 1, "PB", V1, V2, None, None, V1 + T(3)), ("a", 2, "AZ", V1, V2, None, None, V1 + T(9)),
        ("a", 3, "PB", V1, V2, V1, D(2021, 6, 1), V2), ("a", 4, "PB", V1, None, None, None, V1 + T(1)),
    ]
    panel = _panel(spark, people)
    terms = [selfcontrolled.panel_terms(49)[n] for n in ("expgr", "period")]
    rows = selfcontrolled.pd_model(panel, terms, 49, everyone=True).collect()
    totals = {t: (sum(r.event for r in rows if r.term == t), sum(r.personday for r in rows if r.term == t)) for t in ("expgr", "period")}
    assert totals["expgr"] == totals["period"] == (panel.filter("event = 1").count(), panel.count())
    assert 4 in {r.person_id for r in persondays.event_days(panel).collect()}
