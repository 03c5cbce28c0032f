"""One person with a third of all rows: the rows are spread or combined before they meet."""

from datetime import date, timedelta

import pytest

from sequela.operators import followup, outcome, rates, status

D, T = date, timedelta
DAY = D(2021, 3, 1)


@pytest.fixture(scope="module")
def hot(spark):
    """Person 0 has 400 of 1,200 rows."""
    return [0 if i % 3 == 0 else i for i in range(1200)]


def largest_share(df, column="person_id"):
    """Share of the rows of the fullest partition."""
    sizes = df.rdd.glom().map(len).collect()
    return max(sizes) / max(1, sum(sizes))


def test_spells_of_a_person_come_in_parts(spark, hot):
    spells = spark.createDataFrame(
        [(p, DAY + T(i % 300), DAY + T(i % 300 + 5), True) for i, p in enumerate(hot)],
        "person_id long, admission_date date, discharge_date date, emergency boolean",
    )
    sizes = spells.groupBy("person_id", status.spell_part(8).alias("part")).count().orderBy("count").collect()
    assert sizes[-1]["count"] < 400 / 3
    people = sorted(set(hot))
    sets = spark.createDataFrame(
        [("a", p, p, 1, DAY + T(30)) for p in people],
        "endpoint string, case_id long, person_id long, event int, event_time date",
    )
    found = status.hospital_status(sets, spells, D(2021, 1, 1))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan and "partial_max" in plan
    plain = {}
    for i, p in enumerate(hot):
        a, b, at = DAY + T(i % 300), DAY + T(i % 300 + 5), DAY + T(30)
        kind = "in_hosp" if b >= at and a <= at else "before" if at - T(14) <= b < at else "no_adm"
        rank = ("no_adm", "before", "in_hosp").index
        plain[p] = max(plain.get(p, "no_adm"), kind, key=rank)
    assert {r.person_id: r.hosp for r in found.collect()} == plain
    ev = sets.select("endpoint", "person_id", "event_time").withColumnRenamed("event_time", "start_date")
    joined = followup.attach_admissions(ev, spells, D(2021, 1, 1))
    assert joined.count() == len(hot)
    lone = followup.attach_admissions(ev, spells.filter("person_id > 5"), D(2021, 1, 1))
    assert lone.filter("person_id = 0").count() == 1


def test_events_of_a_person_are_days_before_the_join(spark, hot):
    ev = spark.createDataFrame(
        [("a", p, DAY + T(i % 7), "x", 40, "F") for i, p in enumerate(hot)],
        "endpoint string, person_id long, start_date date, code string, age int, sex string",
    )
    vacc = spark.createDataFrame([(p, "PB", DAY) for p in set(hot)], "person_id long, vacc_type string, date_vacc_1 date")
    ends = spark.createDataFrame([("a", DAY + T(60))], "endpoint string, a_end date")
    got = {r.person_id: r.days_1 for r in rates.first_post_exposure(ev, vacc, ends).collect()}
    assert got[0] == min(i % 7 for i, p in enumerate(hot) if p == 0 and i % 7)
    # the aggregate comes first, the wash-out meets one row a person
    first = outcome.washout(outcome.first_event(ev), ev.filter("person_id = 1"))
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftAnti") < plan.index("Aggregate [endpoint")
    assert first.count() == len(set(hot) - {1})
