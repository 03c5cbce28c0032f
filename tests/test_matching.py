import random
from collections import Counter
from datetime import date, timedelta

import pytest

from sequela.operators import matching

D = date
KEYS = ("sex", "band")
BEGIN = D(2021, 1, 1)


def _tables(spark, n=600, seed=3):
    """A cohort with one stratum that holds a third of everyone, and many deaths."""
    rnd = random.Random(seed)
    people = []
    for i in range(n):
        hot = i % 3 == 0
        band = 0 if hot else rnd.randrange(1, 25)
        death = BEGIN + timedelta(rnd.randrange(0, 60)) if rnd.random() < 0.3 else None
        people.append((i, "F" if hot or rnd.random() < 0.5 else "M", band, death))
    prior = [("a", i) for i in range(n) if rnd.random() < 0.1]
    gone = {i for _, i in prior}
    cases = [
        ("a", i, BEGIN + timedelta(rnd.randrange(0, 60)), s, b)
        for i, s, b, _ in people
        if i not in gone and rnd.random() < 0.15
    ]
    cohort = spark.createDataFrame(people, "person_id long, sex string, band int, death_date date")
    prior_df = spark.createDataFrame(prior, "endpoint string, person_id long")
    case_df = spark.createDataFrame(
        cases, "endpoint string, case_id long, event_time date, sex string, band int"
    )
    pool = matching.control_pool(cohort, prior_df, case_df, ["a"])
    eligible = {
        c: {
            i for i, s, b, d in people
            if i != c and i not in gone and (s, b) == (sex, band) and (d is None or d > day)
        }
        for _, c, day, sex, band in cases
    }
    return pool, case_df, eligible, {c for _, c, *_ in cases}


def _ranked(pool):
    return matching.number_pool(pool, KEYS, 4)


@pytest.fixture(scope="module")
def tables(spark):
    return _tables(spark)


def test_candidate_counts_equal_all_pairs(tables):
    pool, _, eligible, _ = tables
    got = {r.case_id: r.n_candidates for r in matching.match_candidates(_ranked(pool), KEYS).collect()}
    assert got == {c: len(e) for c, e in eligible.items()}


def test_ranks_are_dense_within_a_stratum(tables):
    pool = tables[0]
    ranks = {}
    for r in matching.number_pool(pool, KEYS, 4).collect():
        ranks.setdefault((r.sex, r.band), []).append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in ranks.values())


def test_controls_are_eligible_distinct_and_as_many_as_possible(tables):
    pool, cases, eligible, case_ids = tables
    matched = matching.sample_controls(_ranked(pool), KEYS, 5, "s")
    chosen = {}
    for r in matched.collect():
        assert r.control_id in eligible[r.case_id]
        assert r.future_case == int(r.control_id in case_ids)
        chosen.setdefault(r.case_id, []).append(r.control_id)
    for case, possible in eligible.items():
        got = chosen.get(case, [])
        assert len(got) == len(set(got)) == min(5, len(possible))
    lost = {r.case_id for r in matching.unmatched(cases, matched).collect()}
    assert lost == {c for c, e in eligible.items() if not e}


def test_draws_do_not_depend_on_partitioning_or_row_order(tables, collect):
    pool = tables[0]
    one = matching.sample_controls(_ranked(pool.coalesce(1)), KEYS, 5, "s")
    many = matching.sample_controls(_ranked(pool.repartition(7, "band")), KEYS, 5, "s")
    assert collect(one) == collect(many)
    other = matching.sample_controls(_ranked(pool), KEYS, 5, "t")
    assert collect(one) != collect(other)


def test_every_candidate_is_equally_likely(spark):
    people = [(i, "F", 0, None) for i in range(13)]
    cohort = spark.createDataFrame(people, "person_id long, sex string, band int, death_date date")
    names = [f"e{i}" for i in range(400)]
    cases = spark.createDataFrame(
        [(e, 4, BEGIN, "F", 0) for e in names],
        "endpoint string, case_id long, event_time date, sex string, band int",
    )
    none = spark.createDataFrame([], "endpoint string, person_id long")
    pool = matching.control_pool(cohort, none, cases, names)
    drawn = matching.sample_controls(_ranked(pool), KEYS, 3, "s").collect()
    seen = Counter(r.control_id for r in drawn)
    assert sum(seen.values()) == 1200 and 4 not in seen and len(seen) == 12
    assert sum((n - 100) ** 2 / 100 for n in seen.values()) < 31.3  # chi-square, 11 df, 0.1 %


def test_sets_have_one_case_row_and_keep_future_cases_as_controls(tables):
    matched = matching.sample_controls(_ranked(tables[0]), KEYS, 5, "s")
    sets = matching.matched_sets(matched, KEYS).collect()
    cases = [r for r in sets if r.event == 1]
    assert len(cases) == len({r.case_id for r in sets})
    assert all(r.person_id == r.case_id for r in cases)
    assert len(sets) == len(cases) + matched.count()
    day = {r.case_id: r.event_time for r in cases}
    assert all(r.event_time == day[r.case_id] for r in sets)


def test_death_on_the_event_day_excludes_a_control(spark, collect):
    cohort = spark.createDataFrame(
        [(1, "F", 0, None), (2, "F", 0, D(2021, 1, 5)), (3, "F", 0, D(2021, 1, 6))],
        "person_id long, sex string, band int, death_date date",
    )
    case = spark.createDataFrame(
        [("a", 1, D(2021, 1, 5), "F", 0)],
        "endpoint string, case_id long, event_time date, sex string, band int",
    )
    none = spark.createDataFrame([], "endpoint string, person_id long")
    pool = matching.control_pool(cohort, none, case, ["a"])
    assert collect(matching.sample_controls(_ranked(pool), KEYS, 10), "control_id") == [(3,)]


def test_matching_age_groups(spark):
    ages = [78, 79, 80, 88, 89, 93, 94, 98, 99, 100]
    df = spark.createDataFrame([(a,) for a in ages], "age_year int")
    got = {r.age_year: r.match_age for r in matching.matching_age(df).collect()}
    assert got == {78: 79, 79: 80, 80: 80, 88: 88, 89: 92, 93: 92, 94: 97, 98: 97, 99: 100, 100: 100}
