from datetime import date, timedelta

from sequela.operators import status

D = date
INDEX = D(2021, 3, 1)


def _sets(spark, ids, event=0):
    return spark.createDataFrame(
        [("a", i, i, INDEX, event) for i in ids],
        "endpoint string, case_id long, person_id long, event_time date, event int",
    )


def test_bands_open_after_day_0(spark):
    days = [-3, 0, 1, 6, 7, 13, 14, 20, 21, 27, 28, 34, 35, 41, 42, 59]
    vacc = spark.createDataFrame(
        [(i, "PB", INDEX - timedelta(d), None, None) for i, d in enumerate(days)]
        + [(100, "AZ", INDEX - timedelta(60), "AZ", INDEX - timedelta(d)) for d in (0,)]
        + [(101, "AZ", INDEX - timedelta(60), "AZ", INDEX - timedelta(6))]
        + [(102, "AZ", INDEX - timedelta(60), "AZ", INDEX - timedelta(7))],
        "person_id long, vacc_type string, date_vacc_1 date, vacc_type_2 string, date_vacc_2 date",
    )
    ends = spark.createDataFrame([("a", D(2021, 4, 1))], "endpoint string, a_end date")
    sets = _sets(spark, [*range(len(days)), 100, 101, 102, 200])
    df = status.collapse_status(status.product_at_index(status.vacc_status(sets, vacc, ends)))
    got = {r.person_id: r for r in df.collect()}
    labels = ["uv", "uv", "v1_0:6", "v1_0:6", "v1_7:13", "v1_7:13", "v1_14:20", "v1_14:20"]
    labels += ["v1_21:27", "v1_21:27", "v1_28:34", "v1_28:34", "v1_35:41", "v1_35:41", "v1_42+", "v1_42+"]
    assert [got[i].vacc_status for i in range(len(days))] == labels
    assert got[100].vacc_status == "v1_42+" and got[101].vacc_status == "v2_0:6"
    assert got[102].vacc_status == "v2_7+" and got[102].vs_type == "AZ_v1_28+_v2"
    assert got[200].vs_type == "uv" and got[200].vacc_type == "uv"
    assert all((r.vacc_status == "uv") == (r.vacc_type == "uv") for r in got.values())


def test_doses_at_the_study_end_do_not_count(spark):
    vacc = spark.createDataFrame(
        [(1, "PB", D(2021, 2, 1), "PB", D(2021, 2, 20)), (2, "PB", D(2021, 2, 20), None, None)],
        "person_id long, vacc_type string, date_vacc_1 date, vacc_type_2 string, date_vacc_2 date",
    )
    ends = spark.createDataFrame([("a", D(2021, 2, 20))], "endpoint string, a_end date")
    got = {r.person_id: r for r in status.vacc_status(_sets(spark, [1, 2]), vacc, ends).collect()}
    assert got[1].vacc_status == "v1_28:34" and got[1].day_2 is None
    assert got[2].vacc_status == "uv" and got[2].product is None


def _hosp(spark, spells):
    df = spark.createDataFrame(
        spells, "person_id long, admission_date date, discharge_date date"
    )
    ids = sorted({s[0] for s in spells}) + [99]
    out = status.hospital_status(_sets(spark, ids), df, D(2021, 1, 1))
    return {r.person_id: r.hosp for r in out.collect()}


def test_hospital_status(spark):
    t = timedelta
    got = _hosp(
        spark,
        [
            (1, INDEX - t(40), INDEX - t(15)), (2, INDEX - t(40), INDEX - t(14)),
            (3, INDEX - t(40), INDEX - t(1)), (4, INDEX - t(40), INDEX), (5, INDEX, INDEX + t(3)),
            (6, INDEX - t(3), None), (7, INDEX + t(1), None), (8, INDEX + t(1), INDEX + t(2)),
            (9, INDEX - t(30), INDEX - t(5)), (9, INDEX - t(2), INDEX + t(5)),
            (10, D(2020, 1, 1), D(2020, 2, 1)),
        ],
    )
    assert got == {
        1: "no_adm", 2: "before", 3: "before", 4: "in_hosp", 5: "in_hosp", 6: "in_hosp",
        7: "no_adm", 8: "no_adm", 9: "in_hosp", 10: "no_adm", 99: "no_adm",
    }


def test_a_reused_control_has_the_status_of_its_first_set(spark):
    sets = spark.createDataFrame(
        [("a", 1, 7, D(2021, 3, 1), 0), ("a", 2, 7, D(2021, 6, 1), 0)],
        "endpoint string, case_id long, person_id long, event_time date, event int",
    )
    spells = spark.createDataFrame(
        [(7, D(2021, 5, 30), D(2021, 6, 3))], "person_id long, admission_date date, discharge_date date"
    )
    got = [r.hosp for r in status.hospital_status(sets, spells, D(2021, 1, 1)).collect()]
    assert got == ["no_adm", "no_adm"]


def test_timing_of_tests(spark):
    gaps = {1: 28, 2: 27, 3: 14, 4: 13, 5: 0, 6: -1, 7: -6, 8: -7}
    tests = spark.createDataFrame(
        [(i, INDEX - timedelta(g)) for i, g in gaps.items()], "person_id long, specimen_date date"
    )
    got = status.test_timing(_sets(spark, [*gaps, 9]), tests).collect()
    assert {r.person_id: r.positive_before_event for r in got} == {
        1: "28+ days", 2: "14-27 days", 3: "14-27 days", 4: "0-13 days", 5: "0-13 days",
        6: "1-6 post event", 7: "1-6 post event", 8: "7+ post event", 9: "never",
    }


def test_cut_bands_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (10.0, 10.5, 19.0, 19.1, 50.0, 51.0)], "bmi double")
    got = {r.bmi: r.g for r in status.cut_bands(df, "bmi", (10, 19, 50), "g").collect()}
    assert got == {10.0: None, 10.5: "(10,19]", 19.0: "(10,19]", 19.1: "(19,50]", 50.0: "(19,50]", 51.0: None}
