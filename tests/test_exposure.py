from datetime import date, datetime

from sequela.operators import exposure

RULES = (("contains", "BRAVE", "PB"), ("equals", "391", "AZ"))
D = date


def test_pattern_rule_comes_before_exact_code(spark, collect):
    df = spark.createDataFrame(
        [(1, "x BRAVE y"), (2, "391"), (3, "3911"), (4, None)], "rec_id long, type string"
    ).selectExpr("*", "timestamp_ntz'2021-01-05 23:30:00' as occurrence_time")
    got = collect(exposure.classify_product(df, RULES), "rec_id", "vacc_type", "date")
    day = D(2021, 1, 5)
    assert got == [(1, "PB", day), (2, "AZ", day), (3, "UNK", day), (4, "UNK", day)]


def test_stages_0_and_3_are_dose_1(spark, collect):
    df = spark.createDataFrame([(0,), (1,), (2,), (3,)], "stage int")
    assert collect(exposure.normalise_dose(df), "stage", "dose") == [(0, 1), (1, 1), (2, 2), (3, 1)]


def _records(spark, rows):
    return spark.createDataFrame(
        rows, "person_id long, dose int, date date, rec_id long, vacc_type string"
    )


def test_first_record_per_dose_and_widening(spark, collect):
    records = _records(
        spark,
        [
            (1, 1, D(2021, 1, 2), 7, "PB"), (1, 1, D(2021, 1, 1), 9, "AZ"),
            (1, 1, D(2021, 1, 1), 8, "PB"), (1, 2, D(2021, 3, 1), 3, "PB"),
            (2, 2, D(2021, 3, 1), 4, "PB"), (3, 1, D(2021, 1, 1), 5, "AZ"),
        ],
    )
    first = exposure.first_per_dose(records)
    assert collect(first, "person_id", "dose", "rec_id") == [(1, 1, 8), (1, 2, 3), (2, 2, 4), (3, 1, 5)]
    expected = [
        (1, "PB", D(2021, 1, 1), "PB", D(2021, 3, 1)),
        (3, "AZ", D(2021, 1, 1), None, None),
    ]
    assert collect(exposure.widen_doses(records)) == expected
    assert collect(exposure.widen_doses(first)) == expected


def _wide(spark, rows):
    return spark.createDataFrame(
        rows,
        "person_id long, vacc_type string, date_vacc_1 date, vacc_type_2 string, date_vacc_2 date",
    )


def test_cleaning_rules(spark, collect):
    d1 = D(2021, 1, 1)
    wide = _wide(
        spark,
        [
            (1, "PB", d1, None, None), (2, "PB", d1, "AZ", D(2021, 3, 1)),
            (3, "UNK", d1, None, None), (4, "AZ", d1, "UNK", D(2021, 3, 1)),
            (5, "AZ", d1, "AZ", d1), (6, "AZ", d1, "AZ", D(2021, 1, 19)),
            (7, "AZ", d1, "AZ", D(2021, 1, 20)), (8, "AZ", d1, "AZ", D(2020, 12, 1)),
        ],
    )
    kept = exposure.drop_inconsistent(wide, ("AZ", "PB"))
    assert [r[0] for r in collect(kept)] == [1, 5, 6, 7, 8]
    same = exposure.collapse_same_day(kept)
    assert collect(same.filter("person_id = 5")) == [(5, "AZ", d1, None, None)]
    # 18 days apart is too close, 19 is not; a dose 2 before dose 1 goes too
    assert [r[0] for r in collect(exposure.min_gap(same, 18))] == [1, 5, 7]


def test_truncation_at_each_endpoints_end(spark, collect):
    wide = _wide(
        spark,
        [
            (1, "PB", D(2021, 1, 1), "PB", D(2021, 3, 1)),
            (2, "PB", D(2021, 2, 1), None, None),
        ],
    )
    ends = spark.createDataFrame(
        [("a", D(2021, 3, 1)), ("b", D(2021, 2, 1))], "endpoint string, a_end date"
    )
    got = collect(exposure.truncate_exposure(wide, ends), "endpoint", "person_id", "date_vacc_2")
    assert got == [("a", 1, None), ("a", 2, None), ("b", 1, None)]
    later = spark.createDataFrame([("a", D(2021, 3, 2))], "endpoint string, a_end date")
    kept = exposure.truncate_exposure(wide, later).filter("person_id = 1")
    assert collect(kept, "date_vacc_2") == [(D(2021, 3, 1),)]
