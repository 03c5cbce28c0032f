"""Registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_module
from check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# One query per flow; check.py compares all of them at any scale.
COMPARED = (
    "s1_load_register", "s4_write_stage", "s5_stack_results", "e4_widen_doses", "e9_truncate_exposure",
    "v3_trim_extract", "v8_first_event", "v10_attrition", "v11_analysis_set", "c4_control_pool",
    "m1_match_candidates", "m2_sample_controls", "m3_unmatched", "x3_collapse_status",
    "x4_hospital_status", "r6_expected_events", "r8_simulate_oe", "r12_dose2_incidence", "l2_clogit",
    "k4_sccs_rates", "k6_time_split", "k10_label_sccs", "p8_level_rates", "f6_hospital_summary",
    "o1_cooccurrence", "q4_daily_series", "b2_report_counts", "p9_pd_model_binary", "p8_merged_rates",
    "l5_nested_models_product", "l10_its_steps", "p11_rr_table", "p12_event_days", "k4_never_exposed_rates", "k4_level_rates", "q3_count_by_dose_date", "l9_effectiveness",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_twin_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(COMPARED) <= set(entry_module.oracle_sql())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["endpoint", "vacc_type", "expgr", "event", "interval", "rate_week"]
    assert df.count() > 0


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_twin(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    twin = duck.sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(twin.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(twin.columns, twin.fetchall())
