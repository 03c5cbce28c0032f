import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequela.models import effects
from sequela.models.clogit import coef_table, fit, lr_test, strata_table
from sequela.models.kernel import Term
from sequela.operators.report import report_table

X = Term("x")


def _fit(df, terms, models=None, ties="efron", offset=None, by=("g",)):
    strata = strata_table(df, list(by), ["s"], terms, offset=offset)
    return fit(strata, terms, models or {"m": [t.name for t in terms]}, ties)


def test_one_to_one_pairs_have_a_closed_form(spark):
    rows = []
    for i in range(60):
        case, control = (1, 0) if i < 30 else (0, 1) if i < 42 else (1, 1)
        rows += [("a", i, 1, case), ("a", i, 0, control)]
    df = spark.createDataFrame(rows, "g string, s int, event int, x int")
    f = _fit(df, [X])[0]
    assert f.coef[0] == pytest.approx(math.log(30 / 12), abs=1e-8)
    assert f.se[0] == pytest.approx(math.sqrt(1 / 30 + 1 / 12), abs=1e-8)
    assert f.loglik_null == pytest.approx(60 * math.log(0.5))


def _strata(rnd, n, ties):
    """Strata with two covariates; with ties some have several events."""
    out = []
    for s in range(n):
        size = rnd.randrange(3, 7)
        events = rnd.randrange(1, 3) if ties else 1
        flags = [1] * events + [0] * (size - events)
        out += [
            ("a" if s % 2 else "b", s, e, rnd.choice([0.0, 1.0]), rnd.choice(["p", "q", "r"]),
             rnd.choice([0.5, 1.0, 2.0]))
            for e in flags
        ]
    return out


def _matrix(rows):
    by = {}
    for g, s, e, x, c, o in rows:
        by.setdefault(s, []).append((e, [x, c == "q", c == "r"], math.log(o)))
    return [
        (np.array([r[0] for r in v]), np.array([r[1] for r in v], float), np.array([r[2] for r in v]))
        for v in by.values()
    ]


def _loglik(strata, b, ties):
    total = 0.0
    for e, x, o in strata:
        eta = x @ b + o
        w, d = np.exp(eta), int(e.sum())
        total += eta[e == 1].sum()
        if ties == "exact":
            total -= math.log(sum(np.prod(w[list(c)]) for c in itertools.combinations(range(len(w)), d)))
        else:
            total -= sum(math.log(w.sum() - k / d * w[e == 1].sum()) for k in range(d))
    return total


def _numeric_fit(strata, ties, p=3):
    b, h = np.zeros(p), 1e-4
    basis = np.eye(p) * h
    for _ in range(30):
        grad = np.array([(_loglik(strata, b + d, ties) - _loglik(strata, b - d, ties)) / (2 * h) for d in basis])
        hess = np.array([
            [(_loglik(strata, b + d + c, ties) - _loglik(strata, b + d - c, ties)
              - _loglik(strata, b - d + c, ties) + _loglik(strata, b - d - c, ties)) / (4 * h * h) for c in basis]
            for d in basis
        ])
        step = np.linalg.solve(-hess, grad)
        b = b + step
        if abs(step).max() < 1e-9:
            break
    return b, np.sqrt(np.diag(np.linalg.inv(-hess)))


@pytest.mark.parametrize("ties", ["efron", "exact"])
def test_fit_equals_a_direct_maximisation(spark, ties):
    rows = _strata(random.Random(5), 60, True)
    df = spark.createDataFrame(rows, "g string, s int, event int, x double, c string, o double")
    terms = [X, Term("c", ("p", "q", "r"))]
    fits = _fit(df, terms, ties=ties, offset=F.log("o"))
    assert [f.group for f in fits] == [("a",), ("b",)]
    for f in fits:
        strata = _matrix([r for r in rows if r[0] == f.group[0]])
        b, se = _numeric_fit(strata, ties)
        assert f.coef == pytest.approx(list(b), abs=1e-5)
        assert f.se == pytest.approx(list(se), rel=1e-3)
        assert f.loglik == pytest.approx(_loglik(strata, b, ties), abs=1e-7)


def test_equal_rows_and_equal_strata_fold_without_changing_the_fit(spark):
    rnd = random.Random(1)
    rows = []
    for s in range(40):
        kind = s % 4
        rows += [("a", s, 1, kind % 2)] + [("a", s, 0, (kind + j) // 2 % 2) for j in range(8)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, s int, event int, x int")
    strata = strata_table(df, ["g"], ["s"], [X])
    assert strata.count() <= 4
    assert sum(r.w for r in strata.collect()) == 40
    f = fit(strata, [X], {"m": ["x"]})[0]
    by = {}
    for _, s, e, x in rows:
        by.setdefault(s, []).append((e, [float(x)], 0.0))
    direct = [(np.array([r[0] for r in v]), np.array([r[1] for r in v]), np.zeros(len(v))) for v in by.values()]
    b, _ = _numeric_fit(direct, "efron", 1)
    assert f.coef[0] == pytest.approx(b[0], abs=1e-6) and f.n_strata == 40 and f.n_events == 40


def test_a_level_without_events_is_null_and_others_are_the_limit(spark):
    rows = []
    for s in range(30):
        rows += [("a", s, 1, "q" if s % 3 else "p"), ("a", s, 0, "p" if s % 2 else "q"), ("a", s, 0, "r")]
    df = spark.createDataFrame(rows, "g string, s int, event int, c string")
    full = _fit(df, [Term("c", ("p", "q", "r", "never"))])[0]
    less = _fit(df.filter("c <> 'r'"), [Term("c", ("p", "q"))])[0]
    assert full.coef[1] is None and full.coef[2] is None
    assert full.coef[0] == pytest.approx(less.coef[0], abs=1e-8)
    assert full.se[0] == pytest.approx(less.se[0], abs=1e-8)


def test_separation_and_collinear_columns_are_null(spark):
    rows = []
    for s in range(20):
        rows += [("a", s, 1, 1, s % 2, s % 2), ("a", s, 0, 0, 1 - s % 2, 1 - s % 2)]
    df = spark.createDataFrame(rows, "g string, s int, event int, x int, y int, z int")
    sep = _fit(df, [X])[0]
    assert sep.coef == [None]
    twin = _fit(df.withColumn("x", F.lit(0)), [Term("y"), Term("z")])[0]
    assert twin.coef[0] == pytest.approx(0, abs=1e-8) and twin.coef[1] is None


def test_missing_values_leave_only_their_own_model(spark):
    rows = [("a", s, e, float((s + j) % 2), None if s < 5 and e == 0 else 1.0 * (s * j % 3))
            for s in range(30) for j, e in enumerate((1, 0, 0))]
    df = spark.createDataFrame(rows, "g string, s int, event int, x double, y double")
    fits = {f.model: f for f in _fit(df, [X, Term("y")], {"one": ["x"], "two": ["x", "y"]})}
    assert fits["one"].n_strata == 30 and fits["two"].n_strata == 25
    alone = _fit(df.select("g", "s", "event", "x"), [X])[0]
    assert fits["one"].coef[0] == pytest.approx(alone.coef[0], abs=1e-9)


def test_likelihood_ratio(spark):
    rows = _strata(random.Random(8), 60, False)
    df = spark.createDataFrame(rows, "g string, s int, event int, x double, c string, o double")
    df = df.withColumn("g", F.lit("a"))
    fits = {f.model: f for f in _fit(df, [X, Term("c", ("p", "q", "r"))], {"big": ["x", "c"], "small": ["x"]})}
    chi2, dof, p = lr_test(fits["big"], fits["small"])
    assert dof == 2 and chi2 >= 0 and p == pytest.approx(math.exp(-chi2 / 2))


def test_effect_and_effectiveness_tables(spark):
    coefs = spark.createDataFrame(
        [("a", "m", "c", "uv", 0.0, None, None), ("a", "m", "c", "PB", math.log(0.5), 0.1, 0.02)],
        "endpoint string, model string, term string, level string, coef double, se double, p double",
    )
    table = {r.level: r for r in effects.effect_table(coefs).collect()}
    assert (table["uv"].est, table["uv"].lcl, table["uv"].ucl, table["uv"].p) == (1, 1, 1, None)
    assert table["PB"].ucl == pytest.approx(0.5 * math.exp(0.196))
    ve = {r.level: r for r in effects.effectiveness(effects.effect_table(coefs)).collect()}
    assert ve["PB"].ve_raw == pytest.approx(50) and ve["PB"].ve_lcl_raw < 50 < ve["PB"].ve_ucl_raw
    assert ve["uv"].ve_raw == 0


def test_third_model_falls_back_to_the_second_and_the_report_hides_it(spark):
    rows = []
    for i in range(40):
        case, control = ("PB", "uv") if i < 24 else ("uv", "PB")
        rows += [("a", i, 1, case, i % 3, None, 1), ("a", i, 0, control, (i + 1) % 3, None, 2)]
    df = spark.createDataFrame(
        rows, "endpoint string, case_id int, event int, vacc_type string, n_risk_gps int, simd string, n_tests_gp int"
    )
    table = effects.nested_models(df, Term("vacc_type", ("uv", "AZ", "PB")), ["1", "2"])
    got = {r.vacc_type: r for r in table.collect()}
    assert got["PB"].n == 40 and got["PB"].events == 24 and got["PB"].percent == 60
    assert got["PB"].est_1 == pytest.approx(24 / 16)
    assert got["PB"].est_3 == got["PB"].est_2 is not None
    text = {r.vacc_type: r for r in report_table(table, "vacc_type", hide_unfitted=True).collect()}
    assert text["uv"].or_1 == "1.00  ( 1.00  -  1.00 )"
    assert text["PB"].or_3 == "NA  ( NA  -  NA )" and text["PB"].p_3 is None


def test_groups_share_one_job_but_not_their_estimates(spark):
    rows = _strata(random.Random(3), 80, False)
    df = spark.createDataFrame(rows, "g string, s int, event int, x double, c string, o double")
    both = coef_table(spark, _fit(df, [X]), ["g"]).collect()
    alone = coef_table(spark, _fit(df.filter("g = 'a'"), [X]), ["g"]).collect()
    assert {r.g for r in both} == {"a", "b"}
    assert [r.coef for r in both if r.g == "a"] == pytest.approx([r.coef for r in alone], abs=1e-10)


def test_the_unit_of_a_covariate_does_not_matter(spark):
    rows = []
    for i in range(60):
        case, control = (1, 0) if i < 30 else (0, 1) if i < 42 else (1, 1)
        rows += [("a", i, 1, case), ("a", i, 0, control)]
    df = spark.createDataFrame(rows, "g string, s int, event int, x int")
    one = _fit(df, [X])[0]
    for unit in (1e-3, 1e-8, 1e6):
        f = _fit(df.withColumn("x", F.col("x") * F.lit(unit)), [X])[0]
        assert f.converged and f.coef[0] * unit == pytest.approx(one.coef[0], rel=1e-8)
        assert f.se[0] * unit == pytest.approx(one.se[0], rel=1e-8)


def test_an_undeclared_level_is_an_error(spark):
    rows = [("a", s, e, "p" if (s + e) % 2 else "q") for s in range(10) for e in (0, 1)] + [("a", 3, 0, "new"), ("a", 3, 0, None)]
    df = spark.createDataFrame(rows, "g string, s int, event int, c string")
    with pytest.raises(Exception, match="undeclared level of c: new"):
        _fit(df, [Term("c", ("p", "q"))])
    assert _fit(df.filter("c is null or c <> 'new'"), [Term("c", ("p", "q"))])[0].n_strata == 10


def test_a_fit_that_stops_early_is_marked_and_has_no_estimates(spark):
    rows = _strata(random.Random(5), 60, False)
    df = spark.createDataFrame(rows, "g string, s int, event int, x double, c string, o double")
    early = fit(strata_table(df, ["g"], ["s"], [X]), [X], {"m": ["x"]}, max_iter=1)
    assert [f.converged for f in early] == [False, False]
    rows = coef_table(spark, early, ["g"]).collect()
    assert [(r.coef, r.se, r.p, r.converged) for r in rows] == [(None, None, None, False)] * 2


def test_group_names_may_hold_any_character(spark):
    rows = [(g, s, e, (s + e) % 2) for g in ("a|b", None, '"') for s in range(8) for e in (0, 1)]
    fits = _fit(spark.createDataFrame(rows, "g string, s int, event int, x int"), [X])
    assert {f.group for f in fits} == {("a|b",), (None,), ('"',)}


def test_strata_are_dealt_by_rows_not_by_bytes(spark, monkeypatch):
    """Rows that compress to nothing still go to as many tasks as their number asks for."""
    monkeypatch.setattr("sequela.sources.stages.tasks", lambda spark: 1)
    monkeypatch.setattr("sequela.sources.stages.tasks_for.__defaults__", (100,))
    df = spark.range(3000).selectExpr("'a' g", "id div 3 s", "cast(id % 3 = 0 as int) event", "cast(id % 3 as double) x")
    strata = strata_table(df, ["g"], ["s"], [X])
    assert strata.rdd.getNumPartitions() == 30
    assert [(r.g, len(r.pattern), r.w) for r in strata.collect()] == [('["a"]', 12, 1000)]
