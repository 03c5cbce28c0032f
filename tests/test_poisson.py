import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from sequela.models import poisson as P

D, T = date, timedelta
START = D(1998, 1, 1)
SERIES = "endpoint string, start_date date, days int, month string, n int"


def series(name, counts):
    days = [START + T(i) for i in range(len(counts))]
    return [(name, d, i, d.strftime("%B"), int(n)) for i, (d, n) in enumerate(zip(days, counts))]


def dense(x, y, penalty=0.0, rounds=60):
    """Coefficients and covariance by plain reweighted least squares over the whole matrix."""
    s = penalty * (np.diff(np.eye(x.shape[1]), 2, axis=0).T @ np.diff(np.eye(x.shape[1]), 2, axis=0))
    beta = np.linalg.lstsq(x, np.full(len(y), math.log(y.mean())), rcond=None)[0]
    for _ in range(rounds):
        mu = np.exp(x @ beta)
        info = (x * mu[:, None]).T @ x + s
        beta = beta + np.linalg.solve(info, x.T @ (y - mu) - s @ beta)
    mu = np.exp(x @ beta)
    info = (x * mu[:, None]).T @ x
    return beta, np.linalg.inv(info + s), mu, info


def noisy(seed, n, level=lambda i: 5 + 3 * math.sin(i / 20)):
    rng = np.random.default_rng(seed)
    return rng.poisson([level(i) for i in range(n)])


def test_poisson_series_recovers_group_means(spark):
    # one month and one step: means before and after the step are the group means
    rows = [("a", D(1998, 6, 1) + T(i), i, "June", 4 if i < 14 else 9) for i in range(28)]
    fitted, coefs = P.its_poisson(spark.createDataFrame(rows, SERIES), {"step": D(1998, 6, 15)})
    got = {r.term: r for r in coefs.collect()}
    assert got["days"].coef == pytest.approx(0, abs=1e-6)
    assert got["step"].coef == pytest.approx(math.log(9 / 4), abs=1e-6)
    by_day = {r.start_date: r for r in fitted.collect()}
    assert by_day[D(1998, 6, 1)].fit == pytest.approx(4, abs=1e-5)
    assert by_day[D(1998, 6, 28)].fit == pytest.approx(9, abs=1e-5)
    assert all(r.lcl < r.fit < r.ucl for r in by_day.values())


def test_many_series_at_once_equal_dense_fits(spark):
    # different lengths, months and steps in one table; one series has no step inside, one no event
    counts = {"long": noisy(1, 400), "short": noisy(2, 45), "early": noisy(3, 20), "none": [0] * 30}
    rows = [r for name, c in counts.items() for r in series(name, c)]
    random.Random(1).shuffle(rows)
    steps = {"first": START + T(25), "second": START + T(200)}
    fitted, coefs = P.its_poisson(spark.createDataFrame(rows, SERIES).repartition(5), steps)
    got = {(r.endpoint, r.term): r for r in coefs.collect()}
    by_day = {(r.endpoint, r.start_date): r for r in fitted.collect()}
    assert len(by_day) == len(rows)
    for name in ("long", "short", "early"):
        own = [r for r in rows if r[0] == name]
        own.sort(key=lambda r: r[2])
        months = sorted({r[3] for r in own})[1:]
        inside = [k for k, day in steps.items() if day <= own[-1][1]]
        names = [P.INTERCEPT, "days", *months, *inside]
        x = np.array([[1, r[2], *(r[3] == m for m in months), *(r[1] >= steps[k] for k in inside)] for r in own], float)
        beta, cov, mu, _ = dense(x, np.array([r[4] for r in own], float))
        assert {t for g, t in got if g == name} == set(names)
        for j, term in enumerate(names):
            assert got[name, term].coef == pytest.approx(beta[j], abs=1e-6)
            assert got[name, term].se == pytest.approx(math.sqrt(cov[j, j]), abs=1e-6)
        for r, m, row in zip(own, mu, x):
            se = m * math.sqrt(row @ cov @ row)
            f = by_day[name, r[1]]
            assert (f.n, f.fit) == (r[4], pytest.approx(m)) and f.ucl == pytest.approx(m + 1.96 * se)
    assert by_day["none", START].fit is None and not got["none", P.INTERCEPT].converged


def test_no_loop_over_endpoints(spark, monkeypatch):
    jobs = []
    real = P._sums
    monkeypatch.setattr(P, "_sums", lambda *a: jobs.append(len(a[2])) or real(*a))
    rows = [r for k in range(12) for r in series(f"e{k:02d}", noisy(k, 60))]
    P.its_poisson(spark.createDataFrame(rows, SERIES), {"step": START + T(30)})
    assert jobs[0] == 12 and len(jobs) < 12


def _basis(spark, n, size=P.BASIS):
    u = spark.range(n).selectExpr(f"id / {n - 1} as u")
    return np.array([list(r) for r in u.select(*P.spline_basis(u["u"], size)).collect()])


def test_basis_adds_up_to_one_and_is_smooth(spark):
    x = _basis(spark, 701)
    assert x.sum(axis=1) == pytest.approx(1) and (x >= 0).all() and ((x > 0).sum(axis=1) <= 4).all()
    assert np.abs(np.diff(x, axis=0)).max() < 0.02  # no jumps at the knots
    # a straight line is a straight line of coefficients
    line = x @ np.arange(P.BASIS)
    assert np.diff(line) == pytest.approx(np.full(700, 7 / 700))


def test_smooth_trend_without_penalty_is_the_regression_spline(spark):
    y = noisy(4, 150)
    fitted, coefs, choice = P.smooth_trend(spark.createDataFrame(series("a", y), SERIES), {}, penalties=[0.0])
    beta, _, mu, _ = dense(_basis(spark, 150), y.astype(float))
    rows = sorted(fitted.collect(), key=lambda r: r.start_date)
    assert [r.fit for r in rows] == pytest.approx(list(mu), rel=1e-5)
    assert choice.first().edf == pytest.approx(P.BASIS, abs=1e-6)


def test_smooth_trend_at_its_limit_is_a_straight_line(spark):
    y = noisy(5, 150)
    df = spark.createDataFrame(series("a", y), SERIES)
    fitted, _, choice = P.smooth_trend(df, {}, penalties=[1e7])
    x = np.column_stack([np.ones(150), np.arange(150)])
    rows = sorted(fitted.collect(), key=lambda r: r.start_date)
    assert [r.fit for r in rows] == pytest.approx(list(dense(x, y.astype(float))[2]), rel=1e-3)
    assert choice.first().edf == pytest.approx(2, abs=1e-2)


def test_penalty_is_chosen_by_generalised_cross_validation(spark):
    counts = {"wavy": noisy(6, 300, lambda i: 20 + 15 * math.sin(i / 15)), "flat": noisy(7, 300, lambda i: 6)}
    df = spark.createDataFrame([r for k, c in counts.items() for r in series(k, c)], SERIES)
    step = START + T(100)
    _, coefs, choice = P.smooth_trend(df, {"step": step})
    got = {r.endpoint: r for r in choice.collect()}
    after = (np.arange(300) >= 100).astype(float)[:, None]
    x = np.hstack([_basis(spark, 300), after])
    second = np.zeros((8, 11))
    second[:, :10] = np.diff(np.eye(10), 2, axis=0)
    for name, y in counts.items():
        scores = {}
        for penalty in P.PENALTIES:
            beta = np.r_[np.full(10, math.log(y.mean())), 0.0]
            s = penalty * second.T @ second
            for _ in range(60):
                mu = np.exp(x @ beta)
                beta = beta + np.linalg.solve((x * mu[:, None]).T @ x + s, x.T @ (y - mu) - s @ beta)
            mu = np.exp(x @ beta)
            info = (x * mu[:, None]).T @ x
            dev = 2 * float(np.where(y > 0, y * np.log(np.where(y > 0, y, 1) / mu), 0).sum() - (y - mu).sum())
            edf = float(np.trace(np.linalg.solve(info + s, info)))
            scores[penalty] = (300 * dev / (300 - edf) ** 2, edf, beta[-1])
        best = min(scores, key=lambda p: scores[p][0])
        assert got[name].penalty == best and got[name].edf == pytest.approx(scores[best][1], rel=1e-3)
        term = {r.term: r.coef for r in coefs.filter(f"endpoint = '{name}'").collect()}
        assert term["step"] == pytest.approx(scores[best][2], abs=1e-4)
    assert got["wavy"].edf > 5


def test_empty_series(spark):
    empty = spark.createDataFrame([], SERIES)
    assert P.its_poisson(empty, {"step": START})[0].collect() == []
    assert P.smooth_trend(empty, {"step": START})[0].collect() == []
