"""Poisson regressions of many series at once: interrupted time series and smooth trends.

All groups (endpoints) and all models of them (sets of columns, penalties) are fitted side by side. A step
of the iteratively reweighted least squares is one Spark job: tasks add up the weighted cross products of their rows
by group and model, Spark sums these by key, and the driver solves the small systems.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sequela.models.clogit import _solve
from sequela.sources.stages import stage

# Month names in alphabetical order, the first one there is the reference.
MONTHS = (
    "April", "August", "December", "February", "January", "July",
    "June", "March", "May", "November", "October", "September",
)
NORMAL_95 = 1.96
#: Functions of the smooth trend's basis, and the penalties that are tried.
BASIS = 10
PENALTIES = tuple(10.0**k for k in range(-3, 8))
INTERCEPT = "(Intercept)"


@dataclass
class Model:
    """Columns of a model by name, and the penalty on the squared second differences of some of them."""

    names: Sequence[str]
    penalty: float = 0.0
    smooth: Sequence[str] = ()

    def penalties(self) -> np.ndarray:
        out = np.zeros((len(self.names), len(self.names)))
        at = [list(self.names).index(n) for n in self.smooth]
        if self.penalty and len(at) > 2:
            second = np.diff(np.eye(len(at)), 2, axis=0)
            out[np.ix_(at, at)] = self.penalty * second.T @ second
        return out


@dataclass
class PoissonFit:
    """A fitted model of a group; coefficients of columns that others explain are None."""

    group: str
    model: str
    names: tuple[str, ...]
    beta: np.ndarray
    cov: np.ndarray
    usable: np.ndarray
    n: float
    deviance: float
    edf: float
    converged: bool

    @property
    def gcv(self) -> float:
        """Generalised cross-validation score."""
        return self.n * self.deviance / (self.n - self.edf) ** 2 if self.n > self.edf else float("inf")

    def rows(self) -> list[tuple]:
        se = np.sqrt(np.clip(np.diag(self.cov), 0, None))
        return [
            (self.group, name, float(b) if ok else None, float(s) if ok else None)
            for name, b, s, ok in zip(self.names, self.beta, se, self.usable)
        ]


@dataclass
class _State:
    beta: np.ndarray
    penalty: np.ndarray
    last: tuple[np.ndarray, float] | None = None
    halvings: int = 0
    done: bool = False
    converged: bool = False
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def advance(self, sums: np.ndarray, tol: float) -> None:
        """One step from the sums at ``beta``; half a step back where the penalised likelihood fell."""
        p = len(self.beta)
        score = sums[1] - 0.5 * float(self.beta @ self.penalty @ self.beta)
        if self.last is not None and not score >= self.last[1] - 1e-10 * abs(self.last[1]):
            self.halvings += 1
            if self.halvings > 20:
                self.beta, self.done = self.last[0], True
            else:
                self.beta = (self.beta + self.last[0]) / 2
            return
        self.sums = sums
        if self.last is not None and abs(score - self.last[1]) <= tol * (abs(score) + tol):
            self.done = self.converged = True
            return
        self.last, self.halvings = (self.beta, score), 0
        info = sums[3 + p :].reshape(p, p) + self.penalty
        self.beta = self.beta + _solve(info, sums[3 : 3 + p] - self.penalty @ self.beta)[0]


def _sums(table: DataFrame, at: Mapping[tuple[str, str], list[int]], betas: Mapping[tuple[str, str], np.ndarray]) -> dict:
    """Per (group, model): rows, log likelihood, deviance, gradient and information at ``betas``."""
    wanted: dict[str, list[str]] = {}
    for g, m in betas:
        wanted.setdefault(g, []).append(m)

    def run(batches):
        total: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            groups = batch.column("g").to_numpy(zero_copy_only=False)
            n = batch.column("n").to_numpy(zero_copy_only=False)
            lists = batch.column("x")
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(n), -1)
            for g in set(groups.tolist()) & set(wanted):
                mine = groups == g
                y, own = n[mine], x[mine]
                for m in wanted[g]:
                    z = own[:, at[g, m]]
                    eta = np.clip(z @ betas[g, m], -700, 700)
                    mu = np.exp(eta)
                    gap = np.where(y > 0, y * (np.log(np.where(y > 0, y, 1)) - eta), 0.0) - (y - mu)
                    head = [len(y), float(y @ eta - mu.sum()), 2 * float(gap.sum())]
                    one = np.concatenate([head, z.T @ (y - mu), ((z * mu[:, None]).T @ z).ravel()])
                    total[g, m] = total.get((g, m), 0.0) + one
        for (g, m), packed in total.items():
            k = len(packed)
            yield pa.RecordBatch.from_pydict(
                {"g": pa.array([g] * k), "m": pa.array([m] * k), "i": pa.array(range(k), pa.int64()), "v": pa.array(packed)}
            )

    parts = table.mapInArrow(run, "g string, m string, i long, v double")
    out = {k: np.zeros(3 + len(b) + len(b) ** 2) for k, b in betas.items()}
    for row in parts.groupBy("g", "m", "i").agg(F.sum("v").alias("v")).collect():
        out[row.g, row.m][row.i] = row.v
    return out


def fit_poisson(
    table: DataFrame,
    names: Sequence[str],
    models: Mapping[tuple[str, str], Model],
    tol: float = 1e-11,
    max_iter: int = 60,
) -> list[PoissonFit]:
    """Fit ``models``, by (group, name), to the rows (g, n, x) of their groups; ``names`` are the columns of x.

    A column that earlier ones of its model explain gets no coefficient. A group without rows, or whose counts are all 0,
    has no finite fit: ``converged`` is false.
    """
    at = {k: [list(names).index(c) for c in m.names] for k, m in models.items()}
    means = {r["g"]: r["mean"] for r in table.groupBy("g").agg(F.avg("n").alias("mean")).collect()}
    states = {}
    for (g, m), model in models.items():
        beta = np.zeros(len(model.names))
        if means.get(g):
            # a constant: the intercept, or the whole basis, whose functions add up to 1
            level = [INTERCEPT] if INTERCEPT in model.names else list(model.smooth)
            beta[[list(model.names).index(c) for c in level]] = np.log(means[g])
        states[g, m] = _State(beta, model.penalties(), done=not means.get(g))
    for _ in range(max_iter):
        open_ = {k: s.beta for k, s in states.items() if not s.done}
        if not open_:
            break
        for key, sums in _sums(table, at, open_).items():
            states[key].advance(sums, tol)
    fits = []
    for (g, m), s in sorted(states.items()):
        p = len(s.beta)
        sums = s.sums if len(s.sums) else np.zeros(3 + p + p * p)
        info = sums[3 + p :].reshape(p, p)
        _, cov, usable = _solve(info + s.penalty, np.zeros(p))
        chosen = tuple(models[g, m].names)
        fits.append(PoissonFit(g, m, chosen, s.beta, cov, usable, float(sums[0]), float(sums[2]), float(np.trace(cov @ info)), s.converged))
    return fits


def fitted_series(table: DataFrame, names: Sequence[str], fits: Sequence[PoissonFit]) -> DataFrame:
    """Rows of ``table`` with the mean of their group's fit and its 95 % limits; null where it did not converge."""
    known = {f.group: ([list(names).index(c) for c in f.names], f.beta, f.cov) for f in fits if f.converged}

    def run(batches):
        for batch in batches:
            groups = batch.column("g").to_pylist()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            mean, se = np.full(len(x), np.nan), np.full(len(x), np.nan)
            for g in set(groups) & set(known):
                mine = np.array([v == g for v in groups])
                at, beta, cov = known[g]
                z = x[mine][:, at]
                mean[mine] = np.exp(z @ beta)
                se[mine] = mean[mine] * np.sqrt(np.clip(np.einsum("ij,jk,ik->i", z, cov, z), 0, None))
            made = [pa.array(v, from_pandas=True) for v in (mean, mean - NORMAL_95 * se, mean + NORMAL_95 * se)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("start_date"), batch.column("n").cast(pa.int64()), *made],
                names=["endpoint", "start_date", "n", "fit", "lcl", "ucl"],
            )

    return table.mapInArrow(run, "endpoint string, start_date date, n long, fit double, lcl double, ucl double")


def _table(daily: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    x = F.array(*[c.cast("double") for c in columns.values()])
    return stage(daily.select(F.col("endpoint").alias("g"), "start_date", F.col("n").cast("double").alias("n"), x.alias("x")))


def _coefs(daily: DataFrame, fits: Sequence[PoissonFit]) -> DataFrame:
    rows = [(*r, f.converged) for f in fits for r in f.rows()]
    return daily.sparkSession.createDataFrame(rows, "endpoint string, term string, coef double, se double, converged boolean")


def its_poisson(
    daily: DataFrame, steps: Mapping[str, date], trend: bool = True, months: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Trend, months and steps of every endpoint's daily counts (endpoint, start_date, n, days, month).

    Returns the series with fitted mean and limits, and the coefficients. Of the months of an endpoint the first
    in the alphabet is the reference; steps and other columns that never change in a series are left out.
    """
    columns = {INTERCEPT: F.lit(1.0)}
    if trend:
        columns["days"] = F.col("days")
    if months:
        columns |= {m: F.col("month") == m for m in MONTHS}
    columns |= {name: F.col("start_date") >= F.lit(day) for name, day in steps.items()}
    table, names = _table(daily, columns), list(columns)
    # per endpoint and column: whether it changes (a row per endpoint)
    changes = [(F.min(F.get("x", F.lit(i))) < F.max(F.get("x", F.lit(i)))).alias(f"c{i}") for i in range(len(names))]
    seen = [(F.max(F.get("x", F.lit(i))) > 0).alias(f"s{i}") for i in range(len(names))]
    models = {}
    for row in table.groupBy("g").agg(*changes, *seen).collect():
        there = [m for m in MONTHS if months and row[f"s{names.index(m)}"]]
        own = [c for i, c in enumerate(names) if i == 0 or row[f"c{i}"] and c not in there[:1]]
        models[row["g"], "its"] = Model(own)
    fits = fit_poisson(table, names, models)
    return fitted_series(table, names, fits), _coefs(daily, fits)


def spline_basis(u: Column, size: int = BASIS) -> list[Column]:
    """Cubic B-splines on equal steps from 0 to 1: at each ``u`` four of them, with a sum of 1, are not 0."""
    steps = size - 3
    at = F.least(F.floor(u * steps), F.lit(steps - 1))
    f = u * steps - at
    weights = [(1 - f) ** 3 / 6, (3 * f**3 - 6 * f**2 + 4) / 6, (-3 * f**3 + 3 * f**2 + 3 * f + 1) / 6, f**3 / 6]
    out = []
    for j in range(size):
        value = F.lit(0.0)
        for k, w in enumerate(weights):
            if 0 <= j - k < steps:
                value = F.when(at == j - k, w).otherwise(value)
        out.append(value)
    return out


def smooth_trend(
    daily: DataFrame, steps: Mapping[str, date], penalties: Sequence[float] = PENALTIES, size: int = BASIS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A smooth trend and steps of every endpoint's daily counts.

    The trend is a cubic spline over an endpoint's days with a penalty on the second differences of its coefficients;
    all penalties of all endpoints are fitted together, and each endpoint takes the one with the lowest score of
    generalised cross-validation (the larger of equal ones). Returns the series with fitted mean and limits, the
    coefficients, and the choice: endpoint, penalty, edf, deviance, gcv.
    """
    ends = daily.groupBy("endpoint").agg(F.max("days").alias("_last"))  # a row per endpoint
    spread = daily.join(F.broadcast(ends), "endpoint")
    u = F.col("days") / F.greatest(F.col("_last"), F.lit(1))
    smooth = [f"s(days).{j + 1}" for j in range(size)]
    columns = dict(zip(smooth, spline_basis(u, size)))
    columns |= {name: F.col("start_date") >= F.lit(day) for name, day in steps.items()}
    table, names = _table(spread, columns), list(columns)
    groups = [r["g"] for r in table.select("g").distinct().collect()]
    models = {(g, f"{i:03d}"): Model(names, p, smooth) for g in groups for i, p in enumerate(penalties)}
    best: dict[str, PoissonFit] = {}
    for f in fit_poisson(table, names, models):
        if f.converged and (f.group not in best or f.gcv <= best[f.group].gcv):
            best[f.group] = f
    fits = list(best.values())
    chosen = [(f.group, float(penalties[int(f.model)]), f.edf, f.deviance, f.gcv) for f in fits]
    choice = daily.sparkSession.createDataFrame(
        chosen, "endpoint string, penalty double, edf double, deviance double, gcv double"
    )
    return fitted_series(table, names, fits), _coefs(daily, fits), choice
