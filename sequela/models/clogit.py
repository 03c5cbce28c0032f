"""Conditional logistic regression with the likelihood summed on Spark.

Rows are reduced three times before any model code sees them: equal rows of a
stratum become one row with a count, a stratum becomes one array, and equal
strata become one with a weight. Every Newton step is one job that fits all
groups (endpoints, products) and all models over the same table at once; the
driver only solves the small systems.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequela.functions.stats import chi2_tail, two_sided_p
from sequela.models.kernel import Term, step_sums
from sequela.sources.stages import stage, tasks, tasks_for

ROWS_PER_BLOCK = 20_000
# a coefficient whose standard error is that many times what its column's own spread
# would give is not in the data: the likelihood still rises along it
MAX_SCALED_SE = 1e3


@dataclass
class Fit:
    """One model of one group. Coefficients that cannot be estimated are None, and all are None
    where the steps did not converge."""

    group: tuple[str, ...]
    model: str
    terms: tuple[Term, ...]
    coef: list[float | None]
    se: list[float | None]
    loglik_null: float
    loglik: float
    n_strata: int
    n_events: int
    converged: bool

    @property
    def df(self) -> int:
        return sum(c is not None for c in self.coef)

    def rows(self) -> Iterable[tuple[str, str, float | None, float | None]]:
        """(term, level, coef, se); a factor's reference level has coefficient 0."""
        i = 0
        for term in self.terms:
            if term.levels:
                yield term.name, term.levels[0], 0.0, None
            for level in term.levels[1:] or ("",):
                yield term.name, level, self.coef[i], self.se[i]
                i += 1


def _encoded(terms: Sequence[Term]) -> list[Column]:
    """Level position from 1 (0 = missing) for factors, the value for numbers (NaN = missing).

    A value that is not among a factor's levels is an error, not a missing one.
    """
    cols = []
    for term in terms:
        if term.levels:
            cols.append(F.coalesce(_level_code(F.col(term.name).cast("string"), term), F.lit(0.0)))
        else:
            cols.append(F.coalesce(F.col(term.name).cast("double"), F.lit(float("nan"))))
    return cols


def _level_code(value: Column, term: Term) -> Column:
    """Position of the value among the term's levels; null for null."""
    code = F.array_position(F.array(*[F.lit(level) for level in term.levels]), value)
    unknown = F.raise_error(F.concat(F.lit(f"undeclared level of {term.name}: "), value))
    return F.when(code > 0, code.cast("double")).when(value.isNotNull(), unknown.cast("double"))


def strata_table(
    df: DataFrame,
    by: Sequence[str],
    strata: Sequence[str],
    terms: Sequence[Term],
    event: str = "event",
    offset: Column | None = None,
    count: str | None = None,
) -> DataFrame:
    """One row per distinct stratum: group key ``g``, flat rows ``pattern``, weight ``w``.

    A row stands for one subject, or for as many equal ones as its column ``count`` says.

    A stratum is a matched set or a person's observation time, so its array is
    bounded by the number of controls or of calendar days.
    """
    names = [f"t{i}" for i in range(len(terms))]
    coded = df.select(
        *by,
        *strata,
        F.col(event).cast("double").alias("ev"),
        (F.lit(0.0) if offset is None else offset).alias("off"),
        (F.lit(1) if count is None else F.col(count)).alias("n"),
        *[c.alias(n) for c, n in zip(_encoded(terms), names)],
    )
    coded = stage(coded, "strata-rows")
    parts = tasks_for(coded.count(), coded.sparkSession)
    # dealt by stratum, so that neither the folding nor the arrays are shuffled again
    dealt = coded.repartition(parts, *by, *strata)
    folded = dealt.groupBy(*by, *strata, "ev", "off", *names).agg(
        F.sum("n").cast("double").alias("cnt")
    )
    per_stratum = folded.groupBy(*by, *strata).agg(
        F.flatten(F.sort_array(F.collect_list(F.array("ev", "cnt", "off", *names)))).alias("pattern"),
        F.sum(F.col("ev") * F.col("cnt")).alias("events"),
        F.sum("cnt").alias("size"),
    )
    informative = per_stratum.filter((F.col("events") > 0) & (F.col("events") < F.col("size")))
    return _folded_strata(informative.withColumn("w", F.lit(1)), by, parts)


def strata_from_arrays(
    df: DataFrame, by: Sequence[str], rows: str, terms: Sequence[Term], offset: str, weight: str
) -> DataFrame:
    """Strata table when each input row already holds its stratum as an array of structs."""

    def encode(x: Column) -> Column:
        codes = [
            F.coalesce(_level_code(x[t.name], t), F.lit(0.0)) for t in terms
        ]
        return F.array(
            x["event"].cast("double"), F.lit(1.0), F.log(x[offset].cast("double")), *codes
        )

    listed = df.filter(F.exists(rows, lambda x: x["event"] > 0) & (F.size(rows) > 1))
    patterns = stage(
        listed.select(
            *by, F.flatten(F.transform(rows, encode)).alias("pattern"), F.col(weight).alias("w")
        ),
        "patterns",
    )
    width = 3 + len(terms)
    n = patterns.agg(F.coalesce(F.sum(F.size("pattern")), F.lit(0))).first()[0] // width
    return _folded_strata(patterns, by, tasks_for(n, patterns.sparkSession))


def _folded_strata(per_stratum: DataFrame, by: Sequence[str], parts: int) -> DataFrame:
    # JSON, so that names may hold any character and nulls stay nulls
    key = F.to_json(F.array(*[F.col(b).cast("string") for b in by])) if by else F.lit("[]")
    return (
        per_stratum.select(key.alias("g"), "pattern", "w")
        .repartition(parts, "g", "pattern")
        .groupBy("g", "pattern")
        .agg(F.sum("w").alias("w"))
    )


def _blocks(lengths: np.ndarray) -> Iterable[slice]:
    """Slices of strata with a bounded number of rows."""
    ends = np.cumsum(lengths)
    lo = 0
    while lo < len(lengths):
        base = ends[lo] - lengths[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + ROWS_PER_BLOCK, side="right")))
        yield slice(lo, hi)
        lo = hi


def _step_job(
    strata: DataFrame,
    terms: Sequence[Term],
    models: Mapping[str, Sequence[Term]],
    state: Mapping[tuple[str, str], tuple[np.ndarray, np.ndarray]],
    exact: bool,
) -> dict[tuple[str, str], np.ndarray]:
    """One Newton step for every (group, model) in ``state``: sums over all strata."""
    width = 3 + len(terms)
    place = {t.name: i for i, t in enumerate(terms)}
    at = {m: [place[t.name] for t in ts] for m, ts in models.items()}
    wanted: dict[str, list[str]] = {}
    for g, m in state:
        wanted.setdefault(g, []).append(m)

    def run(batches):
        sums: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            lists = batch.column("pattern")
            rows = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False) // width
            weight = batch.column("w").to_numpy(zero_copy_only=False)
            group = batch.column("g").dictionary_encode()
            codes = group.indices.to_numpy(zero_copy_only=False)
            row_code = np.repeat(codes, lengths)
            for code, g in enumerate(group.dictionary.to_pylist()):
                if g not in wanted:
                    continue
                mine = codes == code
                own_rows, own_len, own_w = rows[row_code == code], lengths[mine], weight[mine]
                ends = np.concatenate(([0], np.cumsum(own_len)))
                for part in _blocks(own_len):
                    block = own_rows[ends[part.start] : ends[part.stop]]
                    seg = np.repeat(np.arange(part.stop - part.start), own_len[part])
                    for m in wanted[g]:
                        beta, dropped = state[g, m]
                        one = step_sums(
                            block, seg, own_w[part], models[m], at[m], beta, dropped, exact
                        )
                        sums[g, m] = sums.get((g, m), 0.0) + one
        for (g, m), packed in sums.items():
            filled = np.flatnonzero(packed)
            yield pa.RecordBatch.from_pydict(
                {
                    "g": pa.array([g] * len(filled), pa.string()),
                    "m": pa.array([m] * len(filled), pa.string()),
                    "i": pa.array(filled, pa.int64()),
                    "v": pa.array(packed[filled], pa.float64()),
                }
            )

    parts = strata.mapInArrow(run, "g string, m string, i long, v double")
    totals = parts.groupBy("g", "m", "i").agg(F.sum("v").alias("v")).collect()
    out = {k: np.zeros(3 + 3 * len(b) + len(b) ** 2) for k, (b, _) in state.items()}
    for row in totals:
        out[row.g, row.m][row.i] = row.v
    return out


def _solve(info: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Newton direction, covariance and estimable columns; a column that earlier ones explain is not.

    Columns are scaled by their information, so their units do not matter.
    """
    p = len(grad)
    usable = np.zeros(p, dtype=bool)
    scale = np.sqrt(np.maximum(np.diag(info), 0))
    inverse_scale = np.divide(1.0, scale, out=np.zeros(p), where=scale > 0)
    work = info * inverse_scale[:, None] * inverse_scale[None, :]
    scaled = work.copy()
    for j in range(p):
        if work[j, j] > 1e-9:
            usable[j] = True
            factor = work[:, j] / work[j, j]
            factor[: j + 1] = 0.0
            work -= factor[:, None] * work[j][None, :]
    step, cov = np.zeros(p), np.zeros((p, p))
    if usable.any():
        back = inverse_scale[usable]
        inverse = np.linalg.inv(scaled[np.ix_(usable, usable)]) * back[:, None] * back[None, :]
        cov[np.ix_(usable, usable)] = inverse
        step[usable] = inverse @ grad[usable]
    return step, cov, usable


@dataclass
class _Newton:
    """Iteration state of one (group, model)."""

    beta: np.ndarray
    dropped: np.ndarray
    null: float = float("nan")
    start_info: np.ndarray = field(default_factory=lambda: np.zeros(0))
    last: tuple[np.ndarray, float] | None = None
    halvings: int = 0
    done: bool = False
    converged: bool = False
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def advance(self, sums: np.ndarray, tol: float) -> None:
        p, loglik = len(self.beta), sums[2]
        if self.last is not None and loglik < self.last[1] - 1e-10 * abs(self.last[1]):
            if self.halvings < 12:
                self.halvings += 1
                self.beta = (self.beta + self.last[0]) / 2
                return
            # no better point along the step: stay at the last one, unconverged
            self.beta, self.done = self.last[0], True
            return
        small = self.last is not None and abs(loglik - self.last[1]) <= tol * max(abs(loglik), 1e-8)
        self.sums = sums
        if small or sums[1] == 0 or p == 0:
            self.done = self.converged = True
            return
        self.last, self.halvings = (self.beta, loglik), 0
        step, _, _ = _solve(sums[3 + 3 * p :].reshape(p, p), sums[3 : 3 + p])
        self.beta = self.beta + step


def fit(
    strata: DataFrame,
    terms: Sequence[Term],
    models: Mapping[str, Sequence[str]],
    ties: str = "efron",
    tol: float = 1e-9,
    max_iter: int = 25,
) -> list[Fit]:
    """Fit every model (a list of term names) in every group of the strata table."""
    by_name = {t.name: t for t in terms}
    chosen = {m: tuple(by_name[n] for n in names) for m, names in models.items()}
    exact = ties == "exact"
    # staged, so that a lost partition is read again; every step works through all rows, so all cores get some
    kept = stage(strata.repartition(tasks(strata.sparkSession)))
    groups = [r.g for r in kept.select("g").distinct().collect()]
    states: dict[tuple[str, str], _Newton] = {}
    for g in groups:
        for m, ts in chosen.items():
            p = sum(t.width for t in ts)
            states[g, m] = _Newton(np.zeros(p), np.zeros(p, dtype=bool))
    if states:
        start = {k: (s.beta, s.dropped) for k, s in states.items()}
        for (g, m), sums in _step_job(kept, terms, chosen, start, exact).items():
            _drop_empty(states[g, m], chosen[m], sums)
    for _ in range(max_iter):
        open_ = {k: (s.beta, s.dropped) for k, s in states.items() if not s.done}
        if not open_:
            break
        for key, sums in _step_job(kept, terms, chosen, open_, exact).items():
            states[key].advance(sums, tol)
    return [_finish(g, m, chosen[m], s) for (g, m), s in sorted(states.items())]


def _drop_empty(state: _Newton, terms: Sequence[Term], sums: np.ndarray) -> None:
    """Mark levels without an event, whose coefficient has no finite estimate."""
    p = len(state.beta)
    state.null = sums[2]
    state.start_info = np.diag(sums[3 + 3 * p :].reshape(p, p))
    factor = np.array([bool(t.levels) for t in terms for _ in range(t.width)], dtype=bool)
    state.dropped = factor & (sums[3 + p : 3 + 2 * p] == 0)
    if not state.dropped.any():
        state.advance(sums, 0.0)


def _without_reference(terms: Sequence[Term], sums: np.ndarray) -> np.ndarray:
    """Columns of factors whose reference level has no event, so that nothing can be compared with it."""
    p, at = sum(t.width for t in terms), 0
    events, out = sums[3 + p : 3 + 2 * p], np.zeros(p, dtype=bool)
    for term in terms:
        if term.levels:
            out[at : at + term.width] = events[at : at + term.width].sum() >= sums[1] > 0
        at += term.width
    return out


def _finish(g: str, m: str, terms: tuple[Term, ...], state: _Newton) -> Fit:
    p = len(state.beta)
    sums = state.sums if len(state.sums) else np.zeros(3 + 3 * p + p * p)
    _, cov, usable = _solve(sums[3 + 3 * p :].reshape(p, p), sums[3 : 3 + p])
    se = np.sqrt(np.clip(np.diag(cov), 0, None))
    spread = np.sqrt(np.clip(state.start_info, 0, None)) if len(state.start_info) else np.zeros(p)
    good = usable & ~state.dropped & (se * spread < MAX_SCALED_SE) & state.converged
    good &= ~_without_reference(terms, sums)
    return Fit(
        group=tuple(json.loads(g)),
        model=m,
        terms=terms,
        coef=[float(b) if ok else None for b, ok in zip(state.beta, good)],
        se=[float(s) if ok else None for s, ok in zip(se, good)],
        loglik_null=float(state.null),
        loglik=float(sums[2]),
        n_strata=int(round(sums[0])),
        n_events=int(round(sums[1])),
        converged=state.converged,
    )


def coef_table(spark: SparkSession, fits: Sequence[Fit], by: Sequence[str]) -> DataFrame:
    """Coefficients of all fits, one row per group, model, term and level."""
    rows = []
    for f in fits:
        for term, level, coef, se in f.rows():
            p = None if coef is None or not se else two_sided_p(coef / se)
            rows.append((*f.group, f.model, term, level, coef, se, p, f.converged))
    schema = ", ".join([*(f"{b} string" for b in by), "model string, term string, level string"])
    return spark.createDataFrame(rows, schema + ", coef double, se double, p double, converged boolean")


def lr_test(larger: Fit, smaller: Fit) -> tuple[float, int, float]:
    """Likelihood-ratio statistic, degrees of freedom and p value of nested fits."""
    chi2, df = 2 * (larger.loglik - smaller.loglik), larger.df - smaller.df
    return chi2, df, chi2_tail(chi2, df) if df > 0 else float("nan")
