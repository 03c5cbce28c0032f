"""Sums of one Newton step over a block of strata, in numpy.

A block is a matrix of rows (event, count, offset, term values...) with the
strata contiguous. ``count`` is how many equal subjects a row stands for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

EVENT, COUNT, OFFSET, FIRST_TERM = 0, 1, 2, 3
# information that is that much smaller than the second moment is rounding
FLAT = 1e-14


@dataclass(frozen=True)
class Term:
    """A factor with its levels (reference first), or a number (no levels)."""

    name: str
    levels: tuple[str, ...] = ()

    @property
    def width(self) -> int:
        return len(self.levels) - 1 if self.levels else 1


def design(rows: np.ndarray, terms: Sequence[Term], at: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Design matrix of the terms, and which rows have all of them."""
    cols, known = [np.zeros((len(rows), 0))], np.ones(len(rows), dtype=bool)
    for term, position in zip(terms, at):
        value = rows[:, FIRST_TERM + position]
        if term.levels:
            known &= value > 0
            cols.append(value[:, None] == np.arange(2, len(term.levels) + 1)[None, :])
        else:
            known &= ~np.isnan(value)
            cols.append(value[:, None])
    return np.concatenate(cols, axis=1).astype(float), known


def _by_stratum(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def step_sums(
    rows: np.ndarray,
    seg: np.ndarray,
    weight: np.ndarray,
    terms: Sequence[Term],
    at: Sequence[int],
    beta: np.ndarray,
    dropped: np.ndarray,
    exact: bool,
) -> np.ndarray:
    """Packed sums over strata: counts, log likelihood, gradient, information.

    ``weight`` says how many equal strata each stratum stands for. Rows at a
    dropped level leave the risk sets, which is the limit of a coefficient that
    goes to minus infinity.
    """
    p = len(beta)
    out = np.zeros(3 + 3 * p + p * p)
    x, keep = design(rows, terms, at)
    if dropped.any():
        keep &= ~(x[:, dropped] > 0).any(axis=1)
    x, rows, seg = x[keep], rows[keep], seg[keep]
    n_event = np.bincount(seg, rows[:, EVENT] * rows[:, COUNT], minlength=len(weight))
    n_all = np.bincount(seg, rows[:, COUNT], minlength=len(weight))
    useful = (n_event > 0) & (n_all > n_event)
    inside = useful[seg]
    x, rows, seg = x[inside], rows[inside], seg[inside]
    if not len(rows):
        return out
    starts = np.flatnonzero(np.diff(seg, prepend=-1))
    ids = seg[starts]
    local = np.cumsum(np.diff(seg, prepend=seg[0]) != 0)
    w, d = weight[ids].astype(float), n_event[ids]
    count = rows[:, COUNT]
    event_count = rows[:, EVENT] * count
    eta = x @ beta + rows[:, OFFSET]
    top = np.maximum.reduceat(eta, starts)
    risk = count * np.exp(eta - top[local])
    event_x = x.T @ (event_count * w[local])
    loglik = float(w @ (_by_stratum(event_count * eta, starts) - d * top))
    grad, info, second = event_x.copy(), np.zeros((p, p)), np.zeros(p)

    many = (d > 1) if exact else np.zeros(len(d), dtype=bool)
    single = ~many[local]
    loglik += _efron(x, risk * single, risk * rows[:, EVENT] * single, d * ~many, w, local, starts, grad, info, second)
    if many.any():
        loglik += _exact(x, rows, eta - top[local], local, many, d, w, grad, info, second)
    # a column that is constant within the strata has no information but for rounding
    flat = np.diag(info) <= FLAT * second
    grad[flat], info[flat, :], info[:, flat] = 0, 0, 0

    out[0], out[1], out[2] = w.sum(), w @ d, loglik
    out[3 : 3 + p] = grad
    out[3 + p : 3 + 2 * p] = event_x
    out[3 + 2 * p : 3 + 3 * p] = x.T @ (count * w[local])
    out[3 + 3 * p :] = info.ravel()
    return out


def _efron(x, risk, event_risk, d, w, local, starts, grad, info, second) -> float:
    """Efron sums; with one event per stratum this is the exact likelihood."""
    total = _by_stratum(risk, starts)
    total_x = _by_stratum(risk[:, None] * x, starts)
    tied = _by_stratum(event_risk, starts)
    tied_x = _by_stratum(event_risk[:, None] * x, starts)
    loglik = 0.0
    for taken in range(int(d.max(initial=0))):
        on = d > taken
        part = np.divide(taken, d, out=np.zeros_like(d), where=on)
        z = np.where(on, total - part * tied, 1.0)
        mean = (total_x - part[:, None] * tied_x) / z[:, None]
        share = np.where(on, w, 0.0)
        loglik -= float(share @ np.log(z))
        grad -= share @ mean
        row_weight = (risk - part[local] * event_risk) * (share / z)[local]
        whole = (x * row_weight[:, None]).T @ x
        info += whole - (mean * share[:, None]).T @ mean
        second += np.diag(whole)
    return loglik


def _exact(x, rows, eta, local, many, d, w, grad, info, second) -> float:
    """Exact sums for strata with several events.

    The sum over all subsets of d subjects follows a recursion over the
    subjects; it runs for all strata with the same d at once, with its first
    and second derivatives.
    """
    loglik, p = 0.0, x.shape[1]
    repeat = rows[:, COUNT].astype(int)
    x, eta, local = (np.repeat(v, repeat, axis=0) for v in (x, eta, local))
    for n_event in np.unique(d[many]):
        ids = np.flatnonzero(many & (d == n_event))
        k = int(n_event)
        lookup = np.full(len(d), -1)
        lookup[ids] = np.arange(len(ids))
        mine = lookup[local] >= 0
        where, xs, ws = lookup[local[mine]], x[mine], np.exp(eta[mine])
        size = np.bincount(where, minlength=len(ids))
        place = np.arange(len(where)) - np.concatenate(([0], np.cumsum(size)[:-1]))[where]
        padded_w = np.zeros((len(ids), size.max()))
        padded_x = np.zeros((len(ids), size.max(), p))
        padded_w[where, place], padded_x[where, place] = ws, xs
        e = np.zeros((k + 1, len(ids)))
        g = np.zeros((k + 1, len(ids), p))
        h = np.zeros((k + 1, len(ids), p, p))
        e[0] = 1.0
        for i in range(size.max()):
            wi, xi = padded_w[:, i], padded_x[:, i]
            outer = xi[:, :, None] * xi[:, None, :]
            for j in range(k, 0, -1):
                cross = xi[:, :, None] * g[j - 1][:, None, :]
                second = h[j - 1] + cross + cross.transpose(0, 2, 1)
                h[j] += wi[:, None, None] * (second + e[j - 1][:, None, None] * outer)
                g[j] += wi[:, None] * (g[j - 1] + e[j - 1][:, None] * xi)
                e[j] += wi * e[j - 1]
        share, mean = w[ids], g[k] / e[k][:, None]
        loglik -= float(share @ np.log(e[k]))
        grad -= share @ mean
        whole = np.einsum("s,sij->ij", share / e[k], h[k])
        info += whole - (mean * share[:, None]).T @ mean
        second += np.diag(whole)
    return loglik
