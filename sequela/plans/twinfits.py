"""SQL text of conditional fits with many coefficients, for DuckDB.

Strata have one event each, so every tie rule gives the same likelihood. Rows hold their design as a list of
(column, value). Newton steps follow one another as tables; a step adds up the information by pairs of columns,
lays it out as lists of lists and eliminates pivot by pivot. A group stays where its likelihood no longer changes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

TOLERANCE, PIVOT, FLAT, MAX_SCALED_SE, HALVINGS, MAX_STEPS = 1e-9, 1e-9, 1e-14, 1e3, 12, 25


def _columns(terms: Sequence[tuple[str, Sequence[str]]]) -> tuple[str, list[tuple[int, str, str, bool]]]:
    """SQL list of a row's (column, value), and (column, term, level, is a factor's) of all columns."""
    parts, every, at = [], [], 0
    for name, levels in terms:
        if levels:
            listed = "[" + ", ".join(f"'{v}'" for v in levels) + "]"
            place = f"list_position({listed}, CAST({name} AS VARCHAR))"
            parts.append(f"CASE WHEN {place} > 1 THEN {{'j': ({at} + {place} - 1)::INTEGER, 'v': 1.0::DOUBLE}} END")
            every += [(at + i, name, level, True) for i, level in enumerate(levels[1:], 1)]
            at += len(levels) - 1
        else:
            parts.append(f"CASE WHEN {name} <> 0 THEN {{'j': {at + 1}, 'v': {name}::DOUBLE}} END")
            every.append((at + 1, name, "", False))
            at += 1
    return f"list_filter([{', '.join(parts)}], lambda c: c IS NOT NULL)", every


def _eliminated(matrix: str) -> str:
    """The rows of ``matrix`` after elimination over its first p pivots that are not flat."""
    j = "at_[1][1]::INTEGER"
    return f"""list_reduce(list_prepend({matrix}, list_transform(range(1, p + 1), lambda j: [[j::DOUBLE]])),
      lambda a, at_: CASE WHEN a[{j}][{j}] > {PIVOT} THEN
        list_transform(a, lambda row, i: CASE WHEN i = {j} THEN list_transform(row, lambda v: v / row[{j}])
          ELSE list_transform(row, lambda v, k: v - row[{j}] / a[{j}][{j}] * a[{j}][k]) END)
      ELSE a END)"""


def conditional_fits(
    mark: str,
    source: str,
    stratum: str,
    models: Mapping[str, Sequence[tuple[str, Sequence[str]]]],
    event: str = "event",
    count: str = "1",
    where: Mapping[str, str] | None = None,
    steps: int = 12,
) -> dict[str, str]:
    """Tables by name; ``{mark}_fit`` is (endpoint, model, j, term, level, b, se, converged), null where not estimable.

    ``models`` are lists of terms (column, levels; no levels: a number). Rows with a missing term are left
    out of that model; levels without an event leave the risk sets. ``{mark}_loglik`` is (g, loglik, df).
    """
    out: dict[str, str] = {}
    rows, named = [], []
    for model, terms in models.items():
        cols, every = _columns(terms)
        known = " AND ".join([f"{t} IS NOT NULL" for t, _ in terms] + [(where or {}).get(model, "true")])
        rows.append(
            f"SELECT endpoint || '|{model}' AS g, {stratum} AS s, {event}::DOUBLE AS ev, ({count})::DOUBLE AS cnt, {cols} AS cols"
            f" FROM {source} WHERE {known}"
        )
        named += [f"('{model}', {j}, '{t}', '{lv}', {str(f).lower()})" for j, t, lv, f in every]
    out[f"{mark}_names"] = f"SELECT * FROM (VALUES {', '.join(named)}) t(model, j, term, level, factor)"
    useful = "sum(ev * cnt) OVER st > 0 AND sum(ev * cnt) OVER st < sum(cnt) OVER st"
    window = "WINDOW st AS (PARTITION BY g, s)"
    out[f"{mark}_all"] = " UNION ALL ".join(rows)
    out[f"{mark}_use"] = f"SELECT * FROM {mark}_all {window} QUALIFY {useful}"
    out[f"{mark}_cols"] = f"""SELECT g, n.* FROM (SELECT DISTINCT g FROM {mark}_use) JOIN {mark}_names n
        ON n.model = split_part(g, '|', 2)"""
    out[f"{mark}_drop"] = f"""SELECT c.g, c.j FROM {mark}_cols c
        LEFT JOIN (SELECT g, c.j, sum(ev * cnt) AS e FROM (SELECT g, ev, cnt, unnest(cols) AS c FROM {mark}_use) GROUP BY ALL) e
        USING (g, j) WHERE c.factor AND coalesce(e.e, 0) = 0"""
    out[f"{mark}_lost"] = f"SELECT g, list(j) AS js FROM {mark}_drop GROUP BY g"
    out[f"{mark}_in"] = f"""SELECT a.* FROM {mark}_use a LEFT JOIN {mark}_lost d USING (g)
        WHERE d.js IS NULL OR NOT list_has_any(d.js, list_transform(a.cols, lambda c: c.j))"""
    out[f"{mark}_rows"] = f"""SELECT row_number() OVER () AS r, * FROM (SELECT * FROM {mark}_in {window} QUALIFY {useful})"""
    out[f"{mark}_p"] = f"SELECT g, max(j) AS p FROM {mark}_cols GROUP BY g"
    # spread of each column at the start, over all rows
    out[f"{mark}_start"] = f"""SELECT g, j, sum(q - m * m) AS spread FROM (
          SELECT g, s, c.j AS j, sum(share * c.v) AS m, sum(share * c.v * c.v) AS q FROM (
            SELECT g, s, cnt / sum(cnt) OVER (PARTITION BY g, s) AS share, unnest(cols) AS c FROM {mark}_use) GROUP BY ALL)
        GROUP BY ALL"""
    out[f"{mark}_events"] = f"""SELECT g, c.j AS j, sum(ev * cnt * c.v) AS e FROM (
          SELECT g, ev, cnt, unnest(cols) AS c FROM {mark}_rows) GROUP BY ALL"""
    out[f"{mark}_b0"] = f"""SELECT g, p, list_transform(range(0, p), lambda i: 0.0::DOUBLE) AS b, NULL::DOUBLE[] AS was, NULL::DOUBLE AS last,
        0 AS halved, false AS done, false AS fitted FROM {mark}_p"""
    for k in range(steps + 1):
        b = f"{mark}_b{k}"
        # measured from the stratum's largest, so that likelihoods near 0 keep their digits
        out[f"{mark}_e{k}"] = f"""SELECT r, g, s, ev, cnt, cols, eta, cnt * exp(eta) AS risk,
            sum(cnt * exp(eta)) OVER (PARTITION BY g, s) AS z FROM (
              SELECT * REPLACE (eta - max(eta) OVER (PARTITION BY g, s) AS eta) FROM (
                SELECT a.*, coalesce(list_sum(list_transform(a.cols, lambda c: t.b[c.j] * c.v)), 0) AS eta
                FROM {mark}_rows a JOIN {b} t USING (g) {'WHERE NOT t.done' if k < steps else ''}))"""
        out[f"{mark}_l{k}"] = f"""SELECT g, sum(ev * cnt * eta) - sum(risk / z * ln(z)) AS loglik FROM {mark}_e{k} GROUP BY g"""
        out[f"{mark}_m{k}"] = f"""SELECT g, s, c.j AS j, sum(share * c.v) AS m FROM (
              SELECT g, s, risk / z AS share, unnest(cols) AS c FROM {mark}_e{k}) GROUP BY ALL"""
        out[f"{mark}_q{k}"] = f"""SELECT g, x.j AS j, y.j AS k, sum(share * x.v * y.v) AS q FROM (
              SELECT g, cols, share, x, unnest(cols) AS y FROM (
                SELECT g, cols, risk / z AS share, unnest(cols) AS x FROM {mark}_e{k})) GROUP BY ALL"""
        out[f"{mark}_i{k}"] = f"""SELECT g, j, k, sum(v) AS v FROM (
              SELECT g, j, k, q AS v FROM {mark}_q{k}
              UNION ALL SELECT a.g, a.j, c.j, -sum(a.m * c.m) FROM {mark}_m{k} a JOIN {mark}_m{k} c USING (g, s) GROUP BY ALL) GROUP BY ALL"""
        # columns that are constant within the strata have no information but for rounding
        out[f"{mark}_d{k}"] = f"""SELECT i.g, i.j, CASE WHEN i.v > {FLAT} * q.q THEN 1 / sqrt(i.v) ELSE 0 END AS scale
              FROM {mark}_i{k} i JOIN {mark}_q{k} q USING (g, j, k) WHERE i.j = i.k"""
        out[f"{mark}_g{k}"] = f"""SELECT e.g, e.j, e.e - coalesce(m.m, 0) AS u FROM (
              SELECT c.g, c.j, coalesce(v.e, 0) AS e FROM {mark}_cols c LEFT JOIN {mark}_events v USING (g, j)) e
              LEFT JOIN (SELECT g, j, sum(m) AS m FROM {mark}_m{k} GROUP BY ALL) m USING (g, j)"""
        out[f"{mark}_x{k}"] = f"""SELECT g, p, list(cells ORDER BY j) AS matrix, list(scale ORDER BY j) AS scale FROM (
              SELECT t.g, t.p, a.j, any_value(coalesce(da.scale, 0)) AS scale,
                list(coalesce(i.v * da.scale * dc.scale, 0) ORDER BY c.j) AS line, any_value(coalesce(u.u * da.scale, 0)) AS gradient,
                list_concat(line, {'[gradient]' if k < steps else 'list_transform(range(1, t.p + 1), lambda n: CASE WHEN n = a.j THEN 1.0::DOUBLE ELSE 0 END)'}) AS cells
              FROM {mark}_p t JOIN {mark}_cols a USING (g) JOIN {mark}_cols c ON c.g = a.g
              LEFT JOIN {mark}_i{k} i ON i.g = a.g AND i.j = a.j AND i.k = c.j
              LEFT JOIN {mark}_d{k} da ON da.g = a.g AND da.j = a.j LEFT JOIN {mark}_d{k} dc ON dc.g = a.g AND dc.j = c.j
              LEFT JOIN {mark}_g{k} u ON u.g = a.g AND u.j = a.j GROUP BY t.g, t.p, a.j) GROUP BY g, p"""
        if k < steps:
            # after levels have been dropped a fit has the steps from 0 once more, so one less in all
            late = f" AND t.g NOT IN (SELECT g FROM {mark}_lost)" if k >= MAX_STEPS else ""
            # where the likelihood fell, half the way back to the last point, at most twelve times
            out[f"{mark}_b{k + 1}"] = f"""SELECT t.g, t.p,
              CASE WHEN fell AND halved < {HALVINGS} THEN list_transform(t.b, lambda v, i: (v + t.was[i]) / 2) WHEN fell THEN t.was
                   WHEN near THEN t.b ELSE list_transform(t.b, lambda v, i:
                v + CASE WHEN solved[i][i] > 0.5 THEN solved[i][t.p + 1] * scale[i] ELSE 0 END) END AS b,
              CASE WHEN fell OR near THEN t.was ELSE t.b END AS was, CASE WHEN fell THEN t.last ELSE loglik END AS last,
              CASE WHEN fell THEN halved + 1 ELSE 0 END AS halved, near OR fell AND halved >= {HALVINGS} AS done, near AS fitted FROM (
                SELECT t.*, l.loglik, x.scale, {_eliminated('x.matrix').replace('range(1, p + 1)', 'range(1, t.p + 1)')} AS solved,
                  t.last IS NOT NULL AND l.loglik < t.last - 1e-10 * abs(t.last) AS fell,
                  NOT fell AND t.last IS NOT NULL AND abs(l.loglik - t.last) <= {TOLERANCE} * greatest(abs(l.loglik), 1e-8){late} AS near
                FROM {b} t JOIN {mark}_l{k} l USING (g) JOIN {mark}_x{k} x USING (g)) t
              UNION ALL SELECT * FROM {b} WHERE done"""
    # steps that are over keep their place, so the last tables hold the sums of every group at its end
    last = f"{mark}_b{steps}"
    out[f"{mark}_inverse"] = f"SELECT g, p, scale, {_eliminated('matrix')} AS solved FROM {mark}_x{steps}"
    # a factor whose reference level has no event
    out[f"{mark}_none"] = f"""SELECT c.g, c.term FROM {mark}_cols c LEFT JOIN {mark}_events e USING (g, j)
        JOIN (SELECT g, sum(ev * cnt) AS total FROM {mark}_rows GROUP BY g) t USING (g)
        WHERE c.factor GROUP BY c.g, c.term, t.total HAVING sum(coalesce(e.e, 0)) = t.total"""
    out[f"{mark}_fit"] = f"""SELECT split_part(c.g, '|', 1) AS endpoint, c.model, c.j, c.term, c.level, t.fitted AS converged,
        CASE WHEN ok THEN t.b[c.j] END AS b, CASE WHEN ok THEN se END AS se FROM (
          SELECT c.*, sqrt(greatest(v.solved[c.j][v.p + c.j], 0)) * v.scale[c.j] AS se,
            t.fitted AND d.j IS NULL AND o.term IS NULL AND v.solved[c.j][c.j] > 0.5
              AND sqrt(greatest(v.solved[c.j][v.p + c.j], 0)) * v.scale[c.j] * sqrt(greatest(coalesce(w.spread, 0), 0)) < {MAX_SCALED_SE} AS ok
          FROM {mark}_cols c JOIN {mark}_inverse v USING (g) JOIN {last} t USING (g)
          LEFT JOIN {mark}_drop d USING (g, j) LEFT JOIN {mark}_none o USING (g, term) LEFT JOIN {mark}_start w USING (g, j)) c JOIN {last} t USING (g)"""
    out[f"{mark}_loglik"] = f"SELECT l.g, l.loglik FROM {mark}_l{steps} l"
    return out


def effects_sql(mark: str, models: Mapping[str, Sequence[tuple[str, Sequence[str]]]]) -> str:
    """(endpoint, model, term, level, b, se, converged) with the factors' reference levels at 0."""
    refs = [f"('{m}', '{t}', '{levels[0]}')" for m, terms in models.items() for t, levels in terms if levels]
    sql = f"SELECT endpoint, model, term, level, b, se, converged FROM {mark}_fit"
    if refs:
        sql += f""" UNION ALL SELECT f.endpoint, f.model, r.term, r.level, 0.0, NULL, f.converged
          FROM (SELECT DISTINCT endpoint, model, converged FROM {mark}_fit) f JOIN (VALUES {', '.join(refs)}) r(model, term, level) USING (model)"""
    return sql
