"""ANSI SQL twins of the registered queries, for DuckDB over the same tables.

Written independently of the DataFrame plans: windows instead of aggregates,
joins instead of arrays, all pairs where Spark draws ranks.
"""

from __future__ import annotations

import re

from sequela.config import (
    HOSP_LEVELS,
    INFECTION_LEVELS,
    POSITIVE_LEVELS,
    PRODUCT_LEVELS,
    VS_LEVELS,
    VS_TYPE_LEVELS,
    dose_level_names,
)
from sequela.plans.twinfits import conditional_fits, effects_sql

ORACLES: dict[str, str] = {}
#: The statements without the tables they use.
BODIES: dict[str, str] = {}

BEGIN, END, EXTRACT = "DATE '1998-01-01'", "DATE '1998-12-08'", "DATE '1998-12-15'"
ENDPOINT_CODES = (
    "('any_a','ECONOMY'),('any_a','SMALL'),('any_a','PROMO'),('any_b','MEDIUM'),"
    "('any_b','LARGE'),('ECONOMY','ECONOMY'),('STANDARD','STANDARD')"
)
KEYS = "sex, zone, match_age"


def fine(col: str) -> str:
    return (
        f"CASE WHEN {col} < 15 THEN '0-15' WHEN {col} < 20 THEN '15-19' WHEN {col} < 40 THEN '20-39' "
        f"WHEN {col} < 60 THEN '40-59' WHEN {col} < 80 THEN '60-79' WHEN {col} >= 80 THEN '80+' END"
    )


def coarse(col: str) -> str:
    return (
        f"CASE WHEN {col} < 15 THEN '0-15' WHEN {col} < 40 THEN '16-39' WHEN {col} < 60 THEN '40-59' "
        f"WHEN {col} < 80 THEN '60-79' WHEN {col} >= 80 THEN '80+' END"
    )


def r8(expr: str, name: str) -> str:
    return f"round({expr}, 8) + 0.0 AS {name}"


def r6(expr: str, name: str) -> str:
    """For numbers from iterations and simulations."""
    return f"round({expr}, 6) + 0.0 AS {name}"


def hash_int(text: str, digits: int) -> str:
    return f"('0x' || substr(md5({text}), 1, {digits}))::BIGINT"


def normal_p(z: str) -> str:
    """Two-sided normal tail from the series of the error function, whose terms are all positive."""
    x = f"least(greatest(abs({z}) / sqrt(2.0), 1e-300), 8.0)"
    term = f"exp(2 * k * ln(2.0) + (2 * k + 1) * ln({x}) + lgamma(k + 1) - lgamma(2 * k + 2))"
    total = f"list_sum(list_transform(range(0, 250), lambda k: {term}))"
    return f"CASE WHEN ({z}) IS NOT NULL THEN 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * {total} END"


CTES: dict[str, str] = {
    "cohort": """
        SELECT c_custkey AS person_id,
               CASE WHEN (c_custkey // 2) % 2 = 0 THEN 'F' ELSE 'M' END AS sex,
               CAST(14 + 5 * ((c_custkey * 7) % 19) AS BIGINT) AS age_year,
               n_regionkey AS zone, c_mktsegment AS simd,
               CAST(c_custkey % 5 AS BIGINT) AS n_risk_gps,
               CAST(c_custkey % 3 AS BIGINT) AS n_tests_gp,
               CAST(0.5 + (c_custkey % 10) / 10.0 AS DOUBLE) AS weight,
               CAST(15 + c_custkey % 38 AS DOUBLE) AS bmi,
               CAST(c_custkey % 11 = 0 AS BIGINT) AS diag_chd,
               CAST(c_custkey % 13 = 0 AS BIGINT) AS diag_stroke,
               CAST(CASE WHEN (15 + 5 * ((c_custkey * 7) % 19)) >= 100 THEN 100 WHEN (15 + 5 * ((c_custkey * 7) % 19)) >= 95 THEN 97
                    WHEN (15 + 5 * ((c_custkey * 7) % 19)) >= 90 THEN 92
                    WHEN (15 + 5 * ((c_custkey * 7) % 19)) >= 80 THEN (15 + 5 * ((c_custkey * 7) % 19)) // 2 * 2
                    ELSE 15 + 5 * ((c_custkey * 7) % 19) END AS BIGINT) AS match_age
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "deaths": """
        SELECT c_custkey AS person_id,
               CAST(DATE '1998-03-01' + CAST(c_custkey % 400 AS INT) AS DATE) AS death_date
        FROM customer WHERE c_acctbal < 0""",
    "vrec": """
        SELECT o_custkey AS person_id, o_orderkey AS rec_id, CAST(o_orderdate AS DATE) AS date,
               CASE WHEN o_orderkey % 20 = 0 THEN 'UNK'
                    WHEN (o_custkey + CASE WHEN o_orderkey % 25 = 0 THEN 1 ELSE 0 END) % 2 = 0
                    THEN 'PB' ELSE 'AZ' END AS type,
               CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 WHEN 'P' THEN 2 END AS stage
        FROM orders""",
    "vclass": """
        SELECT person_id, rec_id, date, type,
               CASE WHEN type LIKE '%PB%' THEN 'PB' WHEN type = 'AZ' THEN 'AZ' ELSE 'UNK' END AS vacc_type,
               stage, CASE WHEN stage IN (0, 3) THEN 1 ELSE stage END AS dose
        FROM vrec""",
    "vfirst": f"""
        SELECT person_id, dose, date, vacc_type, rec_id FROM vclass WHERE dose IN (1, 2) AND date >= {BEGIN}
        QUALIFY row_number() OVER (PARTITION BY person_id, dose ORDER BY date, rec_id) = 1""",
    "vwide": """
        SELECT a.person_id, a.vacc_type, a.date AS date_vacc_1,
               b.vacc_type AS vacc_type_2, b.date AS date_vacc_2
        FROM (SELECT * FROM vfirst WHERE dose = 1) a
        LEFT JOIN (SELECT * FROM vfirst WHERE dose = 2) b USING (person_id)""",
    "vcons": """
        SELECT * FROM vwide WHERE vacc_type IN ('AZ', 'PB')
          AND (vacc_type_2 IS NULL OR vacc_type_2 IN ('AZ', 'PB'))
          AND NOT (vacc_type_2 IS NOT NULL AND vacc_type_2 <> vacc_type)""",
    "vsame": """
        SELECT person_id, vacc_type, date_vacc_1,
               CASE WHEN date_vacc_2 = date_vacc_1 THEN NULL ELSE vacc_type_2 END AS vacc_type_2,
               CASE WHEN date_vacc_2 = date_vacc_1 THEN NULL ELSE date_vacc_2 END AS date_vacc_2
        FROM vcons""",
    "vacc": "SELECT * FROM vsame WHERE date_vacc_2 IS NULL OR date_vacc_2 > date_vacc_1 + 18",
    "reg": """
        SELECT o_custkey AS person_id, CAST(l_shipdate AS DATE) AS start_date, p_type AS code,
               CAST(14 + 5 * ((o_custkey * 7) % 19) AS BIGINT) AS age,
               CASE WHEN (o_custkey // 2) % 2 = 0 THEN 'F' ELSE 'M' END AS sex
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
        WHERE l_returnflag = 'R'""",
    "consult": f"SELECT * FROM reg WHERE start_date <= {EXTRACT}",
    "ev": f"""
        SELECT g.endpoint, c.* FROM consult c
        JOIN (VALUES {ENDPOINT_CODES}) g(endpoint, code) ON g.code = c.code""",
    "latest": "SELECT max(start_date) AS latest FROM consult",
    "win": f"""
        SELECT ev.* FROM ev, latest
        WHERE start_date >= {BEGIN} AND start_date <= latest - 7""",
    "prior": f"SELECT * FROM ev WHERE start_date < {BEGIN}",
    "recent": f"SELECT * FROM ev WHERE start_date < {BEGIN} AND start_date >= {BEGIN} - 180",
    "incident": """
        SELECT * FROM win w WHERE age >= 16 AND NOT EXISTS (
          SELECT 1 FROM prior p WHERE p.endpoint = w.endpoint AND p.person_id = w.person_id)""",
    "firsts": """
        SELECT * FROM incident
        QUALIFY row_number() OVER (PARTITION BY endpoint, person_id ORDER BY start_date, code) = 1""",
    "oe_ends": "SELECT endpoint, max(start_date) AS a_end FROM incident GROUP BY endpoint",
    "cc_ends": "SELECT endpoint, max(start_date) AS a_end FROM firsts GROUP BY endpoint",
    "tests": """
        SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) + 3 AS specimen_date,
               CASE WHEN o_orderkey % 5 < 2 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS result
        FROM orders WHERE o_orderkey % 4 = 1""",
    "spells": """
        SELECT o_custkey AS person_id, CAST(o_orderdate AS DATE) AS admission_date,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL
                    ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 21 AS INT) END AS discharge_date,
               o_orderkey % 3 = 0 AS emergency
        FROM orders""",
    "analysis": f"""
        SELECT e.endpoint, e.person_id, e.start_date, e.code, e.age, e.sex,
               v.vacc_type, v.date_vacc_1, v.vacc_type_2, v.date_vacc_2, d.death_date, t.specimen_date
        FROM (SELECT * FROM ev WHERE start_date BETWEEN {BEGIN} AND {END}
              QUALIFY row_number() OVER (PARTITION BY endpoint, person_id ORDER BY start_date, code) = 1) e
        JOIN vacc v ON v.person_id = e.person_id AND v.date_vacc_1 <= {END}
        LEFT JOIN deaths d ON d.person_id = e.person_id
        LEFT JOIN (SELECT person_id, min(specimen_date) AS specimen_date FROM tests
                   WHERE result = 'POSITIVE' AND specimen_date BETWEEN {BEGIN} AND {END}
                   GROUP BY person_id) t ON t.person_id = e.person_id
        WHERE e.age >= 16 AND NOT EXISTS (
          SELECT 1 FROM recent p WHERE p.endpoint = e.endpoint AND p.person_id = e.person_id)""",
    # matching
    "alive": f"""
        SELECT c.*, d.death_date FROM cohort c LEFT JOIN deaths d USING (person_id)
        WHERE d.death_date IS NULL OR d.death_date >= {BEGIN}""",
    "late_alive": f"""
        SELECT c.* FROM cohort c LEFT JOIN deaths USING (person_id)
        WHERE death_date IS NULL OR death_date >= {BEGIN} + 90""",
    "cases": f"""
        SELECT f.endpoint, f.person_id AS case_id, f.start_date AS event_time, {KEYS}
        FROM firsts f JOIN alive a USING (person_id, sex)""",
    "pool": f"""
        SELECT n.endpoint, a.person_id, {KEYS}, a.death_date,
               CAST(EXISTS (SELECT 1 FROM cases k WHERE k.endpoint = n.endpoint
                            AND k.case_id = a.person_id) AS BIGINT) AS event
        FROM alive a, (SELECT DISTINCT endpoint FROM (VALUES {ENDPOINT_CODES}) v(endpoint, code)) n
        WHERE NOT EXISTS (SELECT 1 FROM prior p
                          WHERE p.endpoint = n.endpoint AND p.person_id = a.person_id)""",
    "pairs": f"""
        SELECT k.endpoint, k.case_id, p.person_id AS control_id, k.event_time,
               k.sex, k.zone, k.match_age, p.event AS future_case,
               coalesce(p.death_date, DATE '9999-12-31') AS last_day
        FROM cases k JOIN pool p USING (endpoint, {KEYS})
        WHERE p.person_id <> k.case_id AND (p.death_date IS NULL OR p.death_date > k.event_time)""",
    "ranked_pairs": f"""
        SELECT *, row_number() OVER (PARTITION BY endpoint, case_id ORDER BY last_day DESC,
                    {hash_int("concat_ws('|', 'salt', control_id)", 15)} % 32, control_id) - 1 AS place,
               count(*) OVER (PARTITION BY endpoint, case_id) AS n
        FROM pairs""",
    "floyd": f"""
        SELECT DISTINCT endpoint, case_id, n, greatest(n - 10, 0) AS j, CAST([] AS BIGINT[]) AS taken
        FROM ranked_pairs
        UNION ALL
        SELECT endpoint, case_id, n, j + 1,
               list_append(taken, CASE WHEN list_contains(taken, pick) THEN j ELSE pick END)
        FROM (SELECT *, {hash_int("concat_ws('|', 'sequela', endpoint, case_id, j)", 15)} % (j + 1) AS pick
              FROM floyd WHERE j < n)""",
    "matched": f"""
        SELECT r.endpoint, r.case_id, r.control_id, r.event_time, r.sex, r.zone, r.match_age, r.future_case
        FROM ranked_pairs r JOIN floyd f
          ON f.endpoint = r.endpoint AND f.case_id = r.case_id AND f.j = f.n
        WHERE list_contains(f.taken, r.place)""",
    "sets": f"""
        SELECT DISTINCT endpoint, case_id, event_time, {KEYS}, case_id AS person_id, 1 AS event FROM matched
        UNION ALL
        SELECT endpoint, case_id, event_time, {KEYS}, control_id, 0 FROM matched""",
    "banded": """
        SELECT s.*,
               CASE WHEN v.date_vacc_1 < e.a_end THEN v.vacc_type END AS product,
               CASE WHEN v.date_vacc_1 < e.a_end THEN s.event_time - v.date_vacc_1 END AS day_1,
               CASE WHEN v.date_vacc_1 < e.a_end AND v.date_vacc_2 < e.a_end
                    THEN s.event_time - v.date_vacc_2 END AS day_2
        FROM sets s LEFT JOIN vacc v USING (person_id) LEFT JOIN cc_ends e USING (endpoint)""",
    "statused": """
        SELECT *, CASE WHEN day_1 IS NULL THEN 'uv' WHEN day_2 >= 7 THEN 'v2_7+' WHEN day_2 >= 1 THEN 'v2_0:6'
                       WHEN day_1 <= 0 THEN 'uv' WHEN day_1 <= 6 THEN 'v1_0:6' WHEN day_1 <= 13 THEN 'v1_7:13'
                       WHEN day_1 <= 20 THEN 'v1_14:20' WHEN day_1 <= 27 THEN 'v1_21:27'
                       WHEN day_1 <= 34 THEN 'v1_28:34' WHEN day_1 <= 41 THEN 'v1_35:41'
                       ELSE 'v1_42+' END AS vacc_status
        FROM banded""",
    "xsets": """
        SELECT *, CASE WHEN vacc_type = 'uv' THEN 'uv' ELSE vacc_type || '_' || vs END AS vs_type
        FROM (SELECT *, CASE WHEN vacc_status = 'uv' THEN 'uv' ELSE product END AS vacc_type,
                     CASE WHEN vacc_status IN ('v1_28:34','v1_35:41','v1_42+','v2_0:6','v2_7+')
                          THEN 'v1_28+_v2' ELSE vacc_status END AS vs
              FROM statused)""",
    # observed / expected
    "post": """
        SELECT i.endpoint, i.person_id, v.vacc_type, v.date_vacc_1,
               min(i.start_date - v.date_vacc_1) AS days_1
        FROM incident i JOIN vacc v USING (person_id) JOIN oe_ends e USING (endpoint)
        WHERE v.date_vacc_1 < e.a_end AND i.start_date > v.date_vacc_1
        GROUP BY ALL""",
    "followed": f"""
        SELECT e.endpoint, v.person_id, v.vacc_type, c.age_year,
               coalesce(p.days_1, e.a_end - v.date_vacc_1) AS days_1,
               CAST(p.days_1 IS NOT NULL AS BIGINT) AS event, 1 AS n, {coarse("c.age_year")} AS age_grp
        FROM vacc v JOIN oe_ends e ON v.date_vacc_1 < e.a_end
        LEFT JOIN cohort c ON c.person_id = v.person_id
        LEFT JOIN post p ON p.endpoint = e.endpoint AND p.person_id = v.person_id""",
    "ptime": """
        SELECT endpoint, vacc_type, age_grp, b.period, CAST(count(*) AS BIGINT) AS n,
               CAST(sum(CASE WHEN days_1 <= hi THEN event ELSE 0 END) AS BIGINT) AS event,
               CAST(sum(least(days_1, hi) - lo) AS BIGINT) AS pdays
        FROM followed JOIN (VALUES ('0-7', 0, 7), ('8-14', 7, 14), ('15-21', 14, 21),
                                   ('22-28', 21, 28), ('29+', 28, 1000000)) b(period, lo, hi)
          ON days_1 > lo
        WHERE age_grp IS NOT NULL GROUP BY ALL""",
    "hist": f"""
        SELECT endpoint, {coarse("age")} AS age_grp, count(*) AS events_pre
        FROM (SELECT * FROM ev e
              WHERE start_date BETWEEN {BEGIN} - 68 AND {BEGIN} - 40
                AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.endpoint = e.endpoint
                                AND x.person_id = e.person_id AND x.start_date < {BEGIN} - 68)
              QUALIFY row_number() OVER (PARTITION BY endpoint, person_id ORDER BY start_date, code) = 1)
        WHERE age >= 16 GROUP BY ALL""",
    "popn": f"""
        SELECT {coarse("age_year")} AS age_grp, round_even(sum(weight), 0) AS population
        FROM cohort GROUP BY ALL""",
    "oe": """
        SELECT t.*, coalesce(h.events_pre, 0) AS events_pre, coalesce(p.population, 1) AS population,
               t.pdays * (coalesce(h.events_pre, 0) / 28.0) / coalesce(p.population, 1) AS exp_events
        FROM ptime t LEFT JOIN hist h USING (endpoint, age_grp)
        LEFT JOIN popn p ON p.age_grp = h.age_grp""",
    "oesum": """
        SELECT endpoint, vacc_type, age_grp, CAST(sum(event) AS BIGINT) AS event,
               sum(exp_events) AS exp_events, CAST(sum(pdays) AS BIGINT) AS pdays,
               CAST(sum(CASE WHEN period = '0-7' THEN n ELSE 0 END) AS BIGINT) AS n,
               avg(events_pre) AS events_pre, avg(population) AS population,
               sum(event) / nullif(sum(exp_events), 0) AS data_oe,
               sum(event) - sum(exp_events) AS data_o_minus_e
        FROM oe GROUP BY endpoint, vacc_type, age_grp""",
    "pmf_lists": """
        SELECT m, list_transform(range(0, CAST(ceil(m + 12 * sqrt(m) + 20) AS BIGINT) + 1),
                 lambda k: exp(k * ln(m) - m - lgamma(k + 1))) AS pmf
        FROM (SELECT CAST(event AS DOUBLE) AS m FROM oesum UNION SELECT events_pre FROM oesum)
        WHERE m > 0""",
    "cumulative": """
        SELECT m, list(c ORDER BY k) AS cdf
        FROM (SELECT m, k, sum(p) OVER (PARTITION BY m ORDER BY k) AS c
              FROM (SELECT m, unnest(pmf) AS p, generate_subscripts(pmf, 1) AS k FROM pmf_lists))
        GROUP BY m""",
    "draws": f"""
        SELECT o.*, s.sim,
               {hash_int("concat_ws('|', 'sequela', 'obs', endpoint, vacc_type, age_grp, s.sim)", 8)} / 4294967296.0 AS u_obs,
               {hash_int("concat_ws('|', 'sequela', 'pre', endpoint, vacc_type, age_grp, s.sim)", 8)} / 4294967296.0 AS u_pre
        FROM oesum o, (SELECT unnest(range(1, 10001)) AS sim) s""",
    "simrows": """
        SELECT *, CASE WHEN population = 1 THEN 1.0 ELSE sim_obs / nullif(sim_exp_pre, 0) END AS o_e,
               sim_obs - sim_exp_pre AS o_minus_e
        FROM (SELECT *, CASE WHEN population = 1 THEN 0.0
                             ELSE pdays * (sim_obs_pre / 28.0) / population END AS sim_exp_pre
              FROM (SELECT d.*, coalesce(len(list_filter(a.cdf, lambda x: x <= u_obs)), 0) AS sim_obs,
                           CASE WHEN coalesce(len(list_filter(b.cdf, lambda x: x <= u_pre)), 0) = 0 THEN 0.5
                                ELSE CAST(len(list_filter(b.cdf, lambda x: x <= u_pre)) AS DOUBLE) END AS sim_obs_pre
                    FROM draws d LEFT JOIN cumulative a ON a.m = CAST(d.event AS DOUBLE)
                    LEFT JOIN cumulative b ON b.m = d.events_pre))""",
    "simtot": """
        SELECT endpoint, vacc_type, sim, sum(sim_obs) / nullif(sum(sim_exp_pre), 0) AS o_e,
               sum(sim_obs) - sum(sim_exp_pre) AS o_minus_e,
               sum(event) / nullif(sum(exp_events), 0) AS data_oe, sum(event) - sum(exp_events) AS data_o_minus_e
        FROM simrows GROUP BY endpoint, vacc_type, sim""",
    # self-controlled
    "sstudy": f"""
        SELECT ev.* FROM ev, latest
        WHERE start_date >= {BEGIN} - 104 AND start_date <= latest - 7 AND age >= 16""",
    "srows": """
        SELECT endpoint, person_id, start_date, code, age, sex, count(*) AS n FROM sstudy GROUP BY ALL""",
    "sends": "SELECT endpoint, max(start_date) AS a_end FROM sstudy GROUP BY endpoint",
    "sjoin": """
        SELECT r.*, CASE WHEN v.date_vacc_1 IS NULL THEN 'uv' ELSE v.vacc_type END AS vacc_type,
               v.date_vacc_1, e.a_end
        FROM srows r LEFT JOIN vacc v USING (person_id) JOIN sends e USING (endpoint)""",
    "zwin": """
        SELECT *, date_vacc_1 - 104 AS pre_start, date_vacc_1 - 14 AS pre_end, date_vacc_1 AS risk_start,
               CASE WHEN date_vacc_1 + 28 > a_end THEN a_end ELSE date_vacc_1 + 28 END AS risk_end,
               CASE WHEN date_vacc_1 + 29 > a_end THEN a_end ELSE date_vacc_1 + 29 END AS post_start,
               CASE WHEN date_vacc_1 + 119 > a_end THEN a_end ELSE date_vacc_1 + 119 END AS post_end
        FROM sjoin WHERE date_vacc_1 IS NULL
          OR (start_date BETWEEN date_vacc_1 - 104 AND date_vacc_1 + 119 AND date_vacc_1 < a_end)""",
    "wins": "SELECT * FROM zwin WHERE vacc_type <> 'uv'",
    "ivs": """
        SELECT * FROM (
          SELECT endpoint, person_id, start_date, code, vacc_type, n, b.expgr,
                 CASE b.expgr WHEN 'Pre.Vacc' THEN pre_start WHEN 'Clearance' THEN pre_end ELSE risk_start END AS t_start,
                 CASE b.expgr WHEN 'Pre.Vacc' THEN pre_end WHEN 'Clearance' THEN risk_start ELSE risk_end END AS t_stop,
                 t_stop - t_start AS interval,
                 CAST(start_date > t_start AND start_date <= t_stop AS BIGINT) AS event
          FROM wins, (VALUES ('Pre.Vacc'), ('Clearance'), ('Risk')) b(expgr))
        WHERE interval > 0""",
    "ccuts": """
        SELECT endpoint, cal_start, a_end, cal_start + CAST(k * len AS INT) AS cut
        FROM (SELECT endpoint, min(pre_start) AS cal_start, max(a_end) AS a_end,
                     CAST(round_even((max(post_end) - min(pre_start)) / 5.0, 0) AS BIGINT) AS len
              FROM zwin GROUP BY endpoint), (VALUES (1), (2), (3), (4)) c(k)""",
    "spans": """
        SELECT DISTINCT endpoint, person_id, vacc_type, pre_start AS lo, risk_end AS hi,
               pre_end AS mark_1, risk_start AS mark_2
        FROM wins
        UNION ALL
        SELECT DISTINCT z.endpoint, z.person_id, 'uv', c.cal_start, c.a_end, NULL, NULL
        FROM zwin z JOIN ccuts c USING (endpoint) WHERE z.vacc_type = 'uv'""",
    "sdays": """
        SELECT DISTINCT z.endpoint, z.person_id, z.start_date
        FROM zwin z JOIN spans s USING (endpoint, person_id)
        WHERE z.start_date > s.lo AND z.start_date <= s.hi""",
    "points": """
        SELECT DISTINCT endpoint, person_id, point FROM (
          SELECT endpoint, person_id, lo AS point, lo, hi FROM spans
          UNION ALL SELECT endpoint, person_id, hi, lo, hi FROM spans
          UNION ALL SELECT endpoint, person_id, mark_1, lo, hi FROM spans
          UNION ALL SELECT endpoint, person_id, mark_2, lo, hi FROM spans
          UNION ALL SELECT s.endpoint, s.person_id, c.cut, s.lo, s.hi FROM spans s JOIN ccuts c USING (endpoint)
          UNION ALL SELECT d.endpoint, d.person_id, d.start_date, s.lo, s.hi
                    FROM sdays d JOIN spans s USING (endpoint, person_id))
        WHERE point BETWEEN lo AND hi AND lo < hi""",
    "tsplit": """
        SELECT q.endpoint, q.person_id, s.vacc_type, q.t_start, q.t_stop,
               CAST(EXISTS (SELECT 1 FROM sdays d WHERE d.endpoint = q.endpoint AND d.person_id = q.person_id
                            AND d.start_date = q.t_stop) AS BIGINT) AS event,
               CAST(coalesce(s.mark_1 <= q.t_start, false) AS BIGINT)
                 + CAST(coalesce(s.mark_2 <= q.t_start, false) AS BIGINT) AS expgr,
               (SELECT count(*) FROM ccuts c WHERE c.endpoint = q.endpoint AND c.cut <= q.t_start) AS period
        FROM (SELECT endpoint, person_id, point AS t_start,
                     lead(point) OVER (PARTITION BY endpoint, person_id ORDER BY point) AS t_stop
              FROM points) q
        JOIN spans s ON s.endpoint = q.endpoint AND s.person_id = q.person_id
        WHERE q.t_stop IS NOT NULL""",
    "labelled": """
        SELECT endpoint, person_id, vacc_type, t_start, t_stop, event,
               CASE WHEN expgr = 0 THEN 'uv' ELSE vacc_type END AS vt,
               CASE expgr WHEN 0 THEN 'Pre.Vacc' WHEN 1 THEN 'Clearance' ELSE 'Risk' END AS expgr,
               period, CASE WHEN period >= 1 THEN period - 1 ELSE period END AS period2,
               CASE expgr WHEN 0 THEN 'Pre.Vacc' WHEN 1 THEN vacc_type || '_Clearance'
                          ELSE vacc_type || '_Risk' END AS vt_expgr,
               t_stop - t_start AS interval
        FROM tsplit""",
    # person-days
    "spine": f"""
        SELECT CAST(d AS DATE) AS date, CAST((CAST(d AS DATE) - {BEGIN}) // 7 + 1 AS BIGINT) AS period
        FROM (SELECT unnest(generate_series({BEGIN}, {END}, INTERVAL 1 DAY)) AS d)""",
    "pdany": """
        SELECT a.endpoint, a.person_id, a.vacc_type, s.date, s.period, a.death_date, a.start_date AS event_date,
               s.date - a.date_vacc_1 AS days, s.date - a.date_vacc_2 AS days2, s.date - a.specimen_date AS days3
        FROM analysis a, spine s""",
    "pdall": "SELECT * FROM pdany WHERE days2 IS NOT NULL",
    "pdlev": """
        SELECT *, CASE WHEN days2 BETWEEN 21 AND 27 THEN 'Dose2 21-27' WHEN days2 BETWEEN 14 AND 20 THEN 'Dose2 14-20'
                       WHEN days2 BETWEEN 7 AND 13 THEN 'Dose2 7-13' WHEN days2 BETWEEN 0 AND 6 THEN 'Dose2 0-6'
                       WHEN days2 BETWEEN -14 AND -1 AND days > 27 THEN 'Dose2 clearance'
                       WHEN days BETWEEN 21 AND 27 THEN 'Dose1 21-27' WHEN days BETWEEN 14 AND 20 THEN 'Dose1 14-20'
                       WHEN days BETWEEN 7 AND 13 THEN 'Dose1 7-13' WHEN days BETWEEN 0 AND 6 THEN 'Dose1 0-6'
                       WHEN days BETWEEN -14 AND -1 THEN 'Dose1 clearance' ELSE 'Baseline' END AS lev,
               CASE WHEN days3 BETWEEN -14 AND -1 THEN 'infection clearance'
                    WHEN days3 BETWEEN 0 AND 6 THEN 'infection 0-6' WHEN days3 BETWEEN 7 AND 13 THEN 'infection 7-13'
                    WHEN days3 BETWEEN 14 AND 20 THEN 'infection 14-20'
                    WHEN days3 BETWEEN 21 AND 27 THEN 'infection 21-27' ELSE 'infection Baseline' END AS expgr3
        FROM pdany""",
    "pdx": """
        SELECT *, 'PB ' || CASE WHEN vacc_type = 'PB' THEN lev ELSE 'Baseline' END AS expgr,
               'AZ ' || CASE WHEN vacc_type = 'AZ' THEN lev ELSE 'Baseline' END AS expgr2,
               CAST(date = event_date AS BIGINT) AS event
        FROM pdlev""",
    "panel": "SELECT * FROM pdx WHERE days2 IS NOT NULL AND (death_date IS NULL OR date <= death_date)",
    "exposed_days": "SELECT * FROM pdx WHERE death_date IS NULL OR date <= death_date",
    # follow-up
    "adult": "SELECT * FROM win WHERE age >= 16",
    "afirst": """
        SELECT * FROM adult
        QUALIFY row_number() OVER (PARTITION BY endpoint, person_id ORDER BY start_date, code) = 1""",
    "fexp": f"""
        SELECT a.*, v.date_vacc_1,
               CASE WHEN v.date_vacc_1 <= a.start_date THEN v.vacc_type ELSE 'uv' END AS vacc_type,
               CASE WHEN v.date_vacc_1 <= a.start_date THEN a.start_date - v.date_vacc_1 ELSE 0 END AS days_vacc_event,
               {coarse("a.age")} AS age_grp
        FROM afirst a LEFT JOIN vacc v USING (person_id)""",
    "fadm": f"""
        SELECT a.*, s.admission_date, s.discharge_date,
               CASE WHEN s.admission_date - a.start_date < -7 THEN NULL
                    WHEN s.admission_date - a.start_date < 0 THEN 0
                    ELSE s.admission_date - a.start_date END AS days_adm
        FROM afirst a LEFT JOIN (SELECT * FROM spells WHERE emergency
               AND (discharge_date IS NULL OR discharge_date > {BEGIN})) s USING (person_id)""",
    "fstat": """
        SELECT *, CASE WHEN admission_date IS NULL AND discharge_date IS NULL THEN 'no_adm'
                       WHEN discharge_date < start_date THEN 'dis_before_event'
                       WHEN discharge_date >= start_date THEN 'dis_on_after_event'
                       WHEN admission_date IS NOT NULL AND discharge_date IS NULL THEN 'in_hosp' ELSE 'rest' END AS dis_status,
               CASE WHEN admission_date IS NULL AND discharge_date IS NULL THEN 'no_adm'
                    WHEN admission_date < start_date - 7 THEN 'adm_before_event'
                    WHEN admission_date >= start_date - 7 AND admission_date <= start_date + 7 THEN 'adm_on_event'
                    WHEN admission_date > start_date + 7 THEN 'adm_after_event' ELSE 'rest' END AS adm_status
        FROM fadm""",
    "fspell": """
        SELECT * FROM fstat
        QUALIFY row_number() OVER (PARTITION BY endpoint, person_id ORDER BY days_adm NULLS LAST,
                                   admission_date NULLS FIRST, discharge_date NULLS LAST) = 1""",
    "fsum": """
        SELECT f.*, x.vacc_type, CASE WHEN adm_status = 'no_adm' AND dis_status = 'no_adm' THEN 'no_adm'
                    WHEN adm_status = 'adm_on_event' OR (adm_status = 'adm_before_event'
                         AND dis_status = 'dis_on_after_event') THEN 'in_hosp_at_event' ELSE 'other' END AS hosp_event
        FROM fspell f JOIN fexp x USING (endpoint, person_id)""",
    # dose-2 incidence
    "d2den": f"""
        SELECT count(*) AS doses, CAST(sum(stop - date_vacc_2 + 1) AS BIGINT) AS pdays,
               CAST(sum(least(date_vacc_2 + 27, stop) - date_vacc_2 + 1) AS BIGINT) AS pdays_28
        FROM (SELECT v.date_vacc_2, coalesce(d.death_date, {END}) AS stop
              FROM vacc v LEFT JOIN deaths d USING (person_id) WHERE v.date_vacc_2 <= {END})""",
    "d2ev": f"""
        SELECT endpoint, follow_up, CAST(sum(CASE WHEN start_date >= date_vacc_2 AND start_date <=
                 CASE WHEN follow_up = 'all' THEN stop ELSE least(date_vacc_2 + 27, stop) END
                 THEN 1 ELSE 0 END) AS BIGINT) AS n_events
        FROM (SELECT *, coalesce(death_date, {END}) AS stop FROM analysis WHERE date_vacc_2 <= {END}),
             (VALUES ('all'), ('28 days')) w(follow_up)
        GROUP BY endpoint, follow_up""",
    "limits": """
        SELECT x, 0 AS i, 0.0::DOUBLE AS lo_a, x::DOUBLE AS lo_b, x::DOUBLE AS up_a,
               (x + 12 * sqrt(x + 1) + 20)::DOUBLE AS up_b
        FROM (SELECT DISTINCT n_events AS x FROM d2ev)
        UNION ALL
        SELECT x, i + 1,
               CASE WHEN 1 - below_lo < 0.025 THEN (lo_a + lo_b) / 2 ELSE lo_a END,
               CASE WHEN 1 - below_lo < 0.025 THEN lo_b ELSE (lo_a + lo_b) / 2 END,
               CASE WHEN up_to > 0.025 THEN (up_a + up_b) / 2 ELSE up_a END,
               CASE WHEN up_to > 0.025 THEN up_b ELSE (up_a + up_b) / 2 END
        FROM (SELECT *,
                coalesce(list_sum(list_transform(range(0, x), lambda k:
                  exp(-(lo_a + lo_b) / 2 + k * ln(greatest((lo_a + lo_b) / 2, 1e-300)) - lgamma(k + 1)))), 0) AS below_lo,
                list_sum(list_transform(range(0, x + 1), lambda k:
                  exp(-(up_a + up_b) / 2 + k * ln((up_a + up_b) / 2) - lgamma(k + 1)))) AS up_to
              FROM limits WHERE i < 60)""",
    # one-parameter conditional logistic fit: ever exposed
    "xsum": """
        SELECT endpoint, case_id, sum(CASE WHEN vacc_type <> 'uv' THEN 1 ELSE 0 END)::DOUBLE AS m,
               sum(CASE WHEN vacc_type = 'uv' THEN 1 ELSE 0 END)::DOUBLE AS u,
               sum(CASE WHEN vacc_type <> 'uv' THEN event ELSE 0 END)::DOUBLE AS xe
        FROM xsets GROUP BY endpoint, case_id""",
    "xnewton": """
        SELECT DISTINCT endpoint, 0 AS i, 0.0::DOUBLE AS b FROM xsum
        UNION ALL
        SELECT t.endpoint, t.i + 1, t.b + sum(s.xe - s.m * exp(t.b) / (s.m * exp(t.b) + s.u))
                 / sum(s.m * s.u * exp(t.b) / ((s.m * exp(t.b) + s.u) * (s.m * exp(t.b) + s.u)))
        FROM xnewton t JOIN xsum s USING (endpoint) WHERE t.i < 15
        GROUP BY t.endpoint, t.i, t.b""",
    # where all events of the varied strata lie on one side there is no finite estimate, and the
    # log likelihood is its limit
    "xside": """
        SELECT endpoint, sum(CASE WHEN m > 0 AND u > 0 THEN xe ELSE 0 END) AS ups,
               sum(CASE WHEN m > 0 AND u > 0 THEN 1 ELSE 0 END) AS n_varied
        FROM xsum GROUP BY endpoint""",
    "xfit": """
        SELECT endpoint, CASE WHEN ups > 0 AND ups < n_varied THEN b END AS b,
               CASE WHEN ups > 0 AND ups < n_varied THEN 1 / sqrt(h) END AS se,
               n_strata, CASE WHEN ups > 0 AND ups < n_varied THEN ll WHEN ups = 0 THEN ll_down ELSE ll_up END AS loglik,
               loglik_0, CAST(ups > 0 AND ups < n_varied AS BIGINT) AS df
        FROM (SELECT t.endpoint, t.b,
                     sum(s.m * s.u * exp(t.b) / ((s.m * exp(t.b) + s.u) * (s.m * exp(t.b) + s.u))) AS h,
                     count(*) AS n_strata, sum(s.xe * t.b - ln(s.m * exp(t.b) + s.u)) AS ll,
                     sum(-ln(CASE WHEN s.m > 0 AND s.u > 0 THEN s.u ELSE s.m + s.u END)) AS ll_down,
                     sum(-ln(CASE WHEN s.m > 0 AND s.u > 0 THEN s.m ELSE s.m + s.u END)) AS ll_up,
                     sum(-ln(s.m + s.u)) AS loglik_0
              FROM xnewton t JOIN xsum s USING (endpoint) WHERE t.i = 15 GROUP BY t.endpoint, t.b)
        JOIN xside USING (endpoint)""",
    # the same for person-days: any risk day of either dose
    "dsum": """
        SELECT endpoint, person_id, sum(r)::DOUBLE AS m, sum(1 - r)::DOUBLE AS u, sum(r * event)::DOUBLE AS xe
        FROM (SELECT endpoint, person_id, event,
                     CAST(lev NOT IN ('Baseline', 'Dose1 clearance', 'Dose2 clearance') AS BIGINT) AS r FROM panel)
        GROUP BY endpoint, person_id HAVING sum(event) > 0""",
    "dnewton": """
        SELECT DISTINCT endpoint, 0 AS i, 0.0::DOUBLE AS b FROM dsum
        UNION ALL
        SELECT t.endpoint, t.i + 1, t.b + sum(s.xe - s.m * exp(t.b) / (s.m * exp(t.b) + s.u))
                 / sum(s.m * s.u * exp(t.b) / ((s.m * exp(t.b) + s.u) * (s.m * exp(t.b) + s.u)))
        FROM dnewton t JOIN dsum s USING (endpoint) WHERE t.i < 15
        GROUP BY t.endpoint, t.i, t.b""",
    "dfit": """
        SELECT t.endpoint, t.b,
               1 / sqrt(sum(s.m * s.u * exp(t.b) / ((s.m * exp(t.b) + s.u) * (s.m * exp(t.b) + s.u)))) AS se
        FROM dnewton t JOIN dsum s USING (endpoint) WHERE t.i = 15 GROUP BY t.endpoint, t.b""",
    # exact ties with one 0/1 covariate: the sum over all subsets of d rows is a
    # polynomial in exp(b) whose coefficients are elementary symmetric sums
    "trows": """
        SELECT endpoint, person_id, CAST(expgr = 'Risk' AS BIGINT) AS x, interval::DOUBLE AS w, event,
               row_number() OVER (PARTITION BY endpoint, person_id, expgr = 'Risk' ORDER BY t_start) AS k
        FROM labelled WHERE vacc_type <> 'uv'""",
    "tsize": """
        SELECT endpoint, person_id, sum(event)::BIGINT AS d, sum(event * x)::DOUBLE AS s
        FROM trows GROUP BY ALL HAVING sum(event) > 0 AND sum(event) < count(*)""",
    "symsum": """
        SELECT endpoint, person_id, d, v.x, 0 AS k,
               list_transform(range(0, d + 1), lambda j: CASE WHEN j = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS e
        FROM tsize, (VALUES (0), (1)) v(x)
        UNION ALL
        SELECT p.endpoint, p.person_id, p.d, p.x, p.k + 1,
               list_transform(range(0, p.d + 1),
                 lambda j: p.e[j + 1] + CASE WHEN j > 0 THEN r.w * p.e[j] ELSE 0.0::DOUBLE END)
        FROM symsum p JOIN trows r
          ON r.endpoint = p.endpoint AND r.person_id = p.person_id AND r.x = p.x AND r.k = p.k + 1""",
    "poly": """
        SELECT t.endpoint, t.person_id, t.s, j, a.e[j + 1] * b.e[t.d - j + 1] AS coef
        FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM tsize) t
        JOIN (SELECT endpoint, person_id, arg_max(e, k) AS e FROM symsum WHERE x = 1 GROUP BY ALL) a USING (endpoint, person_id)
        JOIN (SELECT endpoint, person_id, arg_max(e, k) AS e FROM symsum WHERE x = 0 GROUP BY ALL) b USING (endpoint, person_id)""",
    "tnewton": """
        SELECT DISTINCT endpoint, 0 AS i, 0.0::DOUBLE AS b, 0.0::DOUBLE AS v FROM poly
        UNION ALL
        SELECT endpoint, i + 1, b + sum(s - m) / sum(q - m * m), 1 / sum(q - m * m)
        FROM (SELECT t.endpoint, t.i, t.b, p.person_id, p.s,
                     sum(j * coef * exp(t.b * j)) / sum(coef * exp(t.b * j)) AS m,
                     sum(j * j * coef * exp(t.b * j)) / sum(coef * exp(t.b * j)) AS q
              FROM tnewton t JOIN poly p USING (endpoint) WHERE t.i < 20
              GROUP BY t.endpoint, t.i, t.b, p.person_id, p.s)
        GROUP BY endpoint, i, b""",
    # two-parameter fits: strata s, cells (c in {1, 2}) with weight len and event ev
    "cell2": """
        SELECT endpoint AS g, case_id AS s, 1 AS w,
               sum(CASE WHEN vacc_type = 'uv' THEN 1 ELSE 0 END)::DOUBLE AS l0,
               sum(CASE WHEN vacc_type = 'AZ' THEN 1 ELSE 0 END)::DOUBLE AS l1,
               sum(CASE WHEN vacc_type = 'PB' THEN 1 ELSE 0 END)::DOUBLE AS l2,
               sum(CASE WHEN vacc_type = 'AZ' THEN event ELSE 0 END)::DOUBLE AS e1,
               sum(CASE WHEN vacc_type = 'PB' THEN event ELSE 0 END)::DOUBLE AS e2
        FROM xsets GROUP BY endpoint, case_id""",
    "cellk": """
        SELECT endpoint || '|' || vacc_type AS g, 0 AS s, n::DOUBLE AS w,
               max(CASE WHEN expgr = 'Pre.Vacc' THEN interval ELSE 0 END)::DOUBLE AS l0,
               max(CASE WHEN expgr = 'Clearance' THEN interval ELSE 0 END)::DOUBLE AS l1,
               max(CASE WHEN expgr = 'Risk' THEN interval ELSE 0 END)::DOUBLE AS l2,
               max(CASE WHEN expgr = 'Clearance' THEN event ELSE 0 END)::DOUBLE AS e1,
               max(CASE WHEN expgr = 'Risk' THEN event ELSE 0 END)::DOUBLE AS e2
        FROM ivs GROUP BY endpoint, vacc_type, person_id, start_date, code, n
        HAVING sum(event) > 0""",
}

for _name, _cells in (("newton2", "cell2"), ("newtonk", "cellk")):
    CTES[f"{_name}"] = f"""
        SELECT DISTINCT g, 0 AS i, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2
        FROM {_cells}
        UNION ALL
        SELECT g, i + 1, b1 + (h22 * u1 - h12 * u2) / (h11 * h22 - h12 * h12),
               b2 + (h11 * u2 - h12 * u1) / (h11 * h22 - h12 * h12),
               h22 / (h11 * h22 - h12 * h12), h11 / (h11 * h22 - h12 * h12)
        FROM (SELECT g, i, b1, b2, sum(w * (e1 - p1)) AS u1, sum(w * (e2 - p2)) AS u2,
                     sum(w * p1 * (1 - p1)) AS h11, sum(w * p2 * (1 - p2)) AS h22, -sum(w * p1 * p2) AS h12
              FROM (SELECT t.g, t.i, t.b1, t.b2, c.w, c.e1, c.e2,
                           c.l1 * exp(t.b1) / (c.l0 + c.l1 * exp(t.b1) + c.l2 * exp(t.b2)) AS p1,
                           c.l2 * exp(t.b2) / (c.l0 + c.l1 * exp(t.b1) + c.l2 * exp(t.b2)) AS p2
                    FROM {_name} t JOIN {_cells} c USING (g) WHERE t.i < 20)
              GROUP BY g, i, b1, b2)"""
for _name in ("newton2", "newtonk"):
    CTES[f"fit_{_name}"] = f"SELECT g, b1, b2, sqrt(v1) AS se1, sqrt(v2) AS se2 FROM {_name} WHERE i = 20"

RECURSIVE = ("floyd", "limits", "xnewton", "dnewton", "symsum", "tnewton", "newton2", "newtonk")


def _needed(sql: str) -> list[str]:
    """CTEs a statement uses, dependencies first."""
    order: list[str] = []

    def visit(text: str, own: str = "") -> None:
        used = set(re.findall(r"\w+", text))
        for name in CTES:
            if name != own and name not in order and name in used:
                visit(CTES[name], name)
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def oracle(name: str, sql: str) -> None:
    BODIES[name] = sql
    parts = []
    for cte in _needed(sql):
        hint = "" if cte in RECURSIVE else " MATERIALIZED"
        parts.append(f"{cte} AS{hint} ({CTES[cte]})")
    ORACLES[name] = ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql


oracle("s1_load_register", f"""SELECT person_id, sex, age_year, zone, simd, n_risk_gps, n_tests_gp,
  {r8('weight', 'weight')}, {r8('bmi', 'bmi')}, diag_chd, diag_stroke FROM cohort""")
oracle("s2_positive_tests", f"SELECT * FROM tests WHERE result = 'POSITIVE' AND specimen_date >= {BEGIN}")
oracle("s3_positive_test_days", "SELECT DISTINCT person_id, specimen_date FROM tests WHERE result = 'POSITIVE'")
oracle("s4_write_stage", "SELECT endpoint, person_id, start_date, code, age, sex FROM firsts")
_RATES = f"""sum(event * n)::BIGINT AS event, sum(interval * n)::BIGINT AS interval,
  {r8('sum(event * n) / nullif(sum(interval * n), 0)::DOUBLE * 7', 'rate_week')}"""
oracle("s5_stack_results", f"SELECT endpoint, vacc_type, expgr, {_RATES} FROM ivs GROUP BY ALL")
oracle("e1_classify_product", "SELECT person_id, rec_id, type, date, vacc_type FROM vclass")
oracle("e2_normalise_dose", "SELECT rec_id, stage, dose FROM vclass")
oracle("e3_first_per_dose", "SELECT * FROM vfirst")
oracle("e4_widen_doses", "SELECT * FROM vwide")
oracle("e5_drop_inconsistent", "SELECT * FROM vcons")
oracle("e6_collapse_same_day", "SELECT * FROM vsame")
oracle("e7_min_gap", "SELECT * FROM vacc")
oracle("e8_exclude_product", "SELECT * FROM vacc WHERE vacc_type <> 'AZ'")
oracle("e9_truncate_exposure", """SELECT e.endpoint, v.person_id, v.vacc_type, v.date_vacc_1,
  CASE WHEN v.date_vacc_2 >= e.a_end THEN NULL ELSE v.vacc_type_2 END AS vacc_type_2,
  CASE WHEN v.date_vacc_2 >= e.a_end THEN NULL ELSE v.date_vacc_2 END AS date_vacc_2, e.a_end
  FROM vacc v JOIN oe_ends e ON v.date_vacc_1 < e.a_end""")
oracle("e10_exposure_until", f"SELECT * FROM vacc WHERE date_vacc_1 <= {END}")
oracle("e11_require_dose2", "SELECT * FROM vacc WHERE date_vacc_2 IS NOT NULL")
oracle("v1_calendar_labels", f"""SELECT CASE WHEN start_date < {BEGIN} THEN 'Year1' ELSE 'Year2' END AS study_year,
  month(start_date) AS month, CASE WHEN month(start_date) IN (9, 10, 11) THEN 'P1'
  WHEN month(start_date) IN (12, 1, 2, 3) THEN 'P2' ELSE 'P3' END AS season,
  year(start_date) AS calendar_year, count(*) AS n FROM reg GROUP BY ALL""")
oracle("v2_age_band", f"SELECT {fine('age')} AS fine, {coarse('age')} AS coarse, count(*) AS n FROM reg GROUP BY ALL")
oracle("v3_trim_future", "SELECT start_date, count(*) AS n FROM consult GROUP BY ALL")
oracle("v3_trim_extract", """SELECT start_date, count(*) AS n FROM reg
  WHERE start_date <= (SELECT max(start_date) + 3 FROM consult) GROUP BY ALL""")
oracle("v4_resolve_endpoints", "SELECT endpoint, code, start_date, count(*) AS n FROM ev GROUP BY ALL")
oracle("v5_study_window", "SELECT endpoint, start_date, count(*) AS n FROM win GROUP BY ALL")
oracle("v6_washout", """SELECT endpoint, person_id, start_date, count(*) AS n FROM win w
  WHERE (endpoint, person_id) NOT IN (SELECT (endpoint, person_id) FROM recent) GROUP BY ALL""")
oracle("v6_washout_unbounded", """SELECT endpoint, person_id, start_date, count(*) AS n FROM win w
  WHERE (endpoint, person_id) NOT IN (SELECT (endpoint, person_id) FROM prior) GROUP BY ALL""")
oracle("v7_min_age", "SELECT endpoint, person_id, age, count(*) AS n FROM incident GROUP BY ALL")
oracle("v8_first_event", "SELECT endpoint, person_id, start_date, code, age, sex FROM firsts")
oracle("v8_first_incident", "SELECT endpoint, person_id, start_date, code, age, sex FROM firsts")
oracle("v9_study_end", "SELECT * FROM oe_ends")
_ATTRITION = """SELECT i.endpoint, count(*) AS total_events, count(DISTINCT i.person_id) AS total_unique_events,
  count(DISTINCT CASE WHEN a.person_id IS NULL THEN i.person_id END) AS no_link_to_cohort,
  (SELECT count(*) FROM cases k WHERE k.endpoint = i.endpoint AND NOT EXISTS (
     SELECT 1 FROM pairs p WHERE p.endpoint = k.endpoint AND p.case_id = k.case_id)) AS no_match
  FROM incident i LEFT JOIN late_alive a ON a.person_id = i.person_id GROUP BY i.endpoint"""
oracle("v10_attrition", _ATTRITION)
oracle("v11_analysis_set", "SELECT * FROM analysis")
oracle("c1_matching_age", """SELECT age_year, CASE WHEN age_year + 1 >= 100 THEN 100 WHEN age_year + 1 >= 95 THEN 97
  WHEN age_year + 1 >= 90 THEN 92 WHEN age_year + 1 >= 80 THEN (age_year + 1) // 2 * 2 ELSE age_year + 1 END AS match_age,
  count(*) AS n FROM (SELECT age_year FROM cohort) GROUP BY ALL""")
oracle("c2_alive_at", f"""SELECT person_id, death_date FROM cohort LEFT JOIN deaths USING (person_id)
  WHERE death_date IS NULL OR death_date >= {BEGIN} + 90""")
oracle("c3_link_cases", """SELECT f.endpoint, f.person_id, f.start_date, f.code, a.sex, a.zone, a.match_age,
  a.person_id IS NOT NULL AS linked
  FROM firsts f LEFT JOIN late_alive a ON a.person_id = f.person_id""")
oracle("c4_control_pool", f"SELECT endpoint, person_id, {KEYS}, death_date, event FROM pool")
oracle("m1_match_candidates", f"""SELECT k.endpoint, k.case_id, k.event_time, {KEYS}, count(p.control_id) AS n_candidates
  FROM cases k LEFT JOIN (SELECT endpoint, case_id, control_id FROM pairs) p USING (endpoint, case_id) GROUP BY ALL""")
oracle("m2_sample_controls", "SELECT * FROM matched")
oracle("m3_unmatched", """SELECT * FROM cases k WHERE NOT EXISTS (
  SELECT 1 FROM pairs p WHERE p.endpoint = k.endpoint AND p.case_id = k.case_id)""")
oracle("m4_matched_sets", "SELECT * FROM sets")
oracle("m5_match_diagnostics", """
  SELECT endpoint, 'uses_per_control' AS measure, value, count(*) AS n
  FROM (SELECT endpoint, control_id, count(*) AS value FROM matched GROUP BY ALL) GROUP BY endpoint, value
  UNION ALL SELECT endpoint, 'controls_per_case', value, count(*)
  FROM (SELECT endpoint, case_id, count(*) AS value FROM matched GROUP BY ALL) GROUP BY endpoint, value
  UNION ALL SELECT endpoint, 'future_case', future_case, count(*) FROM matched GROUP BY endpoint, future_case""")
_SET = "endpoint, case_id, person_id, event"
oracle("x1_vacc_status", f"SELECT {_SET}, day_1, day_2, vacc_status FROM statused")
oracle("x2_product_at_index", f"SELECT {_SET}, vacc_status, vacc_type FROM xsets")
oracle("x3_collapse_status", f"SELECT {_SET}, vs, vs_type FROM xsets")
oracle("x4_hospital_status", f"""SELECT s.endpoint, s.case_id, s.person_id, s.event, h.hosp FROM sets s JOIN (
  SELECT endpoint, person_id, CASE WHEN bool_or(kind = 'in_hosp') THEN 'in_hosp'
         WHEN bool_or(kind = 'before') THEN 'before' ELSE 'no_adm' END AS hosp
  FROM (SELECT i.endpoint, i.person_id,
          CASE WHEN admission_date IS NULL AND discharge_date IS NULL THEN 'no_adm'
               WHEN discharge_date < event_time - 14 THEN 'no_adm'
               WHEN discharge_date >= event_time - 14 AND discharge_date < event_time THEN 'before'
               WHEN discharge_date >= event_time AND admission_date <= event_time THEN 'in_hosp'
               WHEN discharge_date IS NULL AND admission_date <= event_time THEN 'in_hosp'
               WHEN admission_date > event_time THEN 'after' ELSE 'check' END AS kind
        FROM (SELECT * FROM sets QUALIFY row_number() OVER (
                PARTITION BY endpoint, person_id ORDER BY case_id, event DESC) = 1) i
        LEFT JOIN (SELECT * FROM spells WHERE discharge_date IS NULL OR discharge_date >= {BEGIN} - 14) p
          USING (person_id))
  GROUP BY ALL) h USING (endpoint, person_id)""")
oracle("x5_test_timing", f"""SELECT {_SET}, CASE WHEN t.d IS NULL THEN 'never' WHEN event_time - t.d >= 28 THEN '28+ days'
  WHEN event_time - t.d >= 14 THEN '14-27 days' WHEN event_time - t.d >= 0 THEN '0-13 days'
  WHEN event_time - t.d >= -6 THEN '1-6 post event' ELSE '7+ post event' END AS positive_before_event
  FROM sets LEFT JOIN (SELECT person_id, min(specimen_date) AS d FROM tests
    WHERE result = 'POSITIVE' AND specimen_date >= {BEGIN} GROUP BY person_id) t USING (person_id)""")
oracle("x6_attach_covariates", f"""SELECT s.endpoint, s.case_id, s.person_id, s.event, c.age_year, c.n_risk_gps,
  c.n_tests_gp, c.simd, {r8('c.bmi', 'bmi')}, c.diag_chd, c.diag_stroke,
  c.age_year >= 65 AND c.person_id % 9 = 0 AS care_home, f.code AS event_code
  FROM sets s LEFT JOIN cohort c USING (person_id)
  LEFT JOIN firsts f ON f.endpoint = s.endpoint AND f.person_id = s.person_id""")
oracle("x7_cut_bands", f"""SELECT *, CASE WHEN days > -1 AND days <= 25 THEN '(-1,25]' WHEN days > 25 AND days <= 50 THEN '(25,50]'
    WHEN days > 50 AND days <= 75 THEN '(50,75]' WHEN days > 75 AND days <= 110 THEN '(75,110]'
    WHEN days > 110 AND days <= 400 THEN '(110,400]' END AS days_gp
  FROM (SELECT {_SET}, CASE WHEN bmi > 10 AND bmi <= 19 THEN '(10,19]' WHEN bmi > 19 AND bmi <= 24 THEN '(19,24]'
    WHEN bmi > 24 AND bmi <= 29 THEN '(24,29]' WHEN bmi > 29 AND bmi <= 34 THEN '(29,34]'
    WHEN bmi > 34 AND bmi <= 39 THEN '(34,39]' WHEN bmi > 39 AND bmi <= 50 THEN '(39,50]' END AS bmi_gp,
    event_time - min(event_time) OVER (PARTITION BY endpoint) AS days
    FROM sets LEFT JOIN (SELECT person_id, bmi FROM cohort) USING (person_id))""")
oracle("r1_first_post_exposure", """SELECT *, CAST(days_1 <= 7 AS BIGINT) AS days_07, CAST(days_1 <= 14 AS BIGINT) AS days_14,
  CAST(days_1 <= 21 AS BIGINT) AS days_21, CAST(days_1 <= 28 AS BIGINT) AS days_28 FROM post""")
oracle("r2_exposure_followup", "SELECT * FROM followed")
oracle("r3_person_time", "SELECT * FROM ptime")
oracle("r4_historical_events", "SELECT * FROM hist")
oracle("r5_weighted_population", f"SELECT age_grp, {r8('population', 'population')} FROM popn")
oracle("r6_expected_events", f"""SELECT endpoint, vacc_type, age_grp, period, n, event, pdays, events_pre,
  {r8('population::DOUBLE', 'population')}, {r8('exp_events', 'exp_events')} FROM oe""")
_OE = ", ".join(r8(f"{c}::DOUBLE", c) for c in ("exp_events", "events_pre", "population", "data_oe", "data_o_minus_e"))
oracle("r7_oe_summary", f"SELECT endpoint, vacc_type, age_grp, event, pdays, n, {_OE} FROM oesum")
oracle("r8_simulate_oe", f"""SELECT endpoint, vacc_type, age_grp, count(*) AS n_sims, sum(sim_obs)::BIGINT AS sum_obs,
  max(sim_obs) AS max_obs, {r6('sum(sim_obs_pre)', 'sum_pre')}, {r6('sum(sim_exp_pre)', 'sum_exp')}
  FROM simrows GROUP BY ALL""")


def _interval(source: str, by: str) -> str:
    cols = []
    for col, name in (("o_e", "oe"), ("o_minus_e", "o_minus_e")):
        cols += [
            f"quantile_cont({col}, 0.5) AS med_{name}", f"avg({col}) AS mean_{name}",
            f"quantile_cont({col}, 0.025) AS q025_{name}", f"quantile_cont({col}, 0.975) AS q975_{name}",
            f"max(data_{name}) AS data_{name}",
        ]
    return f"SELECT {by}, {', '.join(cols)} FROM {source} GROUP BY {by}"


_LIMITS = [f"{q}_{n}" for n in ("oe", "o_minus_e") for q in ("med", "mean", "q025", "q975", "data")]
_ROUNDED = ", ".join(r6(c, c) for c in _LIMITS)
oracle("r9_oe_interval", f"""SELECT endpoint, vacc_type, age_grp, {_ROUNDED}
  FROM ({_interval('simrows', 'endpoint, vacc_type, age_grp')})""")
oracle("r10_oe_interval_overall", f"""SELECT endpoint, vacc_type, {_ROUNDED}
  FROM ({_interval('simtot', 'endpoint, vacc_type')})""")
_SHOWN = ", ".join(
    r6(f"{c}::DOUBLE", c)
    for c in ("exp_events", "data_oe", "q025_oe", "q975_oe", "data_o_minus_e", "q025_o_minus_e", "q975_o_minus_e")
)
oracle("r11_oe_table", f"""SELECT endpoint, vacc_type, age_grp, n, event, {_SHOWN} FROM (
  SELECT o.endpoint, o.vacc_type, o.age_grp, n, event, exp_events, coalesce(o.data_oe, 1.0) AS data_oe, o.data_o_minus_e,
         q025_oe, q975_oe, q025_o_minus_e, q975_o_minus_e
  FROM oesum o LEFT JOIN ({_interval('simrows', 'endpoint, vacc_type, age_grp')}) i USING (endpoint, vacc_type, age_grp)
  UNION ALL
  SELECT o.endpoint, o.vacc_type, 'All Ages', n, event, exp_events, event / nullif(exp_events, 0), event - exp_events,
         q025_oe, q975_oe, q025_o_minus_e, q975_o_minus_e
  FROM (SELECT endpoint, vacc_type, sum(n)::BIGINT AS n, sum(event)::BIGINT AS event, sum(exp_events) AS exp_events
        FROM oesum GROUP BY endpoint, vacc_type) o
  LEFT JOIN ({_interval('simtot', 'endpoint, vacc_type')}) i USING (endpoint, vacc_type))""")


def _short(col: str) -> str:
    return f"regexp_replace(printf('%.2f', {col}), '\\.?0+$', '')"


oracle("r12_dose2_incidence", f"""SELECT endpoint, follow_up, n_events, doses,
  {r6('rate', 'rate')}, {r6('lower', 'lower')}, {r6('upper', 'upper')},
  {_short('rate')} || ' (' || {_short('lower')} || ',' || {_short('upper')} || ')' AS rate_ci
  FROM (SELECT e.endpoint, e.follow_up, e.n_events, d.doses, round(e.n_events / (d.doses / 100000.0), 2) AS rate,
        round(CASE WHEN e.n_events = 0 THEN 0 ELSE (l.lo_a + l.lo_b) / 2 END / (d.doses / 100000.0), 2) AS lower,
        round((l.up_a + l.up_b) / 2 / (d.doses / 100000.0), 2) AS upper
        FROM d2ev e, d2den d, limits l WHERE l.x = e.n_events AND l.i = 60)""")
oracle("r13_crude_rate", f"""SELECT endpoint, follow_up, n_events,
  CASE WHEN follow_up = 'all' THEN pdays ELSE pdays_28 END AS pdays,
  {r6("n_events / nullif(CASE WHEN follow_up = 'all' THEN pdays ELSE pdays_28 END, 0)::DOUBLE * 10000000", 'rate')}
  FROM d2ev, d2den""")
_CRUDE = f"count(*) AS n, sum(event)::BIGINT AS events, {r8('sum(event) / count(*)::DOUBLE * 100', 'percent')}"
oracle("l1_crude_table", f"""SELECT endpoint, vs_type AS level, {_CRUDE}, 'vs_type' AS var FROM xsets GROUP BY endpoint, vs_type
  UNION ALL SELECT endpoint, vacc_type, {_CRUDE}, 'vacc_type' FROM xsets GROUP BY endpoint, vacc_type""")
_P = normal_p("b / se")
oracle("l2_clogit", f"""SELECT endpoint, 'raw' AS model, 'exposed' AS term, '' AS level, {r6('b', 'coef')}, {r6('se', 'se')},
  {r6(_P, 'p')}, true AS converged, n_strata, n_strata AS n_events, {r6('loglik', 'loglik')} FROM xfit""")
_TWO = """SELECT g AS endpoint, 'raw' AS model, 'vacc_type' AS term, 'uv' AS level, 0.0 AS b, NULL::DOUBLE AS se FROM fit_newton2
  UNION ALL SELECT g, 'raw', 'vacc_type', 'AZ', b1, se1 FROM fit_newton2
  UNION ALL SELECT g, 'raw', 'vacc_type', 'PB', b2, se2 FROM fit_newton2"""
oracle("l2_clogit_product", f"""SELECT endpoint, model, term, level, {r6('b', 'coef')}, {r6('se', 'se')}, {r6(_P, 'p')}, true AS converged
  FROM ({_TWO})""")
oracle("l3_clogit_exact_risk", f"""SELECT endpoint, 'risk' AS model, 'risk' AS term, '' AS level,
  {r6('b', 'coef')}, {r6('se', 'se')}, {r6(_P, 'p')}, true AS converged FROM (SELECT endpoint, b, sqrt(v) AS se FROM tnewton WHERE i = 20)""")
oracle("l4_effect_table", f"""SELECT endpoint, model, term, level, {r6('exp(b)', 'est')},
  {r6("CASE WHEN level = 'uv' THEN 1 ELSE exp(b - 1.96 * se) END", 'lcl')},
  {r6("CASE WHEN level = 'uv' THEN 1 ELSE exp(b + 1.96 * se) END", 'ucl')}, {r6(_P, 'p')}, true AS converged FROM ({_TWO})""")
oracle("l8_lr_test", f"""SELECT endpoint, {r6('loglik', 'loglik_1')}, {r6('loglik_0', 'loglik_0')},
  {r6('2 * (loglik - loglik_0)', 'chi2')}, df,
  {r6(f"CASE WHEN df > 0 THEN {normal_p('sqrt(greatest(2 * (loglik - loglik_0), 0))')} END", 'p')}, true AS converged
  FROM xfit""")
oracle("l9_effectiveness", f"""SELECT endpoint, 'raw' AS model, 'exposed' AS term, '' AS level, true AS converged,
  {r6('exp(b)', 'or_raw')}, {r6('exp(b - 1.959963984540054 * se)', 'or_lcl_raw')}, {r6('exp(b + 1.959963984540054 * se)', 'or_ucl_raw')},
  {r6('(1 - exp(b)) * 100', 've_raw')}, {r6('(1 - exp(b + 1.959963984540054 * se)) * 100', 've_lcl_raw')},
  {r6('(1 - exp(b - 1.959963984540054 * se)) * 100', 've_ucl_raw')} FROM xfit""")
oracle("k1_sccs_windows", "SELECT * FROM wins")
oracle("k2_sccs_windows_fixed", f"""SELECT *, {BEGIN} - 104 AS pre_start, date_vacc_1 - 14 AS pre_end,
  CASE WHEN date_vacc_1 > a_end THEN a_end ELSE date_vacc_1 END AS risk_start,
  CASE WHEN date_vacc_1 + 28 > a_end THEN a_end ELSE date_vacc_1 + 28 END AS risk_end,
  CASE WHEN date_vacc_1 + 29 > a_end THEN a_end ELSE date_vacc_1 + 29 END AS post_start,
  a_end AS post_end FROM sjoin WHERE vacc_type <> 'uv'""")
oracle("k3_split_intervals", "SELECT * FROM ivs")
oracle("k4_sccs_rates", f"SELECT endpoint, vacc_type, expgr, {_RATES} FROM ivs GROUP BY ALL")
_TRATES = _RATES.replace(" * n", "")
oracle("k4_time_split_rates", f"SELECT endpoint, vt, period, expgr, {_TRATES} FROM labelled GROUP BY ALL")
oracle("k5_sccs_fit", f"""SELECT r.*, CASE WHEN f.g IS NOT NULL THEN true END AS converged, {r6('f.est', 'est')}, {r6('f.lcl', 'lcl')}, {r6('f.ucl', 'ucl')}
  FROM (SELECT endpoint, vacc_type, expgr, {_RATES.replace(', 8)', ', 6)')} FROM ivs GROUP BY ALL) r
  LEFT JOIN (SELECT g, 'Pre.Vacc' AS expgr, 1.0 AS est, NULL AS lcl, NULL AS ucl FROM fit_newtonk
    UNION ALL SELECT g, 'Clearance', exp(b1), exp(b1 - 1.959963984540054 * se1), exp(b1 + 1.959963984540054 * se1) FROM fit_newtonk
    UNION ALL SELECT g, 'Risk', exp(b2), exp(b2 - 1.959963984540054 * se2), exp(b2 + 1.959963984540054 * se2) FROM fit_newtonk) f
  ON f.g = r.endpoint || '|' || r.vacc_type AND f.expgr = r.expgr""")
oracle("k4_never_exposed_rates", f"""SELECT endpoint, period, {_TRATES} FROM labelled WHERE vacc_type = 'uv' GROUP BY ALL""")
oracle("k4_level_rates", f"SELECT endpoint, expgr, vt_expgr, {_TRATES} FROM labelled GROUP BY ALL")
oracle("k6_time_split", "SELECT * FROM tsplit WHERE vacc_type <> 'uv'")
oracle("k7_event_days_in_window", """SELECT d.* FROM sdays d JOIN spans s USING (endpoint, person_id)
  WHERE s.vacc_type <> 'uv'""")
oracle("k8_censor_at", """SELECT t.endpoint, t.person_id, t.vacc_type, t.t_start, least(t.t_stop, coalesce(d.death_date, t.t_stop)) AS t_stop,
  CASE WHEN d.death_date < t.t_stop THEN 0 ELSE t.event END AS event, t.expgr, t.period
  FROM tsplit t LEFT JOIN deaths d USING (person_id)
  WHERE t.vacc_type <> 'uv' AND (d.death_date IS NULL OR t.t_start < d.death_date)""")
oracle("k9_time_split_unexposed", "SELECT * FROM tsplit WHERE vacc_type = 'uv'")
oracle("k10_label_sccs", "SELECT * FROM labelled")
oracle("p1_date_spine", """SELECT s.date, s.period, coalesce(c.n, 0) AS n FROM spine s
  LEFT JOIN (SELECT start_date AS date, count(*) AS n FROM consult GROUP BY ALL) c USING (date)""")
oracle("p2_person_days", """SELECT endpoint, person_id, period, count(*) AS n_days, sum(days)::BIGINT AS sum_days,
  sum(days2)::BIGINT AS sum_days2, sum(days3)::BIGINT AS sum_days3 FROM pdall GROUP BY ALL""")
oracle("p3_dose_levels", "SELECT endpoint, person_id, expgr, expgr2, count(*) AS n FROM pdx WHERE days2 IS NOT NULL GROUP BY ALL")
oracle("p4_infection_levels", "SELECT endpoint, person_id, expgr3, count(*) AS n FROM pdx WHERE days2 IS NOT NULL GROUP BY ALL")
oracle("p5_until_death", "SELECT endpoint, person_id, count(*) AS n_days, max(date) AS last_day FROM panel GROUP BY ALL")
oracle("p6_attach_event", "SELECT endpoint, date, count(*) AS n, sum(event)::BIGINT AS events FROM panel GROUP BY ALL")


def _merge(col: str) -> str:
    return f"regexp_replace({col}, ' (0-6|7-13|14-20|21-27)$', ' 0-27')"


oracle("p7_merge_levels", f"""SELECT endpoint, {_merge('expgr')} AS expgr, {_merge('expgr2')} AS expgr2,
  {_merge('expgr3')} AS expgr3, event, count(*) AS n FROM (SELECT endpoint, expgr, expgr2, expgr3, event FROM panel)
  GROUP BY ALL""")
_WEEKS = ("0-6", "7-13", "14-20", "21-27")


def _listed(prefix: str, groups: tuple[str, ...], merged: bool) -> list[str]:
    spans = ("0-27",) if merged else _WEEKS
    return [f"{prefix} {g}{x}".replace("  ", " ") for g in groups for x in ("clearance", *spans)]


def _level_rates(source: str, merged: bool = False) -> str:
    doses = ("Dose1 ", "Dose2 ")
    every = [("expgr", x) for x in ["PB Baseline", *_listed("PB", doses, merged)]]
    every += [("expgr2", x) for x in ["AZ Baseline", *_listed("AZ", doses, merged)]]
    every += [("expgr3", x) for x in ["infection Baseline", *_listed("infection", ("",), merged)]]
    every += [("period", str(i)) for i in range(1, 50)]
    values = ", ".join(f"('{t}', '{lv}')" for t, lv in every)
    col = _merge if merged else str
    return f"""SELECT d.endpoint, d.term, d.level, coalesce(c.event, 0)::BIGINT AS event,
  coalesce(c.personday, 0)::BIGINT AS personday, {r8('c.event / nullif(c.personday, 0)::DOUBLE * 7', 'rate_week')}
  FROM (SELECT e.endpoint, l.term, l.level FROM (SELECT DISTINCT endpoint FROM {source}) e,
          (VALUES {values}) l(term, level)) d
  LEFT JOIN (SELECT endpoint, 'expgr' AS term, {col('expgr')} AS level, sum(event) AS event, count(*) AS personday
               FROM {source} WHERE vacc_type = 'PB' GROUP BY ALL
             UNION ALL SELECT endpoint, 'expgr2', {col('expgr2')}, sum(event), count(*) FROM {source} WHERE vacc_type = 'AZ' GROUP BY ALL
             UNION ALL SELECT endpoint, 'expgr3', {col('expgr3')}, sum(event), count(*) FROM {source} WHERE days3 IS NOT NULL GROUP BY ALL
             UNION ALL SELECT endpoint, 'period', CAST(period AS VARCHAR), sum(event), count(*) FROM {source} GROUP BY ALL) c
  USING (endpoint, term, level)"""


oracle("p8_level_rates", _level_rates("panel"))
oracle("p8_baseline_rates", _level_rates("exposed_days"))
oracle("p8_merged_rates", _level_rates("exposed_days", merged=True))
oracle("p12_event_days", """SELECT endpoint, person_id, date, period,
  CASE WHEN expgr2 <> 'AZ Baseline' THEN expgr2 WHEN expgr = 'PB Baseline' THEN 'Baseline' ELSE expgr END AS expgr_combined,
  expgr3 FROM exposed_days WHERE event = 1""")
oracle("f1_event_exposure", "SELECT * FROM fexp")
oracle("f2_attach_death", "SELECT a.*, d.death_date FROM afirst a LEFT JOIN deaths d USING (person_id)")
oracle("f3_attach_admissions", "SELECT * FROM fadm")
oracle("f4_admission_status", "SELECT * FROM fstat")
oracle("f5_first_spell", "SELECT * FROM fspell")
oracle("f6_hospital_summary", "SELECT endpoint, person_id, vacc_type, adm_status, dis_status, hosp_event FROM fsum")
oracle("f7_incident_cases", """SELECT endpoint, person_id, event_time AS start_date, sex, zone, vacc_type, vs
  FROM xsets WHERE event = 1""")
oracle("f8_product_at_event", """SELECT f.endpoint, f.person_id, f.start_date, f.code, f.age, f.sex,
  coalesce(v.vacc_type, 'uv') AS vacc_type, v.date_vacc_1, v.date_vacc_2,
  CASE WHEN v.date_vacc_1 > f.start_date THEN 'uv' ELSE coalesce(v.vacc_type, 'uv') END AS vt_at_event
  FROM firsts f LEFT JOIN vacc v USING (person_id)""")
oracle("o1_cooccurrence", """SELECT f.endpoint, f.person_id, f.start_date, f.code, f.age, f.sex, o.other_date,
  CASE WHEN other_date IS NULL THEN 'no_other_event' WHEN other_date < start_date THEN 'before'
       WHEN other_date <= start_date + 7 THEN 'other_1_week'
       WHEN other_date BETWEEN start_date + 8 AND start_date + 14 THEN 'other_2_weeks'
       WHEN other_date BETWEEN start_date + 15 AND start_date + 21 THEN 'other_3_weeks' ELSE 'other_later' END AS other_week
  FROM (SELECT * FROM firsts WHERE endpoint = 'any_a') f
  LEFT JOIN (SELECT person_id, min(start_date) AS other_date FROM ev WHERE endpoint = 'any_b' GROUP BY person_id) o
  USING (person_id)""")
oracle("o1_cooccurrence_status", """SELECT f.vacc_status, CASE WHEN f.vacc_status = 'uv' THEN 'uv' ELSE f.product END AS vacc_type,
  f.other_week, count(*) AS n FROM (
    SELECT CASE WHEN d1 IS NULL THEN 'uv' WHEN d2 >= 7 THEN 'v2_7+' WHEN d2 >= 1 THEN 'v2_0:6'
                WHEN d1 <= 0 THEN 'uv' WHEN d1 <= 6 THEN 'v1_0:6' WHEN d1 <= 13 THEN 'v1_7:13'
                WHEN d1 <= 20 THEN 'v1_14:20' WHEN d1 <= 27 THEN 'v1_21:27' WHEN d1 <= 34 THEN 'v1_28:34'
                WHEN d1 <= 41 THEN 'v1_35:41' ELSE 'v1_42+' END AS vacc_status, product,
           CASE WHEN gap IS NULL THEN 'no_other_event' WHEN gap < 0 THEN 'before' WHEN gap <= 7 THEN 'other_1_week'
                WHEN gap <= 14 THEN 'other_2_weeks' WHEN gap <= 21 THEN 'other_3_weeks' ELSE 'other_later' END AS other_week
    FROM (SELECT v.vacc_type AS product, p.start_date - v.date_vacc_1 AS d1,
                 CASE WHEN v.date_vacc_2 < e.a_end THEN p.start_date - v.date_vacc_2 END AS d2,
                 o.other_date - p.start_date AS gap
          FROM firsts p JOIN cc_ends e USING (endpoint)
          LEFT JOIN vacc v ON v.person_id = p.person_id AND v.date_vacc_1 < e.a_end
          LEFT JOIN (SELECT person_id, min(start_date) AS other_date FROM ev WHERE endpoint = 'any_b' GROUP BY person_id) o
            ON o.person_id = p.person_id
          WHERE p.endpoint = 'any_a')) f GROUP BY ALL""")
oracle("p9_pd_model_binary", f"""SELECT d.endpoint, 'at_risk' AS model, 'at_risk' AS term, '' AS level,
  d.event, d.personday, {r6('d.event / nullif(d.personday, 0)::DOUBLE * 7', 'rate_week')},
  {r6('b', 'coef')}, {r6('se', 'se')}, {r6(_P, 'p')}, true AS converged
  FROM (SELECT endpoint, sum(CASE WHEN lev NOT IN ('Baseline', 'Dose1 clearance', 'Dose2 clearance') THEN event ELSE 0 END)::BIGINT AS event,
               sum(CAST(lev NOT IN ('Baseline', 'Dose1 clearance', 'Dose2 clearance') AS BIGINT))::BIGINT AS personday
        FROM panel GROUP BY endpoint) d JOIN dfit USING (endpoint)""")
oracle("q1_crosstab", """SELECT endpoint, vacc_type, days_adm, count(*) AS n, 'kept' AS nulls FROM fsum GROUP BY ALL
  UNION ALL SELECT endpoint, vacc_type, days_adm, count(*), 'dropped' FROM fsum WHERE days_adm IS NOT NULL GROUP BY ALL""")
oracle("q2_freq_of_freq", """SELECT endpoint, times, count(*) AS n
  FROM (SELECT endpoint, person_id, count(*) AS times FROM adult GROUP BY ALL) GROUP BY ALL""")
oracle("q3_count_by", """SELECT endpoint, vacc_type, start_date - date_vacc_1 AS days, sum(n)::BIGINT AS n
  FROM wins GROUP BY ALL""")
oracle("q3_count_by_day", "SELECT endpoint, start_date, sum(n)::BIGINT AS n FROM wins GROUP BY ALL")
oracle("q3_count_by_age", "SELECT endpoint, age, sum(n)::BIGINT AS n FROM wins GROUP BY ALL")
oracle("q3_count_by_dose_date", "SELECT endpoint, vacc_type, date_vacc_1, sum(n)::BIGINT AS n FROM wins GROUP BY ALL")
oracle("q4_daily_series", """SELECT s.endpoint, s.start_date, coalesce(c.n, 0) AS n, s.start_date - DATE '1997-09-01' AS days,
  monthname(s.start_date) AS month
  FROM (SELECT endpoint, CAST(unnest(generate_series(DATE '1997-09-01', a_end, INTERVAL 1 DAY)) AS DATE) AS start_date
        FROM (SELECT endpoint, max(start_date) AS a_end FROM ev, latest
              WHERE start_date >= DATE '1997-09-01' AND start_date <= latest - 7 AND age >= 16 GROUP BY endpoint)) s
  LEFT JOIN (SELECT endpoint, start_date, count(*) AS n FROM ev, latest
             WHERE start_date <= latest - 7 AND age >= 16 GROUP BY ALL) c USING (endpoint, start_date)""")
_SERIES = ORACLES["q4_daily_series"]
oracle("l10_its_steps", f"""SELECT endpoint, start_date, n, {r6('m', 'fit')}, {r6('m - 1.96 * sqrt(m / k)', 'lcl')}, {r6('m + 1.96 * sqrt(m / k)', 'ucl')}
  FROM (SELECT endpoint, start_date, n, avg(n) OVER part AS m, count(*) OVER part AS k FROM ({_SERIES})
        WINDOW part AS (PARTITION BY endpoint, start_date >= {BEGIN}, start_date >= {BEGIN} + 28))""")
oracle("b2_report_counts", f"""SELECT endpoint, total_events || ' study events of ' || total_unique_events
  || ' incident people; ' || no_link_to_cohort || ' of them are not in the cohort, and '
  || no_match || ' cases have no control.' AS text FROM ({_ATTRITION})""")


# fits with many coefficients

_SIMD = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
_BASE = [("n_risk_gps", ()), ("simd", _SIMD), ("n_tests_gp", ())]
_Z = "1.959963984540054"
CTES["modelsets"] = """SELECT s.*, c.n_risk_gps, c.simd, c.n_tests_gp, c.diag_chd, c.diag_stroke, c.age_year
  FROM xsets s LEFT JOIN (SELECT person_id, n_risk_gps, simd, n_tests_gp, diag_chd, diag_stroke, age_year FROM cohort) c USING (person_id)"""
CTES["hospsets"] = f"SELECT endpoint, case_id, person_id, event, hosp FROM ({BODIES['x4_hospital_status']})"
CTES["testsets"] = f"SELECT endpoint, case_id, person_id, event, positive_before_event FROM ({BODIES['x5_test_timing']})"
CTES["bandsets"] = f"SELECT endpoint, case_id, person_id, event, bmi_gp, days_gp FROM ({BODIES['x7_cut_bands']})"
CTES["fullsets"] = """SELECT m.*, h.hosp, t.positive_before_event, b.bmi_gp, b.days_gp,
    CAST(m.age_year >= 65 AND m.person_id % 9 = 0 AS BIGINT) AS care_home
  FROM modelsets m JOIN hospsets h USING (endpoint, case_id, person_id, event)
  JOIN testsets t USING (endpoint, case_id, person_id, event) JOIN bandsets b USING (endpoint, case_id, person_id, event)"""


def _nested(var: str, levels: tuple[str, ...]) -> str:
    """Counts and odds ratios of the three nested models; the second stands in where the third has no estimate."""
    mark = f"n_{var}"
    models = {"1": [(var, levels)], "2": [(var, levels), _BASE[0]], "3": [(var, levels), *_BASE]}
    CTES.update(conditional_fits(mark, "modelsets", "case_id", models, steps=26))
    CTES[f"{mark}_effects"] = f"""SELECT endpoint, model, level, {_effect('1.96')} FROM ({effects_sql(mark, models)})
      WHERE term = '{var}'"""
    CTES[f"{mark}_shown"] = f"""SELECT * FROM {mark}_effects WHERE model <> '3'
      UNION ALL SELECT e.* REPLACE ('3' AS model) FROM {mark}_effects e
        JOIN (SELECT endpoint, CASE WHEN count(p) FILTER (model = '3') > 0 THEN '3' ELSE '2' END AS model
              FROM {mark}_effects GROUP BY endpoint) w USING (endpoint, model)"""
    parts = [
        f"""LEFT JOIN (SELECT endpoint, level AS {var}, {", ".join(f"{c} AS {c}_{m}" for c in ("est", "lcl", "ucl", "p", "converged"))}
          FROM {mark}_shown WHERE model = '{m}') m{m} USING (endpoint, {var})"""
        for m in models
    ]
    return f"""SELECT * FROM (SELECT endpoint, {var}, count(*) AS n, sum(event)::BIGINT AS events,
      {r6('sum(event) / count(*)::DOUBLE * 100', 'percent')} FROM xsets GROUP BY endpoint, {var}) c {" ".join(parts)}"""


def _effect(z: str) -> str:
    """Ratio, limits and p value from (b, se); a reference level has b = 0 and no se."""
    reference = "b = 0 AND se IS NULL"
    p = normal_p("b / se")
    return f"""{r6('exp(b)', 'est')}, {r6(f'CASE WHEN {reference} THEN 1 ELSE exp(b - {z} * se) END', 'lcl')},
      {r6(f'CASE WHEN {reference} THEN 1 ELSE exp(b + {z} * se) END', 'ucl')}, {r6(p, 'p')}, converged"""


oracle("l5_nested_models", _nested("vs_type", VS_TYPE_LEVELS))
oracle("l5_nested_models_product", _nested("vacc_type", PRODUCT_LEVELS))


def _text(i: int) -> str:
    cell = lambda c: f"CASE WHEN {c}_{i} IS NULL THEN 'NA' ELSE printf('%.2f', {c}_{i}) END"
    return f"concat({cell('est')}, '  ( ', {cell('lcl')}, '  -  ', {cell('ucl')}, ' )') AS or_{i}, p_{i}"


def _report(name: str, var: str, hide: bool) -> str:
    body = BODIES[name]
    if hide:
        third = ", ".join(f"CASE WHEN fitted THEN {c}_3 END AS {c}_3" for c in ("est", "lcl", "ucl", "p"))
        body = f"""SELECT * REPLACE ({third}) FROM (SELECT *, bool_or(est_3 IS DISTINCT FROM est_2) OVER (PARTITION BY endpoint) AS fitted
          FROM ({body}))"""
    return f"SELECT endpoint, {var}, n, events, percent, {', '.join(_text(i) for i in (1, 2, 3))} FROM ({body})"


oracle("b1_report_table", _report("l5_nested_models", "vs_type", True))
oracle("b1_report_product", _report("l5_nested_models_product", "vacc_type", False))

_PRODUCT = ("vacc_type", PRODUCT_LEVELS)
_CANDIDATES = [
    ("bmi_gp", ("(10,19]", "(19,24]", "(24,29]", "(29,34]", "(34,39]", "(39,50]")),
    ("days_gp", ("(-1,25]", "(25,50]", "(50,75]", "(75,110]", "(110,400]")),
    ("hosp", HOSP_LEVELS),
    ("positive_before_event", POSITIVE_LEVELS),
    *[(c, ()) for c in ("age_year", "diag_chd", "diag_stroke", "care_home")],
]
_SCREEN = {"none": [_PRODUCT, *_BASE]} | {c[0]: [_PRODUCT, *_BASE, c] for c in _CANDIDATES}
CTES.update(conditional_fits("screen", "fullsets", "case_id", _SCREEN, steps=26))
oracle("l6_screen_covariates", f"""SELECT endpoint, model AS candidate, term, level, {_effect(_Z)}
  FROM ({effects_sql('screen', _SCREEN)})""")
_EXTRA = {
    "adjusted": [_PRODUCT, *_BASE],
    "hospital": [_PRODUCT, *_BASE, ("hosp", HOSP_LEVELS)],
    "chd": [_PRODUCT, *_BASE, ("diag_chd", ())],
    "stroke": [("vs", VS_LEVELS), *_BASE, ("diag_stroke", ())],
    "never_positive": [_PRODUCT, *_BASE],
}
CTES.update(conditional_fits(
    "extra", "fullsets", "case_id", _EXTRA, where={"never_positive": "positive_before_event = 'never'"}, steps=26
))
oracle("l7_extra_models", f"""SELECT endpoint, model, term, level, {_effect(_Z)} FROM ({effects_sql('extra', _EXTRA)})""")

_PERIODS = ("period", tuple(str(i) for i in range(1, 50)))


def _exposures(merged: bool = False) -> list[tuple[str, tuple[str, ...]]]:
    doses = ("Dose1 ", "Dose2 ")
    listed = [_listed("PB", doses, merged), _listed("AZ", doses, merged), _listed("infection", ("",), merged)]
    first = (dose_level_names("PB")[0], dose_level_names("AZ")[0], INFECTION_LEVELS[0])
    return [(c, (f, *names)) for c, f, names in zip(("expgr", "expgr2", "expgr3"), first, listed)]


for _mark, _merged in (("pdfold", False), ("pdmerged", True)):
    _of = _merge if _merged else str
    CTES[_mark] = f"""SELECT endpoint, person_id, {_of('expgr')} AS expgr, {_of('expgr2')} AS expgr2, {_of('expgr3')} AS expgr3, period,
      event, count(*) AS cnt FROM (SELECT endpoint, person_id, expgr, expgr2, expgr3, period, event FROM panel) GROUP BY ALL"""


def _days_fit(mark: str, source: str, terms: list) -> dict:
    models = {"+".join(t for t, _ in terms): terms}
    CTES.update(conditional_fits(mark, source, "person_id", models, count="cnt", steps=26))
    return models


_COEFS = f"model, {r6('b', 'coef')}, {r6('se', 'se')}, {r6(normal_p('b / se'), 'p')}, converged"
_ONE = _days_fit("pdone", "pdfold", [_exposures()[0], _PERIODS])
oracle("p9_pd_model", f"""SELECT d.* REPLACE (round(d.rate_week, 6) + 0.0 AS rate_week), {_COEFS} FROM (
    SELECT endpoint, 'expgr' AS term, expgr AS level, sum(event * cnt)::BIGINT AS event, sum(cnt)::BIGINT AS personday,
      sum(event * cnt) / sum(cnt)::DOUBLE * 7 AS rate_week FROM pdfold GROUP BY ALL
    UNION ALL SELECT endpoint, 'period', CAST(period AS VARCHAR), sum(event * cnt)::BIGINT, sum(cnt)::BIGINT,
      sum(event * cnt) / sum(cnt)::DOUBLE * 7 FROM pdfold GROUP BY ALL) d
  LEFT JOIN ({effects_sql('pdone', _ONE)}) USING (endpoint, term, level)""")
_JOINT = _days_fit("pdjoint", "pdfold", [*_exposures(), _PERIODS])
oracle("p10_pd_model_joint", f"""SELECT d.* REPLACE (round(d.rate_week, 6) + 0.0 AS rate_week), {_COEFS}
  FROM ({_level_rates("panel")}) d LEFT JOIN ({effects_sql('pdjoint', _JOINT)}) USING (endpoint, term, level)""")
_WIDE = _days_fit("pdwide", "pdmerged", [*_exposures(True), _PERIODS])
_SHORT = "regexp_replace(printf('%.2f', {0}), '\\.?0+$', '')"
oracle("p11_rr_table", f"""SELECT endpoint, term, level, event, personday, rate_week, {r6('rate_ratio', 'rate_ratio')}, ci_lower, ci_upper,
    {_SHORT.format('rate_ratio')} || ' (' || ci_lower || ', ' || ci_upper || ')' AS rr_ci, p, converged FROM (
  SELECT d.* REPLACE (round(d.rate_week, 6) + 0.0 AS rate_week), round(exp(b), 2) AS rate_ratio,
    CASE WHEN se IS NULL THEN '' ELSE {_SHORT.format(f'exp(b - {_Z} * se)')} END AS ci_lower,
    CASE WHEN se IS NULL THEN '' ELSE {_SHORT.format(f'exp(b + {_Z} * se)')} END AS ci_upper,
    {r6(normal_p('b / se'), 'p')}, converged
  FROM ({_level_rates("panel", merged=True)}) d LEFT JOIN ({effects_sql('pdwide', _WIDE)}) USING (endpoint, term, level))""")
