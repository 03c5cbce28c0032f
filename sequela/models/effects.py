"""Tables of effects built from fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sequela.config import HOSP_LEVELS
from sequela.functions.stats import normal_quantile
from sequela.models.clogit import Fit, coef_table, fit, lr_test, strata_table
from sequela.models.kernel import Term
from sequela.operators.describe import crude_table


# 95 % limits of the matched-set tables; tables that quote a model's own
# confidence interval use the exact normal quantile.
Z_ROUNDED = 1.96
Z_EXACT = normal_quantile(0.975)


def effect_table(coefs: DataFrame, z: float = Z_ROUNDED) -> DataFrame:
    """Ratios with limits ``z`` standard errors away; the reference level is 1 / 1 / 1."""
    reference = (F.col("coef") == 0) & F.col("se").isNull()

    def ratio(sign: int):
        return F.when(reference, 1.0).otherwise(F.exp(F.col("coef") + sign * z * F.col("se")))

    return coefs.select(
        *[c for c in coefs.columns if c not in ("coef", "se", "p")],
        F.exp("coef").alias("est"),
        ratio(-1).alias("lcl"),
        ratio(1).alias("ucl"),
        "p",
    )


def effectiveness(effects: DataFrame, suffix: str = "raw") -> DataFrame:
    """Odds ratios and effectiveness in percent, whose limits swap sides."""
    keys = [c for c in effects.columns if c not in ("est", "lcl", "ucl", "p")]
    return effects.select(
        *keys,
        F.col("est").alias(f"or_{suffix}"),
        F.col("lcl").alias(f"or_lcl_{suffix}"),
        F.col("ucl").alias(f"or_ucl_{suffix}"),
        ((1 - F.col("est")) * 100).alias(f"ve_{suffix}"),
        ((1 - F.col("ucl")) * 100).alias(f"ve_lcl_{suffix}"),
        ((1 - F.col("lcl")) * 100).alias(f"ve_ucl_{suffix}"),
    )


def nested_models(
    sets: DataFrame, var: Term, simd_levels: Sequence[str], by: Sequence[str] = ("endpoint",)
) -> DataFrame:
    """Counts and odds ratios of three models: raw, with risk count, fully adjusted.

    The third model uses the rows with a known deprivation group. Where it has
    no estimate for the exposure, the second model stands in for it.
    """
    risk, simd, tests = Term("n_risk_gps"), Term("simd", tuple(simd_levels)), Term("n_tests_gp")
    models = {
        "1": [var.name],
        "2": [var.name, risk.name],
        "3": [var.name, risk.name, simd.name, tests.name],
    }
    terms = [var, risk, simd, tests]
    fits = fit(strata_table(sets, by, ["case_id"], terms), terms, models)
    second = {f.group: f for f in fits if f.model == "2"}
    shown = [
        f if f.model != "3" or _has_effect(f, var) else _as_model(second[f.group], "3")
        for f in fits
    ]
    effects = effect_table(coef_table(sets.sparkSession, shown, by)).filter(
        F.col("term") == var.name
    )
    table = crude_table(sets, var.name)
    for m in models:
        part = effects.filter(F.col("model") == m).select(
            *by,
            F.col("level").alias(var.name),
            *[F.col(c).alias(f"{c}_{m}") for c in ("est", "lcl", "ucl", "p", "converged")],
        )
        table = table.join(part, [*by, var.name], "left")
    return table


def _has_effect(f: Fit, var: Term) -> bool:
    return any(c is not None and s is not None for t, _, c, s in f.rows() if t == var.name)


def _as_model(f: Fit, name: str) -> Fit:
    return Fit(**{**f.__dict__, "model": name})


def screen_covariates(
    sets: DataFrame,
    exposure: Term,
    base: Sequence[Term],
    candidates: Sequence[Term],
    by: Sequence[str] = ("endpoint",),
) -> DataFrame:
    """Exposure effect refitted with one candidate covariate at a time.

    All refits share one strata table and run in the same Newton jobs; a model
    leaves out the rows that miss its own candidate.
    """
    terms = [exposure, *base, *candidates]
    shared = [t.name for t in (exposure, *base)]
    models = {"none": shared, **{c.name: [*shared, c.name] for c in candidates}}
    fits = fit(strata_table(sets, by, ["case_id"], terms), terms, models)
    return effect_table(coef_table(sets.sparkSession, fits, by), Z_EXACT).withColumnRenamed(
        "model", "candidate"
    )


def extra_models(
    sets: DataFrame,
    product: Term,
    status: Term,
    base: Sequence[Term],
    by: Sequence[str] = ("endpoint",),
) -> DataFrame:
    """Further fits: with hospital status, with heart disease and stroke, never positive only."""
    hosp = Term("hosp", HOSP_LEVELS)
    chd, stroke = Term("diag_chd"), Term("diag_stroke")
    shared = [t.name for t in base]
    terms = [product, status, *base, hosp, chd, stroke]
    models = {
        "adjusted": [product.name, *shared],
        "hospital": [product.name, *shared, hosp.name],
        "chd": [product.name, *shared, chd.name],
        "stroke": [status.name, *shared, stroke.name],
    }
    fits = fit(strata_table(sets, by, ["case_id"], terms), terms, models)
    never = sets.filter(F.col("positive_before_event") == "never")
    terms = [product, *base]
    fits += fit(
        strata_table(never, by, ["case_id"], terms), terms, {"never_positive": [t.name for t in terms]}
    )
    return effect_table(coef_table(sets.sparkSession, fits, by), Z_EXACT)


def lr_table(
    spark: SparkSession, fits: Sequence[Fit], larger: str, smaller: str, by: Sequence[str]
) -> DataFrame:
    """Likelihood-ratio test of two nested models per group."""
    found = {(f.group, f.model): f for f in fits}
    rows = []
    for group in sorted({f.group for f in fits}):
        big, small = found[group, larger], found[group, smaller]
        chi2, df, p = lr_test(big, small)
        p = p if df > 0 else None
        done = big.converged and small.converged
        rows.append((*group, big.loglik, small.loglik, *((chi2, df, p) if done else (None,) * 3), done))
    schema = ", ".join(f"{b} string" for b in by)
    return spark.createDataFrame(
        rows, schema + ", loglik_1 double, loglik_0 double, chi2 double, df long, p double, converged boolean"
    )
