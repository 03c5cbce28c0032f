"""Fits of the self-controlled designs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequela.config import SCCS_LEVELS, VT_LEVELS
from sequela.models.clogit import Fit, coef_table, fit, strata_from_arrays, strata_table
from sequela.models.effects import Z_EXACT, effect_table, lr_table
from sequela.models.kernel import Term
from sequela.operators.persondays import level_rates, level_sets
from sequela.operators.sccs import interval_rates, intervals_array
from sequela.sources.stages import stage

EXPGR = Term("expgr", SCCS_LEVELS)
PERIOD = Term("period", ("0", "1", "2", "3", "4"))
VT_EXPGR = Term("vt_expgr", VT_LEVELS)


def interval_fits(windows: DataFrame, by: Sequence[str]) -> list[Fit]:
    """Interval design per group: one stratum per event row, offset log of the length."""
    rows = intervals_array(windows)
    strata = strata_from_arrays(rows, by, "intervals", [EXPGR], "interval", "n")
    return fit(strata, [EXPGR], {"expgr": ["expgr"]}, ties="exact")


def sccs_fit(windows: DataFrame, intervals: DataFrame) -> DataFrame:
    """Rates and rate ratios per endpoint, product and level, joined by level name."""
    by = ["endpoint", "vacc_type"]
    spark = windows.sparkSession
    effects = effect_table(coef_table(spark, interval_fits(windows, by), by), Z_EXACT).select(
        *by, F.col("level").alias("expgr"), "est",
        F.when(F.col("level") != SCCS_LEVELS[0], F.col("lcl")).alias("lcl"),
        F.when(F.col("level") != SCCS_LEVELS[0], F.col("ucl")).alias("ucl"),
        "converged",
    )
    return interval_rates(intervals, [*by, "expgr"]).join(effects, [*by, "expgr"], "left")


def time_split_fits(labelled: DataFrame) -> dict[str, list[Fit]]:
    """The five fits of the time-split design, strata are persons, exact ties.

    ``AZ`` and ``PB``: level among unexposed time and that product; ``uv``:
    calendar period in never-exposed people; ``vt_period`` and ``vt``: product
    by level with and without the period.
    """
    labelled = stage(labelled, "labelled")  # read by the three tables of strata
    log_days = F.log(F.col("interval").cast("double"))
    person = ["person_id"]
    products = [
        labelled.filter(F.col("vt").isin("uv", product)).withColumn("subset", F.lit(product))
        for product in ("AZ", "PB")
    ]
    both = products[0].unionByName(products[1])
    by_product = strata_table(both, ["endpoint", "subset"], person, [EXPGR], offset=log_days)
    never = strata_table(
        labelled.filter(F.col("vacc_type") == "uv"), ["endpoint"], person, [PERIOD], offset=log_days
    )
    joint_terms = [VT_EXPGR, PERIOD]
    joint = strata_table(labelled, ["endpoint"], person, joint_terms, offset=log_days)
    return {
        "product": fit(by_product, [EXPGR], {"expgr": ["expgr"]}, ties="exact"),
        "uv": fit(never, [PERIOD], {"uv_period": ["period"]}, ties="exact"),
        "joint": fit(
            joint, joint_terms, {"vt": ["vt_expgr"], "vt_period": ["vt_expgr", "period"]},
            ties="exact",
        ),
    }


def sccs_models(labelled: DataFrame) -> DataFrame:
    """Effects of the five fits in one table; ``model`` names the fit."""
    spark = labelled.sparkSession
    fits = time_split_fits(labelled)
    product = coef_table(spark, fits["product"], ["endpoint", "subset"])
    rest = coef_table(spark, fits["uv"] + fits["joint"], ["endpoint"])
    return effect_table(
        product.drop("model").withColumnRenamed("subset", "model").unionByName(rest), Z_EXACT
    )


def time_split_tests(labelled: DataFrame) -> DataFrame:
    """Likelihood-ratio test of the period beside product by level, per endpoint."""
    joint = time_split_fits(labelled)["joint"]
    return lr_table(labelled.sparkSession, joint, "vt_period", "vt", ["endpoint"])


def panel_terms(n_periods: int, merged: bool = False) -> dict[str, Term]:
    sets = level_sets(merged)
    terms = {c: Term(c, tuple(names)) for c, names in sets.items()}
    terms["period"] = Term("period", tuple(str(i) for i in range(1, n_periods + 1)))
    return terms


def pd_model(
    panel: DataFrame,
    terms: Sequence[Term],
    n_periods: int,
    merged: bool = False,
    everyone: bool = False,
    model: str | None = None,
) -> DataFrame:
    """Person-day model of the given terms, Efron ties, beside each level's counts.

    ``panel`` holds days or pieces of days. Each day has the same length, so the offset is 0 and equal
    days of a person fold into one row with a count. ``everyone``: the counts of each level are of
    all people of the panel, as the model's are; else each product counts its own
    recipients and the infection those who tested positive.
    """
    names = [t.name for t in terms]
    strata = strata_table(panel, ["endpoint"], ["person_id"], terms, count="interval")
    fits = fit(strata, terms, {model or "+".join(names): names})
    coefs = coef_table(panel.sparkSession, fits, ["endpoint"])
    rates = level_rates(panel, n_periods, merged, None if not everyone else terms)
    return rates.filter(F.col("term").isin(*names)).join(coefs, ["endpoint", "term", "level"], "left")
