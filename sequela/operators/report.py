"""Report tables: text cells from numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _number(col: str) -> Column:
    return F.when(F.col(col).isNull(), "NA").otherwise(F.format_string("%.2f", F.col(col)))


def interval_text(est: str, lcl: str, ucl: str) -> Column:
    """Estimate and limits as ``1.00  ( 0.50  -  2.00 )``."""
    return F.concat_ws(" ", _number(est), F.lit(" ("), _number(lcl), F.lit(" - "), _number(ucl), F.lit(")"))


def report_table(effects: DataFrame, by: str, hide_unfitted: bool = False) -> DataFrame:
    """Counts, and odds ratio text and p value of the three nested models.

    With ``hide_unfitted`` the third model is blanked for an endpoint in which
    it equals the second at every level, which is how a failed fit shows.
    """
    third = ["est_3", "lcl_3", "ucl_3", "p_3"]
    if hide_unfitted:
        differs = effects.groupBy("endpoint").agg(
            F.max(~F.col("est_3").eqNullSafe(F.col("est_2"))).alias("fitted")
        )
        effects = effects.join(differs, "endpoint").withColumns(
            {c: F.when(F.col("fitted"), F.col(c)) for c in third}
        )
    cells = {f"or_{i}": interval_text(f"est_{i}", f"lcl_{i}", f"ucl_{i}") for i in (1, 2, 3)}
    return effects.select(
        "endpoint", by, "n", "events", "percent",
        cells["or_1"].alias("or_1"), "p_1",
        cells["or_2"].alias("or_2"), "p_2",
        cells["or_3"].alias("or_3"), "p_3",
    )


def report_counts(attrition: DataFrame) -> DataFrame:
    """One sentence of counts per endpoint."""
    text = F.format_string(
        "%d study events of %d incident people; "
        "%d of them are not in the cohort, and %d cases have no control.",
        "total_events", "total_unique_events", "no_link_to_cohort", "no_match",
    )
    return attrition.select("endpoint", text.alias("text"))
