"""Study parameters and the fixed vocabularies the result tables use."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, timedelta

# Age bands as (label, from, below). The label "0-15" of both
# schemes stands for ages under 15.
FINE_AGE = (
    ("0-15", None, 15),
    ("15-19", 15, 20),
    ("20-39", 20, 40),
    ("40-59", 40, 60),
    ("60-79", 60, 80),
    ("80+", 80, None),
)
COARSE_AGE = (
    ("0-15", None, 15),
    ("16-39", 15, 40),
    ("40-59", 40, 60),
    ("60-79", 60, 80),
    ("80+", 80, None),
)
AGE_SCHEMES = {"fine": FINE_AGE, "coarse": COARSE_AGE}

# Days since dose 1 and dose 2 at the index date, right-closed.
DOSE1_STATUS = (
    ("uv", None, 0),
    ("v1_0:6", 0, 6),
    ("v1_7:13", 6, 13),
    ("v1_14:20", 13, 20),
    ("v1_21:27", 20, 27),
    ("v1_28:34", 27, 34),
    ("v1_35:41", 34, 41),
    ("v1_42+", 41, None),
)
DOSE2_STATUS = (("v2_0:6", 0, 6), ("v2_7+", 6, None))
LATE_STATUS = ("v1_28:34", "v1_35:41", "v1_42+", "v2_0:6", "v2_7+")
VS_LEVELS = ("uv", "v1_0:6", "v1_7:13", "v1_14:20", "v1_21:27", "v1_28+_v2")
VS_TYPE_LEVELS = (
    "uv",
    "AZ_v1_0:6", "AZ_v1_7:13", "AZ_v1_14:20", "AZ_v1_21:27", "AZ_v1_28+_v2",
    "PB_v1_0:6", "PB_v1_7:13", "PB_v1_14:20", "PB_v1_21:27", "PB_v1_28+_v2",
)
PRODUCT_LEVELS = ("uv", "AZ", "PB")
HOSP_LEVELS = ("no_adm", "before", "in_hosp")

# First positive test around the index date, reference first.
POSITIVE_LEVELS = (
    "never", "28+ days", "14-27 days", "0-13 days", "1-6 post event", "7+ post event",
)

# Person-time bands after the first dose, (label, over, up to).
FOLLOW_BANDS = (
    ("0-7", 0, 7),
    ("8-14", 7, 14),
    ("15-21", 14, 21),
    ("22-28", 21, 28),
    ("29+", 28, None),
)

# Levels of the self-controlled designs, reference level first.
SCCS_LEVELS = ("Pre.Vacc", "Clearance", "Risk")
VT_LEVELS = ("Pre.Vacc", "PB_Clearance", "PB_Risk", "AZ_Clearance", "AZ_Risk")
DOSE_LEVELS = (
    "Baseline",
    "Dose1 clearance", "Dose1 0-6", "Dose1 7-13", "Dose1 14-20", "Dose1 21-27",
    "Dose2 clearance", "Dose2 0-6", "Dose2 7-13", "Dose2 14-20", "Dose2 21-27",
)
INFECTION_LEVELS = (
    "infection Baseline",
    "infection clearance",
    "infection 0-6",
    "infection 7-13",
    "infection 14-20",
    "infection 21-27",
)


def dose_level_names(product: str) -> list[str]:
    return [f"{product} {level}" for level in DOSE_LEVELS]


@dataclass(frozen=True)
class StudyParams:
    """Everything a study fixes in advance; no value depends on the data."""

    begin: date
    end: date
    extract: date
    endpoint_groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    endpoint_names: tuple[str, ...] = ()
    lag_days: int = 7
    # days before the study that prior events are looked for; None for all of them
    lookback_days: int | None = None
    dose2_lookback_days: int | None = None
    min_age: int = 16
    min_gap_days: int = 18
    controls_per_case: int = 10
    match_keys: tuple[str, ...] = ("sex", "zone", "match_age")
    seed: str = "sequela"
    n_sims: int = 10_000
    # self-controlled windows, in days around the first dose
    pre_from: int = 104
    pre_to: int = 14
    risk_from: int = 0
    risk_to: int = 28
    post_from: int = 29
    post_to: int = 119
    # historical window, in days before the study begins
    hist_from: int = 68
    hist_to: int = 40
    hist_days: int = 28
    period_days: int = 7
    hospital_lookback: int = 14
    # parts a single matching stratum is numbered in
    salts: int = 32

    def shift(self, days: int) -> date:
        return self.begin + timedelta(days=days)

    def endpoint_codes(self) -> dict[str, tuple[str, ...]]:
        """A name without a group stands for the code of that name."""
        return {
            name: tuple(self.endpoint_groups.get(name, (name,)))
            for name in self.endpoint_names
        }
