"""Self-controlled case series by person-day: two doses and an infection.

Four tracks run beside each other over a person's study time: the doses of either
product, the infection, and the calendar periods. ``person_pieces`` overlays them:
it cuts the time at every day on which a level can change, so that a piece holds
days of constant levels and ``interval`` says how many. All operators on days take
pieces as well. ``person_days`` unfolds single days. Both come from arrays on the
person's row, without a join or a shuffle; ``event_date`` travels with the person
and marks the event day.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sequela.config import DOSE_LEVELS, INFECTION_LEVELS, dose_level_names
from sequela.functions.columns import days_between, last_rule, short_number
from sequela.functions.stats import normal_quantile
from sequela.models.kernel import Term

LEVEL_SETS = {"expgr": "PB", "expgr2": "AZ"}


def date_spine(spark: SparkSession, start: date, end: date, length: int = 7) -> DataFrame:
    """Every day of the study with the number of its period."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")
    )
    return days.withColumn("period", _period(F.col("date"), start, length))


def _period(day: Column, start: date, length: int) -> Column:
    return (F.floor(days_between(day, F.lit(start)) / F.lit(length)) + 1).cast("int")


def person_days(people: DataFrame, start: date, end: date, length: int = 7) -> DataFrame:
    """One row per person and study day with days since each dose and the infection."""
    day = F.col("date")
    return (
        people.withColumn("date", F.explode(F.sequence(F.lit(start), F.lit(end))))
        .select(
            "endpoint",
            "person_id",
            "vacc_type",
            "date",
            _period(day, start, length).alias("period"),
            days_between(day, F.col("date_vacc_1")).alias("days"),
            days_between(day, F.col("date_vacc_2")).alias("days2"),
            days_between(day, F.col("specimen_date")).alias("days3"),
            "death_date",
            F.col("start_date").alias("event_date"),
            F.lit(1).alias("interval"),
        )
    )


# Days after an exposure on which a level begins or ends.
TRACK_CUTS = (-14, 0, 7, 14, 21, 28)


def person_pieces(people: DataFrame, start: date, end: date, length: int = 7) -> DataFrame:
    """Maximal runs of days with constant levels, periods and event, per person.

    The columns are those of ``person_days``; ``date`` is a piece's first day and ``interval``
    its days. Days after death are left out, the day of death stays; people who died before the
    start have no piece. The event day is a piece of its own.
    """
    first, last = F.lit(start), F.coalesce(F.least(F.lit(end), F.col("death_date")), F.lit(end))
    n_periods = (end - start).days // length + 1
    periods = F.array(*[F.lit(start + timedelta(days=k * length)) for k in range(n_periods)])
    # on day 28 after dose 1 the days before dose 2 begin to count
    tracks = [F.date_add(c, d) for c in ("date_vacc_1", "date_vacc_2", "specimen_date") for d in TRACK_CUTS]
    event = [F.col("start_date"), F.date_add("start_date", 1)]
    cuts = F.filter(
        F.concat(periods, F.array_compact(F.array(*tracks, *event))), lambda d: (d >= first) & (d <= F.col("_last"))
    )
    day = F.col("date")
    return (
        people.filter(F.col("death_date").isNull() | (F.col("death_date") >= first))
        .withColumn("_last", last)
        .withColumn("_cuts", F.sort_array(F.array_distinct(cuts)))
        .withColumn("_ends", F.concat(F.slice("_cuts", F.lit(2), F.size("_cuts")), F.array(F.date_add("_last", 1))))
        .withColumn("_piece", F.explode(F.arrays_zip("_cuts", "_ends")))
        .withColumn("date", F.col("_piece._cuts"))
        .select(
            "endpoint",
            "person_id",
            "vacc_type",
            "date",
            _period(day, start, length).alias("period"),
            days_between(day, F.col("date_vacc_1")).alias("days"),
            days_between(day, F.col("date_vacc_2")).alias("days2"),
            days_between(day, F.col("specimen_date")).alias("days3"),
            "death_date",
            F.col("start_date").alias("event_date"),
            days_between(F.col("_piece._ends"), day).cast("int").alias("interval"),
        )
    )


def _risk_rules(days: Column, levels: Sequence[str]) -> list[tuple[Column, str]]:
    # Risk weeks after an exposure.
    return [(days.between(a, b), lv) for (a, b), lv in
            zip(((0, 6), (7, 13), (14, 20), (21, 27)), levels)]


def dose_levels(panel: DataFrame, product: str, out: str) -> DataFrame:
    """Exposure level to one product on each day; a later rule overrides an earlier one.

    The 14 days before dose 2 are clearance only beyond day 27 after dose 1.
    """
    names = dose_level_names(product)
    d1, d2, own = F.col("days"), F.col("days2"), F.col("vacc_type") == product
    rules = [(d1.between(-14, -1), names[1]), *_risk_rules(d1, names[2:6])]
    rules += [(d2.between(-14, -1) & (d1 > 27), names[6]), *_risk_rules(d2, names[7:11])]
    return panel.withColumn(out, last_rule([(own & c, lv) for c, lv in rules], names[0]))


def infection_levels(panel: DataFrame) -> DataFrame:
    """Infection level on each day; Baseline for people without a positive test."""
    d3 = F.col("days3")
    rules = [(d3.between(-14, -1), INFECTION_LEVELS[1]), *_risk_rules(d3, INFECTION_LEVELS[2:])]
    return panel.withColumn("expgr3", last_rule(rules, INFECTION_LEVELS[0]))


def until_death(panel: DataFrame) -> DataFrame:
    """Drop days after death; the day of death stays."""
    death = F.col("death_date")
    return panel.filter(death.isNull() | (F.col("date") <= death))


def attach_event(panel: DataFrame) -> DataFrame:
    """Add ``event``: 1 on the person's event day, else 0."""
    return panel.withColumn(
        "event", F.when(F.col("date") == F.col("event_date"), 1).otherwise(0)
    )


def full_panel(people: DataFrame, start: date, end: date, length: int = 7) -> DataFrame:
    """Days with every level, cut at death, events marked."""
    return _levelled(until_death(person_days(people, start, end, length)))


def full_pieces(people: DataFrame, start: date, end: date, length: int = 7) -> DataFrame:
    """The same as pieces: a row where ``full_panel`` has ``interval`` equal ones but for the date."""
    return _levelled(person_pieces(people, start, end, length))


def _levelled(panel: DataFrame) -> DataFrame:
    for out, product in LEVEL_SETS.items():
        panel = dose_levels(panel, product, out)
    return attach_event(infection_levels(panel))


def _merged(name: str) -> str:
    kind, _, span = name.rpartition(" ")
    return f"{kind} 0-27" if span[0].isdigit() else name


def merge_levels(panel: DataFrame) -> DataFrame:
    """Replace the weekly risk levels by one level 0-27 per dose and infection."""
    for col, names in level_sets().items():
        merged = {n: _merged(n) for n in names if _merged(n) != n}
        panel = panel.replace(merged, subset=[col])
    return panel


def level_sets(merged: bool = False) -> dict[str, list[str]]:
    """Levels per exposure column, reference first."""
    sets = {col: dose_level_names(product) for col, product in LEVEL_SETS.items()}
    sets["expgr3"] = list(INFECTION_LEVELS)
    if merged:
        sets = {c: list(dict.fromkeys(_merged(n) for n in names)) for c, names in sets.items()}
    return sets


def level_rates(
    panel: DataFrame, n_periods: int, merged: bool = False, terms: Sequence[Term] | None = None
) -> DataFrame:
    """Events, person-days and weekly rate for every level and period.

    Each product counts its own recipients, the infection levels count people
    with a positive test, the periods count everyone. With ``terms`` the levels
    of these terms are counted over everyone instead; a number's level is ``""``
    and counts the days on which it is not 0. Days are counted by their joint
    levels first; each count then adds to one level per term. Levels without a
    day are listed with zeros.
    """
    sets = level_sets(merged) if terms is None else {t.name: list(t.levels) for t in terms if t.name != "period"}
    cells = panel.groupBy(
        "endpoint", "vacc_type", *sets, "period", F.col("days3").isNotNull().alias("tested")
    ).agg(F.sum("event").alias("event"), F.sum("interval").alias("personday"))

    def entry(term: str) -> Column:
        return F.struct(F.lit(term).alias("term"), F.col(term).cast("string").alias("level"))

    if terms is None:
        entries = [F.when(F.col("vacc_type") == v, entry(c)) for c, v in LEVEL_SETS.items()]
        entries += [F.when(F.col("tested"), entry("expgr3")), entry("period")]
    else:
        entries = [
            # a number's days at 0 belong to no level
            entry(c) if names else F.when(F.col(c) != 0, F.struct(F.lit(c).alias("term"), F.lit("").alias("level")))
            for c, names in sets.items()
        ]
        entries.append(entry("period"))
    counted = (
        cells.select("endpoint", "event", "personday", F.inline(F.array_compact(F.array(*entries))))
        .groupBy("endpoint", "term", "level")
        .agg(F.sum("event").alias("event"), F.sum("personday").alias("personday"))
    )
    every = [(c, lv) for c, names in sets.items() for lv in names or ("",)]
    every += [("period", str(i)) for i in range(1, n_periods + 1)]
    listed = F.array(
        *[F.struct(F.lit(c).alias("term"), F.lit(lv).alias("level")) for c, lv in every]
    )
    # one entry per level, so the map of an endpoint is as long as the level list
    found = counted.groupBy("endpoint").agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.struct("term", "level"), F.struct("event", "personday")))
        ).alias("found")
    )
    hit = F.try_element_at("found", F.struct("term", "level"))
    full = found.select("endpoint", "found", F.inline(listed)).select(
        "endpoint",
        "term",
        "level",
        F.coalesce(hit["event"], F.lit(0)).alias("event"),
        F.coalesce(hit["personday"], F.lit(0)).alias("personday"),
    )
    return full.withColumn(
        "rate_week", F.try_divide(F.col("event"), F.col("personday")) * 7
    )


def rr_table(effects: DataFrame, conf: float = 0.95) -> DataFrame:
    """Rate ratios with limits at any level, two decimals, and their text.

    Reference levels have a ratio of 1 and blank limits; levels without an estimate have no text.
    """
    q = F.lit(normal_quantile(1 - (1 - conf) / 2))
    ratio = F.round(F.exp("coef"), 2)

    def limit(sign: int) -> Column:
        value = F.round(F.exp(F.col("coef") + sign * q * F.col("se")), 2)
        return F.when(value.isNotNull(), short_number(value)).otherwise("")

    shown = F.concat(
        short_number("rate_ratio"), F.lit(" ("), "ci_lower", F.lit(", "), "ci_upper", F.lit(")")
    )
    text = F.when(F.col("rate_ratio").isNotNull(), shown)
    return effects.withColumns(
        {"rate_ratio": ratio, "ci_lower": limit(-1), "ci_upper": limit(1)}
    ).withColumn("rr_ci", text)


def event_days(panel: DataFrame) -> DataFrame:
    """The event days with one exposure label over both products."""
    pb, az = F.col("expgr"), F.col("expgr2")
    label = F.when(az != f"AZ {DOSE_LEVELS[0]}", az).otherwise(pb)
    combined = F.when(label == f"PB {DOSE_LEVELS[0]}", DOSE_LEVELS[0]).otherwise(label)
    return panel.filter(F.col("event") == 1).withColumn("expgr_combined", combined)
