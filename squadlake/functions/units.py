"""Unit, scale and score rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit factors, thresholds, weights and cut points the results depend on.
M_PER_YD = 0.9144
MPH_PER_MS = 2.2369362920544
N_PER_LBF = 4.4482216152605
LBF_BELOW = 1500.0
MPH_ABOVE = 12.0
LEAN_PCT_BELOW = 100
ACWR_CUTS = (0.8, 1.3, 1.5)
READINESS_WEIGHTS = {"sleep_quality": 0.20, "sleep_hours": 0.15, "soreness": 0.25,
                     "fatigue": 0.20, "stress": 0.10, "mood": 0.10}
LIKERT = ("sleep_quality", "soreness", "fatigue", "stress", "mood")


def to_newtons(v: Column) -> Column:
    """Pound-force and newton readings do not overlap, so size decides."""
    return F.when(v < LBF_BELOW, v * N_PER_LBF).otherwise(v)


def normalise_force(v: Column, unit: Column) -> tuple[Column, Column]:
    """(newtons, inferred): inferred when the label is absent or contradicts the size."""
    decided = F.when(v < LBF_BELOW, F.lit("lbf")).otherwise(F.lit("N"))
    return to_newtons(v), ~unit.eqNullSafe(decided)


def to_ms(v: Column) -> Column:
    return F.when(v > MPH_ABOVE, v / MPH_PER_MS).otherwise(v)


def normalise_speed(v: Column, unit: Column) -> tuple[Column, Column]:
    decided = F.when(v > MPH_ABOVE, F.lit("mph")).otherwise(F.lit("m/s"))
    return to_ms(v), v.isNotNull() & ~unit.eqNullSafe(decided)


def to_metres(v: Column, unit: Column) -> Column:
    return F.when(unit == "yd", v * M_PER_YD).otherwise(v)


def normalise_distance(v: Column, unit: Column) -> tuple[Column, Column]:
    """Yards and metres overlap, so the label is believed and only its absence is flagged."""
    return to_metres(v, unit), v.isNotNull() & unit.isNull()


def weight_mislabeled(unit: Column) -> Column:
    """Weights are always pounds; a 'kg' label is wrong."""
    return F.coalesce(unit == "kg", F.lit(False))


def lean_mass(lean: Column, weight: Column) -> tuple[Column, Column]:
    """(pounds, was_pct): below 100 the value is a percentage of body weight."""
    was_pct = F.coalesce(lean < LEAN_PCT_BELOW, F.lit(False))
    return F.round(F.when(was_pct, weight * lean / 100).otherwise(lean), 2), was_pct


def rescale(v: Column, scale_max: Column) -> Column:
    """A 1..k answer on 1..10."""
    return F.when(scale_max == 10, v).otherwise(F.round(1 + (v - 1) * 9 / (scale_max - 1), 2))


def day_scale(top_answer: Column) -> Column:
    """A day's cohort answers above 5 only on the ten-point scale."""
    return F.when(top_answer > 5, F.lit(10)).otherwise(F.lit(5))


def acwr_band(ratio: Column, cuts: tuple[float, float, float] = ACWR_CUTS) -> Column:
    low, sweet, elevated = cuts
    return (F.when(ratio < low, "low").when(ratio <= sweet, "sweet")
             .when(ratio <= elevated, "elevated").when(ratio > elevated, "high"))


def readiness(sleep_quality: Column, sleep_hours: Column, soreness: Column, fatigue: Column,
              stress: Column, mood: Column) -> Column:
    """Weighted 1..10 score; soreness, fatigue and stress count inverted."""
    w = READINESS_WEIGHTS
    hours = F.least(F.lit(10.0), F.greatest(F.lit(1.0), sleep_hours))
    return F.round(w["sleep_quality"] * sleep_quality + w["sleep_hours"] * hours
                   + w["soreness"] * (11 - soreness) + w["fatigue"] * (11 - fatigue)
                   + w["stress"] * (11 - stress) + w["mood"] * mood, 2)


def rank_of(c: Column, labels: tuple[str, ...], other: int | None = None) -> Column:
    """1 for the first label, 2 for the second, ...; ``other`` for anything else."""
    ranked = F.when(c == labels[0], 1)
    for i, label in enumerate(labels[1:], start=2):
        ranked = ranked.when(c == label, i)
    return ranked if other is None else ranked.otherwise(other)


def label_of(rank: Column, labels: tuple[str, ...], other: str | None = None) -> Column:
    named = F.when(rank == 1, labels[0])
    for i, label in enumerate(labels[1:], start=2):
        named = named.when(rank == i, label)
    return named if other is None else named.otherwise(other)


PRACTICE = ("DNP", "LP", "FP")
GAME = ("Out", "Doubtful", "Questionable")
METHODS = ("DEXA", "BIA", "scale")


def practice_rank(c: Column) -> Column:
    return rank_of(c, PRACTICE[:2], other=3)


def game_rank(c: Column) -> Column:
    return rank_of(c, GAME)


def method_rank(c: Column) -> Column:
    return rank_of(c, METHODS[:2], other=3)


def flags(*conditional: tuple[Column, str | Column]) -> Column:
    """Array of the labels whose condition holds."""
    return F.array_compact(F.array(*[
        F.when(cond, F.lit(label) if isinstance(label, str) else label) for cond, label in conditional]))
