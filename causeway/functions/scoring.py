"""Directions, magnitudes, scores and updates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
DEADBAND, MEDIUM, LARGE = 0.003, 0.01, 0.03
DECISION_DEADBAND, HALF_MASS, SMALL_BELOW, MEDIUM_BELOW = 0.15, 0.5, 0.40, 0.70
STEP, FLOOR = 0.02, 0.05


def flip(direction: Column) -> Column:
    return F.when(direction == "UP", "DOWN").when(direction == "DOWN", "UP").otherwise(direction)


def sign(direction: Column) -> Column:
    return F.when(direction == "UP", 1.0).when(direction == "DOWN", -1.0).otherwise(0.0)


def magnitude(weight: Column) -> Column:
    return F.when(weight < SMALL_BELOW, "SMALL").when(weight < MEDIUM_BELOW, "MEDIUM").otherwise("LARGE")


def reliability(alpha: Column, beta: Column) -> Column:
    return alpha / (alpha + beta)


def outcome(r: Column, deadband: float = DEADBAND) -> Column:
    return F.when(F.abs(r) < deadband, "NEUTRAL").when(r > 0, "UP").otherwise("DOWN")


def outcome_size(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a < DEADBAND, "NEUTRAL").when(a < MEDIUM, "SMALL").when(a < LARGE, "MEDIUM").otherwise("LARGE")


def signed_return(r: Column, polarity: Column) -> Column:
    return F.when(polarity == "RESOLUTION", -r).otherwise(r)


def abnormal(r: Column, volatility: Column, k: float = 2.0) -> Column:
    return (volatility > 0) & (F.abs(r) >= k * volatility)


def moved_weight(weight: Column, credit: Column, correct: Column, step: float = STEP) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(FLOOR), weight + F.when(correct, step).otherwise(-step) * credit))


def posterior(count: Column, credit: Column, floor: float = 1.0) -> Column:
    return F.greatest(count + credit, F.lit(floor))


def backoff(attempt: Column, base: float = 2.0, most: float = 8.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def edge_id(factor: Column, target: Column, condition: Column, group: Column | None = None) -> Column:
    """``factor->target``, ``|condition`` where there is one, ``@group`` where inherited."""
    out = F.concat(factor, F.lit("->"), target, F.when(condition.isNotNull(), F.concat(F.lit("|"), condition)).otherwise(""))
    return F.concat(out, F.when(group.isNotNull(), F.concat(F.lit("@"), group)).otherwise("")) if group is not None else out


def percentage(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole)
