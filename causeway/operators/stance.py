"""Which decisions of an asset are stored: a policy with few states, so that an asset's history may be cut and its pieces run side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.folds import Automaton, outcomes

DIRECTIONS = ("UP", "DOWN", "NEUTRAL")


def policy(cap: int = 2, directions: tuple[str, ...] = DIRECTIONS) -> Automaton:
    """States: the active direction, and how many decisions of the day are stored, ``cap`` standing for more too. Symbols: direction, open (market), propagated."""
    states = tuple((active, n) for active in (None, *directions) for n in range(cap + 1))

    def step(state: tuple, symbol: tuple) -> tuple[tuple, str]:
        (active, stored), (direction, is_open, propagated) = state, symbol
        against = active is not None and active != direction
        if propagated and against:
            return state, "CONTRADICTS"
        if is_open:
            if active == direction:
                return state, "SAME_DIRECTION"
            if stored == cap:
                return state, "DAILY_CAP"
        elif active is not None:
            return (direction, stored), "SUPERSEDES"
        return (direction, min(cap, stored + 1)), "STORED"

    return Automaton(states, step, lambda state: (state[0], 0))


def apply_stance(decisions: DataFrame, cap: int = 2, pieces: int | None = None, directions: tuple[str, ...] = DIRECTIONS) -> DataFrame:
    """decisions: asset_id, decision_at, direction, open, propagated. Adds ``outcome``: STORED, SAME_DIRECTION, DAILY_CAP, CONTRADICTS, SUPERSEDES.

    Decisions of one time are taken in the order of direction, open ones after closed, propagated ones last.
    """
    order = ["decision_at", "direction", "open", "propagated"]
    told = outcomes(decisions.withColumn("_day", F.to_date("decision_at")), policy(cap, directions), "asset_id", order, "_day", ["direction", "open", "propagated"], pieces)
    return told.select("asset_id", "decision_at", "direction", "outcome")
