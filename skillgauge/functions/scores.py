"""Categorical skill scores of a 2x2 contingency table; null when undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.try_divide(top.cast("double"), bottom.cast("double"))


# Score name -> formula over (hits, misses, false alarms, correct negatives).
SCORES = {
    "hit_rate": lambda h, m, f, c: _ratio(h, h + m),
    "false_alarm_rate": lambda h, m, f, c: _ratio(f, f + c),
    "precision": lambda h, m, f, c: _ratio(h, h + f),
    "csi": lambda h, m, f, c: _ratio(h, h + m + f),
    "miss_rate": lambda h, m, f, c: _ratio(m, h + m),
    "accuracy": lambda h, m, f, c: _ratio(h + c, h + m + f + c),
    "odds_ratio": lambda h, m, f, c: _ratio(h * c, m * f),
}


def score(name: str, hits="hits", misses="misses", false_alarms="false_alarms", correct_negatives="correct_negatives") -> Column:
    args = [F.col(x) if isinstance(x, str) else x for x in (hits, misses, false_alarms, correct_negatives)]
    return SCORES[name](*args)
