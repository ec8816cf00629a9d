"""Position weight matrices and their log-odds scores."""

from __future__ import annotations

import math
from dataclasses import dataclass

BASES = "ACGT"
PSEUDOCOUNT, BACKGROUND = 0.8, 0.25
DEFAULT_THRESHOLD = 75.0


@dataclass(frozen=True)
class Pwm:
    """Counts of each base (rows A, C, G, T) at each position."""

    id: str
    name: str
    counts: tuple[tuple[float, ...], ...]

    @property
    def length(self) -> int:
        return len(self.counts[0])


@dataclass(frozen=True)
class Pssm:
    """Log-odds scores; None where a count is so negative that it has none, and a window with that base never passes."""

    name: str
    scores: tuple[tuple[float | None, ...], ...]
    max_score: float
    min_score: float

    @property
    def length(self) -> int:
        return len(self.scores[0])

    def least(self, threshold: float) -> float:
        """The raw score at ``threshold`` percent of the way from the smallest score to the largest."""
        return self.min_score + threshold / 100.0 * (self.max_score - self.min_score)


def pssm(pwm: Pwm) -> Pssm:
    columns, top, low = [], 0.0, 0.0
    for column in zip(*pwm.counts, strict=True):
        total = sum(column) + 4 * PSEUDOCOUNT
        odds = [(c + PSEUDOCOUNT) / total / BACKGROUND for c in column]
        scores = [math.log2(x) if x > 0 else None for x in odds]
        known = [s for s in scores if s is not None]
        top, low = top + max(known), low + min(known)
        columns.append(scores)
    return Pssm(pwm.name, tuple(zip(*columns, strict=True)), top, low)


def percent(pssm_: Pssm, score: float) -> float:
    """A raw score in percent of the range, from 0 to 100."""
    span = pssm_.max_score - pssm_.min_score
    return 0.0 if span == 0 else max(0.0, min(100.0, (score - pssm_.min_score) / span * 100))


def percent_of(pssm_: Pssm, score):
    """``percent`` of a column."""
    from pyspark.sql import functions as F

    span = pssm_.max_score - pssm_.min_score
    return F.lit(0.0) if span == 0 else F.greatest(F.lit(0.0), F.least(F.lit(100.0), (score - pssm_.min_score) / span * 100))
