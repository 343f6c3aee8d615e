"""Expressions over the 15 state probabilities of a position; each takes and gives the text of an expression."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: The states, by group, and the allowed moves.
N_STATES = 15
INTRON, CODING = (1, 2, 3), tuple(range(4, 15))
MOVES = {0: (0, 7), 1: (1, 12), 2: (2, 13), 3: (3, 11), 4: (5, 9), 5: (6, 10, 14), 6: (4, 8), 7: (5,), 8: (1,), 9: (2,), 10: (3,), 11: (5,), 12: (6,), 13: (4,), 14: (0,)}
EPSILON = 1e-7


@dataclass(frozen=True)
class Calibration:
    """How log odds become scores: a factor and a constant for each state, a floor for probabilities, and a constant for each gene."""

    scale: tuple[float, ...] = field(default=(1.0,) * N_STATES)
    bias: tuple[float, ...] = field(default=(0.0,) * N_STATES)
    epsilon: float = EPSILON
    gene_intercept: float = 0.0
    version: str = "plain"

    def __post_init__(self) -> None:
        for name in ("scale", "bias"):
            if len(getattr(self, name)) != N_STATES:
                raise ValueError(f"{name} must have {N_STATES} values")
        if not all(map(math.isfinite, (*self.scale, *self.bias, self.gene_intercept))):
            raise ValueError("scale, bias and gene_intercept must be finite")
        if min(self.scale) < 0:
            raise ValueError("scale must not be negative")
        if not (math.isfinite(self.epsilon) and self.epsilon > 0):
            raise ValueError("epsilon must be finite and positive")
        if not self.version:
            raise ValueError("version must not be empty")


def softmax(z: str, temperature: float = 1.0) -> str:
    shifted = f"transform({z}, v -> exp((v - array_max({z})) / {temperature}D))"
    return f"transform(array({shifted}), x -> transform(x, v -> v / aggregate(x, 0.0D, (a, b) -> a + b)))[0]"


def log_odds(p: str, epsilon: float = EPSILON, calibration: Calibration | None = None) -> str:
    """ln of each state against the background; with a calibration, times its scale plus its bias, and by its epsilon."""
    if calibration is None:
        return f"transform({p}, v -> ln(greatest(v, {epsilon}D)) - ln(greatest({p}[0], {epsilon}D)))"
    values = lambda v: f"array({', '.join(f'{float(x)!r}D' for x in v)})"
    least = f"{calibration.epsilon!r}D"
    return f"zip_with(transform({p}, v -> ln(greatest(v, {least})) - ln(greatest({p}[0], {least}))), arrays_zip({values(calibration.scale)}, {values(calibration.bias)}), (v, c) -> v * c['0'] + c['1'])"


def bad_probabilities(p: str) -> str:
    """Whether `p` isn't 15 finite values of 0 or more."""
    return f"(coalesce(size({p}), 0) <> {N_STATES} OR exists({p}, v -> v IS NULL OR isnan(v) OR v < 0 OR v = double('Infinity')))"


def mass(p: str, first: int, last: int) -> str:
    return f"aggregate(slice({p}, {first + 1}, {last - first + 1}), 0.0D, (a, b) -> a + b)"


def best_state(p: str) -> str:
    """The first of the most likely states."""
    return f"(array_position({p}, array_max({p})) - 1)"


def center_crop(array: str, length: int) -> str:
    return f"slice({array}, (size({array}) - {length}) div 2 + 1, {length})"


def flank_crop(array: str, flank: int) -> str:
    """Without `flank` values at both ends; an error where nothing would be left."""
    return f"CASE WHEN size({array}) > {2 * flank} THEN slice({array}, {flank + 1}, size({array}) - {2 * flank}) ELSE raise_error(concat('flank {flank} is too long for ', size({array}))) END"
