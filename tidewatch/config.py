"""Settings of the vulnerability rules. Plain values, checked against the published model."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Thresholds with the loss from each on.
SPELL_DAYS = ((100, 1.0), (60, 0.75), (33, 0.5), (13, 0.25), (5, 0.1))
INTENSITY = ((47.0, 0.8), (7.5, 0.5), (2.6, 0.25), (0.5, 0.1))
DISTANCE_M = ((500.0, 0.5), (1200.0, 0.25))
CATEGORY_FACTORS = {"SAFE": 1.0, "CHRONIC": 1.2, "UNSTABLE": 1.4, "CRITICAL": 1.6}
WEIGHTS = (0.45, 0.25, 0.20, 0.10)
EXCEEDANCE = (0.10, 0.25, 0.50, 0.75, 1.00)
RECOVERY_GAP = 4
# The threshold sets of the sensitivity runs.
SENSITIVITY_SETS = {"Conservative": ((130, 1.00), (70, 0.75), (40, 0.50), (16, 0.25), (6, 0.10)), "Base": SPELL_DAYS, "Aggressive": ((70, 1.00), (45, 0.75), (25, 0.50), (10, 0.25), (3, 0.10))}


@dataclass(frozen=True)
class LossConfig:
    """Thresholds, weights of the four rules, which of them are active, category factors, recovery gap in days."""

    spell_days: tuple = SPELL_DAYS
    intensity: tuple = INTENSITY
    distance_m: tuple = DISTANCE_M
    weights: tuple = WEIGHTS
    active: tuple = (True, True, True, True)
    factors: dict = field(default_factory=lambda: dict(CATEGORY_FACTORS))
    gap: int = RECOVERY_GAP

    def calibrated(self, **thresholds) -> LossConfig:
        """The same settings with thresholds replaced by calibrated ones; None keeps what there is."""
        return replace(self, **{k: tuple(v) for k, v in thresholds.items() if v is not None})
