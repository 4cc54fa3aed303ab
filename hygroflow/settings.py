"""Parameters and fixed values of the analyses.

Everything that a deployment may want to change is a field of one of the
dataclasses; the values below are the defaults of the published analyses.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# They must be exactly these for the results to agree.
# ---------------------------------------------------------------------------

# sensor code -> (side, quantity)
SENSORS = {
    "101": ("in", "rh"),
    "102": ("in", "temp"),
    "103": ("out", "rh"),
    "104": ("out", "temp"),
}

# plausibility bands (inclusive) by quantity
BUCKET_BANDS = {"rh": (25.0, 100.0), "temp": (0.0, 55.0)}
MINUTE_BANDS = {"rh": (0.0, 100.0), "temp": (0.0, 50.0)}

# inner edges of the eight score bins 0..7, bins are (lo, hi]
RH_EDGES = (0.0, 1.5, 3.0, 5.0, 8.0, 12.0, 16.0)
AH_EDGES = (0.0, 0.15, 0.30, 0.50, 0.80, 1.20, 1.60)

# (slot number, first hour, hour after the last, label); the last one wraps midnight
SLOTS = (
    (1, 6, 10, "06:00–10:00"),
    (2, 10, 14, "10:00–14:00"),
    (3, 14, 18, "14:00–18:00"),
    (4, 18, 6, "18:00–06:00"),
)

# actuator states
STATES = {"0": "fail", "1": "success", "2": "sent/retry", "3": "other"}

# legal suffixes removed from company names
LEGAL_SUFFIXES = (
    "ltd", "limited", "inc", "llc", "corp", "corporation", "co", "company",
    "gmbh", "sarl", "sa", "bv", "plc", "oy", "ag", "kg",
)

# weights of the name match score and its threshold
MATCH_WEIGHTS = {"token": 0.35, "char": 0.25, "contain": 0.20, "acronym": 0.20}
MATCH_THRESHOLD = 0.6

# Magnus formula
MAGNUS = {"a": 17.67, "b": 243.5, "es0": 6.112, "k": 216.7, "zero_c": 273.15}

# weights of the inside and outside trend in the composite baseline
BASELINE_IN, BASELINE_OUT = 0.33, 0.67


# ---------------------------------------------------------------------------
# Parameters
# ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Clock:
    """Floor of the analysed period and the shift from stored to local time."""

    floor: str
    shift_hours: int


DASHBOARD_CLOCK = Clock(floor="2026-03-01", shift_hours=5)
STUDY_CLOCK = Clock(floor="2026-03-02", shift_hours=0)
OPERATIONS_CLOCK = Clock(floor="2026-02-01", shift_hours=5)


@dataclass(frozen=True)
class EventWindow:
    """Minutes looked at around an actuator event."""

    before: int = 20
    after: int = 30
    coverage: float = 0.7
    fill_limit: int = 5
    max_missing: float = 0.3
    baseline_minutes: int = 3

    @property
    def min_pre(self) -> float:
        return self.before * self.coverage

    @property
    def min_post(self) -> float:
        return self.after * self.coverage

    @property
    def points(self) -> int:
        return self.before + self.after + 1


@dataclass(frozen=True)
class SlopeRule:
    """Row minimums and dead band of the slope classifier."""

    min_pre: int = 10
    min_post: int = 20
    eps: float = 0.02


@dataclass(frozen=True)
class CustomsRule:
    """Text predicates, regime and packaging class of the customs filter."""

    description: str = "tostado"
    origin: str = "colombia"
    cargo: str = "contenerizada"
    data_type: str = "definitivo"
    regime: float = 42
    packaging: str = "caja"


@dataclass(frozen=True)
class MatchRule:
    weights: dict = field(default_factory=lambda: dict(MATCH_WEIGHTS))
    threshold: float = MATCH_THRESHOLD
    block_chars: int = 4
