"""Settings of the risk engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    """window: returns a forecast is made from. block: forecasts made together
    by one group of a grouped map; it does not change results. day_fraction:
    length of a step in years."""

    window: int = 1000
    alphas: tuple[float, ...] = (0.01, 0.05)
    significance: float = 0.05
    refit_every: int = 42
    save_every: int = 50  # days of a sampled model after which its forecasts are saved
    block: int = 250
    day_fraction: float = 1 / 252
    kappa_least: float = 0.01
    simulations: int = 1000
    seed: int = 42
    flagged: tuple[str, ...] = ()
    bands: dict[str, tuple[str, str]] = field(default_factory=dict)


#: The published sample, its flagged days and crisis periods.
SAMPLE = ("2003-01-01", "2026-06-22")
FLAGGED_DATES = ("2024-05-13", "2024-05-16", "2024-09-16")
CRISIS_BANDS = {
    "GFC 2008": ("2008-09-01", "2009-03-31"),
    "COVID 2020": ("2020-02-01", "2020-06-30"),
    "Cocoa crisis 2024": ("2024-01-01", "2024-12-31"),
    "Oil shock 2026": ("2026-02-01", "2026-06-22"),
}
