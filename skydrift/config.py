"""Fixed quantities of the survey and the options of a search."""

from __future__ import annotations

import math
from dataclasses import dataclass

# The survey's window (mission-elapsed seconds), year and energy range (MeV).
WINDOW_START = 479174404.0
WINDOW_STOP = 794707205.0
YEAR_SECONDS = 365 * 86400.0
ENERGY_MIN = 1000.0
ENERGY_MAX = 100000.0
# Seed bands (lower, upper, reference energy of their PSF radius, in MeV).
SEED_BANDS = (
    (1000.0, 2154.4, 1467.8),
    (2154.4, 10000.0, 3162.3),
    (10000.0, 21544.3, 14678.0),
    (21544.3, 46415.9, 31623.0),
    (46415.9, 100000.0, 68129.0),
)
#: Reporting bands: six, logarithmically even.
REPORT_EDGES = tuple(10 ** (3 + 2 * k / 6) for k in range(7))
CLASS_BIT = 128


def bin_edges(days: float = 365.0) -> list[float]:
    """Edges of the time bins; what remains of the window belongs to the last bin."""
    if days <= 0:
        raise ValueError("bins need a positive length")
    width = days * 86400.0
    n = max(1, math.floor((WINDOW_STOP - WINDOW_START) / width))
    return [WINDOW_START + k * width for k in range(n)] + [WINDOW_STOP]


def psf_radius(energy_mev: float) -> float:
    return max(0.8 * (energy_mev / 1000.0) ** -0.8, 0.1)


def band_label(low: float, high: float) -> str:
    return f"{low / 1000:.1f}-{high / 1000:.1f} GeV"


@dataclass(frozen=True)
class SearchConfig:
    """Options of a search with their production values (angles in degrees)."""

    bin_days: float = 365.0
    bands: tuple[tuple[float, float, float], ...] = SEED_BANDS
    least_photons: int = 10
    min_samples: int = 4
    eps_scale: float = 1.0
    inner_scale: float = 2.0
    outer_scale: float = 5.0
    zone_scale: float = 0.5
    min_sigma: float = 2.5
    max_zenith: float = 90.0
    class_bit: int = CLASS_BIT
    mask_scale: float = 2.0
    mask_least_radius: float = 0.5
    mask_least_flux: float = 0.0
    veto_radius: float = 0.5
    least_unmasked: float = 0.25
    least_off: int = 10
    area_samples: int = 8192
    max_area_samples: int = 262144
    max_area_ratio: float = 0.20
    link_degrees_per_year: float = 1.0
    gap_penalty: float = 0.5
    max_gap: int = 2
    max_skips: int = 2
    beam: int = 4
    least_length: int = 5
    least_anisotropy: float = 0.7
    least_time_correlation: float = 0.85
    least_consistency: float = 0.0
    near_duplicate: float = 0.8
    match_degrees: float = 0.6
    match_least_bins: int = 3
    match_fraction: float = 1.0

    def eps(self, reference: float) -> float:
        return psf_radius(reference) * self.eps_scale
