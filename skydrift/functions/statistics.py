"""Counting statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def psf_radius(energy_mev: Column) -> Column:
    return F.greatest(0.8 * F.pow(energy_mev / 1000.0, F.lit(-0.8)), F.lit(0.1))


def li_ma(n_on: Column, n_off: Column, alpha: Column) -> Column:
    """Significance of an excess over alpha x n_off, 0 where there is none."""
    on, off = n_on.cast("double"), n_off.cast("double")
    both = on + off
    # a zero count contributes nothing; log of zero is kept out of the unused branch
    a = on * F.log((1 + alpha) / alpha * (F.greatest(on, F.lit(1e-300)) / F.greatest(both, F.lit(1e-300))))
    b = off * F.log((1 + alpha) * (F.greatest(off, F.lit(1e-300)) / F.greatest(both, F.lit(1e-300))))
    bare = F.sqrt(2 * on * F.log((1 + alpha) / alpha))
    full = F.sqrt(F.greatest(F.lit(0.0), 2 * (a + b)))
    return F.when(on <= alpha * off, F.lit(0.0)).when(off == 0, bare).otherwise(full)


def core_threshold(mu: Column, floor: int) -> Column:
    """Neighbours a core point needs over a background of mu; null where mu is no count."""
    need = F.ceil(mu + 2.5 * F.sqrt(mu) + 1).cast("int")
    return F.when((mu >= 0) & ~F.isnan(mu) & (mu < float("inf")), F.greatest(F.lit(floor), need))


def roi_threshold(n: Column, eps: Column, area_deg2: float, floor: int) -> Column:
    """Threshold from the mean density of a whole region (planar disc of eps degrees)."""
    return core_threshold(n * F.lit(3.141592653589793) * eps * eps / F.lit(area_deg2), floor)


def area_to_poisson(fraction: Column, n_samples: Column, n_off: Column) -> Column:
    """Relative error of a sampled area over that of a count, 0 where either is exact."""
    spread = F.sqrt(fraction * (1 - fraction) / n_samples) / fraction * F.sqrt(n_off.cast("double"))
    return F.when((n_off <= 0) | (fraction <= 0) | (fraction >= 1), F.lit(0.0)).otherwise(spread)
