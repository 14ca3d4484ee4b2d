"""Spherical geometry as column expressions (degrees in, degrees out unless stated)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip_unit(c: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))


def unit_x(ra: Column, dec: Column) -> Column:
    return F.cos(F.radians(dec)) * F.cos(F.radians(ra))


def unit_y(ra: Column, dec: Column) -> Column:
    return F.cos(F.radians(dec)) * F.sin(F.radians(ra))


def unit_z(dec: Column) -> Column:
    return F.sin(F.radians(dec))


def unit(ra: Column, dec: Column) -> tuple[Column, Column, Column]:
    return unit_x(ra, dec), unit_y(ra, dec), unit_z(dec)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance (haversine)."""
    d = F.sin(F.radians(dec2 - dec1) / 2)
    a = F.sin(F.radians(ra2 - ra1) / 2)
    h = d * d + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * a * a
    return F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def direction(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(ra, dec) of a vector that need not be normalised."""
    n = F.sqrt(x * x + y * y + z * z)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0)), F.degrees(F.asin(clip_unit(z / n)))


def mean_direction(ra: Column, dec: Column, weight: Column | None = None) -> tuple[Column, Column]:
    """Aggregates: the (ra, dec) of the mean unit vector; null where it is undefined (length < 1e-12)."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    x, y, z = (F.sum(w * c) / F.sum(w) for c in unit(ra, dec))
    n = F.sqrt(x * x + y * y + z * z)
    a, d = direction(x, y, z)
    ok = n >= 1e-12
    return F.when(ok, a), F.when(ok, d)


def circular_mean(angle: Column, weight: Column | None = None) -> Column:
    """Aggregate: mean angle in [0, 360)."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    r = F.radians(angle)
    return F.pmod(F.degrees(F.atan2(F.sum(w * F.sin(r)) / F.sum(w), F.sum(w * F.cos(r)) / F.sum(w))), F.lit(360.0))


def signed_offset(angle: Column, reference: Column) -> Column:
    """angle - reference, in [-180, 180)."""
    return F.pmod(angle - reference + 180.0, F.lit(360.0)) - 180.0


def tangent_offsets(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """East and north offsets on a flat sky."""
    return signed_offset(ra, ra0) * F.cos(F.radians(dec0)), dec - dec0


def destination(ra: Column, dec: Column, distance: Column, bearing: Column) -> tuple[Column, Column]:
    """Where one arrives after ``distance`` at ``bearing`` (radians, east of north)."""
    d, s = F.radians(dec), F.radians(distance)
    north = F.sin(d) * F.cos(s) + F.cos(d) * F.sin(s) * F.cos(bearing)
    d2 = F.asin(clip_unit(north))
    turn = F.atan2(F.sin(bearing) * F.sin(s) * F.cos(d), F.cos(s) - F.sin(d) * F.sin(d2))
    return F.pmod(F.degrees(F.radians(ra) + turn), F.lit(360.0)), F.degrees(d2)


def moved(ra0: Column, dec0: Column, velocity: Column, angle: Column, years: Column, n_bins: int = 10, east: float = 0.0, north: float = 0.0) -> tuple[Column, Column]:
    """Position of a source of constant velocity (degrees a year at a position angle), centred on mid-window."""
    run = velocity * (years - 0.5 * n_bins)
    x, y = F.lit(east) + run * F.sin(F.radians(angle)), F.lit(north) + run * F.cos(F.radians(angle))
    dec = dec0 + y
    return F.pmod(ra0 + x / F.cos(F.radians(dec)), F.lit(360.0)), dec


def ring_area_deg2(inner: Column, outer: Column) -> Column:
    """Solid angle of a ring; null unless 0 <= inner < outer <= 180."""
    k = 2 * math.pi * (180 / math.pi) ** 2
    area = k * (F.cos(F.radians(inner)) - F.cos(F.radians(outer)))
    return F.when((inner >= 0) & (inner < outer) & (outer <= 180), area)


def disc_steradians(radius: Column) -> Column:
    """Solid angle of a disc; the radius is in radians."""
    return 2 * math.pi * (1 - F.cos(radius))


def ring_steradians(inner: Column, outer: Column) -> Column:
    """Solid angle of a ring; the radii are in radians."""
    return 2 * math.pi * (F.cos(inner) - F.cos(outer))


def lens_area(r1: Column, r2: Column, d: Column) -> Column:
    """Area common to two circles in the plane."""
    a, b = r1 * r1, r2 * r2
    one = a * F.acos(clip_unit((d * d + a - b) / (2 * d * r1)))
    two = b * F.acos(clip_unit((d * d + b - a) / (2 * d * r2)))
    kite = (-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2)
    lens = one + two - 0.5 * F.sqrt(F.greatest(F.lit(0.0), kite))
    small = F.least(r1, r2)
    return F.when(d >= r1 + r2, F.lit(0.0)).when(d <= F.abs(r1 - r2), math.pi * small * small).otherwise(lens)


def clipped_ring_area(d: Column, inner: Column, outer: Column, region: Column) -> Column:
    """Area of a planar ring, its centre ``d`` from that of a region, inside the region."""
    return F.greatest(F.lit(0.0), lens_area(region, outer, d) - lens_area(region, inner, d))
