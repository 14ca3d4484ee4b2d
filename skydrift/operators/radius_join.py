"""Pairs within an angular distance, as an equi-join on cells of space.

Unit vectors are binned into cubes of twice the chord of the largest radius; one side is
replicated to the eight cubes its ball can reach (on each axis the own one and that of the nearer side), so that every pair in
reach meets in exactly one cube and Catalyst plans a hash or merge join. Pairs are told by the
square of their chord, which is cheap; the exact distance is worked out for those that are near.
Cubes know neither poles nor the turn at RA 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydrift.functions.sphere import separation, unit

_BIAS, _BITS = 1 << 20, 21
_AXES = "xyz"


def chord(radius: Column) -> Column:
    return 2 * F.sin(F.radians(radius) / 2) * (1 + 1e-9)


def pack(x: Column, y: Column, z: Column) -> Column:
    """One number for the integer place of a cube."""
    x, y, z = (c.cast("long") + _BIAS for c in (x, y, z))
    return F.shiftleft(x, 2 * _BITS).bitwiseOR(F.shiftleft(y, _BITS)).bitwiseOR(z)


def _placed(df: DataFrame, pos: tuple[str, str], reach: Column, prefix: str) -> DataFrame:
    """df with the unit vector, the chord of the reach and the cube's place of each row; rows without a position meet nothing."""
    x, y, z = unit(F.col(pos[0]), F.col(pos[1]))
    ok = F.col(pos[0]).isNotNull() & F.col(pos[1]).isNotNull() & ~F.isnan(pos[0]) & ~F.isnan(pos[1])
    return df.where(ok).select("*", x.alias(f"{prefix}x"), y.alias(f"{prefix}y"), z.alias(f"{prefix}z"), chord(reach).alias(f"{prefix}r"))


def near_pairs(
    few: DataFrame, many: DataFrame, keys: Sequence[str], reach: Column, few_pos: tuple[str, str], many_pos: tuple[str, str], within: Column, spread: bool = False
) -> DataFrame:
    """few x many on equal keys where ``sep`` (degrees, added) satisfies ``within``.

    ``reach`` bounds the distance per key and must be an expression of the keys alone. Both sides
    carry the keys (there may be none) under the same names and share no other column. ``few`` is the side that is
    replicated. With ``spread`` both sides are shuffled, whatever their size, so that a few files of dense data are work for all cores.
    """
    at = lambda p, n: F.col(f"_{p}{n}") / (2 * F.col(f"_{p}r"))
    cube = lambda p: pack(*[F.floor(at(p, n)) for n in _AXES])
    a, b = _placed(few, few_pos, reach, "_a"), _placed(many, many_pos, reach, "_b")
    turn = [F.when(at("a", n) - F.floor(at("a", n)) >= 0.5, 1 << k * _BITS).otherwise(-(1 << k * _BITS)).cast("long").alias(f"_t{n}") for n, k in zip(_AXES, (2, 1, 0))]
    a = a.select("*", cube("a").alias("_base"), *turn)
    base, (tx, ty, tz) = F.col("_base"), (F.col(f"_t{n}") for n in _AXES)
    steps = F.explode(F.array(base, base + tx, base + ty, base + tz, base + tx + ty, base + tx + tz, base + ty + tz, base + tx + ty + tz))
    left = a.select(*few.columns, "_ax", "_ay", "_az", "_ar", steps.alias("_cell"))
    right = b.select(*many.columns, "_bx", "_by", "_bz", cube("b").alias("_cell"))
    met = (left.hint("merge") if spread else left).join(right, [*keys, "_cell"])
    dx, dy, dz = (F.col(f"_a{n}") - F.col(f"_b{n}") for n in _AXES)
    near = met.where(dx * dx + dy * dy + dz * dz <= F.col("_ar") * F.col("_ar"))
    rest = [c for c in met.columns if c not in ("_cell", "_ar", *[f"_{p}{n}" for p in "ab" for n in _AXES])]
    return near.select(*rest, separation(*[F.col(c) for c in (*few_pos, *many_pos)]).alias("sep")).where(within)


def by_band(values: Sequence[float], band: str = "band") -> Column:
    """A per-band constant as an expression of the band number."""
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(band) + 1)
