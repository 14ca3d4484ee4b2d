"""Density clustering of photons with a threshold from each place's own surroundings.

All steps work on (tile, time bin, energy band) groups at once. Neighbours are counted by
radius joins; the background is counted once per small zone of the sky, in a ring whose inner
edge is pushed out by the farthest member of the zone; a photon with enough neighbours is a core,
cores in reach of each other form clusters, and other photons join their nearest core in reach.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from skydrift.config import SearchConfig
from skydrift.functions import sphere, statistics
from skydrift.operators.components import components
from skydrift.operators.radius_join import by_band, near_pairs
from skydrift.runtime import Durable

GROUP = ("tile_id", "bin_index", "band")


def eps_of(config: SearchConfig) -> list[float]:
    return [config.eps(ref) for _, _, ref in config.bands]


def _points(photons: DataFrame, prefix: str, keys: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    return photons.select(*keys, *[F.col(c).alias(f"{prefix}{c}") for c in ("event_id", "ra", "dec", *extra)])


def neighbour_counts(photons: DataFrame, config: SearchConfig, keys: Sequence[str] = GROUP) -> DataFrame:
    """keys, event_id, n_eps: photons within the band's eps, itself included."""
    eps = by_band(eps_of(config))
    met = near_pairs(_points(photons, "a_", keys), _points(photons, "b_", keys), keys, eps, ("a_ra", "a_dec"), ("b_ra", "b_dec"), F.col("sep") <= eps, spread=True)
    return met.groupBy(*keys, F.col("a_event_id").alias("event_id")).agg(F.count(F.lit(1)).cast("int").alias("n_eps"))


def zone_columns(photons: DataFrame, config: SearchConfig) -> DataFrame:
    """photons with zone_lat, zone_bins, zone_lon: the zone of about half an eps each lies in."""
    size = F.radians(by_band(eps_of(config)) * config.zone_scale)
    lat = F.floor((F.radians("dec") + math.pi / 2) / size)
    middle = (lat + 0.5) * size - math.pi / 2
    bins = F.greatest(F.lit(1), F.ceil(2 * math.pi * F.greatest(F.lit(0.05), F.abs(F.cos(middle))) / size))
    lon = F.floor(F.pmod(F.radians("ra"), F.lit(2 * math.pi)) / F.lit(2 * math.pi) * bins)
    return photons.withColumn("zone_lat", lat.cast("int")).withColumn("zone_bins", bins.cast("int")).withColumn("zone_lon", lon.cast("int"))


ZONE = ("zone_lat", "zone_bins", "zone_lon")


def density_zones(zoned: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """keys, zone, zone_ra, zone_dec (mean direction), zone_n, zone_offset (farthest member, degrees)."""
    ra, dec = sphere.mean_direction(F.col("ra"), F.col("dec"))
    middle = zoned.groupBy(*keys, *ZONE).agg(ra.alias("zone_ra"), dec.alias("zone_dec"), F.count(F.lit(1)).cast("int").alias("zone_n"))
    far = F.max(sphere.separation(F.col("ra"), F.col("dec"), F.col("zone_ra"), F.col("zone_dec"))).alias("zone_offset")
    offsets = zoned.join(middle, [*keys, *ZONE]).groupBy(*keys, *ZONE).agg(far)
    return middle.join(offsets, [*keys, *ZONE])


def zone_background(photons: DataFrame, zones: DataFrame, config: SearchConfig, keys: Sequence[str] = GROUP) -> DataFrame:
    """zones with n_inner, n_outer, n_ring, mu (expected neighbours) and threshold.

    A zone so wide that its guarded inner radius reaches the outer one is an error.
    """
    eps = by_band(eps_of(config))
    outer, guarded = eps * config.outer_scale, eps * config.inner_scale + F.col("zone_offset")
    pts = photons.select(*keys, F.col("ra").alias("p_ra"), F.col("dec").alias("p_dec"))
    met = near_pairs(zones, pts, keys, outer, ("zone_ra", "zone_dec"), ("p_ra", "p_dec"), F.col("sep") <= outer, spread=True)
    counts = met.groupBy(*keys, *ZONE).agg(F.count(F.lit(1)).cast("int").alias("n_outer"), F.count_if(F.col("sep") <= guarded).cast("int").alias("n_inner"))
    z = zones.join(counts, [*keys, *ZONE], "left").fillna(0, ["n_outer", "n_inner"])
    ring = F.greatest(F.lit(0), F.col("n_outer") - F.col("n_inner"))
    ratio = sphere.disc_steradians(F.radians(eps)) / sphere.ring_steradians(F.radians(guarded), F.radians(outer))
    wide = F.raise_error(F.lit("a zone's guarded inner radius reaches the outer one: take smaller zones")).cast("double")
    mu = F.when(guarded < outer, ring.cast("double") * ratio).otherwise(wide)
    return z.withColumn("n_ring", ring).withColumn("mu", mu).withColumn("threshold", statistics.core_threshold(F.col("mu"), config.min_samples))


def core_flags(photons: DataFrame, config: SearchConfig, keys: Sequence[str] = GROUP) -> DataFrame:
    """keys, event_id, ra, dec, n_eps, n_ring, mu, threshold, is_core."""
    # read four times below: worked out once
    zoned = Durable(photons.sparkSession, "zoned").put(zone_columns(photons.select(*keys, "event_id", "ra", "dec"), config))
    zones = zone_background(zoned, density_zones(zoned, keys), config, keys)
    counts = neighbour_counts(zoned, config, keys)
    place = zoned.select(*keys, "event_id", "ra", "dec", *ZONE)
    out = place.join(zones.select(*keys, *ZONE, "n_ring", "mu", "threshold"), [*keys, *ZONE]).join(counts, [*keys, "event_id"])
    return out.withColumn("is_core", F.col("n_eps") >= F.col("threshold")).drop(*ZONE)


def fixed_core_flags(photons: DataFrame, config: SearchConfig, area_deg2: float, keys: Sequence[str] = GROUP) -> DataFrame:
    """The same with one threshold per group, from its mean density over a region."""
    total = photons.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    t = total.withColumn("threshold", statistics.roi_threshold(F.col("_n"), by_band(eps_of(config)), area_deg2, config.min_samples)).drop("_n")
    out = photons.select(*keys, "event_id", "ra", "dec").join(neighbour_counts(photons, config, keys), [*keys, "event_id"]).join(t, list(keys))
    return out.withColumn("is_core", F.col("n_eps") >= F.col("threshold"))


#: Cubes per eps on each axis: cores of one cube are nearer to each other than eps, whatever their places.
_PER_EPS = math.sqrt(3) * (1 + 1e-6)
#: Such a cube is divided into this many parts on each axis where two cubes can't be told connected by their extents.
_FINER = 8


def _cubes(points: DataFrame, keys: Sequence[str], level: int) -> DataFrame:
    """One row per occupied cube: its place (px, py, pz), the extent of its points (unit vectors) and their first event."""
    lo = [F.min(c).alias(f"l{c}") for c in "xyz"]
    hi = [F.max(c).alias(f"h{c}") for c in "xyz"]
    side = F.col("_r") / (_PER_EPS * level)
    place = [F.floor(F.col(c) / side).cast("int").alias(f"p{c}") for c in "xyz"]
    return points.select(*keys, "event_id", "x", "y", "z", "_r", *place).groupBy(*keys, "px", "py", "pz").agg(*lo, *hi, F.first("_r").alias("_r"), F.min("event_id").alias("first"))


def _extents(near: DataFrame) -> tuple[Column, Column]:
    """Squares of the least and the greatest distance that points within the extents l.. h.. and m.. k.. may have."""
    square = lambda c: c * c
    least = sum((square(F.greatest(F.col(f"l{c}") - F.col(f"k{c}"), F.col(f"m{c}") - F.col(f"h{c}"), F.lit(0.0))) for c in "xyz"), F.lit(0.0))
    most = sum((square(F.greatest(F.col(f"h{c}") - F.col(f"m{c}"), F.col(f"k{c}") - F.col(f"l{c}"))) for c in "xyz"), F.lit(0.0))
    return least, most


def _other(cubes: DataFrame) -> DataFrame:
    return cubes.select(*[F.col(c).alias({"l": "m", "h": "k", "p": "q"}.get(c[0], c[0]) + c[1:] if len(c) == 2 and c[0] in "lhp" else c) for c in cubes.columns])


def core_components(flags: DataFrame, config: SearchConfig, keys: Sequence[str] = GROUP) -> DataFrame:
    """keys, event_id, cluster: the smallest event_id of the cluster of each core.

    Cores of one cube of side eps / sqrt 3 are connected without a look at their pairs. Neighbouring cubes are connected,
    or not, by the extents of their cores; where these leave it open the cubes are divided, and only
    parts whose extents leave it open still are compared core by core. So edges are as many as neighbouring cubes, however dense these are.
    """
    k = list(keys)
    keep = Durable(flags.sparkSession, "cubes")
    x, y, z = sphere.unit(F.col("ra"), F.col("dec"))
    radius = 2 * F.sin(F.radians(by_band(eps_of(config))) / 2)
    cores = keep.put(flags.where("is_core").select(*k, "event_id", x.alias("x"), y.alias("y"), z.alias("z"), radius.alias("_r")))
    # the chord of eps is compared with a margin that lets distances equal to eps count, as they do elsewhere
    limit = F.col("_r") * F.col("_r") * (1 + 1e-12)
    cubes = keep.put(_cubes(cores, k, 1))
    # half of the steps to cubes a chord of eps may reach: each pair is met once
    ahead = [(a, b, c) for a in range(-2, 3) for b in range(-2, 3) for c in range(-2, 3) if (a, b, c) > (0, 0, 0)]
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(t, "abc")]) for t in ahead])).alias("_s")
    moved = cubes.select("*", steps).select(*cubes.columns, *[(F.col(f"p{c}") + F.col(f"_s.{n}")).alias(f"q{c}") for c, n in zip("xyz", "abc")])
    met = moved.join(_other(cubes).drop("_r", "first"), [*k, "qx", "qy", "qz"])
    least, most = _extents(met)
    met = keep.put(met.select(*k, "px", "py", "pz", "qx", "qy", "qz", (least <= limit).alias("may"), (most <= limit).alias("sure")).where("may"))
    pair = [*k, "px", "py", "pz", "qx", "qy", "qz"]
    sure, open_ = met.where("sure").select(*pair), met.where("not sure").select(*pair)
    # parts of the cubes of open pairs
    parts = keep.put(_cubes(cores, k, _FINER))
    own = [F.floor(F.col(f"p{c}") / _FINER).cast("int").alias(f"o{c}") for c in "xyz"]
    a = parts.select("*", *own).drop("first").withColumnsRenamed({f"p{c}": f"s{c}" for c in "xyz"}).withColumnsRenamed({f"o{c}": f"p{c}" for c in "xyz"})
    b = _other(parts.select("*", *own).drop("first", "_r").withColumnsRenamed({f"p{c}": f"t{c}" for c in "xyz"}).withColumnsRenamed({f"o{c}": f"p{c}" for c in "xyz"}))
    finer = open_.join(a, [*k, "px", "py", "pz"]).join(b, [*k, "qx", "qy", "qz"])
    least, most = _extents(finer)
    finer = keep.put(finer.select(*pair, "sx", "sy", "sz", "tx", "ty", "tz", (least <= limit).alias("may"), (most <= limit).alias("sure")).where("may"))
    told = finer.where("sure").select(*pair).distinct()
    left = finer.where("not sure").join(told, pair, "left_anti")
    side = F.col("_r") / (_PER_EPS * _FINER)
    at = lambda n, p: cores.select(*k, F.col("event_id").alias(f"{n}_id"), *[F.floor(F.col(c) / side).cast("int").alias(f"{p}{c}") for c in "xyz"], *[F.col(c).alias(f"{n}{c}") for c in "xyz"], *(["_r"] if n == "a" else []))
    apart = sum(((F.col(f"a{c}") - F.col(f"b{c}")) * (F.col(f"a{c}") - F.col(f"b{c}")) for c in "xyz"), F.lit(0.0))
    exact = left.join(at("a", "s"), [*k, "sx", "sy", "sz"]).join(at("b", "t"), [*k, "tx", "ty", "tz"]).where(apart <= limit).select(*pair).distinct()
    node = lambda p: F.struct(*k, *[F.col(f"{p}{c}").alias(c) for c in "xyz"])
    edges = sure.unionByName(told).unionByName(exact).select(node("p").alias("a"), node("q").alias("b"))
    got = components(cubes.select(node("p").alias("node")), edges).withColumnRenamed("component", "_c")
    named = cubes.select(node("p").alias("node"), "first").join(got, "node")
    cluster = named.groupBy("_c").agg(F.min("first").alias("cluster"))
    where = named.join(cluster, "_c").select(*[F.col(f"node.{c}").alias(c) for c in (*k, "x", "y", "z")], "cluster").withColumnsRenamed({c: f"p{c}" for c in "xyz"})
    coarse = F.col("_r") / _PER_EPS
    home = cores.select(*k, "event_id", *[F.floor(F.col(c) / coarse).cast("int").alias(f"p{c}") for c in "xyz"])
    return home.join(where, [*k, "px", "py", "pz"]).select(*k, "event_id", "cluster")


def border_members(flags: DataFrame, labelled: DataFrame, config: SearchConfig, keys: Sequence[str] = GROUP) -> DataFrame:
    """keys, event_id, cluster of photons that are no cores but have one within eps (the nearest, of equal ones the first)."""
    eps = by_band(eps_of(config))
    cores = flags.where("is_core").select(*keys, F.col("event_id").alias("c_id"), F.col("ra").alias("c_ra"), F.col("dec").alias("c_dec"))
    rest = flags.where("not is_core").select(*keys, F.col("event_id").alias("o_id"), F.col("ra").alias("o_ra"), F.col("dec").alias("o_dec"))
    met = near_pairs(cores, rest, keys, eps, ("c_ra", "c_dec"), ("o_ra", "o_dec"), F.col("sep") <= eps, spread=True)
    near = met.groupBy(*keys, F.col("o_id").alias("event_id")).agg(F.min(F.struct("sep", "c_id")).alias("n"))
    names = labelled.select(*keys, F.col("event_id").alias("c_id"), "cluster")
    return near.select(*keys, "event_id", F.col("n.c_id").alias("c_id")).join(names, [*keys, "c_id"]).select(*keys, "event_id", "cluster")


def cluster_members(photons: DataFrame, config: SearchConfig, keys: Sequence[str] = GROUP, flags: DataFrame | None = None) -> DataFrame:
    """keys, event_id, cluster, label (clusters of a group numbered from 0 by their first core), is_core."""
    keep = Durable(photons.sparkSession, "clusters")
    flags = keep.put(core_flags(photons, config, keys) if flags is None else flags)
    cores = keep.put(core_components(flags, config, keys))
    borders = border_members(flags, cores, config, keys)
    every = cores.withColumn("is_core", F.lit(True)).unionByName(borders.withColumn("is_core", F.lit(False)))
    label = (F.dense_rank().over(W.partitionBy(*keys).orderBy("cluster")) - 1).cast("int")
    return every.withColumn("label", label)


def region_area(radius: float) -> float:
    """Solid angle (square degrees) of a cap."""
    return 2 * math.pi * (1 - math.cos(math.radians(radius))) * (180 / math.pi) ** 2


