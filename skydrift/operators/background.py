"""Significance of clusters over their surroundings: vetoes, masks, areas by sampling, counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skydrift.config import REPORT_EDGES, SearchConfig, band_label
from skydrift.functions import sphere, statistics
from skydrift.operators.radius_join import by_band, near_pairs
from skydrift.operators.seeding import GROUP, eps_of
from skydrift.runtime import Durable

CLUSTER = (*GROUP, "label")
GOLDEN = (math.sqrt(5) - 1) / 2


def centroids(photons: DataFrame, members: DataFrame) -> DataFrame:
    """tile_id, bin_index, band, label, c_ra, c_dec, n_members, n_core of each cluster."""
    pos = photons.select(*GROUP, "event_id", "ra", "dec")
    ra, dec = sphere.mean_direction(F.col("ra"), F.col("dec"))
    return (
        members.join(pos, [*GROUP, "event_id"])
        .groupBy(*CLUSTER)
        .agg(ra.alias("c_ra"), dec.alias("c_dec"), F.count(F.lit(1)).cast("int").alias("n_members"), F.count_if("is_core").cast("int").alias("n_core"))
        .where("c_ra is not null")
    )


def cone(catalogue: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    """Distinct catalogue sources nearer than ``radius`` to a place; sources without position are left out."""
    c = catalogue.select("source_name", "ra", "dec", "flux1000").distinct()
    return c.where((sphere.separation(F.col("ra"), F.col("dec"), F.lit(float(ra)), F.lit(float(dec))) < radius) & ~F.isnan("ra") & ~F.isnan("dec"))


def mask_radius(config: SearchConfig) -> Column:
    return by_band([max(config.mask_scale * config.eps(ref), config.mask_least_radius) for _, _, ref in config.bands])


def _near_sources(clusters: DataFrame, catalogue: DataFrame, reach: float, within: Column) -> DataFrame:
    """cluster keys with the sources (s_ra, s_dec, s_flux, source_name, sep) that satisfy ``within``."""
    s = catalogue.select(F.col("ra").alias("s_ra"), F.col("dec").alias("s_dec"), F.col("flux1000").alias("s_flux"), "source_name").where("s_ra is not null and s_dec is not null")
    return near_pairs(clusters.select(*CLUSTER, "c_ra", "c_dec"), s, [], F.lit(float(reach)), ("c_ra", "c_dec"), ("s_ra", "s_dec"), within)


def catalogue_veto(clusters: DataFrame, catalogue: DataFrame, config: SearchConfig, masked: bool = True) -> DataFrame:
    """clusters with near_source: a source strictly nearer than the veto radius (or eps, if that is larger and masks are on)."""
    eps = by_band(eps_of(config))
    limit = F.greatest(F.lit(config.veto_radius), eps) if masked else F.lit(config.veto_radius)
    near = _near_sources(clusters, catalogue, max(config.veto_radius, *eps_of(config)), F.col("sep") < limit)
    hit = near.select(*CLUSTER).distinct().withColumn("near_source", F.lit(True))
    return clusters.join(hit, list(CLUSTER), "left").fillna(False, ["near_source"])


def with_masks(clusters: DataFrame, catalogue: DataFrame, config: SearchConfig) -> DataFrame:
    """clusters with masks: the sources (ra, dec, source_name) whose mask discs meet the background ring.

    With a least flux only sources of a finite flux of at least that mask. A cluster's masks are
    the sources of a few square degrees, so their list is short.
    """
    eps, m = by_band(eps_of(config)), mask_radius(config)
    inner, outer = eps * config.inner_scale, eps * config.outer_scale
    meets = (F.col("sep") < outer + m) & (F.col("sep") + m > inner)
    if config.mask_least_flux > 0:
        meets = meets & F.col("s_flux").isNotNull() & ~F.isnan("s_flux") & (F.col("s_flux") >= config.mask_least_flux)
    widest = max(config.outer_scale * config.eps(ref) + max(config.mask_scale * config.eps(ref), config.mask_least_radius) for _, _, ref in config.bands)
    near = _near_sources(clusters, catalogue, widest, meets)
    item = F.struct(F.col("s_ra").alias("ra"), F.col("s_dec").alias("dec"), "source_name")
    lists = near.groupBy(*CLUSTER).agg(F.array_sort(F.collect_list(item)).alias("masks"))
    empty = F.array().cast("array<struct<ra:double,dec:double,source_name:string>>")
    return clusters.join(lists, list(CLUSTER), "left").withColumn("masks", F.coalesce("masks", empty))


Region = tuple[float, float, float] | DataFrame


def with_region(clusters: DataFrame, region: Region) -> DataFrame:
    """clusters with the unit vector (_rx, _ry, _rz) and radius cosine (_rc) of their region.

    A region is one cap (ra, dec, radius) for all, or a table tile_id, ra_degrees, dec_degrees,
    analysis_radius_degrees with a cap per tile.
    """
    if isinstance(region, DataFrame):
        x, y, z = sphere.unit(F.col("ra_degrees"), F.col("dec_degrees"))
        caps = region.select("tile_id", x.alias("_rx"), y.alias("_ry"), z.alias("_rz"), F.cos(F.radians("analysis_radius_degrees")).alias("_rc"))
        return clusters.join(caps, "tile_id")
    ra, dec, radius = (float(v) for v in region)
    x, y, z = sphere.unit(F.lit(ra), F.lit(dec))
    return clusters.withColumn("_rx", x).withColumn("_ry", y).withColumn("_rz", z).withColumn("_rc", F.cos(F.radians(F.lit(radius))))


def _ring_direction(n: Column, total: int, inner: Column, outer: Column) -> tuple[Column, Column, Column]:
    """The n-th of ``total`` directions spread evenly over a ring around (c_ra, c_dec)."""
    u = (n + 0.5) / total
    c = F.cos(F.radians(inner)) - u * (F.cos(F.radians(inner)) - F.cos(F.radians(outer)))
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - c * c))
    turn = 2 * math.pi * (((n + 0.5) * GOLDEN) % 1.0)
    a, d = F.radians("c_ra"), F.radians("c_dec")
    north, east = F.cos(turn), F.sin(turn)
    x = c * F.cos(d) * F.cos(a) + s * (-north * F.sin(d) * F.cos(a) - east * F.sin(a))
    y = c * F.cos(d) * F.sin(a) + s * (-north * F.sin(d) * F.sin(a) + east * F.cos(a))
    z = c * F.sin(d) + s * north * F.cos(d)
    return x, y, z


def sampled_areas(clusters: DataFrame, keys: Sequence[str], inner: Column, outer: Column, region: Region, samples: int, mask: Column | None = None) -> DataFrame:
    """keys, n_samples, n_region, n_retained, nominal_area, area, fractions of ring n region - masks.

    The directions are fixed, so the estimate is the same on every run.
    """
    caps = ["_rx", "_ry", "_rz", "_rc"]
    rows = with_region(clusters, region).select(*keys, "c_ra", "c_dec", *caps, inner.alias("_in"), outer.alias("_out"), *(["masks", mask.alias("_m")] if mask is not None else []))
    many = rows.withColumn("_n", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    x, y, z = _ring_direction(F.col("_n").cast("double"), samples, F.col("_in"), F.col("_out"))
    many = many.withColumn("_x", x).withColumn("_y", y).withColumn("_z", z)
    many = many.withColumn("_region", F.col("_x") * F.col("_rx") + F.col("_y") * F.col("_ry") + F.col("_z") * F.col("_rz") >= F.col("_rc"))
    free = F.lit(True)
    if mask is not None:
        cos = F.cos(F.radians("_m"))

        def hit(s: Column) -> Column:
            mx, my, mz = sphere.unit(s["ra"], s["dec"])
            return F.col("_x") * mx + F.col("_y") * my + F.col("_z") * mz >= cos

        free = ~F.exists("masks", hit)
    got = many.groupBy(*keys, "_in", "_out").agg(F.count_if("_region").cast("int").alias("n_region"), F.count_if(F.col("_region") & free).cast("int").alias("n_retained"))
    nominal = sphere.ring_area_deg2(F.col("_in"), F.col("_out"))
    kept = F.col("n_retained") / F.lit(float(samples))
    return got.select(
        *keys, F.lit(samples).alias("n_samples"), "n_region", "n_retained", nominal.alias("nominal_area"), (nominal * kept).alias("area"), kept.alias("retained_fraction"),
        (F.col("n_region") / F.lit(float(samples))).alias("region_fraction"),
        F.when(F.col("n_region") > 0, (F.col("n_region") - F.col("n_retained")) / F.col("n_region")).otherwise(0.0).alias("masked_fraction"),
    )


def refined_areas(clusters: DataFrame, keys: Sequence[str], inner: Column, outer: Column, region: Region, config: SearchConfig, mask: Column | None = None) -> DataFrame:
    """sampled_areas with samples doubled, only where needed, until they add little to the noise of n_off.

    ``clusters`` carries n_off. At most six passes; each continues with what is unresolved.
    """
    keep = Durable(clusters.sparkSession, "areas")
    todo, done, n = keep.put(clusters), None, config.area_samples
    while True:
        got = sampled_areas(todo, keys, inner, outer, region, n, mask).join(todo.select(*keys, "n_off"), list(keys))
        ratio = statistics.area_to_poisson(F.col("retained_fraction"), F.col("n_samples"), F.col("n_off"))
        got = keep.put(got.withColumn("area_ratio", ratio).drop("n_off"))
        last = n * 2 > config.max_area_samples
        ready = got if last else got.where(F.col("area_ratio") <= config.max_area_ratio)
        done = ready if done is None else done.unionByName(ready)
        if last:
            return done
        more = todo.join(got.where(F.col("area_ratio") > config.max_area_ratio).select(*keys), list(keys), "left_semi")
        todo = keep.put(more)
        if todo.isEmpty():
            return done
        n *= 2


def on_counts(clusters: DataFrame, photons: DataFrame, config: SearchConfig) -> DataFrame:
    """cluster keys, n_on: photons of the same bin and band within eps of the centroid."""
    eps = by_band(eps_of(config))
    c, p = clusters.select(*CLUSTER, "c_ra", "c_dec"), photons.select(*GROUP, F.col("ra").alias("p_ra"), F.col("dec").alias("p_dec"))
    met = near_pairs(c, p, GROUP, eps, ("c_ra", "c_dec"), ("p_ra", "p_dec"), F.col("sep") <= eps)
    return met.groupBy(*CLUSTER).agg(F.count(F.lit(1)).cast("int").alias("n_on"))


def off_counts(clusters: DataFrame, photons: DataFrame, config: SearchConfig) -> DataFrame:
    """cluster keys, n_off: photons in the closed ring and in none of the cluster's masks."""
    eps, m = by_band(eps_of(config)), mask_radius(config)
    inner, outer = eps * config.inner_scale, eps * config.outer_scale
    c, p = clusters.select(*CLUSTER, "c_ra", "c_dec", "masks"), photons.select(*GROUP, F.col("ra").alias("p_ra"), F.col("dec").alias("p_dec"))
    met = near_pairs(c, p, GROUP, outer, ("c_ra", "c_dec"), ("p_ra", "p_dec"), (F.col("sep") <= outer) & (F.col("sep") >= inner))
    hit = F.exists("masks", lambda s: sphere.separation(F.col("p_ra"), F.col("p_dec"), s["ra"], s["dec"]) <= m)
    return met.where(~hit).groupBy(*CLUSTER).agg(F.count(F.lit(1)).cast("int").alias("n_off"))


def aperture_counts(clusters: DataFrame, photons: DataFrame, config: SearchConfig) -> DataFrame:
    """cluster keys, photons_per_band: photons of any energy of the bin within eps, per reporting band (half-open)."""
    eps = by_band(eps_of(config))
    c = clusters.select(*CLUSTER, "c_ra", "c_dec")
    where = ("tile_id", "bin_index")
    # one radius for all bands keeps the cells free of the band, which the photons' side doesn't share
    widest = F.lit(max(eps_of(config)))
    p = photons.select(*where, F.col("energy").alias("p_energy"), F.col("ra").alias("p_ra"), F.col("dec").alias("p_dec"))
    met = near_pairs(c, p, where, widest, ("c_ra", "c_dec"), ("p_ra", "p_dec"), F.col("sep") <= eps)
    bands = list(zip(REPORT_EDGES[:-1], REPORT_EDGES[1:]))
    counts = [F.count_if((F.col("p_energy") >= lo) & (F.col("p_energy") < hi)).cast("int").alias(f"_{k}") for k, (lo, hi) in enumerate(bands)]
    entries = [x for k, (lo, hi) in enumerate(bands) for x in (F.lit(band_label(lo, hi)), F.col(f"_{k}"))]
    return met.groupBy(*CLUSTER).agg(*counts).select(*CLUSTER, F.create_map(*entries).alias("photons_per_band"))


def significance(clusters: DataFrame, photons: DataFrame, catalogue: DataFrame, region: Region, config: SearchConfig) -> DataFrame:
    """Clusters that pass veto and gates' inputs, with n_on, n_off, areas, alpha, expected_bg, sigma, stable.

    Vetoed clusters and clusters without on-region area are left out; ``stable`` says whether the
    background passes its gate (ring area, unmasked share, counts).
    """
    keep = Durable(photons.sparkSession, "significance")
    eps = by_band(eps_of(config))
    free = catalogue_veto(clusters, catalogue, config).where("not near_source").drop("near_source")
    masked = with_masks(free, catalogue, config)
    counted = masked.join(on_counts(masked, photons, config), list(CLUSTER)).join(off_counts(masked, photons, config), list(CLUSTER), "left").fillna(0, ["n_off"])
    counted = keep.put(counted)
    on = sampled_areas(counted, CLUSTER, F.lit(0.0), eps, region, config.area_samples).select(*CLUSTER, F.col("area").alias("on_area"))
    off = refined_areas(counted, CLUSTER, eps * config.inner_scale, eps * config.outer_scale, region, config, mask_radius(config))
    off = off.withColumnRenamed("area", "off_area")
    unmasked = 1 - F.col("masked_fraction")
    out = counted.join(on, list(CLUSTER)).where("on_area > 0").join(off, list(CLUSTER))
    out = out.withColumn("alpha", F.when(F.col("off_area") > 0, F.col("on_area") / F.col("off_area")))
    stable = (F.col("off_area") >= 1e-10) & (unmasked >= config.least_unmasked) & (F.col("n_off") >= config.least_off)
    return (
        out.withColumn("expected_bg", F.col("alpha") * F.col("n_off"))
        .withColumn("sigma", F.coalesce(statistics.li_ma(F.col("n_on"), F.col("n_off"), F.col("alpha")), F.lit(0.0)))
        .withColumn("stable", F.coalesce(stable, F.lit(False)))
        .withColumn("eps", eps)
    )


def detections(scored: DataFrame, config: SearchConfig) -> DataFrame:
    """Scored clusters with a stable background and enough significance."""
    return scored.where(F.col("stable") & (F.col("sigma") >= config.min_sigma))
