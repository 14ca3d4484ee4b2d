"""Tiles of the sky: overlapping caps, owners, histograms, coverage."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.functions import hashing, sphere
from skydrift.operators.nearby import near_regions, usable_points

#: Tiles whose geometry is worked out on the driver.
MOST_TILES = 10_000


def cap_members(photons: DataFrame, tiles: DataFrame, radius: float) -> DataFrame:
    """Every photon with usable coordinates once per tile whose cap of ``radius`` degrees holds it (column cap_tile).

    ra comes out in [0, 360).
    """
    caps = tiles.select("tile_id", "ra_degrees", "dec_degrees").withColumn("_radius", F.lit(float(radius)))
    p = usable_points(photons).withColumn("_a", F.col("ra")).withColumn("_d", F.col("dec"))
    other = [c for c in photons.columns if c not in ("ra", "dec")]
    got = near_regions(p, [*other, "_a", "_d"], caps, ("tile_id", "ra_degrees", "dec_degrees", "_radius"))
    named = {"ra": "_a", "dec": "_d"}
    return got.select(*[F.col(named.get(c, c)).alias(c) for c in photons.columns], F.col("target").alias("cap_tile"))


def owners(photons: DataFrame, tiles: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., owner: the tile whose centre is nearest to each photon (of equal ones the first by name)."""
    got = near_regions(photons, keep, cells=tiles, cell_cols=("tile_id", "ra_degrees", "dec_degrees"))
    return got.select(*keep, F.col("target").alias("owner"))


def owner_histogram(owned: DataFrame, start: float, width: float) -> DataFrame:
    """owner, day, n: photons per owner and time step."""
    day = F.floor((F.col("time_met") - F.lit(start)) / F.lit(width)).cast("int").alias("day")
    return owned.select("owner", day).groupBy("owner", "day").agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("owner", "day").agg(F.sum("n").alias("n"))


def fibonacci_tiles(spark: SparkSession, n: int) -> DataFrame:
    """tile_id, gal_l_degrees, gal_b_degrees, ra_degrees, dec_degrees of an even lattice of centres.

    A golden-angle lattice in galactic coordinates, rotated to the celestial ones.
    """
    # Rows of the rotation from galactic to J2000 celestial axes.
    rot = (
        (-0.0548755604162154, 0.4941094278755837, -0.8676661490190047),
        (-0.8734370902348850, -0.4448296299600112, -0.1980763734312015),
        (-0.4838350155487132, 0.7469822444972189, 0.4559837761750669),
    )
    i = F.col("id").cast("double")
    sin_b = 1 - (2 * i + 1) / n
    lon = F.pmod(F.degrees(i * F.lit(math.pi * (3 - math.sqrt(5)))), F.lit(360.0))
    base = spark.range(n).select("id", lon.alias("gal_l_degrees"), F.degrees(F.asin(sin_b)).alias("gal_b_degrees"))
    g = sphere.unit(F.col("gal_l_degrees"), F.col("gal_b_degrees"))
    v = [F.lit(r[0]) * g[0] + F.lit(r[1]) * g[1] + F.lit(r[2]) * g[2] for r in rot]
    ra, dec = sphere.direction(*v)
    return base.select(F.format_string("roi_%03d", F.col("id") + 1).alias("tile_id"), ra.alias("ra_degrees"), dec.alias("dec_degrees"), "gal_l_degrees", "gal_b_degrees")


def cell_radii(tiles: DataFrame) -> DataFrame:
    """tile_id, owner_cell_radius_degrees: distance of each centre to the farthest point it owns.

    The farthest points are corners of cells: circumcentres of triangles of centres with no
    other centre nearer. Centres of tiles are few (checked), so corners are found on the driver
    from each centre's nearest neighbours, of which more are taken until the farthest lies beyond
    twice the radius, so that uneven centres are right too.
    """
    rows = tiles.select("tile_id", "ra_degrees", "dec_degrees").orderBy("tile_id").limit(MOST_TILES + 1).toPandas()
    if len(rows) > MOST_TILES:
        raise ValueError(f"more than {MOST_TILES} tiles")
    a, d = np.radians(rows["ra_degrees"].to_numpy(float)), np.radians(rows["dec_degrees"].to_numpy(float))
    c = np.stack([np.cos(d) * np.cos(a), np.cos(d) * np.sin(a), np.sin(d)], axis=1)
    far = np.zeros(len(c))
    for p in range(len(c)):
        order, k = np.argsort(-(c @ c[p]), kind="stable")[1:], 24
        while True:
            k = min(k, len(order))
            near = order[:k]
            i, j = np.triu_indices(k, 1)
            q, r = c[near[i]], c[near[j]]
            n = np.cross(q - c[p], r - c[p])
            size = np.linalg.norm(n, axis=1)
            ok = size > 1e-12
            n = n[ok] / size[ok, None]
            n = np.concatenate([n, -n])
            # corners by the centres used; the cell lies within them
            corner = n[(n @ c[near].T).max(axis=1) <= (n @ c[p]) + 1e-10] if len(n) else n
            if len(corner):
                far[p] = np.degrees(np.arccos(np.clip(corner @ c[p], -1, 1))).max()
            # a centre beyond twice the radius cuts nothing off
            if k == len(order) or len(corner) and np.degrees(np.arccos(np.clip(c[near[-1]] @ c[p], -1, 1))) > 2 * far[p]:
                break
            k *= 2
    return tiles.sparkSession.createDataFrame([(t, float(x)) for t, x in zip(rows["tile_id"], far)], "tile_id string, owner_cell_radius_degrees double")


def union_coverage(spark: SparkSession, tiles: DataFrame, radius: float, samples: int, seed: int) -> DataFrame:
    """multiplicity, n: how many of ``samples`` even random directions lie in so many caps.

    Directions are keyed by (seed, number), so the outcome doesn't depend on partitioning.
    """
    drawn = hashing.with_uniforms(spark.range(samples), F.col("id"), {"_u": seed * 2, "_v": seed * 2 + 1})
    u, v = F.col("_u"), F.col("_v")
    points = drawn.select("id", (u * 360).alias("ra"), F.degrees(F.asin(2 * v - 1)).alias("dec"))
    caps = tiles.withColumn("_radius", F.lit(float(radius)))
    inside = near_regions(points, ["id"], caps, ("tile_id", "ra_degrees", "dec_degrees", "_radius"))
    hit = inside.groupBy("id").agg(F.count(F.lit(1)).alias("multiplicity")).groupBy("multiplicity").agg(F.count(F.lit(1)).alias("n"))
    missed = hit.agg((F.lit(samples) - F.coalesce(F.sum("n"), F.lit(0))).alias("n")).where("n > 0").select(F.lit(0).cast("long").alias("multiplicity"), "n")
    return hit.unionByName(missed)


def coverage_summary(multiplicity: DataFrame) -> DataFrame:
    """One row: samples, covered, fraction, standard_error, mean_multiplicity (of the covered),
    max_multiplicity, covered_bound (95 % lower bound on coverage where every sample is covered).
    """
    n, m = F.col("n"), F.col("multiplicity")
    got = multiplicity.agg(F.sum("n").alias("samples"), F.sum(F.when(m > 0, n).otherwise(0)).alias("covered"), F.sum(m * n).alias("members"), F.max("multiplicity").alias("max_multiplicity"))
    f, total = F.col("covered") / F.col("samples"), F.col("samples")
    return got.select(
        "samples", "covered", f.alias("fraction"), F.sqrt(f * (1 - f) / total).alias("standard_error"),
        F.when(F.col("covered") > 0, F.col("members") / F.col("covered")).otherwise(0.0).alias("mean_multiplicity"), "max_multiplicity",
        F.when(F.col("covered") == total, F.pow(F.lit(0.05), 1 / total)).alias("covered_bound"),
    )
