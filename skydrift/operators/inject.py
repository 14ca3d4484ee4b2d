"""Synthetic moving sources: template rows, energies, point spread, routing to overlapping tiles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from skydrift.config import ENERGY_MAX, ENERGY_MIN
from skydrift.functions import hashing, sphere
from skydrift.functions.statistics import psf_radius
from skydrift.operators.radius_join import near_pairs


def power_law_energy(u: Column, index: float, low: float = ENERGY_MIN, high: float = ENERGY_MAX) -> Column:
    """Inverse distribution function of a power law of photon index ``index``."""
    if abs(index - 1) < 1e-9:
        return F.lit(low) * F.pow(F.lit(high / low), u)
    g = 1 - index
    return F.pow(F.lit(low**g) + u * F.lit(high**g - low**g), F.lit(1 / g))


def track_truth(spark: SparkSession, ra: float, dec: float, velocity: float, angle: float, n_bins: int = 10, east: float = 0.0, north: float = 0.0) -> DataFrame:
    """bin_index, ra, dec of a source in the middle of each bin."""
    base = spark.range(n_bins).select(F.col("id").cast("int").alias("bin_index"))
    a, d = sphere.moved(F.lit(ra), F.lit(dec), F.lit(velocity), F.lit(angle), F.col("bin_index") + 0.5, n_bins, east, north)
    return base.select("bin_index", a.alias("ra"), d.alias("dec"))


def template_rows(photons: DataFrame, per_bin: int, seed: int) -> DataFrame:
    """``per_bin`` rows of each time bin, picked by a salted hash of the event id (column copy numbers repeats).

    Bins with fewer rows give each several times. The pick is a top-k per bin: partial windows keep
    at most ``per_bin`` rows per task and bin.
    """
    order = W.partitionBy("bin_index").orderBy("_h", "event_id")
    top = hashing.with_keyed(photons, "_h", F.col("event_id"), seed).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_bin)
    n = top.groupBy("bin_index").agg(F.count(F.lit(1)).alias("_n"))
    copies = F.ceil((F.lit(per_bin) - F.col("_k") + 1) / F.col("_n")).cast("int")
    many = top.join(n, "bin_index").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    return many.drop("_k", "_n", "_h")


def empty_bins(photons: DataFrame, n_bins: int) -> DataFrame:
    """bin_index of bins no template can be picked from."""
    every = photons.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin_index"))
    return every.join(photons.select("bin_index").distinct(), "bin_index", "left_anti")


def inject(photons: DataFrame, truth: DataFrame, per_bin: int, index: float, seed: int, energy: Column | None = None) -> DataFrame:
    """photons with is_injected, and ``per_bin`` more rows per bin scattered around the truth.

    Draws are keyed by (seed, event_id, copy), so reruns and partitionings give the same rows. The
    scatter is Gaussian with the 68 % radius of the photon's energy.
    """
    rows = template_rows(photons, per_bin, seed)
    rows = hashing.with_uniforms(rows, F.col("event_id"), {f"_u{k}": seed * 16 + k for k in range(3)}, F.col("copy"))
    u = [F.col(f"_u{k}") for k in range(3)]
    e = power_law_energy(u[0], index) if energy is None else energy
    rows = rows.withColumn("energy", e).drop("ra", "dec").join(truth.select("bin_index", F.col("ra").alias("_ra"), F.col("dec").alias("_dec")), "bin_index")
    r = psf_radius(F.col("energy")) / 1.509 * F.sqrt(-2 * F.log(1 - u[1]))
    a, d = sphere.destination(F.col("_ra"), F.col("_dec"), r, 2 * math.pi * u[2])
    rows = rows.withColumn("ra", a).withColumn("dec", d).withColumn("is_injected", F.lit(True))
    return photons.withColumn("is_injected", F.lit(False)).unionByName(rows.select(*photons.columns, "is_injected"))


def cap_memberships(truth: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile_id, bins: tiles whose analysis cap holds the source, with the bins in which it does.

    ``tiles`` carries analysis_radius_degrees; a null, zero or too large radius is an error.
    """
    bad = tiles.where("analysis_radius_degrees is null or analysis_radius_degrees <= 0 or analysis_radius_degrees > 180").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].tile_id} has no usable analysis radius")
    t = tiles.select("tile_id", "ra_degrees", "dec_degrees", "analysis_radius_degrees")
    widest = tiles.agg(F.max("analysis_radius_degrees")).first()[0] or 0.0
    near = F.col("sep") <= F.col("analysis_radius_degrees")
    met = near_pairs(truth.select("bin_index", "ra", "dec"), t, [], F.lit(float(widest)), ("ra", "dec"), ("ra_degrees", "dec_degrees"), near)
    return met.groupBy("tile_id").agg(F.array_sort(F.collect_list("bin_index")).alias("bins"))


def track_midpoint(ra: float, dec: float, velocity: float, angle: float, east: float = 0.0, north: float = 0.0) -> tuple[float, float]:
    """Where a source is in the middle of the window: its offset from the tile's centre, whatever its motion."""
    d = dec + north
    return (ra + east / math.cos(math.radians(d))) % 360.0, d


def unrouted(memberships: DataFrame, handles: DataFrame) -> DataFrame:
    """tile_id, problem of tiles that should have got injected rows and didn't, or the other way round."""
    j = memberships.select("tile_id", F.lit(1).alias("a")).join(handles.select(F.col("cap_tile").alias("tile_id")).distinct().withColumn("b", F.lit(1)), "tile_id", "full")
    return j.where("a is null or b is null").select("tile_id", F.when(F.col("b").isNull(), "no rows").otherwise("no membership").alias("problem"))


def check_template(photons: DataFrame, ra: float, dec: float, radius: float, n_bins: int) -> None:
    """Refuses photons that don't surround the centre claimed, or leave bins without templates."""
    far = photons.agg(F.percentile(sphere.separation(F.col("ra"), F.col("dec"), F.lit(float(ra)), F.lit(float(dec))), 0.5).alias("m")).first().m
    if far is None or far > radius:
        raise ValueError(f"the photons lie {far} degrees (median) from the centre claimed")
    if none := sorted(r.bin_index for r in empty_bins(photons, n_bins).collect()):
        raise ValueError(f"no template photons in bins {none}")


def injected_tiles(photons: DataFrame, tiles: DataFrame, truth: DataFrame, per_bin: int, seed: int, index: float = 2.0, radius: float = 18.0) -> DataFrame:
    """Injected rows of all tiles whose cap holds the source, with cap_tile: what is added to each tile's files.

    ``photons`` (with bin_index) are the templates and must surround the source.
    """
    caps = tiles.withColumn("analysis_radius_degrees", F.lit(float(radius)))
    return routed(inject(photons, truth, per_bin, index, seed), cap_memberships(truth, caps))


def routed(injected: DataFrame, memberships: DataFrame) -> DataFrame:
    """Injected rows once per member tile, for the bins in which it is a member."""
    m = memberships.select(F.col("tile_id").alias("cap_tile"), F.explode("bins").alias("bin_index"))
    return injected.where("is_injected").join(m, "bin_index")


# ---------------------------------------------------------------- tabulated point spread


@dataclass(frozen=True)
class KingTable:
    """A double-King point spread on a (cos theta, log energy) grid."""

    log_energy: tuple[float, ...]
    costheta: tuple[float, ...]
    scaling: tuple[float, float, float]
    cells: dict[str, tuple[tuple[float, ...], ...]]  # NTAIL, SCORE, STAIL, GCORE, GTAIL by theta, energy

    def mixture(self, energy: float, theta: float) -> list[tuple[int, int, float]]:
        def axis(centres: Sequence[float], v: float) -> list[tuple[int, float]]:
            if v <= centres[0]:
                return [(0, 1.0)]
            if v >= centres[-1]:
                return [(len(centres) - 1, 1.0)]
            k = next(i for i, c in enumerate(centres) if c >= v)
            f = (v - centres[k - 1]) / (centres[k] - centres[k - 1])
            return [(k - 1, 1 - f), (k, f)]

        return [(t, e, a * b) for t, a in axis(self.costheta, math.cos(math.radians(theta))) for e, b in axis(self.log_energy, math.log10(energy))]

    def scale(self, energy: float) -> float:
        c0, c1, beta = self.scaling
        return math.hypot(c0 * (energy / 100.0) ** beta, c1)

    def parts(self, energy: float, theta: float) -> list[tuple[float, float, float]]:
        """(weight, sigma, gamma) of the King profiles mixed at an energy and inclination."""
        out = []
        for t, e, w in self.mixture(energy, theta):
            n, sc, st, gc, gt = (self.cells[k][t][e] for k in ("NTAIL", "SCORE", "STAIL", "GCORE", "GTAIL"))
            core = 1 / (1 + n * (st / sc) ** 2)
            out += [(w * core, sc, gc), (w * (1 - core), st, gt)]
        return out


def king_containment(x: Column, sigma: float, gamma: float) -> Column:
    """Share of a King profile within the scaled radius x."""
    return 1 - F.pow(1 + x * x / (2 * gamma * sigma * sigma), F.lit(1 - gamma))


def containment(radius: Column, table: KingTable, energy: float, theta: float) -> Column:
    """Share of photons within ``radius`` degrees."""
    x = F.radians(radius) / table.scale(energy)
    out: Column = F.lit(0.0)
    for w, s, g in table.parts(energy, theta):
        out = out + w * king_containment(x, s, g)
    return out


def king_separation(pick: Column, u: Column, table: KingTable, energy: float, theta: float) -> Column:
    """Degrees from the source, from two uniforms: one picks the profile, one the radius (null beyond 90)."""
    cumulative, chosen = 0.0, None
    profile = lambda s, g: F.lit(s) * F.sqrt(2 * g * (F.pow(1 - u, F.lit(1 / (1 - g))) - 1))
    parts = table.parts(energy, theta)
    for w, s, g in parts:
        cumulative += w
        chosen = F.when(pick < cumulative, profile(s, g)) if chosen is None else chosen.when(pick < cumulative, profile(s, g))
    out = F.degrees(table.scale(energy) * chosen.otherwise(profile(*parts[-1][1:])))
    return F.when(out <= 90, out)


# ---------------------------------------------------------------- exposure-folded energies


def car_pixel(ra: Column, dec: Column, crval: tuple[float, float], cdelt: tuple[float, float], crpix: tuple[float, float], shape: tuple[int, int]) -> tuple[Column, Column]:
    """(ix, iy), zero-based, of the nearest pixel of a plate-carree map; halves go to the even one."""
    x = (ra - crval[0]) / cdelt[0] + crpix[0] - 1
    y = (dec - crval[1]) / cdelt[1] + crpix[1] - 1
    ix = F.pmod(F.rint(x).cast("long"), F.lit(shape[0])).cast("int")
    return ix, F.greatest(F.lit(0), F.least(F.rint(y).cast("int"), F.lit(shape[1] - 1)))


def folded_cdf(spark: SparkSession, layers: Sequence[tuple[float, float]], points: int = 32_769) -> DataFrame:
    """k, energy, density, cdf on an even log grid, of E^-2 times an exposure given at some energies.

    Exposure is linear in log energy between layers, the distribution a running trapezoid sum.
    """
    if len(layers) < 2 or layers[0][0] > ENERGY_MIN or layers[-1][0] < ENERGY_MAX or any(b[0] <= a[0] for a, b in zip(layers, layers[1:])):
        raise ValueError("the exposure layers don't cover the energy range in order")
    if any(not math.isfinite(x) or x <= 0 for _, x in layers):
        raise ValueError("exposure must be positive")
    lo, hi = math.log(ENERGY_MIN), math.log(ENERGY_MAX)
    le = F.lit(lo) + F.col("k") * F.lit((hi - lo) / (points - 1))
    exposure: Column = F.lit(float(layers[-1][1]))
    for (e0, x0), (e1, x1) in reversed(list(zip(layers, layers[1:]))):
        a, b = math.log(e0), math.log(e1)
        exposure = F.when(le <= b, F.lit(x0) + (le - a) * F.lit((x1 - x0) / (b - a))).otherwise(exposure)
    g = spark.range(points).select(F.col("id").cast("int").alias("k")).select("k", F.exp(le).alias("energy"), exposure.alias("exposure"))
    g = g.withColumn("density", F.col("exposure") / (F.col("energy") * F.col("energy")))
    w = W.orderBy("k")  # the grid is a few ten thousand points by definition
    piece = F.coalesce(0.5 * (F.col("density") + F.lag("density").over(w)) * (F.col("energy") - F.lag("energy").over(w)), F.lit(0.0))
    g = g.withColumn("_p", piece).withColumn("_c", F.sum("_p").over(w.rowsBetween(W.unboundedPreceding, 0)))
    total = F.max("_c").over(W.partitionBy())
    return g.select("k", "energy", "density", (F.col("_c") / total).alias("cdf"))


def folded_energy(uniforms: DataFrame, cdf: DataFrame, u: str = "u") -> DataFrame:
    """uniforms with energy: linear interpolation of the inverse distribution (an interval join on coarse slices)."""
    slices = 1024
    w = W.orderBy("k")
    seg = cdf.select("k", F.col("cdf").alias("c0"), F.col("energy").alias("e0"), F.lead("cdf").over(w).alias("c1"), F.lead("energy").over(w).alias("e1")).where("c1 > c0")
    first, last = F.floor(F.col("c0") * slices).cast("int"), F.least(F.floor(F.col("c1") * slices).cast("int"), F.lit(slices - 1))
    seg = seg.withColumn("_s", F.explode(F.sequence(first, last)))
    got = uniforms.withColumn("_s", F.floor(F.col(u) * slices).cast("int")).join(F.broadcast(seg), "_s").where((F.col(u) >= F.col("c0")) & (F.col(u) < F.col("c1")))
    return got.withColumn("energy", F.col("e0") + (F.col("e1") - F.col("e0")) * (F.col(u) - F.col("c0")) / (F.col("c1") - F.col("c0"))).drop("_s", "k", "c0", "c1", "e0", "e1")


def quantile(cdf: DataFrame, points: Sequence[float]) -> DataFrame:
    """u, energy: energies below which the stated shares of a folded_cdf lie, linear between its points."""
    spark = cdf.sparkSession
    return folded_energy(spark.createDataFrame([(float(u),) for u in points], "u double"), cdf).select("u", F.col("energy"))


def probability_between(cdf: DataFrame, edges: DataFrame) -> DataFrame:
    """edges (low, high) with probability: the share of a folded_cdf between two energies; energies outside count as the ends."""
    w = W.orderBy("k")  # the grid is a few ten thousand points by definition
    g = cdf.select("energy", "cdf", F.lead("energy").over(w).alias("_e1"), F.lead("cdf").over(w).alias("_c1"), F.row_number().over(w).alias("_k"))
    ends = g.agg(F.min("energy").alias("_lo"), F.max("energy").alias("_hi"))
    e = edges.crossJoin(F.broadcast(ends))  # one row
    for name in ("low", "high"):
        x = F.greatest(F.least(F.col(name), F.col("_hi")), F.col("_lo"))
        share = F.col("cdf") + (F.col("_x") - F.col("energy")) / (F.col("_e1") - F.col("energy")) * (F.col("_c1") - F.col("cdf"))
        e = e.withColumn("_x", x).join(F.broadcast(g), (F.col("_x") >= F.col("energy")) & (F.coalesce(F.col("_x") < F.col("_e1"), F.lit(True)))).withColumn(f"_{name}", F.when(F.col("_e1").isNull(), F.col("cdf")).otherwise(share)).drop("_x", "energy", "cdf", "_e1", "_c1", "_k")
    return e.withColumn("probability", F.col("_high") - F.col("_low")).drop("_high", "_low", "_lo", "_hi")


def band_probabilities(cdf: DataFrame, bands: Sequence[tuple[float, float]]) -> DataFrame:
    return probability_between(cdf, cdf.sparkSession.createDataFrame([(float(a), float(b)) for a, b in bands], "low double, high double"))


def provenance(layers: Sequence[tuple[float, float]], index: float = 2.0, points: int = 32_769) -> dict[str, object]:
    """What a folded sampler was made of. Only the index 2 is folded."""
    if index != 2.0:
        raise ValueError("the folded spectrum has index 2")
    return {"index": index, "points": points, "layers": len(layers), "lowest": layers[0][0], "highest": layers[-1][0], "least_exposure": min(x for _, x in layers), "most_exposure": max(x for _, x in layers)}
