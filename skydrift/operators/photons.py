"""Photon rows: the fixture view, time bins, energy bands, quality cuts and validity intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from skydrift.config import ENERGY_MAX, ENERGY_MIN, SEED_BANDS, WINDOW_START, WINDOW_STOP, YEAR_SECONDS, band_label, bin_edges
from skydrift.functions.bits import any_bit
from skydrift.functions.sphere import separation

_FINITE = float("inf")


def fixture_photons(events: DataFrame) -> DataFrame:
    """A deterministic photon view of the generic event table, with three moving sources planted.

    Columns: event_id, run_id, time_met, energy, ra, dec, zenith, event_class, is_source, tile_id.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    seconds = (micros - F.lit(1704067200000000)).cast("double") / F.lit(1e6)
    frac = lambda k: (F.lit(k) * F.col("event_id")) % F.lit(1.0)
    k = F.col("user_id") % 50
    src = (k < 3).cast("int")
    base = events.select(
        "event_id",
        F.col("user_id").alias("run_id"),
        (F.lit(WINDOW_START) + seconds * (F.lit(3.15532801e8) / F.lit(2.592e6))).alias("time_met"),
        (F.lit(1000.0) * (1 + F.col("value") / F.lit(25.0))).alias("energy"),
        src.alias("is_source"),
        F.when(src == 1, F.lit(178.0) + 2 * k).otherwise(F.lit(172.0) + 16 * frac(0.7548776662466927)).alias("ra0"),
        F.when(src == 1, F.lit(-2.0) + 2 * k).otherwise(F.lit(-8.0) + 16 * frac(0.5698402909980532)).alias("dec0"),
        (F.lit(0.15) * F.sqrt(frac(0.6180339887498949))).alias("r"),
        (F.lit(6.283185307179586) * frac(0.7548776662466927)).alias("theta"),
    )
    years = (F.col("time_met") - F.lit(WINDOW_START)) / F.lit(YEAR_SECONDS)
    run = F.lit(0.5) * (years - 5)
    s = F.col("is_source").cast("double")
    dec = F.col("dec0") + s * (run * F.cos(F.radians(F.lit(40.0))) + F.col("r") * F.cos("theta"))
    ra = F.col("ra0") + s * (run * F.sin(F.radians(F.lit(40.0))) + F.col("r") * F.sin("theta")) / F.cos(F.radians("dec0"))
    return base.select(
        "event_id", "run_id", "time_met", "energy", ra.alias("ra"), dec.alias("dec"),
        ((F.col("event_id") * 37) % 120).cast("double").alias("zenith"),
        (F.col("event_id") % 256).alias("event_class"), "is_source", F.lit("tile_0").alias("tile_id"),
    )


def one_per_photon(deliveries: DataFrame) -> DataFrame:
    """One row per photon, the low 32 bits of run_id and event_id together: the one delivered last.

    Of several delivered at the same time, one with finite ra, dec and energy goes before others, then
    the greatest values. event_id becomes both ids in one long; rows without an id are ignored.
    """
    values = ["ra", "dec", "energy", "time_met", "zenith", "event_class"]
    whole = finite(F.col("ra"), F.col("dec"), F.col("energy"))
    last = F.max(F.struct("ingested_at", whole.alias("_whole"), *values)).alias("_v")
    named = deliveries.where("run_id is not null and event_id is not null")
    key = F.shiftleft(F.col("run_id").bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(F.col("event_id").bitwiseAND(F.lit(0xFFFFFFFF)))
    return named.groupBy(key.alias("event_id")).agg(last).select("event_id", *[F.col(f"_v.{c}").alias(c) for c in values])


def time_bin(time: Column, days: float = 365.0) -> Column:
    """Number of the time bin; times before the window are in the first, later ones in the last."""
    n = len(bin_edges(days)) - 1
    raw = F.floor((time - F.lit(WINDOW_START)) / F.lit(days * 86400.0))
    return F.greatest(F.lit(0), F.least(raw, F.lit(n - 1))).cast("int")


def band_index(energy: Column, bands: Sequence[tuple[float, float, float]] = SEED_BANDS) -> Column:
    """Number of the half-open band that holds an energy; null outside all bands."""
    out: Column = F.when(F.lit(False), F.lit(0))
    for k, (low, high, _) in enumerate(bands):
        out = out.when((energy >= low) & (energy < high), F.lit(k))
    return out


def band_name(index: Column, bands: Sequence[tuple[float, float, float]] = SEED_BANDS) -> Column:
    out: Column = F.when(F.lit(False), F.lit(""))
    for k, (low, high, _) in enumerate(bands):
        out = out.when(index == k, F.lit(band_label(low, high)))
    return out


def binned(photons: DataFrame, days: float = 365.0, bands: Sequence[tuple[float, float, float]] = SEED_BANDS) -> DataFrame:
    """Photons inside some band, with bin_index and band."""
    return photons.withColumn("bin_index", time_bin(F.col("time_met"), days)).withColumn("band", band_index(F.col("energy"), bands)).where("band is not null")


def crowded(photons: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Photons of keys that hold at least ``least`` of them (a semi join on one count per key)."""
    enough = photons.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*keys)
    return photons.join(enough, list(keys), "left_semi")


def in_window(time: Column) -> Column:
    """Finite and inside the survey's window, both ends excluded."""
    return ~F.isnan(time) & (time > WINDOW_START) & (time < WINDOW_STOP)


def finite(*cols: Column) -> Column:
    ok = F.lit(True)
    for c in cols:
        ok = ok & c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < _FINITE)
    return ok


def quality_cut(photons: DataFrame, max_zenith: float = 90.0, bits: int = 128) -> DataFrame:
    """The search's cuts: zenith below the limit, any class bit, finite values, time in the window."""
    return photons.where(
        (F.col("zenith") < max_zenith) & any_bit(F.col("event_class"), bits) & finite(F.col("ra"), F.col("dec"), F.col("energy")) & in_window(F.col("time_met"))
    )


def preparation_cut(photons: DataFrame, start: float, stop: float, max_zenith: float = 90.0, bits: int = 128) -> DataFrame:
    """Cuts of the archive preparation for one time block, closed at its start."""
    t, e = F.col("time_met"), F.col("energy")
    return quality_cut(photons, max_zenith, bits).where((t >= start) & (t < stop) & (e >= ENERGY_MIN) & (e < ENERGY_MAX))


def in_cap(photons: DataFrame, ra: float, dec: float, radius: float) -> DataFrame:
    return photons.where(separation(F.col("ra"), F.col("dec"), F.lit(float(ra)), F.lit(float(dec))) <= radius)


def in_good_time(photons: DataFrame, intervals: DataFrame, key: str = "file_id") -> DataFrame:
    """Photons whose latest interval begun (greatest start <= time) has not stopped before their time.

    Intervals are (key, start, stop), closed at both ends; of equal starts the latest stop holds.
    Interval lists are cut by ``lead`` into stretches without overlap, which makes the as-of
    lookup an equi-join on the file with a range residual, and a semi-join at that.
    """
    one = intervals.groupBy(key, "start").agg(F.max("stop").alias("stop"))
    following = F.lead("start").over(W.partitionBy(key).orderBy("start"))
    cut = one.withColumn("_next", following).withColumnRenamed(key, "_key")
    p = photons
    cond = (p[key] == F.col("_key")) & (p["time_met"] >= F.col("start")) & (p["time_met"] <= F.col("stop")) & (F.col("_next").isNull() | (p["time_met"] < F.col("_next")))
    return p.join(cut, cond, "left_semi")


def clip_intervals(intervals: DataFrame, start: float, stop: float) -> DataFrame:
    """Intervals that reach into [start, stop), cut to it."""
    return intervals.where((F.col("stop") >= start) & (F.col("start") < stop)).withColumn("start", F.greatest("start", F.lit(float(start)))).withColumn("stop", F.least("stop", F.lit(float(stop))))
