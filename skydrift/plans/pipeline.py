"""The search from photons to tracks as one plan over all tiles, bins and bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.functions import lit

from skydrift.config import SearchConfig
from skydrift.operators import background as B
from skydrift.operators import caps
from skydrift.operators import photons as P
from skydrift.operators import seeding as S
from skydrift.operators import tracks as T
from skydrift.operators.nearby import near_regions
from skydrift.runtime import Durable


def route(photons: DataFrame, tiles: DataFrame) -> DataFrame:
    """Photons once per tile whose analysis cap (analysis_radius_degrees) holds them, tile_id being that tile."""
    kept = ["event_id", "_ra", "_dec", "energy", "time_met"]
    p = photons.withColumn("_ra", photons["ra"]).withColumn("_dec", photons["dec"])
    got = near_regions(p, kept, tiles, ("tile_id", "ra_degrees", "dec_degrees", "analysis_radius_degrees"))
    return got.select(got["target"].alias("tile_id"), "event_id", got["_ra"].alias("ra"), got["_dec"].alias("dec"), "energy", "time_met")


def candidates(photons: DataFrame, catalogue: DataFrame, region: B.Region, config: SearchConfig = SearchConfig(), cuts: bool = True) -> DataFrame:
    """Detections after same-bin deduplication, numbered per tile, with t_mid and photons per band.

    photons: event_id (unique), ra, dec, energy, time_met (and zenith, event_class with ``cuts``; and
    tile_id where the region is one cap). With a table of tiles (tile_id, ra_degrees, dec_degrees,
    analysis_radius_degrees) every tile is searched in one job: each place once for all caps that hold it
    (operators.caps), or, if tiles are too many or caps too wide for that, on photons routed to all caps.
    """
    keep = Durable(photons.sparkSession, "search")
    p = P.quality_cut(photons, config.max_zenith, config.class_bit) if cuts else photons
    far = config.outer_scale * max(S.eps_of(config)) + max(config.mask_scale * max(S.eps_of(config)), config.mask_least_radius)
    if isinstance(region, DataFrame):
        near = B.cone(catalogue, 0.0, 0.0, 181.0)
        if (sky := caps.fits(region, near, config)) is not None:
            every = keep.put(_binned(p.select("event_id", "ra", "dec", "energy", "time_met"), config).drop("time_met"))
            return _deduplicated(keep.put(caps.detections(every, sky)), config, keep)
        p = route(p, region)
    else:
        ra, dec, radius = region
        p, near = P.in_cap(p, ra, dec, radius), B.cone(catalogue, ra, dec, radius + far)
    every = keep.put(_binned(p.select("tile_id", "event_id", "ra", "dec", "energy", "time_met"), config))
    seeds = P.crowded(every.where("band is not null"), S.GROUP, config.least_photons)
    members = keep.put(S.cluster_members(seeds, config))
    scored = keep.put(B.detections(B.significance(B.centroids(seeds, members), seeds, near, region, config), config))
    return _deduplicated(scored.join(B.aperture_counts(scored, every, config), list(B.CLUSTER), "left"), config, keep)


def _binned(photons: DataFrame, config: SearchConfig) -> DataFrame:
    p = photons.withColumn("bin_index", P.time_bin(photons["time_met"], config.bin_days))
    return p.withColumn("band", P.band_index(p["energy"], config.bands))


def _deduplicated(scored: DataFrame, config: SearchConfig, keep: Durable) -> DataFrame:
    first = T.same_bin_dedup(T.numbered(scored, config), config).drop("cand", "t_mid")
    return keep.put(T.numbered(first, config))


def linked(found: DataFrame, config: SearchConfig = SearchConfig()) -> DataFrame:
    """All tracks long enough, whatever their motion."""
    return Durable(found.sparkSession, "linked").put(T.link_tracks(found, T.link_edges(found, config), config))


def chosen(linked: DataFrame, found: DataFrame, config: SearchConfig = SearchConfig(), bypass: bool = False) -> DataFrame:
    """Tracks that pass the motion filter and aren't near-duplicates of better ones."""
    keep = Durable(found.sparkSession, "tracks")
    metrics = T.motion_metrics(T.track_points(linked, found))
    return keep.put(T.drop_near_duplicates(keep.put(T.moving(linked, metrics, config, bypass)), config))


def tracks(found: DataFrame, config: SearchConfig = SearchConfig(), bypass: bool = False) -> DataFrame:
    """Linked tracks that pass the motion filter and aren't near-duplicates of better ones."""
    return chosen(linked(found, config), found, config, bypass)


def records(found: DataFrame, config: SearchConfig = SearchConfig(), bypass: bool = False) -> DataFrame:
    return T.track_records(tracks(found, config, bypass), found, config)


def search(
    photons: DataFrame, catalogue: DataFrame, tiles: DataFrame, region: B.Region, config: SearchConfig = SearchConfig(), cuts: bool = True, own: bool = True
) -> DataFrame:
    """Track records, each kept only by the tile that owns its mean direction (``own``)."""
    out = records(candidates(photons, catalogue, region, config, cuts), config)
    return T.owned_records(out, tiles) if own else out


def search_tiles(photons: DataFrame, catalogue: DataFrame, tiles: DataFrame, radius: float = 18.0, config: SearchConfig = SearchConfig(), cuts: bool = True) -> DataFrame:
    """The search of all tiles at once: caps of ``radius`` degrees overlap, ownership keeps each track once.

    A campaign of randomised times is the same call on photons with their times replaced.
    """
    region = tiles.select("tile_id", "ra_degrees", "dec_degrees").withColumn("analysis_radius_degrees", lit(float(radius)))
    return search(photons, catalogue, tiles, region, config, cuts)
