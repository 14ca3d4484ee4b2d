"""Detections linked into tracks, filtered by their motion, freed of duplicates and assigned to owners."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skydrift.config import WINDOW_START, YEAR_SECONDS, SearchConfig, band_label, bin_edges
from skydrift.functions import sphere
from skydrift.operators.components import components
from skydrift.operators.greedy import greedy_keep
from skydrift.operators.radius_join import by_band, near_pairs


def bin_times(bin_index: Column, days: float) -> tuple[Column, Column, Column]:
    """(start, stop, middle) of a time bin."""
    edges = F.array(*[F.lit(e) for e in bin_edges(days)])
    a, b = F.element_at(edges, bin_index + 1), F.element_at(edges, bin_index + 2)
    return a, b, (a + b) / 2


def numbered(candidates: DataFrame, config: SearchConfig) -> DataFrame:
    """Candidates with cand (order within the tile by bin, then falling sigma) and t_mid.

    A tile holds a few thousand candidates at most, whatever its photons.
    """
    order = W.partitionBy("tile_id").orderBy("bin_index", F.desc("sigma"), "band", "label")
    _, _, mid = bin_times(F.col("bin_index"), config.bin_days)
    return candidates.withColumn("cand", F.row_number().over(order)).withColumn("t_mid", mid)


def same_bin_dedup(candidates: DataFrame, config: SearchConfig) -> DataFrame:
    """Best candidates of each tile and bin; each takes over weaker ones within the larger eps of both.

    Needs tile_id, bin_index, cand, sigma, eps, band, c_ra, c_dec; adds merged_bands and
    merged_count. Consumption isn't passed on: a weaker candidate can't consume for a stronger one.
    """
    group = ("tile_id", "bin_index")
    rank = W.partitionBy(*group).orderBy(F.desc("sigma"), "cand")
    c = candidates.withColumn("_p", F.row_number().over(rank))
    side = lambda p: c.select(*group, *[F.col(x).alias(p + x) for x in ("_p", "c_ra", "c_dec", "eps")])
    reach = F.lit(max(config.eps(ref) for _, _, ref in config.bands))
    near = (F.col("a__p") < F.col("b__p")) & (F.col("sep") <= F.greatest("a_eps", "b_eps"))
    met = near_pairs(side("a_"), side("b_"), group, reach, ("a_c_ra", "a_c_dec"), ("b_c_ra", "b_c_dec"), near)
    key = lambda p: F.struct(*group, F.col(p).alias("p"))
    chosen = greedy_keep(c.select(key("_p").alias("node")), met.select(key("a__p").alias("a"), key("b__p").alias("b")))
    who = chosen.select("node.tile_id", "node.bin_index", F.col("node.p").alias("_p"), F.col("keeper.p").alias("_k"))
    bands = c.join(who, [*group, "_p"]).groupBy(*group, F.col("_k").alias("_p"))
    merged = bands.agg(F.array_sort(F.collect_set("band")).alias("merged_bands"), F.count(F.lit(1)).cast("int").alias("merged_count"))
    return c.join(merged, [*group, "_p"]).drop("_p")


def link_edges(candidates: DataFrame, config: SearchConfig) -> DataFrame:
    """tile_id, src, dst, gap, penalty: pairs one or two bins apart that a source could travel between.

    A bin of a tile has some hundred candidates at most, so they are compared as they are, without copies for cubes of the sky.
    """
    known = candidates.where("c_ra is not null and c_dec is not null and not isnan(c_ra) and not isnan(c_dec)")
    a = known.select("tile_id", F.col("cand").alias("src"), F.col("bin_index").alias("_b"), F.col("t_mid").alias("_t"), F.col("c_ra").alias("_r"), F.col("c_dec").alias("_d"))
    a = a.withColumn("gap", F.explode(F.array(*[F.lit(g) for g in range(1, config.max_gap + 1)]))).withColumn("bin_index", F.col("_b") + F.col("gap")).drop("_b")
    b = known.select("tile_id", "bin_index", F.col("cand").alias("dst"), "t_mid", "c_ra", "c_dec")
    years = (F.col("t_mid") - F.col("_t")) / YEAR_SECONDS
    far = config.link_degrees_per_year * years
    met = a.join(b, ["tile_id", "bin_index"]).where((years > 0) & (F.abs(F.col("c_dec") - F.col("_d")) <= far + 1e-6))
    met = met.withColumn("sep", sphere.separation(*[F.col(c) for c in ("_r", "_d", "c_ra", "c_dec")])).where(F.col("sep") <= far)
    bin_years = config.bin_days * 86400.0 / YEAR_SECONDS
    return met.select("tile_id", "src", "dst", "gap", (F.col("sep") / years * bin_years + config.gap_penalty * (F.col("gap") - 1)).alias("penalty"))


def link_tracks(candidates: DataFrame, edges: DataFrame, config: SearchConfig) -> DataFrame:
    """tile_id, track (order by falling length, then score), length, score, path: all tracks long enough.

    A layered dynamic programme per tile: bins in turn, each candidate keeping per number of skipped bins
    its few best ways to be reached, plus the way that begins with it. Ties fall by gap, number and rank of the predecessor.
    Candidates and edges are shuffled once, by tile, which they pass through in order; ways are made and dropped there,
    as there are a dozen times as many as candidates. Sigma is a number.
    """
    beam, max_skips, least, n_bins = config.beam, config.max_skips, config.least_length, len(bin_edges(config.bin_days)) - 1
    kinds = dict(candidates.dtypes)
    shape = f"tile_id {kinds['tile_id']}, track int, length int, score double, path array<{kinds['cand']}>"
    arrow = to_arrow_schema(StructType.fromDDL(shape))

    def of_tile(own: dict, steps: dict) -> list[tuple]:
        """(-length, -score, cand, skips, rank, path) of the tracks of a tile in order."""
        ways, long = {}, []
        for cand in sorted(own, key=lambda c: (own[c][0], c)):
            sigma, reached = own[cand][1], {}
            for gap, src, penalty in steps.get(cand, ()):
                for length, score, skips, rank, path in ways.get(src, ()):
                    if (k := skips + gap - 1) <= max_skips:
                        reached.setdefault(k, []).append((length - 1, -(-score + sigma - penalty), gap, src, rank, path))
            here = ways[cand] = [(-1, -sigma, 0, beam + 1, (cand,))]
            for k, found in reached.items():
                found.sort()
                here += [(w[0], w[1], k, rank, (*w[5], cand)) for rank, w in enumerate(found[:beam], 1)]
            long += [(w[0], w[1], cand, w[2], w[3], w[4]) for w in here if -w[0] >= least]
        return sorted(long)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]

        def close() -> None:
            for track, (length, score, _, _, _, path) in enumerate(of_tile(own, steps), 1):
                for column, value in zip(out, (now, track, -length, -score, path)):
                    column.append(value)

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(out, arrow.types)], schema=arrow)
            for column in out:
                column.clear()
            return done

        now, own, steps = None, {}, {}
        for batch in batches:
            for tile, cand, b, src, gap, x in zip(*[batch.column(c).to_pylist() for c in range(6)]):
                if tile != now:
                    close()
                    now, own, steps = tile, {}, {}
                    if len(out[0]) > 20_000:
                        yield flush()
                if src is None:
                    if 0 <= b < n_bins:
                        own[cand] = (b, x)
                else:
                    steps.setdefault(cand, []).append((gap, src, x))
        close()
        yield flush()

    c = candidates.where("bin_index is not null").select("tile_id", "cand", "bin_index", F.lit(None).cast(kinds["cand"]).alias("src"), F.lit(0).alias("gap"), F.col("sigma").alias("x"))
    e = edges.select("tile_id", F.col("dst").alias("cand"), F.lit(None).cast(kinds["bin_index"]).alias("bin_index"), "src", "gap", F.col("penalty").alias("x"))
    rows = c.unionByName(e).repartition("tile_id").sortWithinPartitions("tile_id")
    return rows.mapInArrow(link, shape)


def track_points(tracks: DataFrame, candidates: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """tile_id, track, cand, bin_index, t_mid, ra, dec, sigma (and extra): one row per point of a track."""
    steps = tracks.select("tile_id", "track", F.explode("path").alias("cand"))
    cols = candidates.select("tile_id", "cand", "bin_index", "t_mid", F.col("c_ra").alias("ra"), F.col("c_dec").alias("dec"), "sigma", *extra)
    return steps.join(cols, ["tile_id", "cand"])


def motion_metrics(points: DataFrame, keys: Sequence[str] = ("tile_id", "track")) -> DataFrame:
    """keys, n_points, anisotropy, time_correlation, velocity, consistency, scatter, least and most step velocity.

    Points are projected gnomonically around their mean direction; the principal axis comes from
    the 2 x 2 covariance in closed form. Tracks of fewer than three points or without extent get
    zeros and null scatter. Velocities are in degrees per year.
    """
    k = list(keys)
    years = (F.col("t_mid") - WINDOW_START) / YEAR_SECONDS
    p = points.select(*k, years.alias("t"), *[c.alias(n) for n, c in zip("xyz", sphere.unit(F.col("ra"), F.col("dec")))])
    mean = p.groupBy(*k).agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"], F.count(F.lit(1)).cast("int").alias("n_points"))
    length = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2 + F.col("mz") ** 2)
    mean = mean.withColumn("_n", length)
    for c in "xyz":
        mean = mean.withColumn(f"m{c}", F.when(F.col("_n") > 0, F.col(f"m{c}") / F.col("_n")))
    flat = F.sqrt(F.col("mx") ** 2 + F.col("my") ** 2)
    polar = flat < 1e-9
    mean = mean.withColumn("ex", F.when(polar, 1.0).otherwise(-F.col("my") / flat)).withColumn("ey", F.when(polar, 0.0).otherwise(F.col("mx") / flat))
    # north = centre x east
    mean = mean.withColumn("nx", -F.col("mz") * F.col("ey")).withColumn("ny", F.col("mz") * F.col("ex")).withColumn("nz", F.col("mx") * F.col("ey") - F.col("my") * F.col("ex"))
    j = p.join(mean, k)
    depth = F.col("x") * F.col("mx") + F.col("y") * F.col("my") + F.col("z") * F.col("mz")
    j = j.withColumn("u", (F.col("x") * F.col("ex") + F.col("y") * F.col("ey")) / depth).withColumn("v", (F.col("x") * F.col("nx") + F.col("y") * F.col("ny") + F.col("z") * F.col("nz")) / depth)
    cov = j.groupBy(*k).agg(F.var_samp("u").alias("a"), F.covar_samp("u", "v").alias("b"), F.var_samp("v").alias("d"), F.avg("u").alias("mu"), F.avg("v").alias("mv"))
    half = F.sqrt(((F.col("a") - F.col("d")) / 2) ** 2 + F.col("b") ** 2)
    big, small = (F.col("a") + F.col("d")) / 2 + half, (F.col("a") + F.col("d")) / 2 - half
    axis = 0.5 * F.atan2(2 * F.col("b"), F.col("a") - F.col("d"))
    cov = cov.withColumn("big", big).withColumn("small", small).withColumn("axis", axis)
    q = j.select(*k, "t", "u", "v", "n_points").join(cov, k)
    q = q.withColumn("s", (F.col("u") - F.col("mu")) * F.cos("axis") + (F.col("v") - F.col("mv")) * F.sin("axis"))
    fit = q.groupBy(*k).agg(F.corr("t", "s").alias("r"), F.regr_slope("s", "t").alias("slope"), F.first("big").alias("big"), F.first("small").alias("small"), F.first("n_points").alias("n_points"))
    turned = q.join(fit.select(*k, "slope"), k).withColumn("s", F.when(F.col("slope") < 0, -F.col("s")).otherwise(F.col("s")))
    order = W.partitionBy(*k).orderBy("t")
    step = (F.col("s") - F.lag("s").over(order)) / (F.col("t") - F.lag("t").over(order))
    steps = turned.withColumn("w", F.degrees(step)).where("w is not null").groupBy(*k).agg(
        F.min("w").alias("least"), F.max("w").alias("most"), F.stddev_pop("w").alias("sd"), F.avg("w").alias("mean")
    )
    out = fit.join(steps, k, "left")
    ok = (F.col("n_points") >= 3) & (F.col("big") > 0)
    even = F.col("least") > 0
    zero = F.lit(0.0)
    return out.select(
        *k, "n_points",
        F.when(ok, 1 - F.greatest(F.col("small"), zero) / F.col("big")).otherwise(zero).alias("anisotropy"),
        F.when(ok & F.col("r").isNotNull() & ~F.isnan("r"), F.abs("r")).otherwise(zero).alias("time_correlation"),
        F.when(ok, F.degrees(F.abs("slope"))).otherwise(zero).alias("velocity"),
        F.when(ok & even, F.col("least") / F.col("most")).otherwise(zero).alias("consistency"),
        F.when(ok & even, F.col("sd") / F.col("mean")).alias("scatter"),
        F.when(ok, F.col("least")).alias("least_step"), F.when(ok, F.col("most")).alias("most_step"),
    )


def moving(tracks: DataFrame, metrics: DataFrame, config: SearchConfig, bypass: bool = False) -> DataFrame:
    """Tracks that look like straight, steady motion (all of them with ``bypass``)."""
    m = metrics.select("tile_id", "track", "anisotropy", "time_correlation", "velocity", "consistency", "scatter")
    out = tracks.join(m, ["tile_id", "track"])
    if bypass:
        return out
    return out.where((F.col("anisotropy") >= config.least_anisotropy) & (F.col("time_correlation") >= config.least_time_correlation) & (F.col("consistency") >= config.least_consistency))


def drop_near_duplicates(tracks: DataFrame, config: SearchConfig) -> DataFrame:
    """Tracks no better track shares most of its points with (of the shorter of the two).

    A busy tile has thousands of tracks and millions of pairs of them, so pairs are never listed: the tracks of a tile stream
    by in order, each met only by kept ones. Two tracks that share the share asked for must share one of any few points of
    the new one, so kept tracks are looked up by the points of it that fewest of them have.
    """
    share, names = config.near_duplicate, tracks.columns
    tile, path = names.index("tile_id"), names.index("path")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, by_point, shortest = None, [], {}, 0
        for batch in batches:
            paths = batch.column(path)
            ends, points = paths.offsets.tolist(), paths.values.tolist()
            good = []
            for row, t in enumerate(batch.column(tile).to_pylist()):
                if t != now:
                    now, kept, by_point, shortest = t, [], {}, math.inf
                own = points[ends[row] : ends[row + 1]]
                n, own_set = len(own), set(own)
                fewest = sorted([by_point.setdefault(c, []) for c in own_set], key=len)
                look = len(own_set) - math.ceil(share * min(n, shortest) - 1e-9) + 1
                fine = not any(len(own_set & s) >= share * min(n, m) for at in fewest[: max(0, look)] for s, m in map(kept.__getitem__, at))
                good.append(fine)
                if fine:
                    for at in fewest:
                        at.append(len(kept))
                    kept.append((own_set, n))
                    shortest = min(shortest, n)
            yield batch.filter(pa.array(good, pa.bool_()))

    return tracks.repartition("tile_id").sortWithinPartitions("tile_id", "track").mapInArrow(best, tracks.schema)


def track_records(tracks: DataFrame, candidates: DataFrame, config: SearchConfig) -> DataFrame:
    """One nested record per track, numbered per tile in order before any ownership is applied."""
    pts = track_points(tracks, candidates, ("n_on", "expected_bg", "band", "eps", "photons_per_band"))
    labels = F.array(*[F.lit(band_label(lo, hi)) for lo, hi, _ in config.bands])
    label = lambda p: F.element_at(labels, p["band"] + 1)

    def point(p: Column) -> Column:
        start, stop, _ = bin_times(p["bin_index"], config.bin_days)
        return F.struct(
            *[p[c].alias(c) for c in ("bin_index", "ra", "dec")], start.alias("t_start"), stop.alias("t_stop"), p["n_on"].alias("n_photons"),
            p["sigma"].alias("sigma"), p["expected_bg"].alias("expected_bg"), label(p).alias("band"), p["eps"].alias("epsilon_degrees"),
        )

    flat = pts.select("tile_id", "track", F.explode("photons_per_band").alias("k", "v")).groupBy("tile_id", "track", "k").agg(F.sum("v").cast("int").alias("v"))
    per_band = flat.groupBy("tile_id", "track").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("aperture_photons_per_band"))
    # times and names follow from bins and bands: put in once the points have been shuffled
    seen = F.collect_list(F.struct("bin_index", "ra", "dec", "n_on", "sigma", "expected_bg", "band", "eps"))
    rec = pts.groupBy("tile_id", "track").agg(F.count(F.lit(1)).cast("int").alias("track_length"), F.sum("n_on").cast("int").alias("detection_band_photons"), seen.alias("_seen"))
    rec = rec.select(
        "tile_id", "track", "track_length", "detection_band_photons",
        F.array_sort(F.array_distinct(F.array_compact(F.transform("_seen", label)))).alias("detected_bands"), F.array_sort(F.transform("_seen", point)).alias("points"),
    )
    number = F.row_number().over(W.partitionBy("tile_id").orderBy("track")).cast("int")
    first, last = F.col("points")[0], F.element_at("points", -1)
    mid = lambda p: (p["t_start"] + p["t_stop"]) / 2
    years = (mid(last) - mid(first)) / YEAR_SECONDS
    far = sphere.separation(first["ra"], first["dec"], last["ra"], last["dec"])
    return rec.join(per_band, ["tile_id", "track"], "left").select(
        "tile_id", number.alias("candidate_number"), "track", "track_length", first["ra"].alias("ra_start"), last["ra"].alias("ra_end"), first["dec"].alias("dec_start"), last["dec"].alias("dec_end"),
        "detection_band_photons", "aperture_photons_per_band", "detected_bands", F.when(years > 0, far / years).alias("average_velocity_deg_per_year"),
        F.transform("points", lambda p: p["bin_index"]).alias("bin_indices"), "points",
    )


def owned_records(records: DataFrame, tiles: DataFrame) -> DataFrame:
    """Records whose mean direction lies in their own tile's cell, with owner_tile_id and that direction."""
    from skydrift.operators.tiling import owners

    p = records.select("tile_id", "candidate_number", F.explode("points").alias("p"))
    ra, dec = sphere.mean_direction(F.col("p.ra"), F.col("p.dec"))
    mid = p.groupBy("tile_id", "candidate_number").agg(ra.alias("ra"), dec.alias("dec"))
    own = owners(mid, tiles, ["tile_id", "candidate_number"]).withColumnRenamed("owner", "owner_tile_id")
    at = mid.select("tile_id", "candidate_number", F.col("ra").alias("ownership_ra_degrees"), F.col("dec").alias("ownership_dec_degrees"))
    return records.join(own.where("owner_tile_id = tile_id"), ["tile_id", "candidate_number"]).join(at, ["tile_id", "candidate_number"])


def cross_tile_pairs(points: DataFrame, config: SearchConfig) -> DataFrame:
    """a, b (a < b), bins, median_sep, near_share: tracks of different tiles that are the same source.

    ``points``: id, tile_id, campaign, bin_index, ra, dec. Tracks are compared where they share
    bins; a pair needs enough common bins, a median separation within reach and enough bins near.
    Pairs that share a bin within twice the reach are found by cells of the sky; pairs that match
    have half their bins within reach, so none is lost.
    """
    one = points.groupBy("campaign", "bin_index", "id").agg(F.max(F.struct("tile_id", "ra", "dec")).alias("p")).select("campaign", "bin_index", "id", "p.*")
    side = lambda s: one.select("campaign", "bin_index", *[F.col(c).alias(s + c) for c in ("id", "tile_id", "ra", "dec")])
    apart = (F.col("a_tile_id") != F.col("b_tile_id")) & (F.col("a_id") < F.col("b_id"))
    reach = F.lit(2 * config.match_degrees)
    seeds = near_pairs(side("a_"), side("b_"), ("campaign", "bin_index"), reach, ("a_ra", "a_dec"), ("b_ra", "b_dec"), (F.col("sep") <= reach) & apart).select("campaign", F.col("a_id").alias("a"), F.col("b_id").alias("b")).distinct()
    pa = one.select("campaign", F.col("id").alias("a"), "bin_index", F.col("ra").alias("a_ra"), F.col("dec").alias("a_dec"))
    pb = one.select("campaign", F.col("id").alias("b"), "bin_index", F.col("ra").alias("b_ra"), F.col("dec").alias("b_dec"))
    both = seeds.join(pa, ["campaign", "a"]).join(pb, ["campaign", "b", "bin_index"])
    sep = sphere.separation(*[F.col(c) for c in ("a_ra", "a_dec", "b_ra", "b_dec")])
    got = both.withColumn("sep", sep).groupBy("campaign", "a", "b").agg(
        F.count(F.lit(1)).cast("int").alias("bins"), F.percentile("sep", 0.5).alias("median_sep"), F.avg((F.col("sep") <= config.match_degrees).cast("double")).alias("near_share")
    )
    return got.where((F.col("bins") >= config.match_least_bins) & (F.col("median_sep") <= config.match_degrees) & (F.col("near_share") >= config.match_fraction))


def cross_tile_groups(points: DataFrame, config: SearchConfig) -> DataFrame:
    """campaign, id, representative, members: tracks merged across tiles, strongest summed sigma first."""
    pairs = cross_tile_pairs(points, config)
    node = lambda c: F.struct("campaign", F.col(c).alias("id"))
    ids = points.groupBy("campaign", "id").agg(F.sum("sigma").alias("score"))
    comp = components(ids.select(node("id").alias("node")), pairs.select(node("a").alias("a"), node("b").alias("b")))
    c = comp.select("node.campaign", "node.id", F.col("component.id").alias("group")).join(ids, ["campaign", "id"])
    best = c.groupBy("campaign", "group").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"))).alias("r"), F.count(F.lit(1)).cast("int").alias("members"))
    return c.join(best, ["campaign", "group"]).select("campaign", "id", F.col("r.id").alias("representative"), "members")


def truth_matches(points: DataFrame, truth: DataFrame, config: SearchConfig) -> DataFrame:
    """id, matched_bins, median_sep of tracks that follow an injected source (truth: bin_index, ra, dec).

    Bins without truth match nothing.
    """
    t = truth.select("bin_index", F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"))
    got = points.join(t, "bin_index").withColumn("sep", sphere.separation(F.col("ra"), F.col("dec"), F.col("t_ra"), F.col("t_dec")))
    agg = got.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("matched_bins"), F.percentile("sep", 0.5).alias("median_sep"))
    return agg.where((F.col("matched_bins") >= config.match_least_bins) & (F.col("median_sep") <= config.match_degrees))


def audit_apertures(flags: DataFrame, truth: DataFrame, config: SearchConfig) -> DataFrame:
    """Per bin and band: photons, cores, least threshold and most neighbours within eps of the truth.

    ``flags`` as of core_flags. Bins without truth have no row; bands without photons near it have
    zero counts and null extremes.
    """
    eps = by_band([config.eps(ref) for _, _, ref in config.bands])
    t = truth.select("bin_index", F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"))
    near = F.when(sphere.separation(F.col("ra"), F.col("dec"), F.col("t_ra"), F.col("t_dec")) <= eps, 1)
    j = flags.join(t, "bin_index").withColumn("_near", near)
    pick = lambda c: F.when(F.col("_near").isNotNull(), F.col(c))
    return j.groupBy("bin_index", "band").agg(
        F.count(F.lit(1)).cast("int").alias("photons"), F.count("_near").cast("int").alias("near_photons"), F.min(pick("threshold")).alias("least_threshold"),
        F.max(pick("n_eps")).alias("most_neighbours"), F.count_if(F.col("is_core") & F.col("_near").isNotNull()).cast("int").alias("near_cores"),
    )


def audit_stages(stages: dict[str, DataFrame], truth: DataFrame, config: SearchConfig) -> DataFrame:
    """stage, matched_bins: in how many bins some cluster of each stage lies within reach of the truth."""
    t = truth.select("bin_index", F.col("ra").alias("t_ra"), F.col("dec").alias("t_dec"))
    out = None
    for name, clusters in stages.items():
        near = sphere.separation(F.col("c_ra"), F.col("c_dec"), F.col("t_ra"), F.col("t_dec")) <= config.match_degrees
        one = clusters.join(t, "bin_index").where(near).agg(F.countDistinct("bin_index").cast("int").alias("matched_bins")).select(F.lit(name).alias("stage"), "matched_bins")
        out = one if out is None else out.unionByName(one)
    return out
