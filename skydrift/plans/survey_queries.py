"""Queries over what surrounds the search: files read and written, draws, reports, with the SQL they must agree with."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from skydrift.config import SEED_BANDS, WINDOW_START, WINDOW_STOP, band_label, bin_edges
from skydrift.functions import hashing
from skydrift.operators import inference, inject, null, photons as P, seeding as S, tiling, tracks as T
from skydrift.plans import search_queries as Q
from skydrift.plans.registry import Registry
from skydrift.plans.search_queries import lit, r6
from skydrift.runtime import Durable, table
from skydrift.sources import archive, fits, readers, sinks

R = Registry()
_TWO64 = "18446744073709551616::hugeint"


def _folder(spark, name: str) -> str:
    """A local folder for files that are read and written file by file (a few hundred small ones)."""
    base = Durable(spark, name).base.removeprefix("file://").removeprefix("file:")
    os.makedirs(base, exist_ok=True)
    return base


def sql_times(v: str, constant: int) -> str:
    """v (ubigint) x constant modulo 2^64; the product of whole numbers would overflow."""
    c = f"{constant}::hugeint"
    return f"((({v})::hugeint & 4294967295::hugeint) * {c} % {_TWO64} + (((({v}) >> 32)::hugeint * ({c} & 4294967295::hugeint)) % 4294967296::hugeint) * 4294967296::hugeint) % {_TWO64}"


def sql_mix(source: str, key: str, out: str, to: str) -> str:
    """CTEs that add the mixed key, as a uniform named ``out``, to ``source``; the last is named ``to``."""
    steps = [f"{to}_a as (select *, (({key})::hugeint + {hashing.GOLDEN}::hugeint) % {_TWO64} v_ from {source})", f"{to}_b as (select * replace (v_::ubigint as v_) from {to}_a)"]
    for k, (shift, c) in enumerate(((30, hashing.MIX_1), (27, hashing.MIX_2))):
        a, b = ("b", "d") if k == 0 else ("d", "f")
        x = f"xor(v_, v_ >> {shift})"
        steps.append(f"{to}_{b}0 as (select * replace ({sql_times(x, c)} as v_) from {to}_{a})")
        steps.append(f"{to}_{b} as (select * replace (v_::ubigint as v_) from {to}_{b}0)")
    steps.append(f"{to} as (select * exclude (v_), (xor(v_, v_ >> 31) >> 11)::double / 9007199254740992e0 {out}, xor(v_, v_ >> 31) {out}_mix from {to}_f)")
    return ",\n".join(steps)


def sql_seed(seed: int) -> str:
    return f"{(seed * hashing.SEED_STEP) % 2**64}::ubigint"


# ---------------------------------------------------------------- files


@R.add("q_fits_catalogue", "select source_name, round(ra, 9) ra, round(\"dec\", 9) \"dec\", count(*) n from catalog_sources group by all")
def q_fits_catalogue(spark, d):
    """The catalogue as a FITS table and back."""
    rows = table(spark, d, "catalog_sources").select("source_name", "ra", "dec").collect()  # fixed size
    path = f"{_folder(spark, 'fits')}/catalogue.fits"
    fits.write_fits(path, {"SOURCES": {"source_name": ("32A", [r.source_name for r in rows]), "ra": ("D", np.array([r.ra for r in rows])), "dec": ("D", np.array([r.dec for r in rows]))}})
    got = fits.read_fits(spark, path, "SOURCES").groupBy("source_name", F.round("ra", 9).alias("ra"), F.round("dec", 9).alias("dec"))
    return got.agg(F.count(F.lit(1)).alias("n"))


@R.add("q_event_manifest", "select k as file_no, count(*) n from (select ntile(4) over (order by tile_id) k from tiles) group by 1")
def q_event_manifest(spark, d):
    """Event files named in a list, read together, each row with its file."""
    rows = table(spark, d, "tiles").orderBy("tile_id").collect()  # fixed size
    base = _folder(spark, "manifest")
    size, names = -(-len(rows) // 4), []
    for k in range(4):
        part = rows[k * size : (k + 1) * size]
        names.append(f"{base}/events_{k + 1}.fits")
        fits.write_fits(names[-1], {"EVENTS": {"ra": ("D", np.array([r.ra_degrees for r in part])), "dec": ("D", np.array([r.dec_degrees for r in part]))}})
    with open(f"{base}/files.txt", "w") as f:
        f.write("\n  \n".join(names) + "\n\n")
    paths = [r.path for r in readers.event_manifest(spark, f"{base}/files.txt").collect()]
    if fits.schema_differences(paths):
        raise ValueError("the files differ in their columns")
    e = fits.read_fits(spark, f"{base}/events_*.fits")
    return e.groupBy(F.regexp_extract("file_id", r"_(\d+)\.fits$", 1).cast("int").alias("file_no")).agg(F.count(F.lit(1)).alias("n"))


@R.add("q_exposure_cube", "select l::int layer, y::int iy, x::int ix, 1e3 * pow(1e1, l) energy, 1e2 * l + 1e1 * y + x exposure from range(3) a(l), range(4) b(y), range(5) c(x)")
def q_exposure_cube(spark, d):
    cube = np.fromfunction(lambda k, y, x: 100.0 * k + 10.0 * y + x, (3, 4, 5))
    path = f"{_folder(spark, 'cube')}/exposure.fits"
    fits.write_fits(path, {"ENERGIES": {"Energy": ("D", np.array([1e3, 1e4, 1e5]))}}, (cube, {"CTYPE1": "RA---CAR", "CTYPE2": "DEC--CAR"}))
    c = fits.exposure_rows(spark, path)
    return c.select(F.col("layer").cast("int").alias("layer"), F.col("iy").cast("int").alias("iy"), F.col("ix").cast("int").alias("ix"), "energy", "exposure")


@R.add("q_ownership_centres", "select tile_id, round(ra_degrees, 6) ra_degrees, round(dec_degrees, 6) dec_degrees from tiles")
def q_ownership_centres(spark, d):
    """Tile centres as the geometry writer leaves them."""
    from skydrift.plans.prepare import write_geometry

    base = _folder(spark, "centres")
    write_geometry(table(spark, d, "tiles"), base, 18.0)
    return readers.ownership_centres(spark, f"{base}/tile_centers.csv").select("tile_id", r6("ra_degrees", "ra_degrees"), r6("dec_degrees", "dec_degrees"))


@R.add("q_tile_descriptions", "select tile_id, round(ra_degrees, 6) ra_degrees, 18.0::double analysis_radius_degrees from tiles")
def q_tile_descriptions(spark, d):
    from skydrift.plans.prepare import write_geometry

    base = _folder(spark, "descriptions")
    write_geometry(table(spark, d, "tiles"), base, 18.0)
    return readers.tile_descriptions(spark, f"{base}/*/query_info.json").select("tile_id", r6("ra_degrees", "ra_degrees"), "analysis_radius_degrees")


@R.add("q_yield_table", "select round(ra_degrees, 6) a, round(dec_degrees, 6) b from tiles")
def q_yield_table(spark, d):
    base = Durable(spark, "yield").base
    table(spark, d, "tiles").select(F.col("ra_degrees").alias("a"), F.col("dec_degrees").alias("b")).write.option("header", "true").csv(f"{base}/table")
    return readers.yield_table(spark, f"{base}/table").select(r6("a", "a"), r6("b", "b"))


@R.add("q_injected_truth", f"select i::int bin_index, round({Q.sql_mod360('180e0 + 0.5e0 * (i + 0.5e0 - 5)')}, 6) ra, 0e0 \"dec\" from range(10) t(i)")
def q_injected_truth(spark, d):
    """A truth written as an injection's record and read back."""
    rows = [r.asDict() for r in inject.track_truth(spark, 180.0, 0.0, 0.5, 90.0).collect()]  # a row per bin
    path = f"{_folder(spark, 'truth')}/injection.json"
    sinks.write_if_changed(path, json.dumps({"per_bin_truth": rows}))
    return readers.injected_truth(spark, path).select("bin_index", r6("ra", "ra"), F.round(F.col("dec") + 0.0, 6).alias("dec"))


@R.add("q_track_files", "select 'campaign_1/' || tile_id || '_candidate_001' _candidate_id, tile_id, 1 candidate_index, round(ra_degrees, 6) ra from tiles")
def q_track_files(spark, d):
    """Result files, one per tile, as they are written and read."""
    base, part = _folder(spark, "results"), []
    for r in table(spark, d, "tiles").orderBy("tile_id").collect():  # fixed size
        os.makedirs(f"{base}/campaign_1/{r.tile_id}", exist_ok=True)
        part.append(sinks.write_if_changed(f"{base}/campaign_1/{r.tile_id}/tracks.json", json.dumps([{"ra_start": r.ra_degrees, "track_length": 5}])))
    t = readers.track_files(spark, f"{base}/campaign_1/*/tracks.json")
    return t.select("_candidate_id", F.col("folder_tile_id").alias("tile_id"), F.col("candidate_index").cast("int").alias("candidate_index"), r6("ra_start", "ra"))


@R.add("q_slim_json", "select tile_id, round(ra_degrees, 6) ra, round(gal_b_degrees, 6) b from tiles")
def q_slim_json(spark, d):
    path = f"{_folder(spark, 'slim')}/tiles.json"
    if sinks.write_slim_json(table(spark, d, "tiles"), path) != table(spark, d, "tiles").count():
        raise ValueError("records were lost")
    return spark.read.option("multiLine", "true").json(path).select("tile_id", r6("ra_degrees", "ra"), r6("gal_b_degrees", "b"))


@R.add("q_canonical_hash", "select tile_id, sha256('{\"n\":' || row_number() over (order by tile_id) || ',\"tile\":\"' || tile_id || '\"}') hash from tiles")
def q_canonical_hash(spark, d):
    ids = [r.tile_id for r in table(spark, d, "tiles").select("tile_id").orderBy("tile_id").collect()]  # fixed size
    return spark.createDataFrame([(t, sinks.canonical_hash({"tile": t, "n": k})) for k, t in enumerate(ids, 1)], "tile_id string, hash string")


@R.add(
    "q_inventory",
    """with f as (select k, 'file ' || k body from range(8) t(k))
select 'missing' problem, 'f9' "name" union all select 'hash', 'f3' union all select 'unlisted', 'f7' union all select 'size', 'f5'""",
)
def q_inventory(spark, d):
    """An inventory against a folder in which one file is changed, one longer, one new and one gone."""
    base = _folder(spark, "inventory")
    for k in range(8):
        sinks.write_if_changed(f"{base}/f{k}", f"file {k}")
    found = archive.inventory(spark, f"file://{base}")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    size = F.when(name == "f5", F.col("size") + 1).otherwise(F.col("size"))
    sha = F.when(name == "f3", F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256"))
    stated = found.where(name != "f7").select("path", size.alias("size"), sha.alias("sha256"))
    gone = spark.createDataFrame([(f"file:{base}/f9", 6, "x")], "path string, size long, sha256 string")
    return archive.inventory_differences(stated.unionByName(gone), found).select("problem", name.alias("name"))


_PREPARED_CUT = f"zenith < 90 and (event_class & 128) > 0 and ra is not null and not isnan(ra) and \"dec\" is not null and not isnan(\"dec\") and time_met > {lit(WINDOW_START)} and time_met < {lit(WINDOW_STOP)} and energy >= 1e3 and energy < 1e5 and not isnan(energy)"


@R.add(
    "q_prepared_blocks",
    f"""with pp as (select ra - 360 * floor(ra / 360) ra, "dec", time_met, floor((time_met - {lit(WINDOW_START)}) / 8e7)::int block_index from photons where {_PREPARED_CUT} and abs("dec") <= 90),
r as (select block_index, count(*) n_routed from pp p join tiles t on {Q._DOT} >= cos(radians(7.5e0)) group by 1), o as (select block_index, count(*) n_owned from pp group by 1)
select o.block_index, n_routed::bigint n_routed, n_owned::bigint n_owned from o left join r using (block_index)""",
)
def q_prepared_blocks(spark, d):
    """The preparation of the photons as delivered: rows per block after cuts and routing, and photons counted to owners."""
    from skydrift.plans import prepare

    root = Durable(spark, "prepared").base.removeprefix("file://")
    prepare.prepare(table(spark, d, "photons").drop("file_id"), table(spark, d, "tiles"), root, "query", None, prepare.Preparation(radius=7.5, block_seconds=8e7))
    rows = spark.read.parquet(f"{root}/photons").groupBy("block_index").agg(F.count(F.lit(1)).alias("n_routed"))
    owned = spark.read.parquet(f"{root}/histogram").groupBy("block_index").agg(F.sum("n").alias("n_owned"))
    return owned.join(rows, "block_index", "left").select("block_index", "n_routed", "n_owned")


# ---------------------------------------------------------------- tiles and counts


@R.add(
    "q_fibonacci_tiles",
    f"""with a as (select i, {Q.sql_mod360('degrees(i * (pi() * (3 - sqrt(5e0))))')} l, asin(1 - (2 * i + 1) / 448e0) b from range(448) t(i)),
g as (select i, l, b, cos(b) * cos(radians(l)) x, cos(b) * sin(radians(l)) y, sin(b) z from a),
v as (select i, l, b, -0.0548755604162154e0 * x + 0.4941094278755837e0 * y - 0.8676661490190047e0 * z cx, -0.8734370902348850e0 * x - 0.4448296299600112e0 * y - 0.1980763734312015e0 * z cy, -0.4838350155487132e0 * x + 0.7469822444972189e0 * y + 0.4559837761750669e0 * z cz from g)
select 'roi_' || lpad((i + 1)::varchar, 3, '0') tile_id, round({Q.sql_mod360('degrees(atan2(cy, cx))')}, 6) ra, round(degrees(asin(cz / sqrt(cx * cx + cy * cy + cz * cz))), 6) "dec", round(degrees(b), 6) gal_b from v""",
)
def q_fibonacci_tiles(spark, d):
    return tiling.fibonacci_tiles(spark, 448).select("tile_id", r6("ra_degrees", "ra"), r6("dec_degrees", "dec"), r6("gal_b_degrees", "gal_b"))


@R.add("q_histogram_merged", f"with {Q._HIST} select \"owner\", \"day\", n from h")
def q_histogram_merged(spark, d):
    """Histograms of the two hemispheres, merged."""
    p = Q._sky(spark, d).where("time_met is not null").distinct()
    parts = [tiling.owner_histogram(tiling.owners(p.where(w), table(spark, d, "tiles"), ["time_met"]), WINDOW_START, 8.64e6) for w in ("dec >= 0", "dec < 0")]
    return tiling.merge_histograms(*parts)


@R.add("q_car_pixel", f"with {Q.PH} select event_id, ((round_even((ra - 10) / 0.5e0 + 1 - 1, 0)::bigint % 720 + 720) % 720)::int ix, greatest(0, least(round_even((\"dec\" + 90) / 0.5e0, 0)::int, 360))::int iy from ph")
def q_car_pixel(spark, d):
    ix, iy = inject.car_pixel(F.col("ra"), F.col("dec"), (10.0, -90.0), (0.5, 0.5), (1.0, 1.0), (720, 361))
    return Q.view(spark, d).select("event_id", ix.alias("ix"), iy.alias("iy"))


@R.add("q_batch_summary", "select t.tile_id, count(distinct _candidate_id)::bigint candidate_count from tiles t left join tracks k on k.tile_id = t.tile_id group by 1")
def q_batch_summary(spark, d):
    found = table(spark, d, "tracks").select("tile_id", "_candidate_id").where("_candidate_id is not null").distinct()
    return sinks.batch_summary(found, table(spark, d, "tiles"))


@R.add(
    "q_threshold_summary",
    f"""with {Q._ZB}, f as (select zz.bin_index, zz.band, threshold from zz join zt using (bin_index, band, zone_lat, zone_bins, zone_lon))
select bin_index, band, min(threshold) least, trunc(quantile_cont(threshold, 0.5))::int median, max(threshold) most from f group by 1, 2""",
)
def q_threshold_summary(spark, d):
    return sinks.threshold_summary(S.core_flags(Q.grouped(spark, d), Q.CONFIG)).drop("tile_id")


@R.add(
    "q_moving",
    f"with {Q._MOTION} select id, round(velocity, 6) velocity from mm where anisotropy >= 0.7 and time_correlation >= 0.85 and consistency >= 0",
)
def q_moving(spark, d):
    """The motion filter as the search applies it."""
    p = Q.valid_points(spark, d).select(F.lit("t").alias("tile_id"), F.col("id").alias("track"), "t_mid", "ra", "dec")
    got = T.moving(p.select("tile_id", "track").distinct(), T.motion_metrics(p), Q.CONFIG)
    return got.select(F.col("track").alias("id"), r6("velocity", "velocity"))


@R.add("q_dedup_report", f"with recursive {Q._PAIRS}, xe as (select a, b from xm union select b, a from xm), rc(n, r) as (select id, id from (select distinct id from vp) union select xe.b, rc.r from rc join xe on xe.a = rc.n),\ng as (select n, min(r) c from rc group by 1), k as (select distinct campaign, id, c from vp join g on g.n = vp.id), z as (select campaign, c, count(*) m from k group by 1, 2)\nselect campaign, sum(m)::bigint n_tracks, count(*)::bigint n_groups, sum(m - 1)::bigint n_merged, max(m)::int largest from z group by 1")
def q_dedup_report(spark, d):
    from skydrift.plans.batch import deduplication_report

    return deduplication_report(Q.valid_points(spark, d), Q.CONFIG).drop("found")


# ---------------------------------------------------------------- detections of the tracks table, linked anew

_LABELS = [band_label(lo, hi) for lo, hi, _ in SEED_BANDS]


def detections(spark, d: str) -> DataFrame:
    """The points of all valid tracks as detections per campaign and tile, each once, numbered as the search does."""
    t = table(spark, d, "tracks")
    last = F.max(F.struct("loaded_at", "points", "tile_id", "search_root")).alias("r")
    v = t.groupBy("_candidate_id").agg(last)
    p = v.select(F.concat_ws("/", "r.search_root", "r.tile_id").alias("tile_id"), F.explode("r.points").alias("p")).where("p.ra is not null and p.dec is not null")
    sigma = F.coalesce(F.nanvl(F.col("p.sigma"), F.lit(0.0)), F.lit(0.0))
    band = F.array_position(F.array(*[F.lit(x) for x in _LABELS]), F.col("p.band")).cast("int") - 1
    one = p.select("tile_id", "p.bin_index", band.alias("band"), F.col("p.ra").alias("c_ra"), F.col("p.dec").alias("c_dec"), sigma.alias("sigma"), F.col("p.n_photons").alias("n_on"), "p.expected_bg", F.col("p.epsilon_degrees").alias("eps")).repartition("tile_id").distinct()
    label = F.row_number().over(W.partitionBy("tile_id", "bin_index", "band").orderBy("c_ra", "c_dec", "sigma", "n_on", "expected_bg"))
    # a tile's detections are a few thousand at most, so they are shuffled once, by tile, for all that follows
    per_band = F.create_map(F.element_at(F.array(*[F.lit(x) for x in _LABELS]), F.col("band") + 1), F.col("n_on"))
    return T.numbered(one.withColumn("label", label), Q.CONFIG).withColumn("photons_per_band", per_band)


_EDGES = bin_edges()
_DETECTED = f"""dv as (select * from tracks qualify row_number() over (partition by _candidate_id order by loaded_at desc, points desc) = 1),
dq as (select search_root || '/' || tile_id tile_id, unnest(points) p from dv),
d0 as (select distinct tile_id, p.bin_index bin_index, (list_position([{', '.join(f"'{x}'" for x in _LABELS)}], p.band) - 1)::int band, p.ra c_ra, p."dec" c_dec, case when p.sigma is null or isnan(p.sigma) then 0 else p.sigma end sigma, p.n_photons n_on, p.expected_bg expected_bg, p.epsilon_degrees eps
  from dq where p.ra is not null and p."dec" is not null),
d1 as (select *, row_number() over (partition by tile_id, bin_index, band order by c_ra, c_dec, sigma, n_on, expected_bg) lb from d0),
fd as materialized (select *, row_number() over (partition by tile_id order by bin_index, sigma desc, band, lb)::int cand, list_extract([{', '.join(lit((a + b) / 2) for a, b in zip(_EDGES, _EDGES[1:]))}], bin_index + 1) t_mid from d1)"""


@R.add(
    "q_same_bin_dedup",
    f"""with recursive {_DETECTED}, rk as materialized (select *, row_number() over (partition by tile_id, bin_index order by sigma desc, cand)::int p from fd),
ad as (select b.tile_id, b.bin_index, b.p, list(a.p order by a.p) nb from rk a join rk b on a.tile_id = b.tile_id and a.bin_index = b.bin_index and a.p < b.p and {Q.sql_sep('a.c_ra', 'a.c_dec', 'b.c_ra', 'b.c_dec')} <= greatest(a.eps, b.eps) group by 1, 2, 3),
st as materialized (select rk.tile_id, rk.bin_index, rk.p, coalesce(nb, []) nb from rk left join ad on ad.tile_id = rk.tile_id and ad.bin_index = rk.bin_index and ad.p = rk.p),
gr(tile_id, bin_index, k, kept) as (select distinct tile_id, bin_index, 0, []::int[] from st
  union all select gr.tile_id, gr.bin_index, k + 1, case when list_has_any(kept, nb) then kept else list_append(kept, k + 1) end from gr join st on st.tile_id = gr.tile_id and st.bin_index = gr.bin_index and st.p = k + 1),
ke as (select tile_id, bin_index, arg_max(kept, k) kept from gr group by 1, 2),
ow as (select st.tile_id, st.bin_index, st.p, case when list_contains(kept, st.p) then st.p else list_min(list_intersect(kept, nb)) end o from st join ke on ke.tile_id = st.tile_id and ke.bin_index = st.bin_index),
mg as (select ow.tile_id, ow.bin_index, o, count(*)::int merged_count, array_to_string(list_sort(list(distinct band)), '|') merged_bands from ow join rk on rk.tile_id = ow.tile_id and rk.bin_index = ow.bin_index and rk.p = ow.p group by 1, 2, 3)
select mg.tile_id, mg.bin_index, cand, merged_count, merged_bands from mg join rk on rk.tile_id = mg.tile_id and rk.bin_index = mg.bin_index and rk.p = o""",
)
def q_same_bin_dedup(spark, d):
    got = T.same_bin_dedup(detections(spark, d), Q.CONFIG)
    return got.select("tile_id", "bin_index", "cand", "merged_count", F.array_join(F.col("merged_bands").cast("array<string>"), "|").alias("merged_bands"))


def _sql_linked() -> str:
    """The beam linker, a CTE per bin."""
    out = [_DETECTED, f"""le as materialized (select a.tile_id, a.cand src, b.cand dst, (b.bin_index - a.bin_index)::int gap, b.bin_index bb, b.sigma sg, {Q.sql_sep('a.c_ra', 'a.c_dec', 'b.c_ra', 'b.c_dec')} sep, (b.t_mid - a.t_mid) / {Q.YEAR} yr
  from fd a join fd b on a.tile_id = b.tile_id and b.bin_index - a.bin_index between 1 and 2),
lf as materialized (select *, sep / yr * 1e0 + 0.5e0 * (gap - 1) penalty from le where yr > 0 and sep <= yr)"""]
    for b in range(len(_EDGES) - 1):
        own = f"select tile_id, cand, 0 skips, 5 rk, 1 len, sigma score, [cand] path from fd where bin_index = {b}"
        if b:
            past = " union all ".join(f"select * from l{k}" for k in range(max(0, b - 2), b))
            own += f""" union all select tile_id, cand, skips, rk, len, score, path from (select *, row_number() over (partition by tile_id, cand, skips order by len desc, score desc, gap, src, prk)::int rk from (
  select s.tile_id, e.dst cand, s.skips + e.gap - 1 skips, s.len + 1 len, s.score + e.sg - e.penalty score, list_append(s.path, e.dst) path, e.gap, e.src, s.rk prk from ({past}) s join lf e on e.tile_id = s.tile_id and e.src = s.cand and e.bb = {b} where s.skips + e.gap - 1 <= 2)) where rk <= 4"""
        out.append(f"l{b} as materialized ({own})")
    every = " union all ".join(f"select * from l{b}" for b in range(len(_EDGES) - 1))
    out.append(f"""lt as materialized (select tile_id, row_number() over (partition by tile_id order by len desc, score desc, cand, skips, rk)::int track, len, score, path from ({every}) where len >= 5)""")
    return ",\n".join(out)


_KEPT = """ls as materialized (select tile_id, track, len, unnest(path) cand from lt),
lp as (select a.tile_id, a.track a, b.track b, count(*) c from ls a join ls b on a.tile_id = b.tile_id and a.cand = b.cand and a.track < b.track group by a.tile_id, a.track, b.track, a.len, b.len having count(*) >= 0.8 * least(a.len, b.len)),
la as (select tile_id, b track, list(a) nb from lp group by 1, 2),
lz as materialized (select lt.tile_id, lt.track, coalesce(nb, []) nb from lt left join la on la.tile_id = lt.tile_id and la.track = lt.track),
lg(tile_id, k, kept) as (select distinct tile_id, 0, []::int[] from lz union all select lg.tile_id, k + 1, case when list_has_any(kept, nb) then kept else list_append(kept, k + 1) end from lg join lz on lz.tile_id = lg.tile_id and lz.track = k + 1),
lk as materialized (select tile_id, unnest(kept) track from (select tile_id, arg_max(kept, k) kept from lg group by 1))"""


def _linked(spark, d: str):
    keep = Durable(spark, "detections")
    c = keep.put(detections(spark, d))
    e = keep.put(T.link_edges(c, Q.CONFIG))
    linked = keep.put(T.link_tracks(c, e, Q.CONFIG))
    keep.drop(e)
    return c, linked


@R.add("q_link_tracks", f"with {_sql_linked()} select tile_id, track, len length, round(score, 6) score, array_to_string(path, '-') path from lt")
def q_link_tracks(spark, d):
    t = _linked(spark, d)[1]
    return t.select("tile_id", "track", "length", r6("score", "score"), F.array_join(F.col("path").cast("array<string>"), "-").alias("path"))


@R.add("q_track_neardup", f"with recursive {_sql_linked()}, {_KEPT} select tile_id, track from lk")
def q_track_neardup(spark, d):
    return T.drop_near_duplicates(_linked(spark, d)[1], Q.CONFIG).select("tile_id", "track")


@R.add(
    "q_track_records",
    f"""with recursive {_sql_linked()}, {_KEPT}, rp as (select lk.tile_id, lk.track, fd.* exclude (tile_id) from lk join ls on ls.tile_id = lk.tile_id and ls.track = lk.track join fd on fd.tile_id = ls.tile_id and fd.cand = ls.cand)
select tile_id, row_number() over (partition by tile_id order by track)::int candidate_number, count(*)::int track_length, round(arg_min(c_ra, bin_index), 6) ra_start, round(arg_max(c_ra, bin_index), 6) ra_end, sum(n_on)::int detection_band_photons,
  array_to_string(list_sort(list(distinct list_extract([{', '.join(f"'{x}'" for x in _LABELS)}], band + 1))), '|') detected_bands, array_to_string(list(bin_index order by bin_index), '-') bin_indices from rp group by tile_id, track""",
)
def q_track_records(spark, d):
    c, linked = _linked(spark, d)
    keep = Durable(spark, "kept")
    kept = keep.put(T.drop_near_duplicates(linked, Q.CONFIG))
    keep.drop(linked)
    r = T.track_records(kept, c, Q.CONFIG)
    text = lambda n, by: F.array_join(F.col(n).cast("array<string>"), by).alias(n)
    return r.select("tile_id", "candidate_number", "track_length", r6("ra_start", "ra_start"), r6("ra_end", "ra_end"), "detection_band_photons", text("detected_bands", "|"), text("bin_indices", "-"))


# ---------------------------------------------------------------- draws


@R.add("q_splitmix_pipeline", f"with k as (select event_id, ((user_id & 4294967295)::ubigint << 32) | (event_id & 4294967295)::ubigint key from events), {sql_mix('k', 'key', 'u', 'm')} select event_id, round(u, 12) u from m")
def q_splitmix_pipeline(spark, d):
    """The mixing as the campaigns of random times use it."""
    e = table(spark, d, "events").withColumn("_k", hashing.photon_key(F.col("user_id"), F.col("event_id")))
    m = hashing.with_splitmix(e, F.col("_k"), "_m")
    return m.select("event_id", F.round(hashing.to_uniform(F.col("_m")), 12).alias("u"))


_OWN3 = f"""sd as (select distinct run_id, event_id, time_met, ra, "dec" from sky where time_met is not null and run_id is not null and event_id is not null),
ow as (select p.run_id, p.event_id, p.time_met, arg_max(t.tile_id, {Q._DOT}) o from sd p, tiles t group by p.run_id, p.event_id, p.time_met, p.ra, p.dec),
hs as (select o, floor((time_met - {lit(WINDOW_START)}) / 86400e0)::int dy, count(*) n from ow group by 1, 2),
hp as (select * from hs where dy >= 0),
md as (select o, dy, sum(n) over w - n c0, sum(n) over w c1, sum(n) over (partition by o) tt, {lit(WINDOW_START)} + dy * 86400e0 t0, least({lit(WINDOW_START)} + dy * 86400e0 + 86400e0, {lit(WINDOW_STOP)}) t1
   from (select * from hp union all select '*all*', dy, sum(n) from hp group by dy) window w as (partition by o order by dy)),
kn as (select run_id, event_id, s::int campaign, case when o in (select o from md) then o else '*all*' end o, xor(((run_id & 4294967295)::ubigint << 32) | (event_id & 4294967295)::ubigint, case when s = 1 then {sql_seed(1)} else {sql_seed(2)} end) bk from ow, (values (1), (2)) v(s))"""


@R.add(
    "q_null_times",
    f"with {Q._SKY}, {_OWN3}, {sql_mix('kn', 'bk', 'u', 'mu')}, {sql_mix('mu', f'xor(bk, {hashing.FRACTION_KEY}::ubigint)', 'f', 'mf')}\nselect run_id, event_id, campaign, round(t0 + f * (t1 - t0), 2) null_time from mf join md on md.o = mf.o and u * tt >= c0 and u * tt < c1",
)
def q_null_times(spark, d):
    """Two campaigns of random times over all photons with usable coordinates, times and ids."""
    p = Q._sky(spark, d).where("time_met is not null and run_id is not null and event_id is not null").distinct()
    owned = tiling.owners(p, table(spark, d, "tiles"), ["run_id", "event_id", "time_met"])
    model = null.time_model(tiling.owner_histogram(owned, WINDOW_START, 86400.0).where("day >= 0"), WINDOW_START, 86400.0, WINDOW_STOP)
    got = null.scrambled_times(owned, model, [1, 2], ["run_id", "event_id"])
    return got.select("run_id", "event_id", "campaign", F.round("null_time", 2).alias("null_time"))


@R.add(
    "q_simple_scramble",
    f"""with {Q.PH} select tile_id, count(*) n, round(sum(time_met) / 1e6, 3) total, round(sum(time_met * time_met) / 1e15, 3) squares, round(min(time_met), 3) first, round(max(time_met), 3) last, true moved, true other_seed_differs from (select 'tile_0' tile_id, time_met from ph) group by 1""",
)
def q_simple_scramble(spark, d):
    """Times dealt out anew: the same multiset per tile, in another order, another one per seed."""
    p = Q.view(spark, d).select("tile_id", "event_id", "time_met")
    a = null.permuted_times(p, 5)
    b = null.permuted_times(p, 6).select("tile_id", "event_id", F.col("null_time").alias("other"))
    t = F.col("null_time")
    share = lambda c: F.avg(c.cast("double")) > 0.9
    return a.join(b, ["tile_id", "event_id"]).groupBy("tile_id").agg(
        F.count(t).alias("n"), F.round(F.sum(t) / 1e6, 3).alias("total"), F.round(F.sum(t * t) / 1e15, 3).alias("squares"), F.round(F.min(t), 3).alias("first"), F.round(F.max(t), 3).alias("last"),
        share(t != F.col("time_met")).alias("moved"), share(t != F.col("other")).alias("other_seed_differs"),
    )


_PICK = f"{Q.PH}, pk as (select bin_index, event_id, xor(event_id::ubigint, {sql_seed(7)}) hk from ph where band is not null), {sql_mix('pk', 'hk', 'h', 'hm')}, tp as (select bin_index, event_id, row_number() over (partition by bin_index order by case when h_mix >= 9223372036854775808::ubigint then h_mix::hugeint - {_TWO64} else h_mix::hugeint end, event_id) k, count(*) over (partition by bin_index) n from hm)"


@R.add("q_inject_pick", f"with {_PICK} select bin_index, event_id, unnest(range(0, ceil((35 - k + 1) / least(n, 35))::bigint))::int copy from tp where k <= 35")
def q_inject_pick(spark, d):
    return inject.template_rows(P.binned(Q.view(spark, d)), 35, 7).select("bin_index", "event_id", "copy")


@R.add(
    "q_injected_counts",
    f"""with {Q.PH}, tr as (select i::int bin_index, 180e0 + 0.5e0 * (i + 0.5e0 - 5) t_ra, 0e0 t_dec from range(10) g(i)), fb as (select distinct bin_index from ph where band is not null)
select tile_id cap_tile, count(*) * 35 n from tiles, tr join fb using (bin_index) where {Q.sql_sep('t_ra', 't_dec', 'ra_degrees', 'dec_degrees')} <= 18 group by 1""",
)
def q_injected_counts(spark, d):
    """Injected rows per tile that holds the source."""
    truth = inject.track_truth(spark, 180.0, 0.0, 0.5, 90.0)
    got = inject.injected_tiles(P.binned(Q.view(spark, d)), table(spark, d, "tiles"), truth, 35, 7)
    return got.groupBy("cap_tile").agg(F.count(F.lit(1)).alias("n"))


_COVER = f"""sp as (select i::bigint id, xor(i::ubigint, {sql_seed(20260727 * 2)}) ka, xor(i::ubigint, {sql_seed(20260727 * 2 + 1)}) kb from range(1000000) t(i)), {sql_mix('sp', 'ka', 'u', 'su')}, {sql_mix('su', 'kb', 'v', 'sv')},
p as (select id, u * 360 ra, degrees(asin(2 * v - 1)) "dec" from sv), mu as (select p.id, count(*) m from p join tiles t on {Q._DOT} >= cos(radians(7.5e0)) group by 1), n as (select count(*) c, sum(m) s, max(m) x from mu)"""


@R.add("q_coverage_mc", f"with {_COVER} select 1000000::bigint samples, c::bigint covered, round(c / 1000000e0, 9) fraction, round(sqrt(c / 1000000e0 * (1 - c / 1000000e0) / 1000000e0), 9) standard_error, round(s / c::double, 6) mean_multiplicity, x::bigint max_multiplicity from n")
def q_coverage_mc(spark, d):
    """Coverage of the sky by caps of 7.5 degrees, from a million keyed directions."""
    s = tiling.coverage_summary(tiling.union_coverage(spark, table(spark, d, "tiles"), 7.5, 1_000_000, 20260727))
    return s.select("samples", "covered", F.round("fraction", 9).alias("fraction"), F.round("standard_error", 9).alias("standard_error"), r6("mean_multiplicity", "mean_multiplicity"), "max_multiplicity")


# ---------------------------------------------------------------- audit, inference, release


@R.add(
    "q_audit_apertures",
    f"""with {Q._ZB}, ne as (select p.bin_index, p.band, p.event_id, count(*)::int n_eps from pb p join pb q on p.bin_index = q.bin_index and p.band = q.band
  and abs(p.dec - q.dec) < 0.6 and {Q.sql_sep('p.ra', 'p.dec', 'q.ra', 'q.dec')} <= {Q.sql_pick(Q.EPS, 'p.band')} group by 1, 2, 3),
cf as (select zz.bin_index, zz.band, zz.event_id, zz.ra, zz.dec, n_eps, threshold, n_eps >= threshold is_core
  from zz join zt using (bin_index, band, zone_lat, zone_bins, zone_lon) join ne on ne.bin_index = zz.bin_index and ne.band = zz.band and ne.event_id = zz.event_id),
tr as (select i::int bin_index, {Q.sql_mod360('178e0 + 0.5e0 * (i + 0.5e0 - 5) * sin(radians(40e0)) / cos(radians(-2e0 + 0.5e0 * (i + 0.5e0 - 5) * cos(radians(40e0))))')} t_ra, -2e0 + 0.5e0 * (i + 0.5e0 - 5) * cos(radians(40e0)) t_dec from range(10) g(i)),
m as (select cf.*, {Q.sql_sep('cf.ra', 'cf.dec', 't_ra', 't_dec')} <= {Q.sql_pick(Q.EPS)} hit from cf join tr using (bin_index))
select bin_index, band, count(*)::int photons, count(*) filter (hit)::int near_photons, min(threshold) filter (hit) least_threshold, max(n_eps) filter (hit) most_neighbours, count(*) filter (hit and is_core)::int near_cores from m group by 1, 2""",
)
def q_audit_apertures(spark, d):
    return Q.q_audit_apertures(spark, d)


@R.add("q_inference_table", f"with {Q._COUNTS}, a as (select count(*) n, avg(n_tracks) m, coalesce(stddev_samp(n_tracks), 0) s from cc) select round(case when s > 0 then (400 - m) / s end, 6) deviation, round(case when m > 0 then s * s / m end, 6) dispersion from a")
def q_inference_table(spark, d):
    a = inference.plus_one(Q.campaign_counts(spark, d), 400)
    return a.select(r6("deviation", "deviation"), r6("dispersion", "dispersion"))


@R.add("q_survey_efficiency", f"with {Q.PH}, b as (select bin_index, count(*) tiles, avg(case when zenith < 60 then 1e0 else 0e0 end) efficiency from ph group by 1) select round(sum(tiles * efficiency) / sum(tiles), 9) efficiency from b")
def q_survey_efficiency(spark, d):
    b = Q.view(spark, d).groupBy(P.time_bin(F.col("time_met")).alias("bin_index")).agg(F.count(F.lit(1)).alias("tiles"), F.avg((F.col("zenith") < 60).cast("double")).alias("efficiency"))
    return inference.survey_efficiency(b).select(F.round("efficiency", 9).alias("efficiency"))


def _limit_counts(spark) -> tuple[list[int], int]:
    return [3, 5, 2, 8, 4, 6, 3, 5, 7, 4, 2, 6, 5, 3, 4, 9, 1, 5, 6, 4], 7


_LIMIT_B = "(values (3), (5), (2), (8), (4), (6), (3), (5), (7), (4), (2), (6), (5), (3), (4), (9), (1), (5), (6), (4)) v(b)"


@R.add(
    "q_upper_limit",
    f"""with recursive b as (select b from {_LIMIT_B}), n as (select count(*) c from b),
tail(k, lo, hi) as (select 0, 0e0, 64e0 union all
  select k + 1, case when t > 0.1e0 then (lo + hi) / 2 else lo end, case when t > 0.1e0 then hi else (lo + hi) / 2 end
  from (select k, lo, hi, (1 + (select sum(coalesce((select sum(exp(i * ln((lo + hi) / 2) - (lo + hi) / 2 - lgamma(i + 1))) from range(0, 8) r(i) where i <= 7 - b.b), 0)) from b)) / ((select c from n) + 1) t from tail where k < 60))
select round((lo + hi) / 2, 6) upper_limit from tail where k = 60""",
)
def q_upper_limit(spark, d):
    """The limit at 0.90 of 7 seen over twenty null counts (stated numbers)."""
    counts, seen = _limit_counts(spark)
    return spark.createDataFrame([(round(inference.upper_limit(counts, seen), 6),)], "upper_limit double")


@R.add("q_paired_binomial", "select n::int n, k::int k, round(least(1e0, 2 * (select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2e0))) from range(0, 30) r(i) where i <= least(k, n - k))), 9) p from (values (10, 2), (10, 5), (25, 20), (12, 0)) v(n, k)")
def q_paired_binomial(spark, d):
    return spark.createDataFrame([(n, k, round(inference.paired_binomial(k, n), 9)) for n, k in ((10, 2), (10, 5), (25, 20), (12, 0))], "n int, k int, p double")


@R.add("q_empirical_cdf", f"with {Q.PH} select distinct bin_index, zenith, round(cume_dist() over (partition by bin_index order by zenith), 9) share from ph")
def q_empirical_cdf(spark, d):
    p = Q.view(spark, d).withColumn("bin_index", P.time_bin(F.col("time_met")))
    return inference.empirical_cdf(p, "zenith", ["bin_index"]).select("bin_index", "zenith", F.round("share", 9).alias("share"))


@R.add("q_ks_distance", f"with {Q.PH}, s as (select distinct bin_index, zenith, cume_dist() over (partition by bin_index order by zenith) c from ph), b as (select *, coalesce(lag(c) over (partition by bin_index order by zenith), 0) b from s) select bin_index, round(max(greatest(abs(c - zenith / 120), abs(b - zenith / 120))), 9) distance from b group by 1")
def q_ks_distance(spark, d):
    p = Q.view(spark, d).withColumn("bin_index", P.time_bin(F.col("time_met")))
    c = inference.empirical_cdf(p, "zenith", ["bin_index"])
    return inference.ks_distance(c, F.col("zenith") / 120, "zenith", ["bin_index"]).select("bin_index", F.round("distance", 9).alias("distance"))


@R.add("q_volume_change", f"with {Q.PH}, v as (select bin_index, sum(energy) e, count(*) filter (zenith < 30) n from ph group by 1) select bin_index, round(case when n <> 0 then e / n - 1 end, 6) change from v")
def q_volume_change(spark, d):
    p = Q.view(spark, d).groupBy(P.time_bin(F.col("time_met")).alias("bin_index"))
    a, b = p.agg(F.sum("energy").alias("volume")), p.agg(F.count_if(F.col("zenith") < 30).alias("volume"))
    return inference.volume_change(a, b, ["bin_index"]).select("bin_index", r6("change", "change"))


@R.add("q_release_differences", "select bin_index velocity, band photons_per_bin, case when band = 4 then 'no response' else 'source limit' end problem from (select distinct bin_index, band from (select greatest(0, least(floor((time_met - 479174404e0) / 31536000e0), 9))::int bin_index, (case when energy < 2154.4e0 then 0 when energy < 10000 then 1 when energy < 21544.3e0 then 2 when energy < 46415.9e0 then 3 else 4 end)::int band from photons where energy >= 1000 and energy < 100000 and not isnan(energy) and time_met is not null and not isnan(time_met))) where band = 4 or bin_index = 3")
def q_release_differences(spark, d):
    """Published limits against the response: those of one velocity are put off, those of the last band have no response."""
    p = P.binned(table(spark, d, "photons").where("time_met is not null and not isnan(time_met)")).groupBy(F.col("bin_index").alias("velocity"), F.col("band").alias("photons_per_bin"))
    nodes = p.agg((F.count(F.lit(1)) / 1e6).alias("efficiency"))
    off = F.when(F.col("velocity") == 3, 1.001).otherwise(1.0)
    limits = nodes.withColumn("source_limit", F.lit(80.75719) / F.col("efficiency") * off)
    return inference.release_differences(limits, nodes.where("photons_per_bin < 4"), 80.75719)


@R.add(
    "q_band_probabilities",
    "with c as (select * from (" + Q._sql_folded(32769).replace("round(e, 6) energy", "e energy").replace("round(c / max(c) over (), 9) cdf", "c / max(c) over () cdf") + ")), " + f"""g as (select energy e0, cdf c0, lead(energy) over (order by k) e1, lead(cdf) over (order by k) c1 from c),
pt as (select x, c0 + (x - e0) / (e1 - e0) * (c1 - c0) p from (values (2154.4e0), (10000e0), (21544.3e0), (46415.9e0)) v(x) join g on x >= e0 and x < e1 union all select 1e3, 0e0 union all select 1e5, 1e0)
select low, high, round(b.p - a.p, 9) probability from (values (1e3, 2154.4e0), (2154.4e0, 1e4), (1e4, 21544.3e0), (21544.3e0, 46415.9e0), (46415.9e0, 1e5)) w(low, high) join pt a on a.x = low join pt b on b.x = high""",
)
def q_band_probabilities(spark, d):
    """Shares of a folded spectrum per seed band, on the production grid (made-up exposure layers)."""
    cdf = inject.folded_cdf(spark, Q._LAYERS)
    bands = [(lo, hi) for lo, hi, _ in Q.CONFIG.bands]
    return inject.band_probabilities(cdf, bands).select("low", "high", F.round("probability", 9).alias("probability"))


@R.add("q_bin_times", "select * from (values " + ", ".join(f"({k}, {lit(a)}, {lit(b)}, {lit((a + b) / 2)})" for k, (a, b) in enumerate(zip(bin_edges(), bin_edges()[1:]))) + ') v(bin_index, "start", "stop", middle)')
def q_bin_times(spark, d):
    n = spark.range(len(bin_edges()) - 1).select(F.col("id").cast("int").alias("bin_index"))
    a, b, m = T.bin_times(F.col("bin_index"), 365.0)
    return n.select("bin_index", a.alias("start"), b.alias("stop"), m.alias("middle"))


@R.add("q_selected_tiles", "select tile_id from tiles where tile_id in ('roi_001', 'roi_100', 'roi_448')")
def q_selected_tiles(spark, d):
    return sinks.select_tiles(table(spark, d, "tiles"), ["roi_001", "roi_100", "roi_448"]).select("tile_id")
