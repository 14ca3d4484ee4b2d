"""Queries over the search's operators, with the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from skydrift.config import SEED_BANDS, WINDOW_START, WINDOW_STOP, SearchConfig, psf_radius
from skydrift.functions import hashing, sphere, statistics
from skydrift.functions.bits import any_bit
from skydrift.operators import background as B
from skydrift.operators import inference, inject, null, photons as P, seeding as S, tiling, tracks as T
from skydrift.plans.registry import Registry
from skydrift.runtime import Durable, table

R = Registry()
CONFIG = SearchConfig()
REGION = (180.0, 0.0, 18.0)
EPS = [CONFIG.eps(ref) for _, _, ref in SEED_BANDS]


# ---------------------------------------------------------------- pieces of SQL


def lit(x: float) -> str:
    """A double literal (an exponent keeps it from being a decimal)."""
    s = repr(float(x))
    return s if "e" in s or "E" in s else s + "e0"


def sql_sep(a: str, b: str, c: str, d: str) -> str:
    return (
        f"degrees(2 * asin(least(1e0, sqrt(sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2) "
        f"+ cos(radians({b})) * cos(radians({d})) * sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2)))))"
    )


def sql_unit(a: str, d: str) -> tuple[str, str, str]:
    return f"cos(radians({d})) * cos(radians({a}))", f"cos(radians({d})) * sin(radians({a}))", f"sin(radians({d}))"


def sql_mod360(x: str) -> str:
    return f"({x} - 360 * floor(({x}) / 360))"


def sql_mean(a: str, d: str) -> tuple[str, str]:
    x, y, z = (f"avg({c})" for c in sql_unit(a, d))
    return sql_mod360(f"degrees(atan2({y}, {x}))"), f"degrees(asin({z} / sqrt({x} * {x} + {y} * {y} + {z} * {z})))"


def sql_band(e: str) -> str:
    return "case " + " ".join(f"when {e} >= {lit(lo)} and {e} < {lit(hi)} then {k}" for k, (lo, hi, _) in enumerate(SEED_BANDS)) + " end"


def sql_pick(values: list[float], k: str = "band") -> str:
    return f"case {k} " + " ".join(f"when {i} then {lit(v)}" for i, v in enumerate(values)) + " end"


YEAR = lit(31536000)
PH = f"""
ph_a as (select event_id, user_id, value, 1e0 * (epoch_us(ts) - 1704067200000000) / 1e6 s, user_id % 50 k from events),
ph_b as (
  select event_id, user_id run_id, {lit(WINDOW_START)} + s * (3.15532801e8 / 2.592e6) time_met, 1e3 * (1 + value / 2.5e1) energy,
         case when k < 3 then 1 else 0 end is_source, k,
         case when k < 3 then 1.78e2 + 2 * k else 1.72e2 + 16 * ((0.7548776662466927e0 * event_id) % 1e0) end ra0,
         case when k < 3 then -2e0 + 2 * k else -8e0 + 16 * ((0.5698402909980532e0 * event_id) % 1e0) end dec0,
         0.15e0 * sqrt((0.6180339887498949e0 * event_id) % 1e0) r, 6.283185307179586e0 * ((0.7548776662466927e0 * event_id) % 1e0) theta
  from ph_a),
ph_c as (select *, 0.5e0 * ((time_met - {lit(WINDOW_START)}) / {YEAR} - 5) run from ph_b),
ph as (
  select event_id, run_id, time_met, energy, is_source, k,
         ra0 + is_source * (run * sin(radians(40e0)) + r * sin(theta)) / cos(radians(dec0)) ra,
         dec0 + is_source * (run * cos(radians(40e0)) + r * cos(theta)) "dec",
         ((event_id * 37) % 120)::double zenith, event_id % 256 event_class,
         greatest(0, least(floor((time_met - {lit(WINDOW_START)}) / {YEAR}), 9))::int bin_index, ({sql_band('energy')})::int band
  from ph_c)"""
#: Photons of the bins and bands with at least ten of them.
PB = PH + """,
pb as (select * from ph where band is not null qualify count(*) over (partition by bin_index, band) >= 10)"""
PAIRS = PB + f""",
pairs as (
  select p.bin_index, p.band, p.event_id a, q.event_id b, {sql_sep('p.ra', 'p.dec', 'q.ra', 'q.dec')} sep
  from pb p join pb q on p.bin_index = q.bin_index and p.band = q.band and abs(p.dec - q.dec) < 0.6)"""


def view(spark, d: str) -> DataFrame:
    return P.fixture_photons(table(spark, d, "events"))


def grouped(spark, d: str) -> DataFrame:
    return P.crowded(P.binned(view(spark, d)), S.GROUP, CONFIG.least_photons)


def r6(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


# ---------------------------------------------------------------- scalar expressions


@R.add("q_angular_separation", f"with {PH} select event_id, round({sql_sep('ra', '\"dec\"', '180e0', '0e0')}, 6) sep from ph")
def q_angular_separation(spark, d):
    return view(spark, d).select("event_id", r6(sphere.separation(F.col("ra"), F.col("dec"), F.lit(180.0), F.lit(0.0)), "sep"))


@R.add("q_unit_vectors", f"with {PH} select event_id, round({sql_unit('ra', '\"dec\"')[0]}, 6) x, round({sql_unit('ra', '\"dec\"')[1]}, 6) y, round({sql_unit('ra', '\"dec\"')[2]}, 6) z from ph")
def q_unit_vectors(spark, d):
    x, y, z = sphere.unit(F.col("ra"), F.col("dec"))
    return view(spark, d).select("event_id", r6(x, "x"), r6(y, "y"), r6(z, "z"))


@R.add("q_psf_radius", f"with {PH} select event_id, round(greatest(0.8e0 * pow(energy / 1e3, -0.8e0), 0.1e0), 6) radius from ph")
def q_psf_radius(spark, d):
    return view(spark, d).select("event_id", r6(statistics.psf_radius(F.col("energy")), "radius"))


@R.add(
    "q_lima",
    f"""with {PH}, n as (select bin_index, band, count(*) filter (is_source = 1) n_on, count(*) filter (is_source = 0) n_off from ph where band is not null group by 1, 2)
select bin_index, band, n_on, n_off, round(case when n_on <= 0.05e0 * n_off then 0e0 when n_off = 0 then sqrt(2 * n_on * ln(1.05e0 / 0.05e0))
  else sqrt(greatest(0e0, 2 * (n_on * ln((1.05e0 / 0.05e0) * (n_on / (1e0 * n_on + n_off))) + n_off * ln(1.05e0 * (n_off / (1e0 * n_on + n_off)))))) end, 6) sigma from n""",
)
def q_lima(spark, d):
    n = P.binned(view(spark, d)).groupBy("bin_index", "band").agg(F.count_if(F.col("is_source") == 1).alias("n_on"), F.count_if(F.col("is_source") == 0).alias("n_off"))
    return n.select("bin_index", "band", "n_on", "n_off", r6(statistics.li_ma(F.col("n_on"), F.col("n_off"), F.lit(0.05)), "sigma"))


@R.add(
    "q_ring_area",
    f"""with {PH} select event_id, round(2 * pi() * (cos(radians(i)) - cos(radians(o))) * (180 / pi()) * (180 / pi()), 6) area, round(2 * pi() * (1 - cos(radians(o))), 9) disc
from (select event_id, zenith / 60 i, zenith / 60 + 1 + event_class / 64e0 o from ph)""",
)
def q_ring_area(spark, d):
    p = view(spark, d).select("event_id", (F.col("zenith") / 60).alias("i"), (F.col("zenith") / 60 + 1 + F.col("event_class") / 64.0).alias("o"))
    return p.select("event_id", r6(sphere.ring_area_deg2(F.col("i"), F.col("o")), "area"), F.round(sphere.disc_steradians(F.radians("o")), 9).alias("disc"))


@R.add(
    "q_circle_overlap",
    f"""with {PH}, c as (select event_id, 2e0 r1, 0.5e0 + event_class / 128e0 r2, zenith / 24 d from ph)
select event_id, round(case when d >= r1 + r2 then 0e0 when d <= abs(r1 - r2) then pi() * least(r1, r2) * least(r1, r2) else
  r1 * r1 * acos(greatest(-1, least(1, (d * d + r1 * r1 - r2 * r2) / (2 * d * r1)))) + r2 * r2 * acos(greatest(-1, least(1, (d * d + r2 * r2 - r1 * r1) / (2 * d * r2))))
  - 0.5 * sqrt(greatest(0e0, (-d + r1 + r2) * (d + r1 - r2) * (d - r1 + r2) * (d + r1 + r2))) end, 6) area from c""",
)
def q_circle_overlap(spark, d):
    p = view(spark, d).select("event_id", F.lit(2.0).alias("r1"), (0.5 + F.col("event_class") / 128.0).alias("r2"), (F.col("zenith") / 24).alias("d"))
    # the distance is kept off zero where the lens formula, which isn't used there, would divide by it
    return p.select("event_id", r6(sphere.lens_area(F.col("r1"), F.col("r2"), F.greatest("d", F.lit(1e-12))), "area"))


@R.add("q_tangent_offsets", f"with {PH} select event_id, round(({sql_mod360('ra - 179.5e0 + 180')} - 180) * cos(radians(1.5e0)), 6) x, round(\"dec\" - 1.5e0, 6) y from ph")
def q_tangent_offsets(spark, d):
    x, y = sphere.tangent_offsets(F.col("ra"), F.col("dec"), F.lit(179.5), F.lit(1.5))
    return view(spark, d).select("event_id", r6(x, "x"), r6(y, "y"))


@R.add("q_circular_mean", f"with {PH} select bin_index, round({sql_mod360('degrees(atan2(sum(energy * sin(radians(ra))) / sum(energy), sum(energy * cos(radians(ra))) / sum(energy)))')}, 6) mean_ra from ph group by 1")
def q_circular_mean(spark, d):
    p = view(spark, d).withColumn("bin_index", P.time_bin(F.col("time_met")))
    return p.groupBy("bin_index").agg(r6(sphere.circular_mean(F.col("ra"), F.col("energy")), "mean_ra"))


@R.add(
    "q_sphere_offset",
    f"""with {PH}, p as (select event_id, radians(ra) a, radians("dec") d, radians(zenith / 12) s, event_class / 40e0 w from ph),
q as (select *, asin(greatest(-1, least(1, sin(d) * cos(s) + cos(d) * sin(s) * cos(w)))) d2 from p)
select event_id, round({sql_mod360('degrees(a + atan2(sin(w) * sin(s) * cos(d), cos(s) - sin(d) * sin(d2)))')}, 6) ra, round(degrees(d2), 6) "dec" from q""",
)
def q_sphere_offset(spark, d):
    a, b = sphere.destination(F.col("ra"), F.col("dec"), F.col("zenith") / 12, F.col("event_class") / 40.0)
    return view(spark, d).select("event_id", r6(a, "ra"), r6(b, "dec"))


@R.add(
    "q_track_position",
    f"""with {PH}, p as (select event_id, 0.5e0 * (t - 5) run from (select event_id, (time_met - {lit(WINDOW_START)}) / {YEAR} t from ph)),
q as (select event_id, 1e0 + run * sin(radians(40e0)) x, 60e0 - 0.5e0 + run * cos(radians(40e0)) d from p)
select event_id, round({sql_mod360('359.5e0 + x / cos(radians(d))')}, 6) ra, round(d, 6) "dec" from q""",
)
def q_track_position(spark, d):
    p = view(spark, d).withColumn("t", (F.col("time_met") - WINDOW_START) / 31536000.0)
    a, b = sphere.moved(F.lit(359.5), F.lit(60.0), F.lit(0.5), F.lit(40.0), F.col("t"), 10, 1.0, -0.5)
    return p.select("event_id", r6(a, "ra"), r6(b, "dec"))


@R.add(
    "q_splitmix64",
    """with recursive k as (select event_id, user_id, ((user_id & 4294967295)::hugeint * 4294967296 + (event_id & 4294967295)::hugeint) base from events),
a as (select event_id, ((base + 11400714819323198485::hugeint) % 18446744073709551616::hugeint)::ubigint v from k),
b as (select event_id, ((xor(v, v >> 30)::hugeint & 4294967295::hugeint) * 13787848793156543929::hugeint % 18446744073709551616::hugeint
   + (((xor(v, v >> 30) >> 32)::hugeint * (13787848793156543929::hugeint & 4294967295::hugeint)) % 4294967296::hugeint) * 4294967296::hugeint) % 18446744073709551616::hugeint v from a),
c as (select event_id, v::ubigint v from b),
e as (select event_id, ((xor(v, v >> 27)::hugeint & 4294967295::hugeint) * 10723151780598845931::hugeint % 18446744073709551616::hugeint
   + (((xor(v, v >> 27) >> 32)::hugeint * (10723151780598845931::hugeint & 4294967295::hugeint)) % 4294967296::hugeint) * 4294967296::hugeint) % 18446744073709551616::hugeint v from c),
f as (select event_id, v::ubigint v from e)
select event_id, (xor(v, v >> 31) >> 11)::bigint bits from f""",
)
def q_splitmix64(spark, d):
    e = table(spark, d, "events")
    h = hashing.splitmix64(hashing.photon_key(F.col("user_id"), F.col("event_id")))
    return e.select("event_id", F.shiftrightunsigned(h, 11).alias("bits"))


@R.add("q_power_law", f"with {PH} select event_id, round(pow(1e-3 + u * (1e-5 - 1e-3), -1e0), 6) energy from (select event_id, event_class / 256e0 u from ph)")
def q_power_law(spark, d):
    return view(spark, d).select("event_id", r6(inject.power_law_energy(F.col("event_class") / 256.0, 2.0), "energy"))


# ---------------------------------------------------------------- cuts and groups

_CUT = f"zenith < 90 and (event_class & 128) > 0 and time_met > {lit(WINDOW_START)} and time_met < {lit(WINDOW_STOP)}"


@R.add("q_quality_filter", f"with {PH} select event_id from ph where {_CUT} and {sql_sep('ra', '\"dec\"', '180e0', '0e0')} <= 6")
def q_quality_filter(spark, d):
    return P.in_cap(P.quality_cut(view(spark, d)), 180.0, 0.0, 6.0).select("event_id")


@R.add("q_bitmask_any", f"with {PH} select event_id, (event_class & 20) > 0 passes from ph")
def q_bitmask_any(spark, d):
    return view(spark, d).select("event_id", any_bit(F.col("event_class"), 20).alias("passes"))


@R.add("q_preparation_cut", f"with {PH} select event_id from ph where {_CUT} and time_met >= 5e8 and time_met < 6e8 and energy >= 1e3 and energy < 1e5")
def q_preparation_cut(spark, d):
    return P.preparation_cut(view(spark, d), 5e8, 6e8).select("event_id")


@R.add("q_time_bins", f"with {PH} select bin_index, count(*) n from ph group by 1")
def q_time_bins(spark, d):
    return view(spark, d).groupBy(P.time_bin(F.col("time_met")).alias("bin_index")).agg(F.count(F.lit(1)).alias("n"))


@R.add("q_energy_bands", f"with {PH} select event_id, band from ph")
def q_energy_bands(spark, d):
    return view(spark, d).select("event_id", P.band_index(F.col("energy")).alias("band"))


@R.add("q_band_counts", f"with {PB} select bin_index, band, count(*) n from pb group by 1, 2")
def q_band_counts(spark, d):
    return grouped(spark, d).groupBy("bin_index", "band").agg(F.count(F.lit(1)).alias("n"))


def _intervals(spark) -> DataFrame:
    """Overlapping and gappy validity intervals of five files."""
    base = spark.range(5 * 100).select((F.col("id") % 5).cast("string").alias("file_id"), F.floor(F.col("id") / 5).alias("n"))
    start = F.lit(WINDOW_START) + F.col("n") * 3.2e6
    return base.select("file_id", start.alias("start"), (start + 1e6 + (F.col("n") % 7) * 8e5).alias("stop"))


_GTI = f"gti as (select (i % 5)::varchar file_id, {lit(WINDOW_START)} + (i // 5) * 3.2e6 \"start\", {lit(WINDOW_START)} + (i // 5) * 3.2e6 + 1e6 + ((i // 5) % 7) * 8e5 \"stop\" from range(500) t(i))"


@R.add(
    "q_gti_asof",
    f"""with {PH}, {_GTI}, f as (select event_id, (event_id % 5)::varchar file_id, time_met from ph)
select event_id from f asof join gti on f.file_id = gti.file_id and f.time_met >= gti."start" where time_met <= gti."stop" """,
)
def q_gti_asof(spark, d):
    p = view(spark, d).withColumn("file_id", (F.col("event_id") % 5).cast("string"))
    return P.in_good_time(p, _intervals(spark)).select("event_id")


@R.add("q_gti_clip", f"""with {_GTI} select file_id, greatest("start", 5e8) "start", least("stop", 5.6e8) "stop" from gti where "stop" >= 5e8 and "start" < 5.6e8""")
def q_gti_clip(spark, d):
    return P.clip_intervals(_intervals(spark), 5e8, 5.6e8)


# ---------------------------------------------------------------- tiles

_SKY = """sky as (select run_id, event_id, time_met, ra - 360 * floor(ra / 360) ra, "dec" from photons
  where ra is not null and not isnan(ra) and "dec" is not null and not isnan("dec") and abs("dec") <= 90)"""
_DOT = "(cos(radians(p.dec)) * cos(radians(p.ra)) * cos(radians(t.dec_degrees)) * cos(radians(t.ra_degrees)) + cos(radians(p.dec)) * sin(radians(p.ra)) * cos(radians(t.dec_degrees)) * sin(radians(t.ra_degrees)) + sin(radians(p.dec)) * sin(radians(t.dec_degrees)))"
_OWN = f"own as (select p.run_id, p.event_id, p.time_met, p.ra, p.dec, arg_max(t.tile_id, {_DOT}) \"owner\" from sky p, tiles t group by all)"


def _sky(spark, d: str) -> DataFrame:
    from skydrift.operators.nearby import usable_points

    return usable_points(table(spark, d, "photons")).select("run_id", "event_id", "time_met", "ra", "dec")


@R.add("q_tile_caps", f"with {_SKY} select t.tile_id cap_tile, count(*) n from sky p join tiles t on {_DOT} >= cos(radians(7.5e0)) group by 1")
def q_tile_caps(spark, d):
    return tiling.cap_members(_sky(spark, d), table(spark, d, "tiles"), 7.5).groupBy("cap_tile").agg(F.count(F.lit(1)).alias("n"))


@R.add("q_nearest_owner", f"with {_SKY}, {_OWN} select distinct run_id, event_id, ra, \"dec\", \"owner\" from own")
def q_nearest_owner(spark, d):
    p = _sky(spark, d)
    keep = p.withColumn("r", F.col("ra")).withColumn("e", F.col("dec"))
    got = tiling.owners(keep, table(spark, d, "tiles"), ["run_id", "event_id", "r", "e"])
    return got.select("run_id", "event_id", F.col("r").alias("ra"), F.col("e").alias("dec"), "owner").distinct()


_HIST = f"{_SKY}, sd as (select distinct * from sky), own as (select p.run_id, p.event_id, p.time_met, arg_max(t.tile_id, {_DOT}) \"owner\" from sd p, tiles t group by p.run_id, p.event_id, p.time_met, p.ra, p.dec), h as (select \"owner\", floor((time_met - {lit(WINDOW_START)}) / 8.64e6)::int \"day\", count(*) n from own where time_met is not null group by 1, 2)"


def _histogram(spark, d: str) -> DataFrame:
    p = _sky(spark, d).where("time_met is not null").distinct()
    return tiling.owner_histogram(tiling.owners(p, table(spark, d, "tiles"), ["time_met"]), WINDOW_START, 8.64e6)


@R.add("q_owner_histogram", f"with {_HIST} select \"owner\", \"day\", n from h")
def q_owner_histogram(spark, d):
    return _histogram(spark, d)


@R.add("q_hist_cumulative", f"with {_HIST} select \"owner\", \"day\", n, sum(n) over (partition by \"owner\" order by \"day\")::bigint cum from h")
def q_hist_cumulative(spark, d):
    w = W.partitionBy("owner").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return _histogram(spark, d).select("owner", "day", "n", F.sum("n").over(w).alias("cum"))


@R.add("q_spherical_mean", f"with {PH} select bin_index, round({sql_mean('ra', '\"dec\"')[0]}, 6) ra, round({sql_mean('ra', '\"dec\"')[1]}, 6) \"dec\" from ph group by 1")
def q_spherical_mean(spark, d):
    a, b = sphere.mean_direction(F.col("ra"), F.col("dec"))
    return view(spark, d).groupBy(P.time_bin(F.col("time_met")).alias("bin_index")).agg(r6(a, "ra"), r6(b, "dec"))


# ---------------------------------------------------------------- seeding

_ZONES = PB + f""",
z0 as (select *, radians({sql_pick(EPS)} * 0.5e0) zs from pb),
z1 as (select *, floor((radians("dec") + pi() / 2) / zs)::int zone_lat from z0),
z2 as (select *, greatest(1, ceil(2 * pi() * greatest(0.05e0, abs(cos((zone_lat + 0.5e0) * zs - pi() / 2))) / zs))::int zone_bins from z1),
zz as (select *, floor((radians(ra) - 2 * pi() * floor(radians(ra) / (2 * pi()))) / (2 * pi()) * zone_bins)::int zone_lon from z2),
zm as (select bin_index, band, zone_lat, zone_bins, zone_lon, {sql_mean('ra', '"dec"')[0]} zone_ra, {sql_mean('ra', '"dec"')[1]} zone_dec, count(*)::int zone_n from zz group by 1, 2, 3, 4, 5),
zo as (select zm.*, mx zone_offset from zm join (select zz.bin_index, zz.band, zz.zone_lat, zz.zone_bins, zz.zone_lon, max({sql_sep('zz.ra', 'zz.dec', 'zone_ra', 'zone_dec')}) mx
   from zz join zm using (bin_index, band, zone_lat, zone_bins, zone_lon) group by 1, 2, 3, 4, 5) using (bin_index, band, zone_lat, zone_bins, zone_lon))"""
_ZB = _ZONES + f""",
zc as (select zo.*, {sql_pick(EPS)} eps from zo),
zr as (select zc.*, (select count(*) from pb p where p.bin_index = zc.bin_index and p.band = zc.band and {sql_sep('zone_ra', 'zone_dec', 'p.ra', 'p.dec')} <= eps * 5)::int n_outer,
   (select count(*) from pb p where p.bin_index = zc.bin_index and p.band = zc.band and {sql_sep('zone_ra', 'zone_dec', 'p.ra', 'p.dec')} <= eps * 2 + zone_offset)::int n_inner from zc),
zb as (select *, greatest(0, n_outer - n_inner) n_ring,
   greatest(0, n_outer - n_inner) * (2 * pi() * (1 - cos(radians(eps)))) / (2 * pi() * (cos(radians(eps * 2 + zone_offset)) - cos(radians(eps * 5)))) mu from zr),
zt as (select *, greatest(4, ceil(mu + 2.5e0 * sqrt(mu) + 1))::int threshold from zb)"""


@R.add("q_density_zones", f"with {_ZONES} select bin_index, band, zone_lat, zone_bins, zone_lon, round(zone_ra, 6) zone_ra, round(zone_dec, 6) zone_dec, zone_n, round(zone_offset, 6) zone_offset from zo")
def q_density_zones(spark, d):
    z = S.density_zones(S.zone_columns(grouped(spark, d), CONFIG))
    return z.select("bin_index", "band", *S.ZONE, r6("zone_ra", "zone_ra"), r6("zone_dec", "zone_dec"), "zone_n", r6("zone_offset", "zone_offset"))


@R.add("q_eps_neighbor_count", f"with {PAIRS} select bin_index, band, a event_id, count(*)::int n_eps from pairs where sep <= {sql_pick(EPS)} group by 1, 2, 3")
def q_eps_neighbor_count(spark, d):
    return S.neighbour_counts(grouped(spark, d), CONFIG).drop("tile_id")


def _zones(spark, d: str) -> DataFrame:
    p = grouped(spark, d)
    return S.zone_background(p, S.density_zones(S.zone_columns(p, CONFIG)), CONFIG)


@R.add("q_zone_annulus_counts", f"with {_ZB} select bin_index, band, zone_lat, zone_bins, zone_lon, n_outer, n_inner, n_ring::int n_ring from zb")
def q_zone_annulus_counts(spark, d):
    return _zones(spark, d).select("bin_index", "band", *S.ZONE, "n_outer", "n_inner", "n_ring")


@R.add("q_core_threshold", f"with {_ZB} select bin_index, band, zone_lat, zone_bins, zone_lon, round(mu, 6) mu, threshold from zt")
def q_core_threshold(spark, d):
    return _zones(spark, d).select("bin_index", "band", *S.ZONE, r6("mu", "mu"), "threshold")


@R.add(
    "q_core_flags",
    f"""with {_ZB}, ne as (select p.bin_index, p.band, p.event_id, count(*)::int n_eps from pb p join pb q on p.bin_index = q.bin_index and p.band = q.band
  and abs(p.dec - q.dec) < 0.6 and {sql_sep('p.ra', 'p.dec', 'q.ra', 'q.dec')} <= {sql_pick(EPS, 'p.band')} group by 1, 2, 3)
select zz.bin_index, zz.band, zz.event_id, n_eps, threshold, n_eps >= threshold is_core
from zz join zt using (bin_index, band, zone_lat, zone_bins, zone_lon) join ne on ne.bin_index = zz.bin_index and ne.band = zz.band and ne.event_id = zz.event_id""",
)
def q_core_flags(spark, d):
    return S.core_flags(grouped(spark, d), CONFIG).select("bin_index", "band", "event_id", "n_eps", "threshold", "is_core")


_CLUSTERS = f"""{_ZB}, ne as (select p.bin_index, p.band, p.event_id, count(*)::int n_eps from pb p join pb q on p.bin_index = q.bin_index and p.band = q.band
  and abs(p.dec - q.dec) < 0.6 and {sql_sep('p.ra', 'p.dec', 'q.ra', 'q.dec')} <= {sql_pick(EPS, 'p.band')} group by 1, 2, 3),
cf as (select zz.bin_index, zz.band, zz.event_id, zz.ra, zz.dec, n_eps >= threshold is_core
  from zz join zt using (bin_index, band, zone_lat, zone_bins, zone_lon) join ne on ne.bin_index = zz.bin_index and ne.band = zz.band and ne.event_id = zz.event_id),
co as (select * from cf where is_core),
ed as (select a.event_id a, b.event_id b from co a join co b on a.bin_index = b.bin_index and a.band = b.band and {sql_sep('a.ra', 'a.dec', 'b.ra', 'b.dec')} <= {sql_pick(EPS, 'a.band')}),
re(n, r) as (select event_id, event_id from co union select ed.b, re.r from re join ed on ed.a = re.n),
cl as (select co.bin_index, co.band, n event_id, min(r) first_core from re join co on co.event_id = re.n group by 1, 2, 3),
lb as (select *, (dense_rank() over (partition by bin_index, band order by first_core) - 1)::int as "label" from cl)"""


@R.add("q_component_labels", f"with recursive {_CLUSTERS} select bin_index, band, event_id, \"label\" from lb")
def q_component_labels(spark, d):
    p = grouped(spark, d)
    return S.cluster_members(p, CONFIG).where("is_core").select("bin_index", "band", "event_id", "label")


@R.add(
    "q_border_attach",
    f"""with recursive {_CLUSTERS}, bo as (select o.bin_index, o.band, o.event_id, c.event_id core, {sql_sep('c.ra', 'c.dec', 'o.ra', 'o.dec')} sep
  from cf o join co c on o.bin_index = c.bin_index and o.band = c.band and not o.is_core),
near as (select * from bo where sep <= {sql_pick(EPS)} qualify row_number() over (partition by event_id order by sep, core) = 1)
select near.bin_index, near.band, near.event_id, "label" from near join lb on lb.event_id = near.core""",
)
def q_border_attach(spark, d):
    p = grouped(spark, d)
    return S.cluster_members(p, CONFIG).where("not is_core").select("bin_index", "band", "event_id", "label")


_AREA = S.region_area(18.0)


@R.add(
    "q_roi_average_threshold",
    f"""with {PAIRS}, n as (select bin_index, band, count(*) n from pb group by 1, 2),
t as (select bin_index, band, greatest(4, ceil(mu + 2.5e0 * sqrt(mu) + 1))::int threshold from (select *, n * pi() * {sql_pick(EPS)} * {sql_pick(EPS)} / {lit(_AREA)} mu from n)),
c as (select bin_index, band, a event_id, count(*)::int n_eps from pairs where sep <= {sql_pick(EPS)} group by 1, 2, 3)
select c.bin_index, c.band, event_id, n_eps, threshold, n_eps >= threshold is_core from c join t on c.bin_index = t.bin_index and c.band = t.band""",
)
def q_roi_average_threshold(spark, d):
    return S.fixed_core_flags(grouped(spark, d), CONFIG, _AREA).select("bin_index", "band", "event_id", "n_eps", "threshold", "is_core")


# ---------------------------------------------------------------- background, at the planted sources


#: Centroids of the clusters of a folder, found once per program and kept as long as their table is there.
_FOUND: dict[tuple[str, str], DataFrame] = {}


def probes(spark, d: str) -> DataFrame:
    """The clusters found in the fixture region, with their mean directions."""
    key, path = (spark.sparkContext.applicationId, d), spark._jvm.org.apache.hadoop.fs.Path
    have = _FOUND.get(key)
    if have is None or not path(have._durable_path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(path(have._durable_path)):
        p = grouped(spark, d)
        have = _FOUND[key] = Durable(spark, "centroids").put(B.centroids(p, S.cluster_members(p, CONFIG)).select(*B.CLUSTER, "c_ra", "c_dec"))
    return have


def planted(spark, d: str) -> DataFrame:
    """The planted sources' photons per bin and band, with their mean direction."""
    a, b = sphere.mean_direction(F.col("ra"), F.col("dec"))
    p = grouped(spark, d).where("is_source = 1").withColumn("label", (F.col("run_id") % 50).cast("int"))
    return p.groupBy(*B.CLUSTER).agg(a.alias("c_ra"), b.alias("c_dec"))


_SRC = f"cs as (select distinct source_name, ra, \"dec\", flux1000 from catalog_sources where {sql_sep('ra', '\"dec\"', '180e0', '0e0')} < 24)"
_PLANTED = PB + f""", pr as (select bin_index, band, k::int label, {sql_mean('ra', '"dec"')[0]} c_ra, {sql_mean('ra', '"dec"')[1]} c_dec from pb where is_source = 1 group by 1, 2, 3), {_SRC}"""
_PROBE = f"""{_CLUSTERS}, bo as (select o.bin_index, o.band, o.event_id, c.event_id core, {sql_sep('c.ra', 'c.dec', 'o.ra', 'o.dec')} sep
  from cf o join co c on o.bin_index = c.bin_index and o.band = c.band and not o.is_core),
nb as (select * from bo where sep <= {sql_pick(EPS)} qualify row_number() over (partition by event_id order by sep, core) = 1),
mb as (select event_id, "label" from lb union all select nb.event_id, lb."label" from nb join lb on lb.event_id = nb.core),
pr as (select bin_index, band, "label" as "label", {sql_mean('ra', '"dec"')[0]} c_ra, {sql_mean('ra', '"dec"')[1]} c_dec from mb join pb using (event_id) group by 1, 2, 3), {_SRC}"""
_MASK = [max(2 * psf_radius(ref), 0.5) for _, _, ref in SEED_BANDS]


def catalogue(spark, d: str) -> DataFrame:
    return B.cone(table(spark, d, "catalog_sources"), 180.0, 0.0, 24.0)


@R.add("q_catalog_veto", f"with recursive {_PROBE} select bin_index, band, label, exists (select 1 from cs where {sql_sep('c_ra', 'c_dec', 'cs.ra', 'cs.dec')} < greatest(0.5e0, {sql_pick(EPS)})) near_source from pr")
def q_catalog_veto(spark, d):
    return B.catalogue_veto(probes(spark, d), catalogue(spark, d), CONFIG).select("bin_index", "band", "label", "near_source")


_MEETS = f"{sql_sep('c_ra', 'c_dec', 'cs.ra', 'cs.dec')} < {sql_pick(EPS)} * 5 + {sql_pick(_MASK)} and {sql_sep('c_ra', 'c_dec', 'cs.ra', 'cs.dec')} + {sql_pick(_MASK)} > {sql_pick(EPS)} * 2"


@R.add("q_mask_selection", f"with recursive {_PROBE} select bin_index, band, label, source_name from pr, cs where {_MEETS}")
def q_mask_selection(spark, d):
    m = B.with_masks(probes(spark, d), catalogue(spark, d), CONFIG)
    return m.select("bin_index", "band", "label", F.explode("masks.source_name").alias("source_name"))


_OFF = f"""(select count(*) from pb p where p.bin_index = pr.bin_index and p.band = pr.band and {sql_sep('c_ra', 'c_dec', 'p.ra', 'p.dec')} between {sql_pick(EPS, 'pr.band')} * 2 and {sql_pick(EPS, 'pr.band')} * 5
  and not exists (select 1 from cs where {_MEETS.replace('case band', 'case pr.band')} and {sql_sep('p.ra', 'p.dec', 'cs.ra', 'cs.dec')} <= {sql_pick(_MASK, 'pr.band')}))"""


@R.add("q_annulus_offcount", f"with recursive {_PROBE} select bin_index, band, label, {_OFF}::int n_off from pr")
def q_annulus_offcount(spark, d):
    m = B.with_masks(probes(spark, d), catalogue(spark, d), CONFIG)
    got = B.off_counts(m, grouped(spark, d), CONFIG)
    return m.select(*B.CLUSTER).join(got, list(B.CLUSTER), "left").fillna(0, ["n_off"]).select("bin_index", "band", "label", "n_off")


def _sql_area(inner: str, outer: str, n: int, masks: bool, src: str = "pr") -> str:
    g = lit((5**0.5 - 1) / 2)
    mx, my, mz = sql_unit("cs.ra", "cs.dec")
    hit = f"and not exists (select 1 from cs where {_MEETS} and x * {mx} + y * {my} + z * {mz} >= cos(radians({sql_pick(_MASK)})))" if masks else ""
    return f"""s0 as (select *, {inner} ri, {outer} ro from {src}),
s1 as (select *, cos(radians(ri)) - (i + 0.5e0) / {n} * (cos(radians(ri)) - cos(radians(ro))) cr, 2 * pi() * (((i + 0.5e0) * {g}) % 1e0) az from s0, range({n}) g(i)),
s2 as (select *, sqrt(greatest(0e0, 1 - cr * cr)) sr, radians(c_ra) a, radians(c_dec) d from s1),
s3 as (select *, cr * cos(d) * cos(a) + sr * (-cos(az) * sin(d) * cos(a) - sin(az) * sin(a)) x, cr * cos(d) * sin(a) + sr * (-cos(az) * sin(d) * sin(a) + sin(az) * cos(a)) y, cr * sin(d) + sr * cos(az) * cos(d) z from s2),
ar as (select bin_index, band, label, ri, ro, count(*) filter (x * cos(radians(180e0)) + y * sin(radians(180e0)) >= cos(radians(18e0)))::int n_region,
  count(*) filter (x * cos(radians(180e0)) + y * sin(radians(180e0)) >= cos(radians(18e0)) {hit})::int n_retained from s3 group by all)"""


@R.add(
    "q_mc_area",
    f"with recursive {_PROBE}, {_sql_area('0e0', sql_pick(EPS), 1024, False)} select bin_index, band, label, n_region, n_retained, round(2 * pi() * (cos(radians(ri)) - cos(radians(ro))) * (180 / pi()) * (180 / pi()) * n_retained / 1024e0, 6) area from ar",
)
def q_mc_area(spark, d):
    from skydrift.operators.radius_join import by_band

    a = B.sampled_areas(probes(spark, d), B.CLUSTER, F.lit(0.0), by_band(EPS), REGION, 1024)
    return a.select("bin_index", "band", "label", "n_region", "n_retained", r6("area", "area"))


def _sql_refined() -> str:
    """Areas of background rings with the number of directions doubled until they add little to the noise (rf), and of the discs (rn)."""
    g = lit((5**0.5 - 1) / 2)
    mx, my, mz = sql_unit("mk.s_ra", "mk.s_dec")
    walk = lambda t, src, ri, ro: f"""{t}0 as (select *, {ri} ri, {ro} ro from {src}),
{t}1 as (select *, unnest(range(n_s)) i from {t}0),
{t}2 as (select *, cos(radians(ri)) - (i + 0.5e0) / n_s * (cos(radians(ri)) - cos(radians(ro))) cr, 2 * pi() * (((i + 0.5e0) * {g}) % 1e0) az, radians(c_ra) a, radians(c_dec) d from {t}1),
{t}3 as (select *, sqrt(greatest(0e0, 1 - cr * cr)) sr from {t}2),
{t}4 as (select bin_index, band, "label", n_s, ri, ro, i, cr * cos(d) * cos(a) + sr * (-cos(az) * sin(d) * cos(a) - sin(az) * sin(a)) x, cr * cos(d) * sin(a) + sr * (-cos(az) * sin(d) * sin(a) + sin(az) * cos(a)) y, cr * sin(d) + sr * cos(az) * cos(d) z from {t}3),
{t}5 as (select *, x * cos(radians(180e0)) + y * sin(radians(180e0)) >= cos(radians(18e0)) inside from {t}4)"""  # noqa: E731
    nominal = "2 * pi() * (cos(radians(ri)) - cos(radians(ro))) * (180 / pi()) * (180 / pi())"
    return f"""fo as (select pr.*, {_OFF}::int n_off from pr where not exists (select 1 from cs where {sql_sep('c_ra', 'c_dec', 'cs.ra', 'cs.dec')} < greatest(0.5e0, {sql_pick(EPS)}))),
mk as (select pr.bin_index, pr.band, pr."label", cs.ra s_ra, cs."dec" s_dec, {sql_pick(_MASK)} m from pr, cs where {_MEETS}),
sz as (select fo.*, n_s from fo, (values (8192), (16384), (32768), (65536), (131072), (262144)) v(n_s)),
{walk('w', 'sz', f'{sql_pick(EPS)} * 2', f'{sql_pick(EPS)} * 5')},
wm as (select distinct w5.bin_index, w5.band, w5."label", n_s, i from w5 join mk using (bin_index, band, "label") where inside and x * {mx} + y * {my} + z * {mz} >= cos(radians(m))),
wa as (select w5.bin_index, w5.band, w5."label", w5.n_s, any_value(ri) ri, any_value(ro) ro, count(*) filter (inside) n_region, count(*) filter (inside and wm.i is null) n_retained from w5 left join wm on wm.bin_index = w5.bin_index and wm.band = w5.band and wm."label" = w5."label" and wm.n_s = w5.n_s and wm.i = w5.i group by 1, 2, 3, 4),
wr as (select wa.*, n_off, n_retained / n_s::double f from wa join fo using (bin_index, band, "label")),
wq as (select *, {nominal} * f area, case when n_off <= 0 or f <= 0 or f >= 1 then 0e0 else sqrt(f * (1 - f) / n_s) / f * sqrt(n_off::double) end area_ratio from wr),
rf as (select * from wq where area_ratio <= 0.2e0 or n_s = 262144 qualify row_number() over (partition by bin_index, band, "label" order by n_s) = 1),
sn as (select fo.*, 8192 n_s from fo),
{walk('y', 'sn', '0e0', sql_pick(EPS))},
rn as (select bin_index, band, "label", {nominal.replace('ri', 'any_value(ri)').replace('ro)', 'any_value(ro))')} * count(*) filter (inside) / 8192e0 on_area from y5 group by 1, 2, 3)"""


@R.add(
    "q_adaptive_mc_area",
    f"with recursive {_PROBE}, {_sql_refined()} select bin_index, band, \"label\", n_s::int n_samples, n_region::int n_region, n_retained::int n_retained, round(area, 6) area, round(area_ratio, 6) area_ratio from rf",
)
def q_adaptive_mc_area(spark, d):
    from skydrift.operators.radius_join import by_band

    free = B.catalogue_veto(probes(spark, d), catalogue(spark, d), CONFIG).where("not near_source").drop("near_source")
    m = B.with_masks(free, catalogue(spark, d), CONFIG)
    m = m.join(B.off_counts(m, grouped(spark, d), CONFIG), list(B.CLUSTER), "left").fillna(0, ["n_off"])
    eps = by_band(EPS)
    a = B.refined_areas(m, B.CLUSTER, eps * 2, eps * 5, REGION, CONFIG, B.mask_radius(CONFIG))
    return a.select("bin_index", "band", "label", "n_samples", "n_region", "n_retained", r6("area", "area"), r6("area_ratio", "area_ratio"))


@R.add(
    "q_on_off_significance",
    f"""with recursive {_PROBE}, {_sql_refined()},
oc as (select pr.*, (select count(*) from pb p where p.bin_index = pr.bin_index and p.band = pr.band and {sql_sep('c_ra', 'c_dec', 'p.ra', 'p.dec')} <= {sql_pick(EPS, 'pr.band')})::int n_on from pr),
al as (select oc.bin_index, oc.band, oc."label", n_on, n_off, case when area > 0 then on_area / area end alpha, area, n_region, n_retained from oc join rf using (bin_index, band, "label") join rn using (bin_index, band, "label") where on_area > 0 and n_on > 0)
select bin_index, band, "label", n_on, n_off, round(alpha, 6) alpha, round(alpha * n_off, 6) expected_bg,
  round(coalesce(case when n_on <= alpha * n_off then 0e0 when n_off = 0 then sqrt(2 * n_on * ln((1 + alpha) / alpha))
    else sqrt(greatest(0e0, 2 * (n_on * ln((1 + alpha) / alpha * (n_on / (1e0 * n_on + n_off))) + n_off * ln((1 + alpha) * (n_off / (1e0 * n_on + n_off)))))) end, 0), 6) sigma,
  coalesce(area >= 1e-10 and 1 - case when n_region > 0 then (n_region - n_retained) / n_region::double else 0 end >= 0.25e0 and n_off >= 10, false) stable from al""",
)
def q_on_off_significance(spark, d):
    s = B.significance(probes(spark, d), grouped(spark, d), catalogue(spark, d), REGION, CONFIG)
    return s.select("bin_index", "band", "label", "n_on", "n_off", r6("alpha", "alpha"), r6("expected_bg", "expected_bg"), r6("sigma", "sigma"), "stable")


@R.add(
    "q_on_counts",
    f"with recursive {_PROBE} select bin_index, band, label, (select count(*) from pb p where p.bin_index = pr.bin_index and p.band = pr.band and {sql_sep('c_ra', 'c_dec', 'p.ra', 'p.dec')} <= {sql_pick(EPS, 'pr.band')})::int n_on from pr",
)
def q_on_counts(spark, d):
    return B.on_counts(probes(spark, d), grouped(spark, d), CONFIG).select("bin_index", "band", "label", "n_on")


_REPORT = [10 ** (3 + 2 * k / 6) for k in range(7)]


@R.add(
    "q_aperture_by_band",
    f"""with recursive {_PROBE}, m as (select pr.bin_index, pr.band, label, p.energy from pr join ph p on p.bin_index = pr.bin_index and {sql_sep('c_ra', 'c_dec', 'p.ra', 'p.dec')} <= {sql_pick(EPS, 'pr.band')})
select bin_index, band, label, {', '.join(f"count(*) filter (energy >= {lit(lo)} and energy < {lit(hi)})::int n{k}" for k, (lo, hi) in enumerate(zip(_REPORT[:-1], _REPORT[1:])))} from m group by 1, 2, 3""",
)
def q_aperture_by_band(spark, d):
    from skydrift.config import REPORT_EDGES, band_label

    every = view(spark, d).withColumn("bin_index", P.time_bin(F.col("time_met")))
    a = B.aperture_counts(probes(spark, d), every, CONFIG)
    names = [band_label(lo, hi) for lo, hi in zip(REPORT_EDGES[:-1], REPORT_EDGES[1:])]
    return a.select("bin_index", "band", "label", *[F.col("photons_per_band")[n].alias(f"n{k}") for k, n in enumerate(names)])


# ---------------------------------------------------------------- the whole search


def search(spark, d: str, config: SearchConfig = CONFIG):
    """(candidates after same-bin dedup, photons) of the fixture region."""
    from skydrift.plans.pipeline import candidates

    return candidates(view(spark, d), table(spark, d, "catalog_sources"), REGION, config, cuts=False)


@R.add("q_search")
def q_search(spark, d):
    from skydrift.plans.pipeline import search as whole

    tiles = table(spark, d, "tiles")
    return whole(view(spark, d), table(spark, d, "catalog_sources"), tiles, REGION, CONFIG, cuts=False, own=False)


@R.add("q_search_tiles")
def q_search_tiles(spark, d):
    """The survey's search: all photons as delivered, all tiles and sources, production config, cuts and ownership."""
    from skydrift.plans.pipeline import search_tiles

    photons = P.one_per_photon(table(spark, d, "photons"))
    return search_tiles(photons, table(spark, d, "catalog_sources"), table(spark, d, "tiles"))


_LINK_C = f"""{PB}, pr0 as (select bin_index, k::int as label, {sql_mean('ra', '"dec"')[0]} c_ra, {sql_mean('ra', '"dec"')[1]} c_dec from pb where is_source = 1 group by 1, 2),
pr as (select *, dense_rank() over (order by bin_index, label)::int cand from pr0),
lc as (select *, (e0 + case when bin_index = 9 then {lit(WINDOW_STOP)} else e0 + {YEAR} end) / 2 t_mid from (select *, {lit(WINDOW_START)} + bin_index * {YEAR} e0 from pr))"""


def _link_candidates(spark, d: str) -> DataFrame:
    a, b = sphere.mean_direction(F.col("ra"), F.col("dec"))
    p = grouped(spark, d).where("is_source = 1").withColumn("label", (F.col("run_id") % 50).cast("int"))
    c = p.groupBy("tile_id", "bin_index", "label").agg(a.alias("c_ra"), b.alias("c_dec"), F.count(F.lit(1)).cast("double").alias("sigma"))
    _, _, mid = T.bin_times(F.col("bin_index"), 365.0)
    return c.withColumn("cand", F.dense_rank().over(W.partitionBy("tile_id").orderBy("bin_index", "label"))).withColumn("t_mid", mid)


@R.add(
    "q_link_edges",
    f"""with {_LINK_C}, e as (select a.cand src, b.cand dst, (b.bin_index - a.bin_index)::int gap, (b.t_mid - a.t_mid) / {YEAR} y, {sql_sep('a.c_ra', 'a.c_dec', 'b.c_ra', 'b.c_dec')} s
  from lc a join lc b on b.bin_index - a.bin_index between 1 and 2)
select src, dst, gap, round(s / y + 0.5e0 * (gap - 1), 6) penalty from e where y > 0 and s <= y""",
)
def q_link_edges(spark, d):
    return T.link_edges(_link_candidates(spark, d), CONFIG).select("src", "dst", "gap", r6("penalty", "penalty"))


# ---------------------------------------------------------------- tracks of the table


def valid_points(spark, d: str) -> DataFrame:
    """Points of the valid rows of tracks: id, campaign, tile_id, bin_index, t_mid, ra, dec, sigma."""
    t = table(spark, d, "tracks")
    last = F.max(F.struct("loaded_at", "points", "tile_id", "search_root")).alias("r")
    v = t.groupBy("_candidate_id").agg(last)
    p = v.select(F.col("_candidate_id").alias("id"), F.col("r.search_root").alias("campaign"), F.col("r.tile_id").alias("tile_id"), F.explode("r.points").alias("p"))
    sigma = F.coalesce(F.nanvl(F.col("p.sigma"), F.lit(0.0)), F.lit(0.0))
    return p.select("id", "campaign", "tile_id", "p.bin_index", ((F.col("p.t_start") + F.col("p.t_stop")) / 2).alias("t_mid"), "p.ra", "p.dec", sigma.alias("sigma")).where("ra is not null and dec is not null")


_VP = """vt as (select * from tracks qualify row_number() over (partition by _candidate_id order by loaded_at desc, points desc) = 1),
vq as (select _candidate_id id, search_root campaign, tile_id, unnest(points) p from vt),
vp as (select id, campaign, tile_id, p.bin_index bin_index, (p.t_start + p.t_stop) / 2 t_mid, p.ra ra, p."dec" "dec",
  case when p.sigma is null or isnan(p.sigma) then 0 else p.sigma end sigma from vq where p.ra is not null and p."dec" is not null)"""
_MOTION = _VP + f""",
m0 as (select id, (t_mid - {lit(WINDOW_START)}) / {YEAR} t, {sql_unit('ra', '"dec"')[0]} x, {sql_unit('ra', '"dec"')[1]} y, {sql_unit('ra', '"dec"')[2]} z from vp),
m1 as (select id, count(*)::int n, avg(x) ax, avg(y) ay, avg(z) az from m0 group by 1),
m2 as (select id, n, ax / l mx, ay / l my, az / l mz from (select *, sqrt(ax * ax + ay * ay + az * az) l from m1)),
m3 as (select *, -my / sqrt(mx * mx + my * my) ex, mx / sqrt(mx * mx + my * my) ey from m2),
m4 as (select *, -mz * ey nx, mz * ex ny, mx * ey - my * ex nz from m3),
m5 as (select m0.id, t, n, (x * ex + y * ey) / (x * mx + y * my + z * mz) u, (x * nx + y * ny + z * nz) / (x * mx + y * my + z * mz) v from m0 join m4 using (id)),
m6 as (select id, var_samp(u) a, covar_samp(u, v) b, var_samp(v) d, avg(u) mu, avg(v) mv from m5 group by 1),
m7 as (select *, (a + d) / 2 + sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) big, (a + d) / 2 - sqrt(((a - d) / 2) * ((a - d) / 2) + b * b) small, 0.5 * atan2(2 * b, a - d) w from m6),
m8 as (select m5.id, n, t, big, small, (u - mu) * cos(w) + (v - mv) * sin(w) s from m5 join m7 using (id)),
m9 as (select id, any_value(n) n, any_value(big) big, any_value(small) small, corr(t, s) r, regr_slope(s, t) sl from m8 group by 1),
ms as (select id, min(g) lo, max(g) hi from (select m8.id, degrees((case when sl < 0 then -1 else 1 end * (s - lag(s) over w)) / (t - lag(t) over w)) g from m8 join m9 using (id) window w as (partition by m8.id order by t)) where g is not null group by 1),
mm as (select id, n n_points, case when n >= 3 and big > 0 then 1 - greatest(small, 0) / big else 0 end anisotropy, case when n >= 3 and big > 0 then coalesce(abs(r), 0) else 0 end time_correlation,
  case when n >= 3 and big > 0 then degrees(abs(sl)) else 0 end velocity, case when n >= 3 and big > 0 and lo > 0 then lo / hi else 0 end consistency from m9 left join ms using (id))"""


@R.add("q_motion_metrics", f"with {_MOTION} select id, n_points, round(anisotropy, 6) anisotropy, round(time_correlation, 6) time_correlation, round(velocity, 6) velocity, round(consistency, 6) consistency from mm")
def q_motion_metrics(spark, d):
    m = T.motion_metrics(valid_points(spark, d), ["id"])
    return m.select("id", "n_points", r6("anisotropy", "anisotropy"), r6("time_correlation", "time_correlation"), r6("velocity", "velocity"), r6("consistency", "consistency"))


@R.add("q_motion_filter", f"with {_MOTION} select id from mm where anisotropy >= 0.7 and time_correlation >= 0.85 and consistency >= 0")
def q_motion_filter(spark, d):
    m = T.motion_metrics(valid_points(spark, d), ["id"])
    return m.where((F.col("anisotropy") >= CONFIG.least_anisotropy) & (F.col("time_correlation") >= CONFIG.least_time_correlation) & (F.col("consistency") >= 0)).select("id")


@R.add(
    "q_owner_filter",
    f"""with {_VP}, mid as (select id, tile_id, {sql_mean('ra', '"dec"')[0]} ra, {sql_mean('ra', '"dec"')[1]} "dec" from vp group by 1, 2),
own as (select p.id, p.tile_id, arg_max(t.tile_id, {_DOT}) o from mid p, tiles t group by 1, 2) select id, o = tile_id owned from own""",
)
def q_owner_filter(spark, d):
    a, b = sphere.mean_direction(F.col("ra"), F.col("dec"))
    mid = valid_points(spark, d).groupBy("id", "tile_id").agg(a.alias("ra"), b.alias("dec"))
    return tiling.owners(mid, table(spark, d, "tiles"), ["id", "tile_id"]).select("id", (F.col("owner") == F.col("tile_id")).alias("owned"))


_PAIRS = _VP + f""",
xs as (select a.campaign, a.id a, b.id b, {sql_sep('a.ra', 'a.dec', 'b.ra', 'b.dec')} sep from vp a join vp b on a.campaign = b.campaign and a.bin_index = b.bin_index and a.id < b.id and a.tile_id <> b.tile_id),
xp as (select campaign, a, b, count(*)::int bins, quantile_cont(sep, 0.5) median_sep, avg(case when sep <= 0.6 then 1e0 else 0e0 end) share from xs group by 1, 2, 3),
xm as (select * from xp where bins >= 3 and median_sep <= 0.6 and share >= 1)"""


@R.add("q_cross_tile_pairs", f"with {_PAIRS} select campaign, a, b, bins, round(median_sep, 6) median_sep from xm")
def q_cross_tile_pairs(spark, d):
    return T.cross_tile_pairs(valid_points(spark, d), CONFIG).select("campaign", "a", "b", "bins", r6("median_sep", "median_sep"))


@R.add(
    "q_cross_tile_dedup",
    f"""with recursive {_PAIRS}, xe as (select a, b from xm union select b, a from xm), rc(n, r) as (select id, id from (select distinct id from vp) union select xe.b, rc.r from rc join xe on xe.a = rc.n),
g as (select n, min(r) c from rc group by 1), sc as (select id, sum(sigma) s from vp group by 1), k as (select n id, c, row_number() over (partition by c order by round(s, 6) desc, n) k, count(*) over (partition by c) m from g join sc on sc.id = g.n)
select k.id, r.id representative, k.m::int members from k join k r on r.c = k.c and r.k = 1""",
)
def q_cross_tile_dedup(spark, d):
    p = valid_points(spark, d)
    return T.cross_tile_groups(p, CONFIG).select("id", "representative", "members")


@R.add("q_summary_percentiles", f"with {_VP} select campaign, unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])::double p, round(unnest(quantile_cont(sigma, [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])), 6) sigma from vp group by 1")
def q_summary_percentiles(spark, d):
    ps = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    a = valid_points(spark, d).groupBy("campaign").agg(F.percentile("sigma", F.array(*[F.lit(p) for p in ps])).alias("v"))
    pair = F.explode(F.arrays_zip(F.array(*[F.lit(p) for p in ps]).alias("p"), F.col("v"))).alias("z")
    return a.select("campaign", pair).select("campaign", F.col("z.p").alias("p"), F.round("z.v", 6).alias("sigma"))


@R.add(
    "q_stage_audit",
    f"""with {_PLANTED}, tr as (select i::int bin_index, {sql_mod360('178e0 + 0.5e0 * (i + 0.5e0 - 5) * sin(radians(40e0)) / cos(radians(-2e0 + 0.5e0 * (i + 0.5e0 - 5) * cos(radians(40e0))))')} t_ra, -2e0 + 0.5e0 * (i + 0.5e0 - 5) * cos(radians(40e0)) t_dec from range(10) g(i)),
m as (select label, {sql_sep('c_ra', 'c_dec', 't_ra', 't_dec')} sep from pr join tr using (bin_index)),
a as (select label, count(*)::int matched_bins, quantile_cont(sep, 0.5) median_sep from m group by 1)
select label id, matched_bins, round(median_sep, 6) median_sep from a where matched_bins >= 3 and median_sep <= 0.6""",
)
def q_stage_audit(spark, d):
    truth = inject.track_truth(spark, 178.0, -2.0, 0.5, 40.0)
    pts = planted(spark, d).select(F.col("label").alias("id"), "bin_index", F.col("c_ra").alias("ra"), F.col("c_dec").alias("dec"))
    return T.truth_matches(pts, truth, CONFIG).select("id", "matched_bins", r6("median_sep", "median_sep"))


def q_audit_apertures(spark, d):
    truth = inject.track_truth(spark, 178.0, -2.0, 0.5, 40.0)
    flags = S.core_flags(grouped(spark, d), CONFIG)
    return T.audit_apertures(flags, truth, CONFIG)


@R.add(
    "q_audit_stages",
    f"""with recursive {_PROBE}, tr as (select i::int bin_index, {sql_mod360('178e0 + 0.5e0 * (i + 0.5e0 - 5) * sin(radians(40e0)) / cos(radians(-2e0 + 0.5e0 * (i + 0.5e0 - 5) * cos(radians(40e0))))')} t_ra, -2e0 + 0.5e0 * (i + 0.5e0 - 5) * cos(radians(40e0)) t_dec from range(10) g(i)),
m as (select bin_index, band from pr join tr using (bin_index) where {sql_sep('c_ra', 'c_dec', 't_ra', 't_dec')} <= 0.6)
select 'all' stage, count(distinct bin_index)::int matched_bins from m union all select 'upper bands', count(distinct bin_index) filter (band > 0)::int from m""",
)
def q_audit_stages(spark, d):
    truth = inject.track_truth(spark, 178.0, -2.0, 0.5, 40.0)
    c = probes(spark, d)
    return T.audit_stages({"all": c, "upper bands": c.where("band > 0")}, truth, CONFIG)


# ---------------------------------------------------------------- nulls, injections, inference


@R.add(
    "q_inject_routing",
    f"""with tr as (select i::int bin_index, 180e0 + 0.5e0 * (i + 0.5e0 - 5) t_ra, 0e0 t_dec from range(10) g(i))
select tile_id, to_json(list(bin_index order by bin_index)) bins from tiles, tr where {sql_sep('t_ra', 't_dec', 'ra_degrees', 'dec_degrees')} <= 18 group by 1""",
)
def q_inject_routing(spark, d):
    truth = inject.track_truth(spark, 180.0, 0.0, 0.5, 90.0)
    tiles = table(spark, d, "tiles").withColumn("analysis_radius_degrees", F.lit(18.0))
    return inject.cap_memberships(truth, tiles).select("tile_id", F.to_json("bins").alias("bins"))


def king_table() -> inject.KingTable:
    """A small made-up table of the production shape."""
    n_e, n_t = 5, 4
    grid = lambda f: tuple(tuple(f(t, e) for e in range(n_e)) for t in range(n_t))
    return inject.KingTable(
        tuple(2.5 + 0.6 * e for e in range(n_e)), tuple(0.25 + 0.22 * t for t in range(n_t)), (0.05, 0.0003, -0.8),
        {"NTAIL": grid(lambda t, e: 0.1 + 0.02 * e), "SCORE": grid(lambda t, e: 0.6 + 0.05 * t), "STAIL": grid(lambda t, e: 1.4 + 0.1 * e), "GCORE": grid(lambda t, e: 2.2 + 0.1 * t), "GTAIL": grid(lambda t, e: 1.8 + 0.05 * e)},
    )


def _sql_king() -> str:
    t = king_table()
    scale = t.scale(3000.0)
    terms = [f"{lit(w)} * (1 - pow(1 + x * x / {lit(2 * g * s * s)}, {lit(1 - g)}))" for w, s, g in t.parts(3000.0, 45.0)]
    return f"with {PH} select event_id, round({' + '.join(terms)}, 6) share from (select event_id, radians(zenith / 60) / {lit(scale)} x from ph)"


@R.add("q_psf_cdf", _sql_king())
def q_psf_cdf(spark, d):
    return view(spark, d).select("event_id", r6(inject.containment(F.col("zenith") / 60, king_table(), 3000.0, 45.0), "share"))


_LAYERS = [(1000.0, 2.0e11), (3000.0, 2.6e11), (10000.0, 3.1e11), (30000.0, 3.0e11), (100000.0, 2.4e11)]


def _sql_folded(points: int = 1025) -> str:
    import math

    lo, hi = math.log(1000.0), math.log(100000.0)
    case = "case " + " ".join(f"when le <= {lit(math.log(b[0]))} then {lit(a[1])} + (le - {lit(math.log(a[0]))}) * {lit((b[1] - a[1]) / (math.log(b[0]) - math.log(a[0])))}" for a, b in zip(_LAYERS, _LAYERS[1:])) + f" else {lit(_LAYERS[-1][1])} end"
    return f"""with g as (select i::int k, {lit(lo)} + i * {lit((hi - lo) / (points - 1))} le from range({points}) t(i)),
h as (select k, exp(le) e, ({case}) / (exp(le) * exp(le)) f from g), c as (select k, e, coalesce(0.5e0 * (f + lag(f) over w) * (e - lag(e) over w), 0) a from h window w as (order by k)),
s as (select k, e, sum(a) over (order by k) c from c) select k, round(e, 6) energy, round(c / max(c) over (), 9) cdf from s"""


@R.add("q_exposure_cdf", _sql_folded())
def q_exposure_cdf(spark, d):
    c = inject.folded_cdf(spark, _LAYERS, 1025)
    return c.select("k", r6("energy", "energy"), F.round("cdf", 9).alias("cdf"))


_COUNTS = "cc as (select search_root campaign, count(distinct _candidate_id) n_tracks from tracks group by 1)"


def campaign_counts(spark, d: str) -> DataFrame:
    return table(spark, d, "tracks").groupBy(F.col("search_root").alias("campaign")).agg(F.countDistinct("_candidate_id").alias("n_tracks"))


@R.add(
    "q_plus_one_p",
    f"with {_COUNTS} select count(*) n, count(*) filter (n_tracks >= 400) at_least, round((1 + count(*) filter (n_tracks >= 400)) / (count(*) + 1e0), 9) p, round(avg(n_tracks), 6) mean, round(coalesce(stddev_samp(n_tracks), 0), 6) sd from cc",
)
def q_plus_one_p(spark, d):
    a = inference.plus_one(campaign_counts(spark, d), 400)
    return a.select("n", "at_least", F.round("p", 9).alias("p"), r6("mean", "mean"), r6("sd", "sd"))


@R.add(
    "q_campaign_stats",
    f"with {_COUNTS}, s as (select n_tracks, 'combined' subset from cc union all select n_tracks, case when right(campaign, 1)::int % 2 = 0 then 'calibration' else 'validation' end from cc) select subset, count(*) n, round(avg(n_tracks), 6) mean, round(coalesce(stddev_samp(n_tracks), 0), 6) sd, round(coalesce(stddev_samp(n_tracks), 0) / sqrt(count(*)), 6) standard_error from s group by 1",
)
def q_campaign_stats(spark, d):
    c = campaign_counts(spark, d).withColumn("campaign", F.regexp_extract("campaign", r"(\d+)$", 1).cast("int"))
    seeds = [r.campaign for r in c.select("campaign").distinct().collect()]
    a = inference.campaign_subsets(c, [s for s in seeds if s % 2 == 0], [s for s in seeds if s % 2])
    return a.select("subset", "n", r6("mean", "mean"), r6("sd", "sd"), r6("standard_error", "standard_error"))


_WZ = lit(1.959963984540054)


@R.add(
    "q_wilson",
    f"""with {PH}, n as (select bin_index, count(*) filter ((event_class & 128) > 0) k, count(*)::double n from ph group by 1), p as (select *, k / n p from n)
select bin_index, round((p + {_WZ} * {_WZ} / (2 * n) - {_WZ} * sqrt(p * (1 - p) / n + {_WZ} * {_WZ} / (4 * n * n))) / (1 + {_WZ} * {_WZ} / n), 6) low,
       round((p + {_WZ} * {_WZ} / (2 * n) + {_WZ} * sqrt(p * (1 - p) / n + {_WZ} * {_WZ} / (4 * n * n))) / (1 + {_WZ} * {_WZ} / n), 6) high from p""",
)
def q_wilson(spark, d):
    n = view(spark, d).groupBy(P.time_bin(F.col("time_met")).alias("bin_index")).agg(F.count_if(any_bit(F.col("event_class"), 128)).alias("k"), F.count(F.lit(1)).alias("n"))
    low, high = inference.wilson(F.col("k"), F.col("n"))
    return n.select("bin_index", r6(low, "low"), r6(high, "high"))


@R.add("q_source_limits", f"with {PH} select bin_index, round(80.75719e0 / (count(*) filter (zenith < 90) / (1e0 * count(*))), 6) source_limit from ph group by 1")
def q_source_limits(spark, d):
    n = view(spark, d).groupBy(P.time_bin(F.col("time_met")).alias("bin_index")).agg((F.count_if(F.col("zenith") < 90) / F.count(F.lit(1))).alias("efficiency"))
    return inference.source_limits(n, 80.75719).select("bin_index", r6("source_limit", "source_limit"))


@R.add(
    "q_poisson_validation",
    f"with {PB}, c as (select bin_index, band, count(*) filter (zenith < 60) o, count(*) * 0.5e0 p, sqrt(count(*) * 0.25e0) s from pb group by 1, 2) select sum(o)::bigint observed, round(sum(p), 6) predicted, round(sqrt(sum(s * s)), 6) sd, round((sum(o) - sum(p)) / sqrt(sum(s * s)), 6) z from c",
)
def q_poisson_validation(spark, d):
    n = F.count(F.lit(1))
    c = grouped(spark, d).groupBy("bin_index", "band").agg(F.count_if(F.col("zenith") < 60).alias("observed"), (n * 0.5).alias("predicted"), F.sqrt(n * 0.25).alias("sd"))
    a = inference.poisson_validation(c)
    return a.select("observed", r6("predicted", "predicted"), r6("sd", "sd"), r6("z", "z"))


@R.add(
    "q_yield_trapezoid",
    f"with {PH}, c as (select bin_index, floor(energy / 500)::int x, count(*) y from ph group by 1, 2), a as (select bin_index, 0.5e0 * (y + lag(y) over w) * (x - lag(x) over w) a from c window w as (partition by bin_index order by x)) select bin_index, sum(a) integral from a group by 1",
)
def q_yield_trapezoid(spark, d):
    c = view(spark, d).groupBy(P.time_bin(F.col("time_met")).alias("bin_index"), F.floor(F.col("energy") / 500).cast("int").alias("x")).agg(F.count(F.lit(1)).alias("y"))
    return inference.trapezoid(c, "x", "y", ["bin_index"])


# ---------------------------------------------------------------- archive


def _archive(spark, d: str) -> DataFrame:
    """File names of weekly deliveries, several versions of some, made from the event table."""
    e = table(spark, d, "events").select((F.floor(F.col("event_id") / 7) % 400).alias("w"), (F.col("user_id") % 4).alias("v"))
    return e.select(F.format_string("lat_photon_weekly_w%03d_p305_v%03d.fits", F.col("w"), F.col("v")).alias("name"))


_ARCH = "ar as (select (event_id // 7) % 400 w, user_id % 4 v from events)"


@R.add("q_latest_version", f"with {_ARCH} select w::int as \"week\", max(v)::int as \"version\", format('lat_photon_weekly_w{{:03d}}_p305_v{{:03d}}.fits', w, max(v)) \"name\" from ar group by w")
def q_latest_version(spark, d):
    from skydrift.sources.archive import latest_versions

    return latest_versions(_archive(spark, d), "name").select("week", "version", "name")


@R.add("q_missing_weeks", f"with {_ARCH} select i::int as \"week\" from range(0, 420) g(i) where i not in (select w from ar) and i <> 405")
def q_missing_weeks(spark, d):
    from skydrift.sources.archive import latest_versions, missing_weeks

    return missing_weeks(latest_versions(_archive(spark, d), "name"), 0, 419, known_holes=(405,))


@R.add(
    "q_row_accounting",
    f"with {PH} select count(*) n_read, count(*) filter ({_CUT}) selected, count(*) filter ({_CUT} and band is not null) written from ph",
)
def q_row_accounting(spark, d):
    p = view(spark, d)
    q = P.quality_cut(p).select("event_id", P.band_index(F.col("energy")).alias("band"), F.lit(1).alias("kept"))
    j = p.select("event_id").join(q, "event_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n_read"), F.count("kept").alias("selected"), F.count("band").alias("written"))
