"""Queries of the general data problems: skewed keys, neighbourhoods, small files."""

from __future__ import annotations

from pyspark.sql import functions as F

from skydrift.operators import compaction, nearby, skew
from skydrift.plans.registry import Registry
from skydrift.runtime import Durable, table

R = Registry()

_COUNTS = """
with p as (
  select tile_id, archive_id, count(distinct ((run_id & 4294967295)::varchar || ':' || (event_id & 4294967295)::varchar)) n_photons
  from photons where tile_id is not null and archive_id is not null group by 1, 2),
b as (
  select tile_id, archive_id, sum(coalesce(nrows, 0)) stated
  from (select *, row_number() over (partition by path order by written_at desc nulls last, nrows desc nulls last) k
        from block_outputs where path is not null)
  where k = 1 and tile_id is not null and archive_id is not null group by 1, 2)
select coalesce(p.tile_id, b.tile_id) tile_id, coalesce(p.archive_id, b.archive_id)::int archive_id,
       coalesce(n_photons, 0)::bigint n_photons, coalesce(stated, 0)::bigint stated
from p full join b on p.tile_id = b.tile_id and p.archive_id = b.archive_id
"""


@R.add("p4_counts", _COUNTS)
def p4_counts(spark, d):
    return skew.photon_accounting(table(spark, d, "photons"), table(spark, d, "block_outputs"))


@R.add("p4_found", f"select tile_id, archive_id from ({_COUNTS}) where n_photons <> stated")
def p4_found(spark, d):
    return p4_counts(spark, d).where("n_photons <> stated").select("tile_id", "archive_id")


@R.add(
    "p4_energy_percentiles",
    """
select tile_id, unnest([0.1, 0.5, 0.9])::double p, round(unnest(quantile_cont(energy, [0.1, 0.5, 0.9])), 6) energy
from photons where energy is not null and not isnan(energy) group by tile_id
""",
)
def p4_energy_percentiles(spark, d):
    got = skew.percentiles_by_key(table(spark, d, "photons"), ["tile_id"], F.col("energy"), [0.1, 0.5, 0.9])
    return got.select("tile_id", "p", F.round("value", 6).alias("energy"))


@R.add(
    "p4_class_modes",
    """
select tile_id, event_class, n from (
  select tile_id, event_class, count(*) n,
         row_number() over (partition by tile_id order by count(*) desc, event_class) k
  from photons where event_class is not null group by 1, 2) where k = 1
""",
)
def p4_class_modes(spark, d):
    got = skew.modes_by_key(table(spark, d, "photons"), ["tile_id"], F.col("event_class"))
    return got.where("mode is not null").select("tile_id", F.col("mode").alias("event_class"), F.col("mode_rows").alias("n"))


_SURROUNDINGS = """
with p as (
  select run_id & 4294967295 run_id, event_id & 4294967295 event_id, ra - 360 * floor(ra / 360) ra, dec, tile_id
  from photons where ra is not null and not isnan(ra) and dec is not null and not isnan(dec) and abs(dec) <= 90
  and run_id is not null and event_id is not null),
s as (select distinct source_name, ra, dec, mask_radius_degrees m from catalog_sources where mask_radius_degrees is not null),
near as (
  select p.run_id, p.event_id, source_name, s.m,
         2 * asin(least(1, sqrt(pow(sin(radians(s.dec - p.dec) / 2), 2)
           + cos(radians(s.dec)) * cos(radians(p.dec)) * pow(sin(radians(s.ra - p.ra) / 2), 2)))) sep
  from p join s on abs(s.dec - p.dec) <= s.m + 0.001),
own as (
  select p.*, arg_max(t.tile_id, sin(radians(p.dec)) * sin(radians(t.dec_degrees))
      + cos(radians(p.dec)) * cos(radians(t.dec_degrees)) * cos(radians(p.ra - t.ra_degrees))) right_tile
  from p, tiles t group by all)
select distinct run_id, event_id, 'source' near_kind, source_name target from near where sep <= radians(m)
union
select distinct run_id, event_id, 'tile', right_tile from own where tile_id is null or tile_id <> right_tile
"""


@R.add("p5_found", _SURROUNDINGS)
def p5_found(spark, d):
    return nearby.photon_surroundings(table(spark, d, "photons"), table(spark, d, "catalog_sources"), table(spark, d, "tiles"))


@R.add("p5_partitioned", _SURROUNDINGS)
def p5_partitioned(spark, d):
    """The same where no region is broadcast: points and regions meet by leaf and salt."""
    return nearby.photon_surroundings(table(spark, d, "photons"), table(spark, d, "catalog_sources"), table(spark, d, "tiles"), max_broadcast=0)


_FILES = r"""
with a as (select listing_no, size, regexp_replace(path, '^\s+|\s+$', '', 'g') path from file_listing),
b as (select listing_no, size, case when path like 'file:%'
        then url_decode(replace(regexp_replace(path, '^file:(//[^/]*)?', ''), '+', '%2B')) else path end path from a),
c as (select listing_no, size, case when path like '/%' then path else '/srv/fps/' || path end path from b),
d as (select listing_no, size, regexp_replace(regexp_replace(path, '(/\.)+/', '/', 'g'), '/+', '/', 'g') path from c),
e as (select listing_no, size, regexp_replace(regexp_replace(regexp_replace(path, '/[^/]+/\.\./', '/', 'g'),
        '/[^/]+/\.\./', '/', 'g'), '/[^/]+/\.\./', '/', 'g') path from d)
"""


@R.add(
    "p6_found",
    _FILES
    + r"""
select min(listing_no) listing_no from e
where regexp_matches(path, '/events_block_[0-9]{3}(_s[0-9]{3})?\.fits$') and size > 0 and size < 1048576 group by path
""",
)
def p6_found(spark, d):
    return compaction.compaction_plan(table(spark, d, "file_listing")).select("listing_no")


@R.add(
    "p6_targets",
    _FILES
    + r"""
, s as (select min(listing_no) listing_no, path, arg_min(size, listing_no) size from e
  where regexp_matches(path, '/events_block_[0-9]{3}(_s[0-9]{3})?\.fits$') and size > 0 and size < 1048576 group by path),
f as (select *, regexp_replace(path, '/[^/]*$', '') dir, regexp_replace(regexp_replace(path, '/[^/]*$', ''), '/[^/]*$', '') up from s),
ds as (select up, dir, sum(size) b, count(*) n from f group by 1, 2),
us as (select up, sum(b) b, sum(n) n from ds where not (b >= 1048576 and n > 1) group by 1),
h as (select dir, case when ds.b >= 1048576 and ds.n > 1 then dir when us.b >= 1048576 and us.n > 1 then ds.up else '/srv/fps' end home from ds left join us on us.up = ds.up),
g as (select f.*, home, coalesce(sum(size) over (partition by home order by path rows between unbounded preceding and 1 preceding), 0) before from f join h using (dir)),
o as (select path, size, home || '/events_merged_' || lpad(floor(before / 134217728)::bigint::varchar, 6, '0') || '.fits' output from g),
n as (select '/srv/fps/allsky_queries/data/' || file_id path, count(*) n from photons where file_id is not null group by 1)
select output, count(*) n_files, sum(size)::bigint bytes, coalesce(sum(n), 0)::bigint n_photons from o left join n using (path) group by 1
""",
)
def p6_targets(spark, d):
    plan = compaction.compaction_plan(table(spark, d, "file_listing"))
    return compaction.plan_targets(plan, table(spark, d, "photons"))


@R.add(
    "p6_compacted",
    """
select archive_id, count(*) n_before, count(*) n_after, true same_rows, 1 small_files from photons group by archive_id
""",
)
def p6_compacted(spark, d):
    """Photons delivered in many small files per archive, consolidated in place: rows before and after, and what is left."""
    keep = Durable(spark, "compacted")
    root = f"{keep.base}/photons"
    photons = table(spark, d, "photons").select("run_id", "event_id", "ra", "dec", "energy", "time_met", "archive_id")
    photons.repartition(16).write.partitionBy("archive_id").parquet(root)
    row = F.xxhash64(*[c for c in photons.columns if c != "archive_id"])
    sums = lambda df, n, h: df.groupBy("archive_id").agg(F.count(F.lit(1)).alias(n), F.sum(row.cast("decimal(20,0)")).alias(h))
    before = keep.put(sums(spark.read.parquet(root), "n_before", "_h"))
    compaction.compact_table(spark, root, ["archive_id"], small_bytes=16 * compaction.SMALL_BYTES, max_small=1)
    after = sums(spark.read.parquet(root), "n_after", "_g")
    files = compaction.table_files(spark, root).groupBy("part").agg(F.count(F.lit(1)).cast("int").alias("small_files"))
    value = F.regexp_extract("part", r"archive_id=(-?\d+)", 1)
    files = files.select(F.when(value != "", value).cast("int").alias("_a"), "small_files")
    both = before.join(after.withColumnRenamed("archive_id", "_b"), F.col("archive_id").eqNullSafe(F.col("_b")), "full")
    return both.join(files, F.col("archive_id").eqNullSafe(F.col("_a")), "left").select("archive_id", "n_before", "n_after", F.col("_h").eqNullSafe(F.col("_g")).alias("same_rows"), "small_files")
