"""Preparation of an archive: cuts, good times, routing to tiles, owner counts and time blocks, as one resumable job."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.config import CLASS_BIT, WINDOW_START, WINDOW_STOP
from skydrift.operators import photons as P, tiling
from skydrift.operators.compaction import table_files
from skydrift.sources.sinks import canonical_hash, dataset_violations, write_if_changed


@dataclass(frozen=True)
class Preparation:
    """Options of a preparation (degrees, seconds)."""

    radius: float = 18.0
    block_seconds: float = 91.25 * 86400
    day_seconds: float = 86400.0
    max_zenith: float = 90.0
    class_bit: int = CLASS_BIT

    def blocks(self) -> range:
        return range(math.ceil((WINDOW_STOP - WINDOW_START) / self.block_seconds))

    def bounds(self, block: int) -> tuple[float, float]:
        start = WINDOW_START + block * self.block_seconds
        return start, min(start + self.block_seconds, WINDOW_STOP)


def file_signature(spark: SparkSession, path: str) -> str:
    """A hash of names, sizes and times of the files at a path: what a run's input is known by."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        f = it.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return canonical_hash(sorted(found))


def block_done(root: str, block: int, fingerprint: str) -> bool:
    """Whether a block was finished under this fingerprint (its note is written last)."""
    try:
        with open(f"{root}/blocks_done/{block:03d}.json") as f:
            return json.load(f)["fingerprint"] == fingerprint
    except (FileNotFoundError, json.JSONDecodeError, KeyError):
        return False


def prepare(photons: DataFrame, tiles: DataFrame, root: str, fingerprint: str, intervals: DataFrame | None = None, options: Preparation = Preparation()) -> list[int]:
    """Writes below ``root``: photons (tile_id, block_index), histogram (block_index), gti (block_index); returns the blocks done.

    photons: file_id, run_id, event_id, ra, dec, energy, time_met, zenith, event_class. Blocks finished under the
    same fingerprint are left alone; the others, as many as they are, are one job whose partitions are overwritten.
    intervals: file_id, start, stop of good times; without them all times are good.
    """
    spark = photons.sparkSession
    todo = [b for b in options.blocks() if not block_done(root, b, fingerprint)]
    if not todo:
        return []
    block = F.floor((F.col("time_met") - WINDOW_START) / options.block_seconds).cast("int")
    p = P.preparation_cut(photons, WINDOW_START, WINDOW_STOP, options.max_zenith, options.class_bit).withColumn("block_index", block).where(F.col("block_index").isin(*todo))
    if intervals is not None:
        p = P.in_good_time(p, intervals)
    dynamic = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    counted = tiling.owners(p, tiles, ["time_met", "block_index"]).select("owner", F.floor((F.col("time_met") - WINDOW_START) / options.day_seconds).cast("int").alias("day"), "block_index")
    dynamic(counted.groupBy("block_index", "owner", "day").agg(F.count(F.lit(1)).alias("n")).repartition("block_index")).partitionBy("block_index").parquet(f"{root}/histogram")
    if intervals is not None:
        bounds = spark.createDataFrame([(b, *options.bounds(b)) for b in todo], "block_index int, _a double, _b double")
        good = intervals.join(F.broadcast(bounds), (F.col("stop") >= F.col("_a")) & (F.col("start") < F.col("_b")))  # a row per block
        clipped = good.select("block_index", "file_id", F.greatest("start", "_a").alias("start"), F.least("stop", "_b").alias("stop"))
        dynamic(clipped.repartition("block_index")).partitionBy("block_index").parquet(f"{root}/gti")
    routed = tiling.cap_members(p.drop("tile_id"), tiles, options.radius).withColumnRenamed("cap_tile", "tile_id")
    # a busy tile is spread over several files, quiet ones get one each
    spread = routed.repartition("tile_id", "block_index", F.pmod(F.xxhash64("run_id", "event_id"), F.lit(4))).sortWithinPartitions("tile_id", "block_index", "time_met")
    dynamic(spread).option("maxRecordsPerFile", 2_000_000).partitionBy("tile_id", "block_index").parquet(f"{root}/photons")
    for b in todo:
        write_if_changed(f"{root}/blocks_done/{b:03d}.json", json.dumps({"block": b, "fingerprint": fingerprint, **asdict(options)}))
    return todo


def histogram(spark: SparkSession, root: str) -> DataFrame:
    """owner, day, n over all blocks."""
    return tiling.merge_histograms(spark.read.parquet(f"{root}/histogram").select("owner", "day", "n"))


def write_geometry(tiles: DataFrame, root: str, radius: float) -> None:
    """tile_centers.csv and a query_info.json per tile; files that hold this already are left alone."""
    rows = tiles.select("tile_id", "ra_degrees", "dec_degrees").orderBy("tile_id").limit(tiling.MOST_TILES + 1).collect()
    if len(rows) > tiling.MOST_TILES:
        raise ValueError(f"more than {tiling.MOST_TILES} tiles")
    write_if_changed(f"{root}/tile_centers.csv", "tile_id,ra_degrees,dec_degrees\n" + "".join(f"{r.tile_id},{r.ra_degrees!r},{r.dec_degrees!r}\n" for r in rows))
    for r in rows:
        info = {"tile_id": r.tile_id, "ra_degrees": r.ra_degrees, "dec_degrees": r.dec_degrees, "analysis_radius_degrees": radius, "window": [WINDOW_START, WINDOW_STOP]}
        write_if_changed(f"{root}/{r.tile_id}/query_info.json", json.dumps(info, indent=1, sort_keys=True))


def write_manifest(spark: SparkSession, root: str, fingerprint: str, options: Preparation = Preparation()) -> str:
    """manifest.json: the fingerprint, options, files and bytes per block, rows; returns the dataset's identity, a hash of these."""
    files = table_files(spark, f"{root}/photons").withColumn("block", F.regexp_extract("part", r"block_index=(\d+)", 1).cast("int"))
    per = files.groupBy("block").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
    rows = spark.read.parquet(f"{root}/photons").groupBy(F.col("block_index").alias("block")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("tile_id", "run_id", "event_id", "time_met")).alias("check"))
    blocks = [r.asDict() for r in per.join(rows, "block").orderBy("block").collect()]  # a row per block
    body = {"fingerprint": fingerprint, "options": asdict(options), "blocks": blocks}
    identity = canonical_hash(body)
    write_if_changed(f"{root}/manifest.json", json.dumps({**body, "identity": identity}, indent=1, sort_keys=True))
    return identity


def verify(spark: SparkSession, root: str, tiles: DataFrame) -> list[str]:
    """What is wrong with a prepared dataset: rows out of place, unknown tiles, totals, files that differ from the manifest."""
    found = [f"{r.problem}: {r.detail}" for r in dataset_violations(spark.read.parquet(f"{root}/photons"), histogram(spark, root), tiles).limit(1000).collect()]
    with open(f"{root}/manifest.json") as f:
        stated = json.load(f)
    body = {k: stated[k] for k in ("fingerprint", "options", "blocks")}
    if canonical_hash(body) != stated["identity"]:
        found.append("manifest: its identity doesn't fit its content")
    files = table_files(spark, f"{root}/photons").withColumn("block", F.regexp_extract("part", r"block_index=(\d+)", 1).cast("int"))
    now = {r.block: (r.files, r.bytes) for r in files.groupBy("block").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes")).collect()}
    for b in stated["blocks"]:
        if now.get(b["block"]) != (b["files"], b["bytes"]):
            found.append(f"block {b['block']}: {now.get(b['block'])} files and bytes, stated {(b['files'], b['bytes'])}")
    return found
