"""The small inputs of a search: file lists, tile descriptions, tracks, truths, tables of models."""

from __future__ import annotations

import math
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.operators.inject import KingTable
from skydrift.sources.fits import read_table


def event_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path of each event file named in a list, blank lines aside; an empty list is an error."""
    out = spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")
    if out.isEmpty():
        raise ValueError(f"{path} names no event files")
    return out


def ownership_centres(spark: SparkSession, path: str) -> DataFrame:
    """tile_id, ra_degrees, dec_degrees from a CSV file with header; no rows are an error."""
    raw = spark.read.option("header", "true").csv(path)
    out = raw.select("tile_id", F.col("ra_degrees").cast("double"), F.col("dec_degrees").cast("double"))
    if out.isEmpty():
        raise ValueError(f"{path} holds no centres")
    return out


def tile_descriptions(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per JSON description of a tile; two for one tile are an error."""
    out = spark.read.option("multiLine", "true").json(pattern).withColumn("source_path", F.input_file_name())
    twice = out.groupBy("tile_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"tile {twice[0].tile_id} is described twice")
    return out


def track_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Tracks of result files (JSON arrays), named by their folder and place in the file.

    Adds search_root, tile_id, candidate_index (from 1) and _candidate_id. The place in an array
    is kept by reading each file, a few hundred tracks, as one value.
    """
    text = spark.read.text(pattern, wholetext=True).withColumn("_p", F.input_file_name())
    sample = spark.read.option("multiLine", "true").json(pattern).schema.simpleString()
    rows = text.select("_p", F.posexplode(F.from_json("value", f"array<{sample}>")).alias("_i", "r"))
    tile = F.regexp_extract("_p", r"/(roi_[^/]+)/[^/]*$", 1)
    root = F.regexp_extract("_p", r"/([^/]+)/roi_[^/]+/[^/]*$", 1)
    number = F.col("_i") + 1
    return rows.select(
        "r.*", root.alias("search_root"), tile.alias("folder_tile_id"), number.alias("candidate_index"),
        F.concat(root, F.lit("/"), tile, F.format_string("_candidate_%03d", number)).alias("_candidate_id"),
    )


def injected_truth(spark: SparkSession, path: str) -> DataFrame:
    """bin_index, ra, dec of an injection's record."""
    return spark.read.option("multiLine", "true").json(path).select(F.explode("per_bin_truth").alias("t")).select(F.col("t.bin_index").cast("int").alias("bin_index"), "t.ra", "t.dec")


def yield_table(spark: SparkSession, path: str) -> DataFrame:
    """Columns of a model table (CSV with header), all as doubles."""
    raw = spark.read.option("header", "true").csv(path)
    return raw.select(*[F.col(c).cast("double").alias(c) for c in raw.columns])


def first_existing(paths: Sequence[str | None]) -> str:
    """The first of several places a calibration file may be at."""
    tried = [p for p in paths if p]
    for p in tried:
        if os.path.isfile(p):
            return os.path.abspath(p)
    raise FileNotFoundError(f"none of these exists: {tried}")


def king_table(path: str, conversion: str) -> KingTable:
    """The tabulated point spread of one conversion type ('FRONT' or 'BACK') of a calibration file."""
    row = next(read_table(path, f"RPSF_{conversion}")).to_pylist()[0]
    scale = next(read_table(path, f"PSF_SCALING_PARAMS_{conversion}")).to_pylist()[0]["PSFSCALE"]
    mid = lambda a, b, f: tuple(f(x, y) for x, y in zip(row[a], row[b]))
    energy = mid("ENERG_LO", "ENERG_HI", lambda x, y: math.log10(math.sqrt(x * y)))
    theta = mid("CTHETA_LO", "CTHETA_HI", lambda x, y: (x + y) / 2)
    n = len(energy)
    cells = {k: tuple(tuple(row[k][t * n : (t + 1) * n]) for t in range(len(theta))) for k in ("NTAIL", "SCORE", "STAIL", "GCORE", "GTAIL")}
    return KingTable(energy, theta, tuple(scale[:3]), cells)
