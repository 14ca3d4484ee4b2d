"""The archive of weekly event files: latest versions, gaps, inventories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how weekly files are named.
WEEK_FILE = r"_w(\d+)_p[^_]*_v(\d+)"


def latest_versions(listing: DataFrame, path: str = "path") -> DataFrame:
    """listing rows of the greatest version of each week, with week and version.

    Of equal versions the first path wins; names that are no weekly files are left out.
    """
    week, version = (F.regexp_extract(path, WEEK_FILE, k) for k in (1, 2))
    rows = listing.withColumn("week", F.when(week != "", week).cast("int")).withColumn("version", F.when(version != "", version).cast("int")).where("week is not null")
    best = rows.groupBy("week").agg(F.min(F.struct((-F.col("version")).alias("v"), F.col(path).alias("p"))).alias("b"))
    return rows.join(best.select("week", (-F.col("b.v")).alias("version"), F.col("b.p").alias(path)), ["week", "version", path], "left_semi").dropDuplicates(["week"])


def missing_weeks(weeks: DataFrame, first: int, last: int, known_holes: Sequence[int] = ()) -> DataFrame:
    """week of those in [first, last] without a file, known holes aside."""
    every = weeks.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("week"))
    return every.where(~F.col("week").isin(*known_holes) if known_holes else F.lit(True)).join(weeks.select("week"), "week", "left_anti")


def inventory(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """path, size, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def inventory_differences(stated: DataFrame, found: DataFrame) -> DataFrame:
    """path, problem ('missing', 'unlisted', 'size', 'hash') where an inventory and a folder disagree."""
    j = stated.select("path", F.col("size").alias("s0"), F.col("sha256").alias("h0"), F.lit(1).alias("a")).join(
        found.select("path", F.col("size").alias("s1"), F.col("sha256").alias("h1"), F.lit(1).alias("b")), "path", "full"
    )
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(F.col("s0") != F.col("s1"), "size").when(F.col("h0") != F.col("h1"), "hash")
    return j.select("path", problem.alias("problem")).where("problem is not null")
