"""Results per key when a few keys hold most rows.

Rows are first grouped by key *and* value, so that a busy key is spread over as many tasks as
it has values and a repeated value shrinks to one weighted row before it is moved. Everything
else is derived from those weighted values: counts and modes by a second aggregation whose
partial step runs before the shuffle, percentiles by a range partitioning on (key, value), so
that even one key that holds a third of all rows is cut over many tasks.

Nulls: a null key is a key of its own; null values count as rows but are no values. Empty
input gives no rows. Columns other than those named are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydrift.runtime import Durable


def weighted_values(df: DataFrame, keys: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """keys, v (the values as a struct; null where any of them is null), w (rows)."""
    whole = values[0].isNotNull()
    for v in values[1:]:
        whole = whole & v.isNotNull()
    pair = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return (
        df.select(*[F.col(k) for k in keys], F.when(whole, pair).alias("v"))
        .groupBy(*keys, "v")
        .agg(F.count(F.lit(1)).alias("w"))
    )


def counts_by_key(df: DataFrame, keys: Sequence[str], values: Sequence[Column]) -> DataFrame:
    """keys, n_rows, n_values (exact distinct count of whole values)."""
    return (
        weighted_values(df, keys, values)
        .groupBy(*keys)
        .agg(F.sum("w").alias("n_rows"), F.count("v").alias("n_values"))
    )


def modes_by_key(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """keys, mode, mode_rows: the most frequent value, the smallest of equally frequent ones.

    Keys without any value come out with a null mode and 0 rows.
    """
    best = F.min(F.when(F.col("v").isNotNull(), F.struct((-F.col("w")).alias("w"), F.col("v.v0").alias("v"))))
    return (
        weighted_values(df, keys, [value])
        .groupBy(*keys)
        .agg(best.alias("b"))
        .select(*keys, F.col("b.v").alias("mode"), F.coalesce(-F.col("b.w"), F.lit(0)).alias("mode_rows"))
    )


def running_total(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: str) -> DataFrame:
    """df with ``before`` (sum of the weights of earlier rows of the key) and ``total`` (of all).

    The rows are written range-partitioned on (keys, order). Each partition sums its weights per
    key; these sums (one row per partition and key in it) become running offsets, so no window
    ever holds more than one range partition, even if one key holds most rows. Rows equal in
    keys and order come out in any order among themselves, after each other.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order)
    # spark_partition_id must see the ranged partitions: the written files keep what it said
    part = Durable(spark, "running").put(ranged.withColumn("_part", F.spark_partition_id()))
    inside = W.partitionBy(*keys, "_part")
    upto = W.unboundedPreceding
    sums = part.groupBy(*keys, "_part").agg(F.sum(weight).alias("_sum"))
    over = W.partitionBy(*keys)
    offsets = sums.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_p"),
        F.coalesce(F.sum("_sum").over(over.orderBy("_part").rowsBetween(upto, -1)), F.lit(0)).alias("_off"),
        F.sum("_sum").over(over).alias("total"),
    )
    cond = F.col("_part") == F.col("_p")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    here = F.coalesce(F.sum(weight).over(inside.orderBy(*order).rowsBetween(upto, -1)), F.lit(0))
    return (
        part.withColumn("_here", here)
        .join(offsets, cond)
        .select(*df.columns, (F.col("_off") + F.col("_here")).alias("before"), "total")
    )


def percentiles_by_key(df: DataFrame, keys: Sequence[str], value: Column, points: Sequence[float]) -> DataFrame:
    """keys, p (the percentile asked for), value: exact, linearly interpolated between ranks.

    NaN and null values are left out; keys without values give no rows.
    """
    num = value.cast("double")
    vals = (
        weighted_values(df, keys, [F.when(~F.isnan(num), num)])
        .where("v is not null")
        .select(*keys, F.col("v.v0").alias("x"), "w")
    )
    asked = F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("p")
    pos = running_total(vals, keys, ["x"], "w").select("*", asked).withColumn("pos", F.col("p") * (F.col("total") - 1))
    low = F.expr("floor(pos) >= before and floor(pos) < before + w")
    high = F.expr("ceil(pos) >= before and ceil(pos) < before + w")
    return (
        pos.where(low | high)
        .groupBy(*keys, "p", "pos")
        .agg(F.max(F.when(low, F.col("x"))).alias("a"), F.max(F.when(high, F.col("x"))).alias("b"))
        .select(*keys, "p", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.floor("pos"))).alias("value"))
    )


def low32(c: Column) -> Column:
    """The low 32 bits of an integer, as a non-negative long."""
    return c.cast(T.LongType()).bitwiseAND(F.lit(0xFFFFFFFF))


def photon_counts(photons: DataFrame) -> DataFrame:
    """tile_id, archive_id, n_photons: distinct photons recorded under each key.

    A photon is named by the low 32 bits of both ids; rows without both are no photon. Keys
    with a null part are left out.
    """
    rows = photons.where("tile_id is not null and archive_id is not null")
    return counts_by_key(rows, ["tile_id", "archive_id"], [low32(F.col("run_id")), low32(F.col("event_id"))]).select(
        "tile_id", "archive_id", F.col("n_values").alias("n_photons")
    )


def stated_counts(block_outputs: DataFrame) -> DataFrame:
    """tile_id, archive_id, stated: sum of nrows over the latest row of each path.

    The latest row is the one with the greatest written_at (a null one is the oldest; of equal
    ones the greatest nrows). A null nrows counts as zero, rows without a path are no file.
    """
    latest = F.max(F.struct("written_at", "nrows", "tile_id", "archive_id")).alias("r")
    return (
        block_outputs.where("path is not null")
        .groupBy("path")
        .agg(latest)
        .select("r.tile_id", "r.archive_id", F.coalesce("r.nrows", F.lit(0)).alias("nrows"))
        .where("tile_id is not null and archive_id is not null")
        .groupBy("tile_id", "archive_id")
        .agg(F.sum("nrows").alias("stated"))
    )


def photon_accounting(photons: DataFrame, block_outputs: DataFrame) -> DataFrame:
    """tile_id, archive_id, n_photons, stated: both counts beside each other, 0 where absent."""
    return (
        photon_counts(photons)
        .join(stated_counts(block_outputs), ["tile_id", "archive_id"], "full")
        .select(
            "tile_id",
            F.col("archive_id").cast("int").alias("archive_id"),
            F.coalesce("n_photons", F.lit(0)).cast("long").alias("n_photons"),
            F.coalesce("stated", F.lit(0)).cast("long").alias("stated"),
        )
    )
