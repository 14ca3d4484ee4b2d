"""Campaigns of randomised times: no source survives, all else does."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from skydrift.functions import hashing


def time_model(histogram: DataFrame, start: float, width: float, stop: float) -> DataFrame:
    """owner, day, cum_before, cum, total, t0, t1: empirical distribution of times per owner, and of all (owner null)."""
    every = histogram.groupBy("day").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("owner"), "day", "n")
    h = histogram.select(F.col("owner").cast("string"), "day", "n").unionByName(every).where("n > 0")
    w = W.partitionBy("owner").orderBy("day")
    cum = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy("owner"))
    t0 = F.lit(start) + F.col("day") * F.lit(width)
    return h.select("owner", "day", (cum - F.col("n")).alias("cum_before"), cum.alias("cum"), total.alias("total"), t0.alias("t0"), F.least(t0 + F.lit(width), F.lit(stop)).alias("t1"))


def scrambled_times(owned: DataFrame, model: DataFrame, seeds: list[int], keep: list[str]) -> DataFrame:
    """keep..., campaign, null_time: each photon with a time drawn from its owner's distribution, per seed.

    The draw is a hash of the photon's ids and the seed, so copies of a photon in several tiles
    get one time. Owners without photons in the model draw from all. All campaigns are one job;
    the lookup is an equi-join on the owner and a coarse slice of the distribution, with the exact
    interval as residual.
    """
    slices = 64
    known = model.where("owner is not null").select("owner").distinct().select(F.col("owner").alias("_known"))
    p = owned.join(known, owned["owner"] == F.col("_known"), "left")
    p = p.withColumn("_o", F.when(F.col("_known").isNotNull(), F.col("owner")).otherwise("*all*")).drop("_known")
    parts = [hashing.with_draws(p, "run_id", "event_id", s, ("_u", "_f")).withColumn("campaign", F.lit(s)) for s in seeds]
    drawn = parts[0]
    for q in parts[1:]:
        drawn = drawn.unionByName(q)
    drawn = drawn.withColumn("_slice", F.floor(F.col("_u") * slices).cast("int"))
    m = model.withColumn("_o", F.coalesce("owner", F.lit("*all*"))).drop("owner")
    lo = F.floor(F.col("cum_before") / F.col("total") * slices).cast("int")
    hi = F.least(F.floor(F.col("cum") / F.col("total") * slices).cast("int"), F.lit(slices - 1))
    m = m.withColumn("_slice", F.explode(F.sequence(F.greatest(lo - 1, F.lit(0)), hi)))
    target = F.col("_u") * F.col("total")
    got = drawn.join(m, ["_o", "_slice"]).where((target >= F.col("cum_before")) & (target < F.col("cum")))
    return got.select(*keep, "campaign", (F.col("t0") + F.col("_f") * (F.col("t1") - F.col("t0"))).alias("null_time"))


def permuted_times(photons: DataFrame, seed: int, group: str = "tile_id", ident: str = "event_id") -> DataFrame:
    """photons with null_time: the times of each group dealt out anew.

    Row k by id gets the time of row k by a salted hash, so the multiset of times is kept. Ranks
    come from range-partitioned running counts, so a busy tile isn't sorted in one task.
    """
    from skydrift.operators.skew import running_total

    one = photons.withColumn("_one", F.lit(1)).withColumn("_h", F.xxhash64(F.lit(seed), ident))
    a = running_total(one, [group], [ident], "_one").withColumnRenamed("before", "_k").drop("total", "_one", "_h")
    b = running_total(one.select(group, "time_met", ident, "_h", "_one"), [group], ["_h", ident], "_one").select(group, F.col("before").alias("_k"), F.col("time_met").alias("null_time"))
    return a.join(b, [group, "_k"]).drop("_k")
