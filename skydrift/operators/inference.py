"""What campaign counts say: tail probabilities, limits, intervals, consistency."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def plus_one(nulls: DataFrame, observed: int, column: str = "n_tracks") -> DataFrame:
    """One row: n, at_least, p (plus-one probability), mean, sd (ddof 1; 0 of one value), deviation, dispersion."""
    c = F.col(column)
    a = nulls.agg(F.count(c).alias("n"), F.count_if(c >= observed).alias("at_least"), F.avg(c).alias("mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias("sd"))
    return a.select(
        "n", "at_least", ((1 + F.col("at_least")) / (F.col("n") + 1)).alias("p"), "mean", "sd", F.when(F.col("sd") > 0, (observed - F.col("mean")) / F.col("sd")).alias("deviation"),
        F.when(F.col("mean") > 0, F.col("sd") * F.col("sd") / F.col("mean")).alias("dispersion"),
    )


def gaussian_equivalent(p: float) -> float:
    return NormalDist().inv_cdf(1 - p)


def _poisson_cdf(k: int, mu: float) -> float:
    if k < 0:
        return 0.0
    if mu == 0:
        return 1.0
    return math.fsum(math.exp(i * math.log(mu) - mu - math.lgamma(i + 1)) for i in range(k + 1))


def upper_limit(nulls: Sequence[int], observed: int, level: float = 0.90) -> float:
    """Signal at which the plus-one probability of seeing no more than observed falls to 1 - level.

    Each null count is a background that a Poisson signal is added to. The counts are those of a
    few dozen campaigns, so this is arithmetic on the driver.
    """
    def tail(s: float) -> float:
        return (1 + math.fsum(_poisson_cdf(observed - b, s) for b in nulls)) / (len(nulls) + 1)

    low, high = 0.0, 1.0
    if tail(0.0) <= 1 - level:
        return 0.0
    while tail(high) > 1 - level:
        high *= 2
        if high > 1e9:
            raise ValueError("too few campaigns for this level")
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if tail(mid) > 1 - level else (low, mid)
    return (low + high) / 2


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson interval of a share."""
    p, n = k / n, n.cast("double")
    d = 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half


def source_limits(nodes: DataFrame, limit: float) -> DataFrame:
    """nodes (velocity, photons_per_bin, efficiency) with source_limit; null where nothing is recovered."""
    return nodes.withColumn("source_limit", F.when(F.col("efficiency") > 0, F.lit(limit) / F.col("efficiency")))


def survey_efficiency(bands: DataFrame) -> DataFrame:
    """One row: efficiency, weighted by tiles."""
    return bands.agg((F.sum(F.col("tiles") * F.col("efficiency")) / F.sum("tiles")).alias("efficiency"))


def poisson_validation(cells: DataFrame) -> DataFrame:
    """One row: observed, predicted, sd, z over independent cells (observed, predicted, sd)."""
    a = cells.agg(F.sum("observed").alias("observed"), F.sum("predicted").alias("predicted"), F.sqrt(F.sum(F.col("sd") * F.col("sd"))).alias("sd"))
    return a.withColumn("z", F.when(F.col("sd") > 0, (F.col("observed") - F.col("predicted")) / F.col("sd")))


def paired_binomial(k: int, n: int) -> float:
    """Two-sided probability of k or fewer of n fair outcomes."""
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(min(k, n - k) + 1)) / 2**n)


def trapezoid(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, integral of y over x."""
    w = W.partitionBy(*keys).orderBy(x)
    area = 0.5 * (F.col(y) + F.lag(y).over(w)) * (F.col(x) - F.lag(x).over(w))
    return df.withColumn("_a", area).groupBy(*keys).agg(F.sum("_a").alias("integral"))


def sample_statistics(counts: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, mean, sd (0 of one value), standard_error."""
    a = counts.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    return a.withColumn("standard_error", F.col("sd") / F.sqrt("n"))


def campaign_subsets(counts: DataFrame, calibration: Sequence[int], validation: Sequence[int], value: str = "n_tracks") -> DataFrame:
    """subset (calibration, validation, combined) with sample statistics; the sets may overlap, combined counts a seed once."""
    seed = F.col("campaign")
    member = F.array_compact(F.array(F.when(seed.isin(*calibration), F.lit("calibration")), F.when(seed.isin(*validation), F.lit("validation")), F.when(seed.isin(*calibration, *validation), F.lit("combined"))))
    return sample_statistics(counts.select(F.explode(member).alias("subset"), value), value, ["subset"])


def missing_seeds(counts: DataFrame, expected: Sequence[int]) -> DataFrame:
    """Expected campaigns without a result."""
    want = counts.sparkSession.createDataFrame([(int(s),) for s in expected], "campaign int")
    return want.join(counts.select(F.col("campaign").cast("int")).distinct(), "campaign", "left_anti")


def repeated_seeds(counts: DataFrame) -> DataFrame:
    return counts.groupBy("campaign").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def empirical_cdf(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, value, share: the share of rows with values up to each distinct one. Values are counted first, so repeated ones are one row."""
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*keys)
    return counts.select(*keys, value, (F.sum("_n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, 0)) / F.sum("_n").over(w)).alias("share"))


def ks_distance(cdf: DataFrame, expected: Column, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, distance: the greatest distance of an empirical_cdf from an expected one, on either side of each step."""
    before = F.coalesce(F.lag("share").over(W.partitionBy(*keys).orderBy(value)), F.lit(0.0))
    d = cdf.select(*keys, F.greatest(F.abs(F.col("share") - expected), F.abs(before - expected)).alias("_d"))
    return d.groupBy(*keys).agg(F.max("_d").alias("distance"))


def volume_change(coarse: DataFrame, primary: DataFrame, keys: Sequence[str], volume: str = "volume") -> DataFrame:
    """keys, change: coarse / primary - 1 where both have a volume; null where the primary one is 0."""
    a, b = coarse.select(*keys, F.col(volume).alias("_a")), primary.select(*keys, F.col(volume).alias("_b"))
    return a.join(b, list(keys)).select(*keys, F.when(F.col("_b") != 0, F.col("_a") / F.col("_b") - 1).alias("change"))


def release_differences(limits: DataFrame, nodes: DataFrame, upper: float, keys: Sequence[str] = ("velocity", "photons_per_bin"), tolerance: float = 1e-10) -> DataFrame:
    """keys, problem: published source limits (source_limit) that don't follow from the upper limit and the response (efficiency) there."""
    j = limits.select(*keys, "source_limit").join(nodes.select(*keys, "efficiency", F.lit(True).alias("_has")), list(keys), "left")
    want = F.lit(float(upper)) / F.col("efficiency")
    off = F.abs(F.col("source_limit") - want) > tolerance + tolerance * F.abs(want)
    return j.select(*keys, F.when(F.col("_has").isNull(), "no response").when((F.col("efficiency") > 0) & off, "source limit").alias("problem")).where("problem is not null")
