"""What a search and a preparation leave behind: records, summaries, partitioned tables, manifests."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skydrift.config import WINDOW_START


def canonical_hash(value: object) -> str:
    """SHA-256 of JSON with sorted keys and no blanks."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def write_if_changed(path: str, text: str) -> bool:
    """Replaces a small text file in one step, unless it holds that text already."""
    if os.path.exists(path):
        with open(path) as f:
            if f.read() == text:
                return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        f.write(text)
    os.replace(tmp, path)
    return True


def write_slim_json(records: DataFrame, path: str) -> int:
    """A JSON array of records, one key a line with nested values inline; '[]' if there are none.

    Records stream through the driver one by one: a search's result, a few hundred tracks.
    """
    def lines(rows: Iterator) -> Iterator[str]:
        for n, r in enumerate(rows):
            body = ",\n".join(f"    {json.dumps(k)}: {json.dumps(v)}" for k, v in r.asDict(recursive=True).items())
            yield (",\n" if n else "") + "  {\n" + body + "\n  }"

    n = 0
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        f.write("[")
        for n, part in enumerate(lines(records.toLocalIterator()), 1):
            f.write(("\n" if n == 1 else "") + part)
        f.write("\n]\n" if n else "]\n")
    os.replace(tmp, path)
    return n


def write_blocks(photons: DataFrame, root: str, block_seconds: float = 91.25 * 86400, mode: str = "overwrite") -> None:
    """Photons by tile and time block, sorted by time inside; only partitions written to are replaced.

    A busy tile is spread over several files by a hash of the event, quiet ones get one file each.
    """
    p = photons.withColumn("block_index", F.floor((F.col("time_met") - WINDOW_START) / block_seconds).cast("int"))
    p = p.repartition("tile_id", "block_index", F.pmod(F.xxhash64("event_id"), F.lit(4))).sortWithinPartitions("tile_id", "block_index", "time_met")
    p.write.mode(mode).option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", 2_000_000).partitionBy("tile_id", "block_index").parquet(root)


def summary(areas: DataFrame) -> DataFrame:
    """One row of diagnostics over scored clusters: counts and percentiles of samples, ratios, masks."""
    p = lambda c, *q: F.percentile(c, F.array(*[F.lit(x / 100) for x in q]))
    return areas.agg(
        F.count(F.lit(1)).alias("measurements"), F.count_if(~F.col("stable")).alias("unstable"), F.count_if(1 - F.col("region_fraction") > 1 / F.col("n_samples")).alias("clipped"),
        p("masked_fraction", 0, 10, 25, 50, 75, 90, 100).alias("masked_percentiles"), p("n_samples", 0, 50, 90, 100).alias("sample_percentiles"),
        p("area_ratio", 0, 50, 90, 100).alias("ratio_percentiles"), F.percentile("sigma", 0.5).alias("median_sigma"),
    )


def threshold_summary(flags: DataFrame) -> DataFrame:
    """Per tile, bin and band: least, median (cut to a whole number) and most of the core thresholds."""
    return flags.groupBy("tile_id", "bin_index", "band").agg(F.min("threshold").alias("least"), F.percentile("threshold", 0.5).cast("int").alias("median"), F.max("threshold").alias("most"))


def batch_summary(records: DataFrame, tiles: DataFrame) -> DataFrame:
    """tile_id, candidate_count of every tile searched, tiles without tracks included."""
    return tiles.select("tile_id").join(records.groupBy("tile_id").agg(F.count(F.lit(1)).alias("candidate_count")), "tile_id", "left").fillna(0, ["candidate_count"])


def select_tiles(tiles: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The tiles asked for; naming one that doesn't exist is an error."""
    known = {r.tile_id for r in tiles.where(F.col("tile_id").isin(*ids)).select("tile_id").collect()}
    if missing := sorted(set(ids) - known):
        raise ValueError(f"no such tiles: {missing}")
    return tiles.where(F.col("tile_id").isin(*ids))


def dataset_violations(photons: DataFrame, histogram: DataFrame, tiles: DataFrame) -> DataFrame:
    """problem, detail: rows outside their block or window, unknown tiles, histogram totals off."""
    from skydrift.config import ENERGY_MAX, ENERGY_MIN, WINDOW_STOP

    t, e = F.col("time_met"), F.col("energy")
    bad = photons.where((t <= WINDOW_START) | (t >= WINDOW_STOP) | (e < ENERGY_MIN) | (e >= ENERGY_MAX) | F.isnan("ra") | F.isnan("dec"))
    rows = bad.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit("rows outside the window").alias("problem"), F.col("n").cast("string").alias("detail"))
    strange = photons.select("tile_id").distinct().join(tiles, "tile_id", "left_anti").select(F.lit("unknown tile").alias("problem"), F.col("tile_id").alias("detail"))
    # a photon lies in several tiles but has one owner: distinct photons must equal the histogram's total
    distinct = photons.select("run_id", "event_id").distinct().agg(F.count(F.lit(1)).alias("a")).withColumn("_k", F.lit(1))
    both = distinct.join(histogram.agg(F.sum("n").alias("b")).withColumn("_k", F.lit(1)), "_k")
    off = both.where("not (a <=> b)").select(F.lit("histogram total").alias("problem"), F.format_string("%s photons, %s counted", F.col("a").cast("string"), F.col("b").cast("string")).alias("detail"))
    return rows.unionByName(strange).unionByName(off)


def close(a: float, b: float) -> bool:
    return abs(a - b) <= 1e-10 + 1e-10 * abs(b)


def release_problems(headline: Mapping[str, object], limits: Sequence[Mapping[str, float]], nodes: Sequence[Mapping[str, float]]) -> list[str]:
    """Relations between published numbers that don't hold.

    headline: observed, null_counts, null_mean, plus_one_probability, upper_limit. Limits and
    response nodes are matched on velocity and photons_per_bin.
    """
    from skydrift.operators.inference import upper_limit

    out, nulls = [], list(headline["null_counts"])
    if not close(sum(nulls) / len(nulls), headline["null_mean"]):
        out.append("null mean")
    if not close((1 + sum(n >= headline["observed"] for n in nulls)) / (len(nulls) + 1), headline["plus_one_probability"]):
        out.append("plus-one probability")
    if abs(upper_limit(nulls, int(headline["observed"])) - headline["upper_limit"]) > 1e-6:
        out.append("upper limit")
    by = {(n["velocity"], n["photons_per_bin"]): n for n in nodes}
    for row in limits:
        node = by.get((row["velocity"], row["photons_per_bin"]))
        if node is None:
            out.append(f"no response at {row['velocity']}, {row['photons_per_bin']}")
        elif not close(headline["upper_limit"] / node["efficiency"], row["source_limit"]):
            out.append(f"source limit at {row['velocity']}, {row['photons_per_bin']}")
    return out
