"""The search as a batch: options, fingerprints, skipping what is there, dumps, the stationary mode and reports."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.config import SearchConfig
from skydrift.operators import tracks as T
from skydrift.plans import pipeline
from skydrift.plans.prepare import file_signature
from skydrift.sources import sinks

#: Columns of the dump of detections.
DUMP = ("tile_id", "bin_index", "band", "cand", "c_ra", "c_dec", "n_on", "n_off", "expected_bg", "sigma", "merged_count")


@dataclass(frozen=True)
class Run:
    """What is searched and what is left behind."""

    photons: str
    catalogue: str
    tiles: str
    out: str
    radius: float = 18.0
    only: tuple[str, ...] = ()
    cuts: bool = True
    own: bool = True
    skip_existing: bool = False
    bin_dump: bool = False
    pre_tube_dump: bool = False
    stationary: bool = False
    bypass_motion: bool = False

    def __post_init__(self) -> None:
        if self.stationary and not self.bin_dump:
            raise ValueError("the stationary mode leaves nothing but the dump of detections: ask for it")


def run_fingerprint(spark: SparkSession, run: Run, config: SearchConfig) -> str:
    """What a result depends on: inputs by their files, the options, the configuration."""
    inputs = {k: file_signature(spark, getattr(run, k)) for k in ("photons", "catalogue", "tiles")}
    options = {k: v for k, v in asdict(run).items() if k not in ("photons", "catalogue", "tiles", "out", "skip_existing")}
    return sinks.canonical_hash({"inputs": inputs, "options": options, "config": asdict(config)})


def read_fingerprint(spark: SparkSession, out: str) -> str | None:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/fingerprint")
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.text(f"{out}/fingerprint").first().value


def run_search(spark: SparkSession, run: Run, config: SearchConfig = SearchConfig()) -> str:
    """'skipped' or 'done'. Leaves tracks, summary (tracks per tile) and the dumps asked for in ``out``; the fingerprint is written last.

    The stationary mode writes the detections, no tracks, and links nothing.
    """
    mark = run_fingerprint(spark, run, config)
    if run.skip_existing and read_fingerprint(spark, run.out) == mark:
        return "skipped"
    tiles = spark.read.parquet(run.tiles)
    searched = sinks.select_tiles(tiles, run.only) if run.only else tiles
    region = searched.select("tile_id", "ra_degrees", "dec_degrees").withColumn("analysis_radius_degrees", F.lit(float(run.radius)))
    found = pipeline.candidates(spark.read.parquet(run.photons), spark.read.parquet(run.catalogue), region, config, run.cuts)
    save = lambda df, name: df.write.mode("overwrite").parquet(f"{run.out}/{name}")
    if run.bin_dump:
        save(found.select(*DUMP), "detections")
    linked = pipeline.linked(found, config)
    if run.stationary:
        records = T.track_records(pipeline.chosen(linked.limit(0), found, config), found, config)
    else:
        if run.pre_tube_dump:
            save(linked, "tracks_before_motion")
        records = T.track_records(pipeline.chosen(linked, found, config, run.bypass_motion), found, config)
        records = T.owned_records(records, tiles) if run.own else records
    save(records, "tracks")
    kept = spark.read.schema(records.schema).parquet(f"{run.out}/tracks")
    save(sinks.batch_summary(kept, searched), "summary")
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.mode("overwrite").text(f"{run.out}/fingerprint")
    return "done"


def group_report(points: DataFrame, config: SearchConfig) -> DataFrame:
    """campaign, representative, n_members, members (strongest first) of tracks merged across tiles, those of one tile included."""
    groups = T.cross_tile_groups(points, config)
    score = points.groupBy("campaign", "id").agg(F.sum("sigma").alias("score"))
    item = F.struct((-F.col("score")).alias("s"), "id")
    return groups.join(score, ["campaign", "id"]).groupBy("campaign", "representative").agg(F.count(F.lit(1)).cast("int").alias("n_members"), F.transform(F.array_sort(F.collect_list(item)), lambda m: m["id"]).alias("members"))


def deduplication_report(points: DataFrame, config: SearchConfig, expected: Sequence[str] = ()) -> DataFrame:
    """campaign, n_tracks, n_groups, n_merged, largest, found: what merging leaves of each campaign; expected ones without tracks come out with zeros."""
    r = group_report(points, config)
    n = F.col("n_members")
    got = r.groupBy("campaign").agg(F.sum(n).alias("n_tracks"), F.count(F.lit(1)).alias("n_groups"), F.sum(n - 1).alias("n_merged"), F.max(n).alias("largest"), F.lit(True).alias("found"))
    if not expected:
        return got
    want = points.sparkSession.createDataFrame([(c,) for c in expected], "campaign string")
    return want.join(got, "campaign", "full").fillna(0, ["n_tracks", "n_groups", "n_merged", "largest"]).fillna(False, ["found"])


def search_command(run: Run, config: SearchConfig = SearchConfig()) -> list[str]:
    """The command line that repeats a run."""
    out = ["python", "-m", "skydrift", "search", run.photons, run.catalogue, run.tiles, run.out, "--radius", repr(run.radius)]
    for name in ("skip_existing", "bin_dump", "pre_tube_dump", "stationary", "bypass_motion"):
        out += [f"--{name.replace('_', '-')}"] if getattr(run, name) else []
    out += [] if run.cuts else ["--no-cuts"]
    out += [] if run.own else ["--no-own"]
    for t in run.only:
        out += ["--tile", t]
    default = asdict(SearchConfig())
    for k, v in asdict(config).items():
        if k != "bands" and v != default[k]:
            out += [f"--{k.replace('_', '-')}", repr(v)]
    return out


def parse(args: Sequence[str]) -> tuple[Run, SearchConfig]:
    """The options of the command line; every number of SearchConfig is one."""
    import argparse
    from dataclasses import fields

    a = argparse.ArgumentParser(prog="python -m skydrift search")
    for name in ("photons", "catalogue", "tiles", "out"):
        a.add_argument(name)
    a.add_argument("--radius", type=float, default=18.0)
    a.add_argument("--tile", action="append", default=[])
    for name in ("skip-existing", "bin-dump", "pre-tube-dump", "stationary", "bypass-motion", "no-cuts", "no-own"):
        a.add_argument(f"--{name}", action="store_true")
    numbers = [f for f in fields(SearchConfig) if f.name != "bands"]
    for f in numbers:
        a.add_argument(f"--{f.name.replace('_', '-')}", type=type(f.default), default=f.default)
    got = a.parse_args(list(args))
    run = Run(got.photons, got.catalogue, got.tiles, got.out, got.radius, tuple(got.tile), not got.no_cuts, not got.no_own, got.skip_existing, got.bin_dump, got.pre_tube_dump, got.stationary, got.bypass_motion)
    return run, SearchConfig(**{f.name: getattr(got, f.name) for f in numbers})


def write_summary(path: str, areas: DataFrame, flags: DataFrame, n_tracks: int) -> bool:
    """summary.json of a run: samples, ratios, clipped and masked shares, core thresholds, tracks; whether it changed."""
    body = {"background": sinks.summary(areas).first().asDict(), "n_tracks": n_tracks}
    rows = sinks.threshold_summary(flags).agg(F.min("least").alias("least"), F.percentile("median", 0.5).alias("median"), F.max("most").alias("most")).first()
    return sinks.write_if_changed(path, json.dumps({**body, "thresholds": rows.asDict()}, indent=1, sort_keys=True))
