import json
import os

import pytest
from pyspark.sql import functions as F

from skydrift.config import WINDOW_START, SearchConfig
from skydrift.operators import inject
from skydrift.plans import batch, prepare


@pytest.fixture(scope="module")
def survey(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('survey')}"
    tiles = [("roi_001", 10.0, 0.0), ("roi_002", 20.0, 0.0), ("roi_003", 200.0, 40.0)]
    spark.createDataFrame(tiles, "tile_id string, ra_degrees double, dec_degrees double").write.parquet(f"{at}/tiles")
    n = F.col("id")
    rows = spark.range(4000).select(
        F.when(n % 2 == 0, "a").otherwise("b").alias("file_id"), (n % 7).alias("run_id"), n.alias("event_id"), (10 + (n * 0.618) % 10).alias("ra"), ((n * 0.31) % 4 - 2).alias("dec"), F.lit(2000.0).alias("energy"),
        (F.lit(WINDOW_START) + 1 + n * 78000.0).alias("time_met"), F.lit(10.0).alias("zenith"), F.lit(128).cast("long").alias("event_class"),
    )
    rows.write.parquet(f"{at}/photons")
    spark.createDataFrame([("s", 100.0, 0.0, 1.0)], "source_name string, ra double, dec double, flux1000 double").write.parquet(f"{at}/sources")
    return at


def test_preparation_is_resumed_where_it_stopped(spark, survey, tmp_path):
    root, read = str(tmp_path / "d"), lambda n: spark.read.parquet(f"{survey}/{n}")
    gti = spark.createDataFrame([("a", 0.0, 1e9), ("b", 0.0, WINDOW_START + 1e7)], "file_id string, start double, stop double")
    mark = prepare.file_signature(spark, f"{survey}/photons")
    options = prepare.Preparation(radius=9.0, block_seconds=1e8)
    prepare.write_geometry(read("tiles"), root, 9.0)
    assert prepare.prepare(read("photons"), read("tiles"), root, mark, gti, options) == [0, 1, 2, 3]
    assert prepare.prepare(read("photons"), read("tiles"), root, mark, gti, options) == []
    got = spark.read.parquet(f"{root}/photons")
    n_rows = got.count()
    kept = got.select("run_id", "event_id").distinct().count()
    assert kept == prepare.histogram(spark, root).agg(F.sum("n")).first()[0] and 2000 < kept < 2200
    assert {r.file_id for r in got.where(f"time_met > {WINDOW_START + 1e7}").select("file_id").distinct().collect()} == {"a"}
    clipped = spark.read.parquet(f"{root}/gti")
    assert clipped.where("block_index = 1 and file_id = 'a'").first().stop - clipped.where("block_index = 1 and file_id = 'a'").first().start == 1e8 and clipped.where("file_id = 'b'").count() == 1
    identity = prepare.write_manifest(spark, root, mark, options)
    assert prepare.verify(spark, root, read("tiles")) == [] and identity == prepare.write_manifest(spark, root, mark, options)
    os.remove(f"{root}/blocks_done/002.json")
    assert prepare.prepare(read("photons"), read("tiles"), root, mark, gti, options) == [2] and spark.read.parquet(f"{root}/photons").count() == n_rows
    assert prepare.prepare(read("photons"), read("tiles"), root, "other inputs", gti, options) == [0, 1, 2, 3]
    part = next(d for d, _, f in os.walk(f"{root}/photons/tile_id=roi_001/block_index=0") if f)
    os.remove(os.path.join(part, next(f for f in os.listdir(part) if f.endswith(".parquet"))))
    assert prepare.verify(spark, root, read("tiles"))
    assert json.load(open(f"{root}/roi_002/query_info.json"))["ra_degrees"] == 20.0 and len(open(f"{root}/tile_centers.csv").readlines()) == 4


def test_options_fingerprints_dumps_and_stationary_mode(spark, survey, tmp_path):
    run, config = batch.parse([f"{survey}/photons", f"{survey}/sources", f"{survey}/tiles", f"file://{tmp_path}/o", "--radius", "9", "--tile", "roi_001", "--bin-dump", "--stationary", "--least-photons", "7", "--min-sigma", "3.5"])
    assert config == SearchConfig(least_photons=7, min_sigma=3.5) and run.only == ("roi_001",) and run.stationary
    again = batch.parse(batch.search_command(run, config)[4:])
    assert again == (run, config)
    with pytest.raises(ValueError):
        batch.Run("a", "b", "c", "d", stationary=True)
    a = batch.run_fingerprint(spark, run, config)
    assert a != batch.run_fingerprint(spark, run, SearchConfig()) and a == batch.run_fingerprint(spark, *again)
    assert batch.run_search(spark, run, config) == "done"
    assert spark.read.parquet(f"{run.out}/detections").columns == list(batch.DUMP) and spark.read.parquet(f"{run.out}/tracks").count() == 0
    assert [(r.tile_id, r.candidate_count) for r in spark.read.parquet(f"{run.out}/summary").collect()] == [("roi_001", 0)]
    skip = batch.parse([*batch.search_command(run, config)[4:], "--skip-existing"])
    assert batch.run_search(spark, *skip) == "skipped"
    assert batch.run_search(spark, skip[0], SearchConfig()) == "done"


def test_deduplication_report(spark):
    rows = [("c", f"t{k}", f"roi_{k}", b, 10.0 + 0.01 * k, 0.0, 1.0 + k) for k in range(3) for b in range(4)] + [("c", "far", "roi_9", b, 50.0, 0.0, 1.0) for b in range(4)]
    p = spark.createDataFrame(rows, "campaign string, id string, tile_id string, bin_index int, ra double, dec double, sigma double")
    g = {r.representative: (r.n_members, r.members) for r in batch.group_report(p, SearchConfig()).collect()}
    assert g == {"t2": (3, ["t2", "t1", "t0"]), "far": (1, ["far"])}
    d = {r.campaign: (r.n_tracks, r.n_groups, r.n_merged, r.largest, r.found) for r in batch.deduplication_report(p, SearchConfig(), ["c", "lost"]).collect()}
    assert d == {"c": (4, 2, 2, 3, True), "lost": (0, 0, 0, 0, False)}


def test_injected_rows_go_to_the_tiles_that_hold_the_source(spark, survey):
    p = spark.read.parquet(f"{survey}/photons").withColumn("bin_index", (F.col("event_id") % 10).cast("int"))
    truth = inject.track_truth(spark, 10.0, 0.0, 0.1, 0.0)
    got = inject.injected_tiles(p, spark.read.parquet(f"{survey}/tiles"), truth, 5, 3, radius=12.0)
    assert {(r.cap_tile, r["count"]) for r in got.groupBy("cap_tile").count().collect()} == {("roi_001", 50), ("roi_002", 50)}
