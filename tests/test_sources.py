import datetime as dt
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.sources import archive, fits, sinks
from skydrift.streaming import ingest


def events(n, seed=0):
    r = np.random.default_rng(seed)
    bits = r.random((n, 32)) < 0.2
    return {"EVENTS": {
        "ENERGY": ("E", r.random(n) * 1e4), "RA": ("D", r.random(n) * 360), "TIME": ("D", r.random(n) * 1e8), "RUN_ID": ("J", r.integers(0, 2**31 - 1, n)), "EVENT_ID": ("K", r.integers(0, 2**62, n)),
        "CONVERSION": ("I", r.integers(0, 2, n)), "EVENT_CLASS": ("32X", bits), "NAME": ("8A", [f"s{i}" for i in range(n)]), "PAIR": ("2D", r.random((n, 2))), "OK": ("L", r.random(n) < 0.5), "B": ("B", r.integers(0, 255, n)),
    }, "GTI": {"START": ("D", [1.0, 5.0]), "STOP": ("D", [4.0, 9.0])}}


def test_fits_round_trip(spark, tmp_path):
    want = {}
    for k in range(3):
        want[k] = events(50 + k, k)
        fits.write_fits(f"{tmp_path}/w{k}.fits", want[k])
        assert os.path.getsize(f"{tmp_path}/w{k}.fits") % 2880 == 0
    got = fits.read_fits(spark, str(tmp_path)).toPandas()
    assert len(got) == 153 and got["file_id"].nunique() == 3
    for k in range(3):
        g, w = got[got["file_id"] == f"{tmp_path}/w{k}.fits"].reset_index(drop=True), want[k]["EVENTS"]
        for c in ("RA", "TIME", "RUN_ID", "EVENT_ID", "CONVERSION", "OK", "B"):
            assert (g[c].to_numpy() == np.asarray(w[c][1])).all(), c
        assert np.allclose(g["ENERGY"], np.asarray(w["ENERGY"][1], np.float32)) and g["NAME"].tolist() == w["NAME"][1]
        assert (np.stack(g["EVENT_CLASS"]) == w["EVENT_CLASS"][1]).all() and np.allclose(np.stack(g["PAIR"]), w["PAIR"][1])
    gti = fits.read_fits(spark, f"{tmp_path}/w0.fits", "GTI")
    assert [(r.START, r.STOP) for r in gti.orderBy("START").collect()] == [(1.0, 4.0), (5.0, 9.0)]
    assert fits.schema_differences([f"{tmp_path}/w{k}.fits" for k in range(3)]) == []
    fits.write_fits(f"{tmp_path}/x.fits", {"EVENTS": {"RA": ("E", [1.0])}})
    assert fits.schema_differences([f"{tmp_path}/w0.fits", f"{tmp_path}/x.fits"]) == [f"{tmp_path}/x.fits"]
    with pytest.raises(ValueError):
        list(fits.read_table(f"{tmp_path}/x.fits", "EVENTS", ["DEC"]))
    with pytest.raises(ValueError):
        fits.find(f"{tmp_path}/x.fits", "GTI")


def test_exposure_cube(spark, tmp_path):
    cube = np.arange(2 * 3 * 4, dtype=float).reshape(2, 3, 4) + 1
    head = {"CTYPE1": "RA---CAR", "CTYPE2": "DEC--CAR"}
    fits.write_fits(f"{tmp_path}/c.fits", {"ENERGIES": {"ENERGY": ("D", [1000.0, 100000.0])}}, (cube, head))
    got = fits.exposure_rows(spark, f"{tmp_path}/c.fits")
    assert got.count() == 24 and got.where("layer = 1 and iy = 2 and ix = 3").first().exposure == 24 and got.where("layer = 1").first().energy == 100000.0
    fits.write_fits(f"{tmp_path}/d.fits", {"ENERGIES": {"ENERGY": ("D", [2.0, 1.0])}}, (cube, head))
    with pytest.raises(ValueError):
        fits.exposure_rows(spark, f"{tmp_path}/d.fits")


def test_archive_versions_gaps_and_inventory(spark, tmp_path, rows):
    names = ["a_w009_p305_v001.fits", "b_w009_p305_v002.fits", "a_w009_p305_v002.fits", "x_w012_p305_v001.fits", "readme.txt"]
    l = archive.latest_versions(spark.createDataFrame([(n,) for n in names], "path string"))  # noqa: E741
    assert rows(l, "week", "version", "path") == [(12, 1, "x_w012_p305_v001.fits"), (9, 2, "a_w009_p305_v002.fits")]
    assert [r.week for r in archive.missing_weeks(l, 9, 12, (10,)).collect()] == [11]
    for n in ("p", "q"):
        (tmp_path / n).write_text(n)
    found = archive.inventory(spark, f"file://{tmp_path}")
    stated = found.withColumn("sha256", F.when(F.col("path").endswith("p"), "x").otherwise(F.col("sha256"))).union(spark.createDataFrame([("gone", 1, "h")], found.schema))
    assert {(r.path[-4:], r.problem) for r in archive.inventory_differences(stated, found).collect()} == {("gone", "missing"), (found.where("path like '%p'").first().path[-4:], "hash")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.5, 2.0], {"a": 1})], "n int, v array<double>, m map<string,int>")
    assert sinks.write_slim_json(df, f"{tmp_path}/a.json") == 1 and json.load(open(f"{tmp_path}/a.json")) == [{"n": 1, "v": [1.5, 2.0], "m": {"a": 1}}]
    assert sinks.write_slim_json(df.limit(0), f"{tmp_path}/b.json") == 0 and open(f"{tmp_path}/b.json").read() == "[]\n"
    assert sinks.write_if_changed(f"{tmp_path}/c/t", "x") and not sinks.write_if_changed(f"{tmp_path}/c/t", "x")
    assert sinks.canonical_hash({"b": 1, "a": 2}) == sinks.canonical_hash({"a": 2, "b": 1})
    tiles = spark.createDataFrame([("a",), ("b",)], "tile_id string")
    assert {(r.tile_id, r.candidate_count) for r in sinks.batch_summary(spark.createDataFrame([("a",)], "tile_id string"), tiles).collect()} == {("a", 1), ("b", 0)}
    with pytest.raises(ValueError):
        sinks.select_tiles(tiles, ["a", "z"])


def test_release_relations():
    from skydrift.operators.inference import upper_limit

    nulls = [5, 6, 7, 9, 4, 6, 5, 7, 8, 6, 5, 6]
    head = {"observed": 8, "null_counts": nulls, "null_mean": sum(nulls) / 12, "plus_one_probability": 3 / 13, "upper_limit": upper_limit(nulls, 8)}
    node = {"velocity": 0.5, "photons_per_bin": 35.0, "efficiency": 0.8}
    limit = {"velocity": 0.5, "photons_per_bin": 35.0, "source_limit": head["upper_limit"] / 0.8}
    assert sinks.release_problems(head, [limit], [node]) == []
    assert sinks.release_problems({**head, "null_mean": 6.0}, [{**limit, "source_limit": 1.0}, {**limit, "velocity": 9.0}], [node]) == ["null mean", "source limit at 0.5, 35.0", "no response at 9.0, 35.0"]


def photon(i, when, **kw):
    base = {"run_id": 1, "event_id": i, "tile_id": "a", "ra": 10.0, "dec": 1.0, "energy": 2000.0, "time_met": 5e8 + i, "zenith": 10.0, "event_class": 128, "ingested_at": when}
    return tuple({**base, **kw}.values())


SCHEMA = "run_id long, event_id long, tile_id string, ra double, dec double, energy double, time_met double, zenith double, event_class long, ingested_at timestamp"


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    batches = [[photon(i, t0) for i in range(20)], [photon(i, t0 + dt.timedelta(days=1)) for i in range(10, 30)] + [photon(99, t0, zenith=100.0)]]
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for k, b in enumerate(batches):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        q = ingest.ingest(stream, out, f"{tmp_path}/cp")
        q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted(r.event_id for r in got.collect()) == list(range(30)) and {r.tile_id for r in got.select("tile_id").distinct().collect()} == {"a"}


def test_dataset_violations(spark):
    t0 = dt.datetime(2024, 1, 1)
    good = spark.createDataFrame([photon(1, t0), photon(2, t0), photon(2, t0, tile_id="b")], SCHEMA)
    tiles = spark.createDataFrame([("a",), ("b",)], "tile_id string")
    hist = spark.createDataFrame([("a", 0, 2)], "owner string, day int, n long")
    assert sinks.dataset_violations(good, hist, tiles).count() == 0
    bad = good.union(spark.createDataFrame([photon(3, t0, energy=1.0, tile_id="z")], SCHEMA))
    assert {r.problem for r in sinks.dataset_violations(bad, hist, tiles).collect()} == {"rows outside the window", "unknown tile", "histogram total"}
