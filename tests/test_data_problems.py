import datetime as dt
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.operators import compaction, nearby, skew

T0 = dt.datetime(2024, 1, 1)


def photons(spark, rows):
    return spark.createDataFrame(rows, "run_id long, event_id long, tile_id string, archive_id int, ra double, dec double, w string, v string")


# ---------------------------------------------------------------- skewed keys


def test_photon_accounting_dirty_rows(spark, rows):
    big = 1 << 32
    p = photons(spark, [
        (5, 7, "a", 1, 0.0, 0.0, "x", "y"), (5 + big, 7 - big, "a", 1, 1.0, 1.0, None, None), (5, 8, "a", 1, None, None, None, None),
        (None, 9, "a", 1, 0.0, 0.0, None, None), (5, 7, None, 1, 0.0, 0.0, None, None), (5, 7, "a", None, 0.0, 0.0, None, None), (1, 1, "b", 2, math.nan, 0.0, None, None),
    ])
    later = T0 + dt.timedelta(days=1)
    b = spark.createDataFrame(
        [("a", 1, "p1", 5, T0), ("a", 1, "p1", 2, later), ("a", 1, "p1", 2, later), ("c", 3, "p2", None, T0), ("d", 4, "p3", 7, None), (None, 4, "p4", 7, T0), ("e", 5, None, 7, T0)],
        "tile_id string, archive_id int, path string, nrows long, written_at timestamp",
    )
    got = rows(skew.photon_accounting(p, b))
    assert got == sorted([("a", 1, 2, 2), ("b", 2, 1, 0), ("c", 3, 0, 0), ("d", 4, 0, 7)], key=repr)
    assert rows(skew.photon_accounting(p.limit(0), b.limit(0))) == []
    assert ("a", 1, 2, 0) in rows(skew.photon_accounting(p, b.limit(0)))


def test_percentiles_and_modes_with_a_hot_key(spark):
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.6 else rng.choice("abc"), float(rng.randint(0, 40))) for _ in range(3000)] + [("hot", None), ("z", None), (None, 3.0), ("hot", math.nan)]
    df = spark.createDataFrame(data, "k string, x double")
    got = {(r.k, r.p): r.value for r in skew.percentiles_by_key(df, ["k"], F.col("x"), [0.0, 0.25, 0.5, 0.99, 1.0]).collect()}
    for k in {k for k, _ in data}:
        v = [x for q, x in data if q == k and x is not None and x == x]
        for p in (0.0, 0.25, 0.5, 0.99, 1.0):
            if v:
                assert abs(got.pop((k, p)) - np.percentile(v, 100 * p)) < 1e-9
    assert not got
    modes = {r.k: (r.mode, r.mode_rows) for r in skew.modes_by_key(df.where("x is null or not isnan(x)"), ["k"], F.col("x")).collect()}
    assert modes["z"] == (None, 0) and modes[None] == (3.0, 1)
    v = [x for q, x in data if q == "hot" and x is not None and x == x]
    best = max(set(v), key=lambda x: (v.count(x), -x))
    assert modes["hot"] == (best, v.count(best))


def test_running_total_ties_and_empty(spark):
    df = spark.createDataFrame([("k", i % 5, 1) for i in range(50)], "k string, o int, w int")
    got = skew.running_total(df, ["k"], ["o"], "w").collect()
    assert sorted(r.before for r in got) == list(range(50)) and {r.total for r in got} == {50}
    assert all(r.before // 10 == r.o for r in got)
    assert skew.running_total(df.limit(0), ["k"], ["o"], "w").count() == 0


# ---------------------------------------------------------------- neighbourhoods


def places(spark, pts):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, ra double, dec double")


def sky(rng, n):
    return [(rng.uniform(-360, 720), math.degrees(math.asin(rng.uniform(-1, 1)))) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"max_broadcast": 3, "rows_per_task": 40}])
def test_discs_and_cells_by_brute_force(spark, how):
    rng = random.Random(7)
    pts = sky(rng, 400) + [(0.0, 90.0), (123.0, -90.0), (359.9999, 0.0), (360.0, 0.0), (-1e-14, 10.0)] + [(10.0, 10.0)] * 60
    discs = [(f"s{i}", *sky(rng, 1)[0], rng.choice((0.5, 4.0, 25.0, 120.0))) for i in range(40)] + [("pole", 0.0, 90.0, 3.0), ("turn", 359.5, 0.0, 1.0), ("whole", 5.0, 5.0, 180.0), ("dot", 10.0, 10.0, 0.0)]
    cells = [(f"c{i:02d}", *sky(rng, 1)[0]) for i in range(30)]
    d = spark.createDataFrame(discs + discs[:5] + [("none", 1.0, 1.0, None), ("nan", 1.0, 1.0, math.nan), (None, 1.0, 1.0, 2.0), ("far", 1.0, 95.0, 2.0)], "name string, ra double, dec double, radius double")
    c = spark.createDataFrame(cells + cells[:3], "name string, ra double, dec double")
    got = {(r.id, r.near_kind, r.target) for r in nearby.near_regions(places(spark, pts), ["id"], d, cells=c, sample_rows=100, leaves=16, **how).collect()}
    want = set()
    for i, (a, b) in enumerate(pts):
        want |= {(i, "disc", s) for s, x, y, r in discs if nearby.separation(a, b, x, y) <= r}
        want.add((i, "cell", min(cells, key=lambda t: (nearby.separation(a, b, t[1], t[2]), t[0]))[0]))
    assert got == want


def test_neighbourhood_edge_cases(spark, rows):
    p = spark.createDataFrame(
        [(1, 1, 10.0, 10.0, "a", 0.0), (1, 1, 10.0, 10.0, "a", 1.0), (2, 2, None, 10.0, "a", 0.0), (3, 3, math.nan, 1.0, None, 0.0), (4, 4, 10.0, 90.5, "a", 0.0), (5, 5, math.inf, 1.0, "a", 0.0),
         (6, 6, 370.0, 10.0, None, 0.0), (7, 7, -350.0, 10.0, "zz", 0.0), (None, 8, 10.0, 10.0, "b", 0.0)],
        "run_id long, event_id long, ra double, dec double, tile_id string, target double",
    )
    cat = spark.createDataFrame([("s", 10.0, 10.0, 0.5, "x"), ("t", 200.0, 0.0, 0.5, "x")], "source_name string, ra double, dec double, mask_radius_degrees double, run_id string")
    tiles = spark.createDataFrame([("a", 10.0, 12.0), ("b", 190.0, 0.0)], "tile_id string, ra_degrees double, dec_degrees double")
    got = rows(nearby.photon_surroundings(p, cat, tiles))
    assert got == sorted([(i, i, "source", "s") for i in (1, 6, 7)] + [(6, 6, "tile", "a"), (7, 7, "tile", "a")], key=repr)
    assert rows(nearby.photon_surroundings(p.limit(0), cat, tiles)) == []
    assert {r[2] for r in rows(nearby.photon_surroundings(p, cat.limit(0), tiles))} == {"tile"}
    assert {r[2] for r in rows(nearby.photon_surroundings(p, cat, tiles.limit(0)))} == {"source"}


# ---------------------------------------------------------------- small files


def test_canonical_paths(spark):
    cases = {
        "/srv/fps/d/a/events_block_000.fits": "/srv/fps/d/a/events_block_000.fits", "d/a/x": "/srv/fps/d/a/x", "./d//a/x ": "/srv/fps/d/a/x", "\t/srv/./fps/d/b/../a/x\n": "/srv/fps/d/a/x",
        "file:///srv/fps/d%5Fa/x%2Fy": "/srv/fps/d_a/x/y", "/srv/fps/d%5Fa": "/srv/fps/d%5Fa", "//srv/fps/a/b/../../c": "/srv/fps/c", "/../x": "/x", "file:///a+b%20c": "/a+b c", "file:///bad%zz": "/bad%zz",
        "   ": None, None: None, "": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    got = {r.path: r.c for r in df.select("path", compaction.canonical_path(F.col("path")).alias("c")).collect()}
    assert got == cases


def listing(spark, rows):
    return spark.createDataFrame(rows, "listing_no long, path string, size long, output string")


def test_plan_takes_each_small_file_once(spark):
    d = "/srv/fps/d/arch_001/roi_001/"
    rows = [(9, d + "events_block_001.fits", 10, "x"), (3, d + "./events_block_001.fits", 10, "x"), (4, d + "events_block_002.fits", None, None), (5, d + "events_block_003.fits", 0, None),
            (6, d + "events_block_004.fits.tmp", 10, None), (7, d + "events_block_04.fits", 10, None), (8, d + "events_block_005_s001.fits", 1_048_575, None), (10, d + "events_block_006.fits", 1_048_576, None), (11, None, 5, None),
            (12, "/srv/fps/d/arch_001/roi_002/events_block_001.fits", 7, None)]
    plan = compaction.compaction_plan(listing(spark, rows), target_bytes=1_048_580).collect()
    assert sorted(r.listing_no for r in plan) == [3, 8, 12]
    out = {r.listing_no: r.output for r in plan}
    assert out[3].startswith(d + "events_merged") and out[12].startswith("/srv/fps/events_merged")
    assert compaction.compaction_plan(listing(spark, [])).count() == 0


def test_plan_packs_to_the_target(spark):
    rng = random.Random(1)
    rows = [(i, f"/srv/fps/d/arch_001/roi_001/events_block_{i:03d}.fits", rng.randint(1, 900_000), None) for i in range(400)]
    plan = compaction.compaction_plan(listing(spark, rows), target_bytes=5_000_000).toPandas()
    by = plan.groupby("output")["size"].sum()
    assert len(plan) == 400 and by.max() < 5_000_000 + 900_000 and sorted(by)[1] > 4_000_000


def small_table(spark, root):
    for k in range(6):
        spark.range(k * 50, k * 50 + 50).withColumn("part", (F.col("id") % 2).cast("int")).where(F.lit(k == 0) | (F.col("part") == 1)).repartition(4).write.mode("append").partitionBy("part").parquet(root)


def files(root):
    return {p: len([f for f in os.listdir(f"{root}/{p}") if f.endswith(".parquet")]) for p in ("part=0", "part=1")}


def test_compaction_rewrites_only_crowded_partitions(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    small_table(spark, root)
    before, data = files(f"{tmp_path}/t"), sorted(r.id for r in spark.read.parquet(root).collect())
    done = compaction.compact_table(spark, root, ["part"], max_small=8)
    after = files(f"{tmp_path}/t")
    assert done["partitions"] == 1 and done["version"] == 1 and done["rows"] == 150
    assert after["part=0"] == before["part=0"] and after["part=1"] == 1
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == data
    assert compaction.compact_table(spark, root, ["part"], max_small=8)["partitions"] == 0


def test_compaction_gives_way_to_other_writers(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    small_table(spark, root)
    more = lambda: spark.range(900, 905).withColumn("part", F.lit(1)).write.mode("append").partitionBy("part").parquet(root)
    with pytest.raises(compaction.Conflict):
        compaction.compact_table(spark, root, ["part"], max_small=8, before_commit=more)
    assert spark.read.parquet(root).count() == 180
    with pytest.raises(compaction.Conflict):
        compaction.compact_table(spark, root, ["part"], max_small=8, before_commit=lambda: compaction.commit_snapshot(spark, root, 1))
    assert spark.read.parquet(root).count() == 180 and compaction.snapshot_version(spark, root) == 1


def test_a_quiet_partition_ends_in_one_file_beside_a_busy_one(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    wide = F.concat(*[F.md5((F.col("id") * k).cast("string")) for k in range(1, 6)])
    spark.range(40_000).withColumn("text", wide).withColumn("part", F.lit(0)).repartition(20).write.mode("append").partitionBy("part").parquet(root)
    spark.range(200).withColumn("text", wide).withColumn("part", F.lit(1)).repartition(10).write.mode("append").partitionBy("part").parquet(root)
    data = sorted((r.part, r.id) for r in spark.read.parquet(root).collect())
    done = compaction.compact_table(spark, root, ["part"], small_bytes=500_000, max_small=5, target_bytes=400_000)
    after = files(f"{tmp_path}/t")
    assert done["partitions"] >= 1 and after["part=1"] == 1 and 5 <= after["part=0"] <= 20
    assert sorted((r.part, r.id) for r in spark.read.parquet(root).collect()) == data


@pytest.mark.parametrize("stop", ["before", "parked", "half"])
def test_a_consolidation_broken_off_loses_nothing(spark, tmp_path, monkeypatch, stop):
    root = f"file://{tmp_path}/t"
    for k in range(4):
        spark.range(k * 50, k * 50 + 50).withColumn("part", (F.col("id") % 2).cast("int")).repartition(3).write.mode("append").partitionBy("part").parquet(root)
    swap, calls = compaction._swap, []

    def broken(spark, root, note, part):
        calls.append(part)
        if stop == "parked":
            compaction._move(spark, f"{root}{part}", f"{note['parked']}{part}")
        if stop != "half" or len(calls) > 1:
            raise KeyboardInterrupt
        swap(spark, root, note, part)

    monkeypatch.setattr(compaction, "_swap", broken)
    with pytest.raises(KeyboardInterrupt):
        compaction.compact_table(spark, root, ["part"], max_small=2)
    monkeypatch.setattr(compaction, "_swap", swap)
    if stop == "parked":  # and someone writes into the partition before it is completed
        spark.range(900, 905).withColumn("part", F.lit(0)).write.mode("append").partitionBy("part").parquet(root)
    with pytest.raises(compaction.Conflict):
        compaction.compact_table(spark, root, ["part"], max_small=2)
    assert compaction.recover(spark, root) == 1 and compaction.recover(spark, root) is None
    want = sorted([*range(200), *(range(900, 905) if stop == "parked" else ())])
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == want and compaction.snapshot_version(spark, root) == 1
    assert not os.listdir(f"{tmp_path}/t/_staging") and not os.listdir(f"{tmp_path}/t/_replaced")


def test_rows_that_come_after_the_check_stay(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/t"
    small_table(spark, root)
    claim = compaction._claim

    def late(*a):
        claim(*a)
        if a[1].endswith(".note"):
            spark.range(900, 905).withColumn("part", F.lit(1)).write.mode("append").partitionBy("part").parquet(root)

    monkeypatch.setattr(compaction, "_claim", late)
    assert compaction.compact_table(spark, root, ["part"], max_small=8)["rows"] == 150
    assert sorted(r.id for r in spark.read.parquet(root).where("id >= 900").collect()) == list(range(900, 905)) and spark.read.parquet(root).count() == 180


def test_partitions_of_strange_values_are_consolidated(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    for k in range(3):
        spark.createDataFrame([(k, "a b=c/d"), (k, None), (k, "é%20")], "id int, part string").repartition(3).write.mode("append").partitionBy("part").parquet(root)
    before = sorted(((r.id, r.part) for r in spark.read.parquet(root).collect()), key=repr)
    assert compaction.compact_table(spark, root, ["part"], max_small=2)["partitions"] == 3
    assert sorted(((r.id, r.part) for r in spark.read.parquet(root).collect()), key=repr) == before
    assert compaction.compact_table(spark, root, ["part"], max_small=2)["partitions"] == 0
