import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skydrift.config import bin_edges, psf_radius
from skydrift.functions import bits, hashing, sphere, statistics


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_destination_near_the_pole_and_the_turn(spark):
    a, d = sphere.destination(F.lit(359.8), F.lit(83.0), F.lit(7.0), F.lit(1.2))
    back = sphere.separation(F.lit(359.8), F.lit(83.0), a, d)
    assert abs(one(spark, back).c0 - 7.0) < 1e-10


def test_mean_direction_across_the_turn_and_undefined(spark):
    df = spark.createDataFrame([("x", 359.0, 0.0), ("x", 1.0, 0.0), ("y", 0.0, 0.0), ("y", 180.0, 0.0)], "k string, ra double, dec double")
    a, d = sphere.mean_direction(F.col("ra"), F.col("dec"))
    got = {r.k: (r.a, r.d) for r in df.groupBy("k").agg(a.alias("a"), d.alias("d")).collect()}
    assert min(abs(got["x"][0]), abs(got["x"][0] - 360)) < 1e-9 and abs(got["x"][1]) < 1e-9
    assert got["y"] == (None, None)


def test_weighted_mean_is_the_mean_of_repeats(spark):
    df = spark.createDataFrame([(10.0, 20.0, 3.0), (40.0, -5.0, 1.0)], "ra double, dec double, w double")
    three = spark.createDataFrame([(10.0, 20.0)] * 3 + [(40.0, -5.0)], "ra double, dec double")
    a = df.agg(*sphere.mean_direction(F.col("ra"), F.col("dec"), F.col("w"))).first()
    b = three.agg(*sphere.mean_direction(F.col("ra"), F.col("dec"))).first()
    assert np.allclose(a, b)


def test_ring_areas(spark):
    whole = one(spark, sphere.ring_area_deg2(F.lit(0.0), F.lit(180.0)), sphere.ring_area_deg2(F.lit(2.0), F.lit(1.0)), sphere.ring_area_deg2(F.lit(1.0), F.lit(2.0)))
    assert abs(whole.c0 - 4 * math.pi * (180 / math.pi) ** 2) < 1e-6 and whole.c1 is None
    assert abs(whole.c2 - math.pi * 3) / (math.pi * 3) < 1e-3


def test_lens_area_limits(spark):
    r = one(spark, sphere.lens_area(F.lit(1.0), F.lit(1.0), F.lit(2.5)), sphere.lens_area(F.lit(3.0), F.lit(1.0), F.lit(1.0)), sphere.lens_area(F.lit(1.0), F.lit(1.0), F.lit(1e-9)))
    assert r.c0 == 0 and abs(r.c1 - math.pi) < 1e-12 and abs(r.c2 - math.pi) < 1e-6


def test_li_ma_branches(spark):
    lm = lambda a, b, al: statistics.li_ma(F.lit(a), F.lit(b), F.lit(al))
    r = one(spark, lm(1, 100, 0.1), lm(5, 0, 0.1), lm(20, 50, 0.1), lm(0, 0, 0.1))
    assert r.c0 == 0 and r.c3 == 0
    assert abs(r.c1 - math.sqrt(2 * 5 * math.log(1.1 / 0.1))) < 1e-12
    on, off, al = 20, 50, 0.1
    want = math.sqrt(2 * (on * math.log((1 + al) / al * on / (on + off)) + off * math.log((1 + al) * off / (on + off))))
    assert abs(r.c2 - want) < 1e-12


def test_threshold_never_below_the_floor(spark):
    got = one(spark, *[statistics.core_threshold(F.lit(m), 4) for m in (0.0, 0.1, 1.0, -1.0, float("nan"))])
    assert list(got) == [4, 4, 5, None, None]


def test_class_bits_in_three_writings(spark):
    flags = [False] * 32
    flags[24] = True  # most significant first: bit 7
    df = spark.createDataFrame([(128, flags, bytearray([0, 0, 0, 128])), (0, [False] * 32, bytearray(4)), (129, [*flags[:31], True], bytearray([0, 0, 0, 129]))], "i int, f array<boolean>, b binary")
    for r in df.select("i", bits.class_from_flags(F.col("f")).alias("f"), bits.class_from_bytes(F.col("b")).alias("b"), bits.any_bit(F.col("i"), 128).alias("p"), bits.any_bit(F.col("i"), 0).alias("all")).collect():
        assert r.f == r.i and r.b == r.i and r.p == (r.i >= 128) and r.all


def splitmix(v):
    v = v + np.uint64(hashing.GOLDEN)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(hashing.MIX_1)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(hashing.MIX_2)
    return v ^ (v >> np.uint64(31))


def test_mixing_agrees_with_unsigned_arithmetic(spark):
    rng = np.random.default_rng(3)
    keys = np.concatenate([rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64), np.array([0, 1, -1, 2**63 - 1, -(2**63)])])
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    a = [r.m for r in df.select(hashing.splitmix64(F.col("k")).alias("m")).collect()]
    b = [r.m for r in hashing.with_splitmix(df, F.col("k"), "m").collect()]
    with np.errstate(over="ignore"):
        want = splitmix(keys.astype(np.uint64)).astype(np.int64).tolist()
    assert a == want and b == want
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_draws_depend_on_low_words_only(spark):
    df = spark.createDataFrame([(5, 7), (5 + (1 << 32), 7 - (1 << 32))], "r long, e long")
    got = hashing.with_draws(df, "r", "e", 11, ("u", "f")).collect()
    assert got[0].u == got[1].u and got[0].f == got[1].f and 0 <= got[0].u < 1 and got[0].u != got[0].f
    base = (np.uint64(5) << np.uint64(32)) ^ np.uint64(7) ^ np.uint64((11 * hashing.SEED_STEP) & (2**64 - 1))
    with np.errstate(over="ignore"):
        assert got[0].u == float(splitmix(base) >> np.uint64(11)) / 2**53


def test_bins_and_radii():
    e = bin_edges()
    assert len(e) == 11 and e[-1] - e[-2] == 31_708_801.0
    assert [round(psf_radius(x), 5) for x in (1467.8, 3162.3, 14678.0)] == [0.58851, 0.31848, 0.1]
    with pytest.raises(ValueError):
        bin_edges(0)
