"""64-bit mixing with wrap-around under ANSI arithmetic.

Spark's long overflows with an error under ANSI rules, so products are built from 16-bit limbs
of the constant and 32-bit halves of the value, every partial sum kept to 32 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_LOW = 0xFFFFFFFF
# The constants of the mixing function and of the draws built on it.
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB
SEED_STEP = 0xD2B74407B1CE6E93
FRACTION_KEY = 0xCA5A826395121157


def signed(n: int) -> int:
    """The signed long of the same 64 bits."""
    n &= (1 << 64) - 1
    return n - (1 << 64) if n >> 63 else n


def _halves(c: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(_LOW))


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(high.bitwiseAND(F.lit(_LOW)), 32).bitwiseOR(low)


def add64(c: Column, constant: int) -> Column:
    high, low = _halves(c)
    s = low + F.lit(constant & _LOW)
    return _join(high + F.lit((constant >> 32) & _LOW) + F.shiftrightunsigned(s, 32), s.bitwiseAND(F.lit(_LOW)))


def multiply64(c: Column, constant: int) -> Column:
    """c x constant modulo 2^64."""
    high, low = _halves(c)
    limbs = [(constant >> s) & 0xFFFF for s in (0, 16, 32, 48)]
    # low x constant: four products of 48 bits, carried in 16-bit columns
    p = [low * F.lit(x).cast("long") for x in limbs]
    c0 = p[0].bitwiseAND(F.lit(0xFFFF))
    s1 = F.shiftrightunsigned(p[0], 16) + p[1].bitwiseAND(F.lit(_LOW))
    low_out = c0.bitwiseOR(F.shiftleft(s1.bitwiseAND(F.lit(0xFFFF)), 16))
    carry = F.shiftrightunsigned(s1, 16) + F.shiftleft(F.shiftrightunsigned(p[1], 32), 16)
    upper = carry + p[2].bitwiseAND(F.lit(_LOW)) + F.shiftleft(p[3].bitwiseAND(F.lit(0xFFFF)), 16)
    # high x constant only reaches the upper half
    h = (high * F.lit(limbs[0]).cast("long")).bitwiseAND(F.lit(_LOW)) + F.shiftleft((high * F.lit(limbs[1]).cast("long")).bitwiseAND(F.lit(0xFFFF)), 16)
    return _join(upper + h, low_out)


def splitmix64(c: Column) -> Column:
    v = add64(c, GOLDEN)
    v = multiply64(v.bitwiseXOR(F.shiftrightunsigned(v, 30)), MIX_1)
    v = multiply64(v.bitwiseXOR(F.shiftrightunsigned(v, 27)), MIX_2)
    return v.bitwiseXOR(F.shiftrightunsigned(v, 31))


def to_uniform(mixed: Column) -> Column:
    """In [0, 1), from the upper 53 bits of a mixed key."""
    return F.shiftrightunsigned(mixed, 11).cast("double") / F.lit(float(1 << 53))


def photon_key(run_id: Column, event_id: Column) -> Column:
    """Both low 32-bit ids in one long."""
    r = run_id.cast("long").bitwiseAND(F.lit(_LOW))
    e = event_id.cast("long").bitwiseAND(F.lit(_LOW))
    return F.shiftleft(r, 32).bitwiseOR(e)


@contextmanager
def wrapping(spark: SparkSession) -> Iterator[None]:
    """Plans built inside wrap around on overflow.

    An arithmetic expression takes its overflow rule from the session when it is analysed and keeps
    it; the session's own setting is put back at once.
    """
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def with_splitmix(df: DataFrame, key: Column, out: str) -> DataFrame:
    """df with column ``out``, the mixed key, in native wrap-around arithmetic (a fifth of the code)."""
    s = f"_{out}"
    with wrapping(df.sparkSession):
        df = df.withColumn(s, key + F.lit(signed(GOLDEN)))
        for shift, constant in ((30, MIX_1), (27, MIX_2)):
            df = df.withColumn(s, F.col(s).bitwiseXOR(F.shiftrightunsigned(s, shift)) * F.lit(signed(constant)))
        return df.withColumn(out, F.col(s).bitwiseXOR(F.shiftrightunsigned(s, 31))).drop(s)


def with_draws(df: DataFrame, run_id: str, event_id: str, seed: int, names: tuple[str, str]) -> DataFrame:
    """df with two uniforms per photon under a seed, the same wherever the photon turns up."""
    base = "_base"
    df = df.withColumn(base, photon_key(F.col(run_id), F.col(event_id)).bitwiseXOR(F.lit(signed(seed * SEED_STEP))))
    for name, extra in zip(names, (0, FRACTION_KEY)):
        df = with_splitmix(df, F.col(base).bitwiseXOR(F.lit(signed(extra))), name)
        df = df.withColumn(name, to_uniform(F.col(name)))
    return df.drop(base)


def with_keyed(df: DataFrame, out: str, key: Column, salt: int = 0, more: Column | None = None) -> DataFrame:
    """df with column ``out``, a mixed long of a key (with ``more``: of the low words of both), the same on any partitioning."""
    key = key.cast("long") if more is None else photon_key(more, key)
    return with_splitmix(df, key.bitwiseXOR(F.lit(signed(salt * SEED_STEP))), out)


def with_uniforms(df: DataFrame, key: Column, salts: dict[str, int], more: Column | None = None) -> DataFrame:
    """df with a uniform per name, for draws that need no fixed stream."""
    for name, salt in salts.items():
        df = with_keyed(df, name, key, salt, more)
        df = df.withColumn(name, to_uniform(F.col(name)))
    return df
