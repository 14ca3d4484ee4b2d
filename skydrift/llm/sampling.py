"""A sample that stays the same across reruns and partitionings and only grows with the data.

Whether a record is selected depends on its key alone: a salted hash of the key is compared
with the threshold of its stratum, and the stratum is itself a function of the key. Nothing
that arrives later, nor how often or with what other values a record is delivered, can change
a decision. Rates are fixed per stratum and may only be raised, which keeps what was selected.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skydrift.config import WINDOW_START, WINDOW_STOP

#: Hexadecimal digits of the hash that are compared (60 bits).
DIGITS = 15


@dataclass(frozen=True)
class Rates:
    """Selection rates per stratum, with a default for strata not named."""

    default: float
    by_stratum: Mapping[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for r in (self.default, *self.by_stratum.values()):
            if not 0 <= r <= 1:
                raise ValueError(f"a rate lies between 0 and 1, not at {r}")

    def raised(self, default: float | None = None, by_stratum: Mapping[str, float] | None = None) -> Rates:
        """These rates with some of them raised; lowering one is an error."""
        d = self.default if default is None else default
        if d < self.default:
            raise ValueError(f"the default rate {self.default} can't be lowered to {d}")
        merged = {k: max(r, d) if k not in (by_stratum or {}) else r for k, r in self.by_stratum.items()}
        for k, r in (by_stratum or {}).items():
            if r < self.by_stratum.get(k, self.default):
                raise ValueError(f"the rate of stratum {k} can't be lowered to {r}")
            merged[k] = r
        return Rates(d, merged)


def stored_rates(spark: SparkSession, path: str) -> Rates | None:
    """The rates last stored below ``path``, None if there are none."""
    found = _versions(spark, path)
    if not found:
        return None
    got = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/{found[-1]}").collect()))
    return Rates(got["default"], got["by_stratum"])


def _versions(spark: SparkSession, path: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json")) if fs.exists(p) else []


def store_rates(spark: SparkSession, path: str, rates: Rates) -> Rates:
    """Stores rates beside the data they select from, as the next version; lower ones than those stored are refused.

    Strata not named keep their rate, raised to the default at least. Of two programs that store the same version one fails.
    """
    last = stored_rates(spark, path)
    rates = last.raised(rates.default, rates.by_stratum) if last else rates
    if rates != last:
        name = f"{path}/{len(_versions(spark, path)) + 1:06d}.json"
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(p.getParent())
        out = fs.create(p, False)
        out.write(bytearray(json.dumps({"default": rates.default, "by_stratum": dict(rates.by_stratum)}).encode()))
        out.close()
    return rates


def threshold(rate: float) -> str:
    """The bound below which hashes are selected, as DIGITS hexadecimal digits ('g': all)."""
    n = round(rate * 16**DIGITS)
    return "g" if n >= 16**DIGITS else format(n, f"0{DIGITS}x")


def key_hash(keys: list[Column], salt: str) -> Column:
    return F.substring(F.md5(F.concat_ws(":", F.lit(salt), *[k.cast("string") for k in keys]).cast("binary")), 1, DIGITS)


def selected(keys: list[Column], rates: Rates, salt: str, stratum: Column | None = None) -> Column:
    """Whether a record is selected. Keys with a null part never are."""
    bound: Column = F.lit(threshold(rates.default))
    if rates.by_stratum:
        if stratum is None:
            raise ValueError("rates per stratum need a stratum")
        entries = [x for k, r in sorted(rates.by_stratum.items()) for x in (F.lit(k), F.lit(threshold(r)))]
        bound = F.coalesce(F.create_map(*entries)[stratum.cast("string")], bound)
    whole = keys[0].isNotNull()
    for k in keys[1:]:
        whole = whole & k.isNotNull()
    return whole & (key_hash(keys, salt) < bound)


def stable_sample(df: DataFrame, keys: dict[str, Column], rates: Rates, salt: str, stratum: Column | None = None) -> DataFrame:
    """The distinct keys selected, under the names given.

    The filter runs before the shuffle that removes repeats, so only selected rows move.
    """
    return df.where(selected(list(keys.values()), rates, salt, stratum)).select(*[c.alias(n) for n, c in keys.items()]).distinct()


#: Quarters of the survey (91.25 days) in which runs begin: the strata of photons.
QUARTER_SECONDS = 7_884_000
QUARTERS = range(int(WINDOW_START // QUARTER_SECONDS), int(WINDOW_STOP // QUARTER_SECONDS) + 1)
PHOTON_RATES = Rates(1 / 50, {str(q): 1 / 50 for q in QUARTERS})
PHOTON_SALT = "photon-sample-1"


def photon_sample(photons: DataFrame, rates: Rates = PHOTON_RATES, salt: str = PHOTON_SALT, kept: str | None = None) -> DataFrame:
    """run_id, event_id (low 32 bits) of the photons selected, one row per photon.

    With ``kept``, a folder beside the data, the rates are stored there and may not be lower than the last ones.

    The stratum is the quarter in which the run began, which the run id tells: a function of
    the key, unlike anything that a later delivery may give otherwise.
    """
    if kept:
        rates = store_rates(photons.sparkSession, kept, rates)
    run = F.col("run_id").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    event = F.col("event_id").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    quarter = F.floor(run / F.lit(QUARTER_SECONDS))
    return stable_sample(photons, {"run_id": run, "event_id": event}, rates, salt, quarter)
