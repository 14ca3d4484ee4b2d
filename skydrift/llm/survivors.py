"""The best representative of each group of duplicates, field by field.

One aggregation per group takes, for every attribute, the greatest composite of (has a value,
strength, name), so the strongest member names the survivor and each gap is filled from the
next best member that has a value. The composites are kept in ascending order of (missing,
-strength, id): their minimum is the maximum of the composite with ties to the smaller id. The
partial aggregation keeps one composite per task, group and attribute, so a group may hold any
share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attributes of a surviving track that are filled from the members.
FIELDS = ("average_velocity_deg_per_year", "detection_band_photons", "detected_bands")


def has_number(c: Column) -> Column:
    """Not null, NaN or negative (placeholders are negative)."""
    return c.isNotNull() & ~F.isnan(c.cast("double")) & (c >= 0)


def has_entries(c: Column) -> Column:
    return c.isNotNull() & (F.size(c) > 0)


def survivors(members: DataFrame, group: str, name: str, strength: Column, fields: dict[str, Column]) -> DataFrame:
    """group, representative, and per field f: f (value) and f_from (the member it is from).

    ``fields`` says of each attribute when it counts as a value. The strongest member is the
    representative, of equally strong ones the one with the smaller name; a null or NaN
    strength counts as zero. Fields without any value come out null. Rows without group or name
    are ignored; repeated rows change nothing. Columns of any other name are ignored.
    """
    s = F.coalesce(F.nanvl(strength, F.lit(0.0)), F.lit(0.0))
    rows = members.where(F.col(group).isNotNull() & F.col(name).isNotNull()).select(
        F.col(group).alias("_g"),
        (-s).alias("_s"),
        F.col(name).alias("_n"),
        *[F.coalesce(~ok, F.lit(True)).alias(f"_m{i}") for i, ok in enumerate(fields.values())],
        *[F.col(f).alias(f"_f{i}") for i, f in enumerate(fields)],
    )
    best = [F.min(F.struct(f"_m{i}", "_s", "_n", f"_f{i}")).alias(f"_b{i}") for i in range(len(fields))]
    got = rows.groupBy("_g").agg(F.min(F.struct("_s", "_n")).alias("_r"), *best)
    cols = []
    for i, f in enumerate(fields):
        cols.append(F.when(~F.col(f"_b{i}._m{i}"), F.col(f"_b{i}._f{i}")).alias(f))
        cols.append(F.when(~F.col(f"_b{i}._m{i}"), F.col(f"_b{i}._n")).alias(f"{f}_from"))
    return got.select(F.col("_g").alias(group), F.col("_r._n").alias("representative"), *cols)


def valid_tracks(tracks: DataFrame) -> DataFrame:
    """One row per _candidate_id: its latest by loaded_at, with ``score``, the sum of its sigmas.

    Null and NaN sigmas count as zero. A null loaded_at is the earliest; of equally late rows
    the one with the greatest values wins, so the choice does not depend on the order of rows.
    """
    sigma = F.aggregate(
        "points",
        F.lit(0.0),
        lambda acc, p: acc + F.coalesce(F.nanvl(p["sigma"], F.lit(0.0)), F.lit(0.0)),
    )
    rows = tracks.where("_candidate_id is not null").select(
        "_candidate_id", "loaded_at", F.coalesce(sigma, F.lit(0.0)).alias("score"), *FIELDS
    )
    last = F.max(F.struct("loaded_at", "score", *FIELDS)).alias("r")
    return rows.groupBy("_candidate_id").agg(last).select("_candidate_id", "r.score", *[f"r.{f}" for f in FIELDS])


def surviving_tracks(tracks: DataFrame, groups: DataFrame) -> DataFrame:
    """The surviving track of each group (columns as of ``survivors``)."""
    members = valid_tracks(tracks).join(groups, "_candidate_id")
    v, n, b = FIELDS
    return survivors(
        members,
        "group_id",
        "_candidate_id",
        F.col("score"),
        {v: has_number(F.col(v)), n: has_number(F.col(n)), b: has_entries(F.col(b))},
    )


def survivor_sources(survived: DataFrame) -> DataFrame:
    """group_id, field_name, _candidate_id: which member names the survivor and fills each field."""
    pairs = [("representative", F.col("representative")), *[(f, F.col(f"{f}_from")) for f in FIELDS]]
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), c.alias("_candidate_id")) for f, c in pairs])).alias("r")
    return survived.select("group_id", rows).select("group_id", "r.*").where("_candidate_id is not null")
