"""Command line: search, prepare, inject, list small files to consolidate, compact a table.

python -m skydrift search PHOTONS CATALOGUE TILES OUT [--radius 18] [--tile ID]... [--bin-dump] [--stationary] [--skip-existing] ...
python -m skydrift prepare PHOTONS TILES ROOT [INTERVALS]
python -m skydrift inject PHOTONS TILES OUT RA DEC VELOCITY ANGLE PER_BIN SEED
python -m skydrift plan LISTING OUT
python -m skydrift compact TABLE PARTITION_COLUMN...
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from skydrift.runtime import scratch


def main(args: list[str]) -> int:
    if not args or args[0] not in ("search", "prepare", "inject", "plan", "compact"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("skydrift").getOrCreate()
    read = spark.read.parquet
    with scratch():
        if args[0] == "search":
            from skydrift.plans.batch import parse, run_search

            print(run_search(spark, *parse(args[1:])))
        elif args[0] == "prepare":
            from skydrift.plans import prepare as P

            photons, tiles, root = args[1:4]
            mark = P.file_signature(spark, photons)
            P.write_geometry(read(tiles), root, P.Preparation().radius)
            print(P.prepare(read(photons), read(tiles), root, mark, read(args[4]) if len(args) > 4 else None))
            print(P.write_manifest(spark, root, mark), P.verify(spark, root, read(tiles)))
        elif args[0] == "inject":
            from skydrift.operators import inject as I

            photons, tiles, out = args[1:4]
            ra, dec, velocity, angle = map(float, args[4:8])
            per_tile = I.injected_tiles(read(photons), read(tiles), I.track_truth(spark, ra, dec, velocity, angle), int(args[8]), int(args[9]))
            per_tile.write.mode("overwrite").partitionBy("cap_tile").parquet(out)
        elif args[0] == "plan":
            from skydrift.operators.compaction import compaction_plan

            compaction_plan(read(args[1])).write.mode("overwrite").parquet(args[2])
        else:
            from skydrift.operators.compaction import compact_table

            print(compact_table(spark, args[1], args[2:]))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
