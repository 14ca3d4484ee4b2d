"""Weekly arrivals as a stream into the same tables (ours: the search itself is a batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skydrift.operators.photons import quality_cut
from skydrift.sources.sinks import write_blocks


def arrivals(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """Photons that pass the cuts, each once: repeats within the watermark are dropped by state.

    What is delivered again later than that is a row of its own (``one_per_photon`` reduces such); state is
    bounded by the watermark.
    """
    key = [F.col(c).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"_{c}") for c in ("run_id", "event_id")]
    return quality_cut(stream).select("*", *key).withWatermark("ingested_at", late).dropDuplicatesWithinWatermark(["_run_id", "_event_id"]).drop("_run_id", "_event_id")


def daily_counts(stream: DataFrame, late: str = "30 days") -> DataFrame:
    """window, tile_id, n: photons ingested per day and tile, closed once the watermark has passed."""
    return stream.withWatermark("ingested_at", late).groupBy(F.window("ingested_at", "1 day"), "tile_id").agg(F.count(F.lit(1)).alias("n"))


def ingest(stream: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Appends arrivals to the table of tiles and blocks, each batch once.

    A batch is noted below ``root`` before it is appended. Only one that is noted already, because
    it broke off in between, is compared with the table: rows it has already (they carry its number) are left out.
    """
    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(number))
        note = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_batches/{number}")
        fs = note.getFileSystem(spark._jsc.hadoopConfiguration())
        if fs.exists(note):
            try:
                seen = spark.read.parquet(root).where(F.col("batch") == number).select("run_id", "event_id")
                rows = rows.join(seen, ["run_id", "event_id"], "left_anti")
            except Exception as e:  # it broke off before the table existed
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        fs.mkdirs(note.getParent())
        fs.create(note, True).close()
        write_blocks(rows, root, mode="append")

    return arrivals(stream).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
