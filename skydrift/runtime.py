"""Session, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: str | None = None
_MADE: list[Durable] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@atexit.register
def _tidy() -> None:
    """Intermediate tables that nobody closed go when the program ends."""
    for made in list(_MADE):
        try:
            made.close()
        except Exception:  # the JVM is gone already; a local folder can still be removed
            shutil.rmtree(made.base.removeprefix("file://").removeprefix("file:"), True)


@contextmanager
def scratch() -> Iterator[None]:
    """Drops the intermediate tables made inside at its end, by when all that reads them must be written.

    Operators return DataFrames that are not computed yet, so they can't drop these themselves.
    """
    before = list(_MADE)
    try:
        yield
    finally:
        for made in [m for m in _MADE if m not in before]:
            made.close()


def session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("skydrift")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir`` (a file or a directory of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only where that is unset and all runs on one machine (tests) is a folder of our own made; on a
    cluster that is an error, as a folder of one machine is no shared one.
    """
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _OWN_DIR is None or not os.path.isdir(_OWN_DIR):
        _OWN_DIR = tempfile.mkdtemp(prefix="skydrift-")
        atexit.register(shutil.rmtree, _OWN_DIR, True)
    return f"file://{_OWN_DIR}"


class Durable:
    """Writes intermediate results as Parquet in the shared folder and reads them back.

    That cuts the lineage of iterative operators and survives the loss of executors. A
    superseded table is dropped by the operator that wrote it, the rest by ``close``.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0
        _MADE.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")  # else shuffle files stay until the driver happens to collect its garbage
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._durable_path = path
        return back

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := getattr(df, "_durable_path", None):
                remove(self.spark, path)

    def close(self) -> None:
        remove(self.spark, self.base)
        if self in _MADE:
            _MADE.remove(self)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder on whatever file system its path names."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
