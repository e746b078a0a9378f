"""Session defaults, table access and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written by :func:`keep` in this process, removed when it ends.
_kept: list[tuple[SparkSession, str]] = []
#: Removes the shuffle files of a plan when it has run.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def session(app: str = "brindle", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the defaults the engine is tested with; a cluster supplies its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    return b.config(map=base | conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir` (a file or a folder of files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than can run at once, as a single small file is, dealt out to all of them.

    For work on rows that costs more than sending them once. Large tables have more tasks and are left as they are.
    """
    n = cores(scan.sparkSession)
    return scan.repartition(n) if scan.rdd.getNumPartitions() < n else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Where that is unset a local session gets a folder of its own; on a cluster, whose executors see different disks, it is
    an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset; the executors of {master} need a folder they share")
        where = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the process ends."""
    path = f"{shared_dir(spark)}/brindle-{os.getpid()}/{what}-{uuid.uuid4().hex[:12]}"
    _kept.append((spark, path))
    return path


def keep(df: DataFrame, what: str, sweep: bool = False) -> DataFrame:
    """Cut the lineage: write `df` as a table in the shared folder and read it again.

    Unlike localCheckpoint the copy outlives any executor, and later readers get column pruning and pushdown. With
    `sweep` the driver collects its garbage first, so that the shuffle files of earlier plans that are kept by now are
    removed before this one adds its own. The shuffle files of this plan, which nothing reads again, are removed as soon
    as the table is written, wherever they are.
    """
    spark = df.sparkSession
    if sweep:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    path = shared_path(spark, what)
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_SWEEP) if before is None else spark.conf.set(_SWEEP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended
        if path.startswith("file://"):
            shutil.rmtree(path[7:], ignore_errors=True)


def release(*kept: DataFrame) -> None:
    """Remove tables written by :func:`keep` that nothing reads any more."""
    for df in kept:
        path = getattr(df, "_kept_at", None)
        if path:
            _kept[:] = [x for x in _kept if x[1] != path]
            _remove(df.sparkSession, path)


@contextmanager
def kept_within() -> Iterator[None]:
    """Within this block :func:`keep` may write tables; they are removed at its end, when its results must have been written."""
    before = len(_kept)
    try:
        yield
    finally:
        for spark, path in _kept[before:]:
            _remove(spark, path)
        del _kept[before:]


def drop_kept() -> None:
    """Remove all tables written by :func:`keep`; the DataFrames made from them can't be read any more."""
    while _kept:
        _remove(*_kept.pop())


atexit.register(drop_kept)


def cores(spark: SparkSession) -> int:
    """Tasks that can run at once."""
    return max(1, spark.sparkContext.defaultParallelism)
