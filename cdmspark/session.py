"""Session helpers: the settings the operators assume, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with AQE, skew-join splitting and UTC time; reuses an active session."""
    cores = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cores}]")
        .appName("cdmspark")
        .config("spark.sql.shuffle.partitions", str(partitions or int(cores)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "16g"))
        # Whole-stage methods over 8000 bytecodes are never compiled by the JVM's JIT; below this limit
        # Spark falls back to per-operator projections, which it splits into small methods (conform at
        # sf0.1: 34 s -> 17 s in a cold session, 28 s -> 12 s in a warm one)
        .config("spark.sql.codegen.hugeMethodLimit", METHOD_LIMIT)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


METHOD_LIMIT, METHOD_DEFAULT = "8000", "65535"


def small_methods(spark: SparkSession) -> None:
    """Have Spark fall back from whole-stage methods that the JVM never compiles (see :func:`get_spark`), also
    in a session that was made elsewhere, unless a limit was set there."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(name) == METHOD_DEFAULT:
        spark.conf.set(name, METHOD_LIMIT)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings (``__`` for a dot) for what runs inside; one that the session has set otherwise stays."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    mine = {k: v for k, v in names.items() if spark.conf.get(k, None) in (None, "0")}
    for k, v in mine.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k in mine:
            spark.conf.unset(k)


def freed_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """For writes: Spark removes the shuffle files of what runs inside as soon as it is done. Otherwise they stay on the
    executors' disks until the driver's garbage collector finds their plans."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. Where it is unset, a single-machine
    session gets a temporary folder; a cluster must name one, as its executors share no disk."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="cdmspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path
