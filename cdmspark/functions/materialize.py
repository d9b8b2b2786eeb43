"""Cut lineage of an intermediate that several branches read: a Parquet table in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, freed_shuffles

#: Codec of stored tables: about a third smaller than Spark's default.
CODEC = "zstd"


def table_path(spark: SparkSession) -> str:
    """A new folder for a stored intermediate."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once below the folder of ``spark.checkpoint.dir`` and read it back: branches
    stop recomputing its plan, read only the columns they use, and a lost executor costs a read of
    files. The files' size is known to the planner, so a small table is broadcast by its bytes. What
    the plan shuffled is removed once it is written."""
    return materialize_all([df])


def materialize_all(parts: list[DataFrame]) -> DataFrame:
    """``materialize`` of the union of ``parts`` (of one schema), written one after the other, so that only
    one part's shuffles and spills are on disk at a time."""
    spark, path = parts[0].sparkSession, table_path(parts[0].sparkSession)
    for df in parts:
        typed = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if t == "void" else F.col(f"`{c}`")
                            for c, t in df.dtypes])
        with freed_shuffles(spark):
            typed.write.mode("append").option("compression", CODEC).parquet(path)
    return spark.read.schema(typed.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    jvm, folders = df.sparkSession.sparkContext._jvm, {f.rpartition("/")[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
