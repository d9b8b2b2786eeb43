"""Queries of stateful streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materialize import materialize
from ..session import ensure_checkpoint_dir
from ..sources import sinks as SK
from ..streaming import states as SS
from . import catalog as CAT
from . import oracle_workflow as OW
from .registry import register

#: Steps arrive up to this many hours after their time, in deliveries by arrival; those after which the log is compacted.
LATE_HOURS, FILES, COMPACTED = 48, 5, (2, 4)
#: Uploads are dealt to so many buckets that each has about this many steps over all deliveries.
STEPS_A_BUCKET, LEAST_BUCKETS = 1 << 14, 64


@register("stream_strict_states", OW.strict_states_sql())
def stream_strict_states(spark: SparkSession, sf: str) -> DataFrame:
    """W4 as a stream: steps arrive out of order, one delivery a micro-batch, with a restart after each."""
    steps = CAT.upload_steps(spark, sf).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    hour = 3_600_000_000
    late = F.pmod(F.xxhash64("event_id"), F.lit(LATE_HOURS * hour))
    steps = materialize(steps.withColumn("arrival", F.col("at") + late))
    ends = steps.agg(F.min("arrival").alias("lo"), F.max("arrival").alias("hi"))
    buckets = max(LEAST_BUCKETS, steps.count() // STEPS_A_BUCKET)
    steps = steps.crossJoin(F.broadcast(ends)).withColumn(
        "file", F.floor((F.col("arrival") - F.col("lo")) * FILES / (F.col("hi") - F.col("lo") + 1)).cast("int"))
    steps = steps.select("upload_id", "ts", "event_id", "step", "file")
    schema = steps.drop("file").schema
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/strict-{uuid.uuid4().hex}"
    SK.append(steps, f"{root}/arriving", ["file"])  # so that a delivery reads its own rows
    arriving = spark.read.schema(steps.schema).parquet(f"{root}/arriving")
    for k in range(FILES):
        SK.append(arriving.filter(F.col("file") == k).drop("file"), f"{root}/steps")
        SS.strict_states_stream(spark, f"{root}/steps", f"{root}/out", f"{root}/ck", schema, f"{LATE_HOURS} hours", buckets=buckets)
        if k in COMPACTED:
            SS.states_log(spark, f"{root}/out").compact()
    return SS.latest_states(spark, f"{root}/out")
