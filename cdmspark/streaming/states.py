"""W4 as a stream: strict upload states with a reorder buffer (``transformWithStateInPandas``).

Uploads are dealt by a hash to buckets, as a call for every upload costs milliseconds whatever its rows. State
per bucket, in the RocksDB state store: what the settled steps of each of its uploads led to (state, illegal
steps, steps), and the steps that wait, both as lists of Arrow batches. A step settles once the watermark has
passed its time, as no earlier one can come any more; a timer at the earliest waiting step settles it without
new input. Steps are folded in the order of (time, event id), in whatever order they arrive.

Every micro-batch puts out the uploads it has steps of, as the settled state followed by the waiting steps in
order, so the newest row of an upload is right for all steps seen, and what settles later does not
change it unless another step comes between. The buffer holds the steps of ``lateness`` at most; steps
later than that are dropped by the watermark, as Spark does. The state of a quiet upload is one row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

from ..operators.statemachine import ILLEGAL, NEXT, STATES, STEPS
from ..sources import sinks

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = 2**63 - 1
#: Columns of the two states; rows an Arrow batch of them holds at most.
SETTLED, WAITING, BATCH_ROWS = ["upload_id", "state", "illegal_steps", "n_steps"], ["upload_id", "at", "event_id", "code"], 1 << 16
OUT = "upload_id string, state string, illegal_steps bigint, n_steps bigint"
LOG = T.StructType([T.StructField("upload_id", T.StringType()), T.StructField("state", T.StringType()),
                    *[T.StructField(n, T.LongType()) for n in ("illegal_steps", "n_steps", "epoch_no")]])


def fold(settled: tuple[int, int, int], steps: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    """(state, illegal steps, steps) after ``steps`` (time, event id, step number) in their order."""
    state, illegal, n = settled
    for _, _, step in steps:
        illegal += ILLEGAL[step][state]
        state = NEXT[step][state]
        n += 1
    return state, illegal, n


def folded(now: dict[str, Sequence[int]], steps: pd.DataFrame) -> dict[str, tuple[int, int, int]]:
    """What each upload of ``steps``, which are in their order, is led to from ``now``."""
    rows = zip(*(steps[c].tolist() for c in WAITING))
    return {u: fold(now.get(u, (0, 0, 0)), [x[1:] for x in of_u]) for u, of_u in groupby(rows, itemgetter(0))}


def pack(rows: pd.DataFrame) -> list[tuple[bytes]]:
    """Rows as Arrow batches, one a value of a list state."""
    batches = pa.Table.from_pandas(rows, preserve_index=False).to_batches(max_chunksize=BATCH_ROWS)
    out = []
    for batch in batches:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as w:
            w.write_batch(batch)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def unpack(state: ListState) -> pd.DataFrame | None:
    """The rows of a list state, or None where it has none."""
    if not state.exists():
        return None
    return pd.concat([pa.ipc.open_stream(b).read_pandas() for (b,) in state.get()], ignore_index=True)


class StrictStates(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getListState("settled", "uploads binary")
        self.waiting = handle.getListState("waiting", "steps binary")

    def _advance(self, watermark: int) -> dict[str, tuple[int, int, int]]:
        """Settle what the watermark has passed; returns what the uploads with waiting steps are led to by all of them."""
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        steps, rows = unpack(self.waiting), unpack(self.settled)
        if steps is None:
            return {}
        now = {} if rows is None else {u: x for u, *x in rows.itertuples(index=False)}
        steps = steps.sort_values(WAITING, ignore_index=True)
        ready = steps["at"] // 1000 < watermark
        if ready.any():
            now |= folded(now, steps[ready])
            self.settled.put(pack(pd.DataFrame([(u, *x) for u, x in now.items()], columns=SETTLED)))
            steps = steps[~ready]
            if len(steps):
                self.waiting.put(pack(steps))
            else:
                self.waiting.clear()
        if len(steps):
            self.handle.registerTimer(int(steps["at"].min()) // 1000 + 1)
        return now | folded(now, steps)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        touched: set[str] = set()
        for part in rows:
            touched |= set(part["upload_id"])
            self.waiting.appendList(pack(part[WAITING]))
        now = self._advance(timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame([(u, STATES[now[u][0]], *now[u][1:]) for u in touched], columns=["upload_id", "state", *SETTLED[2:]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._advance(timerValues.getCurrentWatermarkInMs())  # what settles changes no upload's row
        yield from ()

    def close(self) -> None:
        pass


def states_log(spark: SparkSession, out_dir: str) -> sinks.KeyedLog:
    """Per upload the row of its last epoch."""
    return sinks.KeyedLog(spark, out_dir, LOG, "upload_id", ("epoch_no",))


def strict_states_stream(spark: SparkSession, steps_dir: str, out_dir: str, checkpoint: str, schema: T.StructType,
                         lateness: str, files_a_batch: int | None = None, buckets: int = 256) -> None:
    """Run over all steps (upload_id, ts, event_id, step) that ``steps_dir`` has and the checkpoint has not seen.
    Steps of unknown kinds, or without an upload or a time, are no steps; of steps at one time, one without an event
    id is the last. ``buckets`` must stay as it was when the checkpoint began; a task holds one of them at a time."""
    kept = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKSDB)
    try:
        reader = spark.readStream.schema(schema)
        if files_a_batch:
            reader = reader.option("maxFilesPerTrigger", files_a_batch)
        code = F.array_position(F.array(*[F.lit(x) for x in STEPS]), F.col("step")).cast("int") - 1
        steps = (reader.parquet(steps_dir).withColumn("time", F.col("ts").cast("timestamp")).withColumn("code", code)
                 .filter("code >= 0 and upload_id is not null and time is not null").withWatermark("time", lateness)
                 .select(F.pmod(F.xxhash64("upload_id"), F.lit(buckets)).alias("bucket"), "upload_id", "time",
                         F.unix_micros("time").alias("at"), F.coalesce("event_id", F.lit(LAST)).alias("event_id"), "code"))
        states = steps.groupBy("bucket").transformWithStateInPandas(
            statefulProcessor=StrictStates(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")

        def put(batch: DataFrame, epoch: int) -> None:
            rows = batch.groupBy("upload_id").agg(F.max_by(F.struct("state", "illegal_steps", "n_steps"), "n_steps").alias("r"))
            states_log(batch.sparkSession, out_dir).put(
                rows.select("upload_id", "r.*", F.lit(epoch).cast("bigint").alias("epoch_no")), epoch)

        query = (states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        if query.exception():
            raise query.exception()
    finally:
        if kept is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, kept)


def latest_states(spark: SparkSession, out_dir: str) -> DataFrame:
    """(upload_id, state, illegal_steps, n_steps) as of the last epoch."""
    return states_log(spark, out_dir).read().drop("epoch_no")
