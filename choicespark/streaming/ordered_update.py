"""Online preference update in event-time order, with forgetting.

Per user a Gaussian belief (mean, precision) starts at a prior and takes the user's events in the order
of (event time, event id).  Each event first makes what was known fade, then adds its own precision:

    precision <- forget * precision + w        mean <- (forget * precision * mean + w * x) / new precision

so the order matters.  An event that follows the one before it by more than ``idle`` starts at the
prior again.

The stream keeps, per user, the belief up to the watermark and the events that are still ahead of it
(``transformWithState``).  Events may arrive out of order within the watermark's delay: they wait in
the user's state, and an event-time timer folds them into the belief, in order, when no earlier one can arrive
any more.  Events later than that are dropped by the engine.  A timer after ``idle`` releases the
state of users who have gone quiet.  Every batch returns the belief with the waiting events applied,
so the latest row of a user is the sequential replay of all the user's events so far.

The batch twin computes the same from the table in closed form: the k-th last event weighs
forget^k.  Terms that are too small to change a double are left out before any user's events meet, so
a user with a third of all events is no single task's work (with ``idle``, sessions need the whole order).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType

from choicespark.session import ensure_checkpoint_dir
from choicespark.streaming.preference_update import EVENTS_SCHEMA, compacted, weight

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Update:
    """Prior mean and precision, the factor by which knowledge fades with each event, and the pause that ends it."""

    mean: float = 0.0
    precision: float = 1.0
    forget: float = 0.95
    idle_seconds: float | None = None

    def apply(self, belief: tuple[float, float, int, int], events: list[tuple[int, int, float, float]]) -> tuple[float, float, int, int]:
        """(mean, precision, events, last event time in microseconds) after events (time, id, w, x) in order."""
        m, t, n, last = belief
        for at, _, w, x in sorted(events):
            if self.idle_seconds is not None and n and at - last > self.idle_seconds * 1e6:
                m, t, n = self.mean, self.precision, 0
            faded = self.forget * t
            t = faded + w
            m = (faded * m + w * x) / t if t else m
            n, last = n + 1, at
        return m, t, n, last


#: An event as it waits in the state: time, id, weight and value.
EVENT = np.dtype([("at", "<i8"), ("id", "<i8"), ("w", "<f8"), ("x", "<f8")])


class _Believer(StatefulProcessor):
    """A user's state is one value: the belief, the pending timer and the waiting events as packed bytes.

    A call reads it once and writes it once, however many events wait, as every access is a round
    trip between the worker and the executor and every list entry would be converted on its own.
    """

    def __init__(self, update: Update):
        self.update = update

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("user", "mean double, precision double, n long, last long, timer long, waiting binary")

    def _read(self) -> tuple[tuple[float, float, int, int], int | None, list[tuple[int, int, float, float]]]:
        held = self.state.get()
        if held is None:
            return (self.update.mean, self.update.precision, 0, 0), None, []
        *belief, timer, waiting = held
        return tuple(belief), timer, np.frombuffer(waiting, dtype=EVENT).tolist()

    def _write(self, belief: tuple[float, float, int, int], timer: int | None, events: list[tuple[int, int, float, float]]) -> None:
        self.state.update((*belief, timer, np.array(events, dtype=EVENT).tobytes()))

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        belief, timer, events = self._read()
        for part in rows:
            events += zip(*(part[c].tolist() for c in ("at", "event_id", "w", "x")))
        # one timer at a time: when the watermark passes the earliest waiting event
        due = -(-min(e[0] for e in events) // 1000)
        if timer is None or due < timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self._write(belief, timer, events)
        m, t, n, last = self.update.apply(belief, events)
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "posterior_mean": [m], "precision": [t], "last": [last], "waiting": [len(events)]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        due = timerValues.getCurrentWatermarkInMs() * 1000  # no event up to here can come any more
        belief, _, events = self._read()
        belief = self.update.apply(belief, [e for e in events if e[0] <= due])
        left, idle = [e for e in events if e[0] > due], self.update.idle_seconds
        if left:
            timer = -(-min(e[0] for e in left) // 1000)
        elif idle is None:
            timer = None
        elif due - belief[3] > idle * 1e6:
            self.state.clear()
            return iter(())
        else:
            timer = math.ceil(belief[3] / 1000 + idle * 1000) + 1
        if timer is not None:
            self.handle.registerTimer(timer)
        self._write(belief, timer, left)
        return iter(())

    def close(self) -> None:
        pass


_OUT = "user_id long, n long, posterior_mean double, precision double, last long, waiting long"


def _events(df: DataFrame, *also: str) -> DataFrame:
    """(user_id, event_id, time in microseconds, w, x); events without a user, a time or a value tell nothing."""
    w = weight(F.col("props"))
    usable = df.filter("user_id is not null and ts is not null and value is not null")
    return usable.select(*also, "user_id", F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
                         w.alias("w"), F.col("value").cast("double").alias("x"))


def ordered_update_batch(events: DataFrame, update: Update = Update()) -> DataFrame:
    """Per user: n, posterior_mean and precision after all events in order, in closed form (of the last session with ``idle``)."""
    ev = _events(events)
    order = [F.col("at").desc(), F.col("event_id").desc(), F.col("w").desc(), F.col("x").desc()]
    if update.idle_seconds is not None:
        w = Window.partitionBy("user_id").orderBy("at", "event_id", "w", "x")
        starts = (F.col("at") - F.lag("at").over(w) > update.idle_seconds * 1e6).cast("int")
        ev = ev.withColumn("_s", F.sum(F.coalesce(starts, F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        ev = ev.withColumn("_last", F.max("_s").over(Window.partitionBy("user_id"))).filter("_s = _last").drop("_s", "_last")
    counts = ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    if update.forget < 1:
        keep = 1 + (math.ceil(math.log(1e-20) / math.log(update.forget)) if update.forget > 0 else 1)
        salted = ev.withColumn("_salt", F.pmod(F.xxhash64("event_id", "at"), F.lit(256)))
        first = salted.withColumn("_r", F.row_number().over(Window.partitionBy("user_id", "_salt").orderBy(*order))).filter(F.col("_r") <= keep)
        ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)) - 1).filter(F.col("k") < keep)
        fade = F.pow(F.lit(update.forget), F.col("k"))
    else:
        ranked, fade = ev, F.lit(1.0)
    sums = ranked.groupBy("user_id").agg(F.sum(fade * F.col("w")).alias("tw"), F.sum(fade * F.col("w") * F.col("x")).alias("twx"))
    prior = F.lit(update.precision) * F.pow(F.lit(update.forget), F.col("n"))
    precision = prior + F.col("tw")
    mean = F.when(precision > 0, (prior * update.mean + F.col("twx")) / precision).otherwise(update.mean)
    return counts.join(sums, "user_id").select("user_id", "n", mean.alias("posterior_mean"), precision.alias("precision"))


def ordered_update_stream(spark: SparkSession, source_glob: str, update: Update = Update(), watermark: str = "1 day",
                          checkpoint: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Run the update over the files available now; the latest row of every user.

    ``checkpoint`` is a folder that the whole cluster shares; a later call with the same one goes on where
    the last one stopped.  A batch writes the users it changed to a folder named by its id (a batch
    that runs again replaces its own), and a run ends by merging them into one table, so the number
    of result folders does not grow with the batches.
    """
    base = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/ordered-update-{uuid.uuid4().hex}"
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        source = spark.readStream.schema(EVENTS_SCHEMA)
        if files_per_batch:
            source = source.option("maxFilesPerTrigger", files_per_batch)
        stream = source.parquet(source_glob).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
        changed = _events(stream, "ts").groupBy("user_id").transformWithStateInPandas(
            statefulProcessor=_Believer(update), outputStructType=_OUT, outputMode="Update", timeMode="EventTime")

        def write(part: DataFrame, batch: int) -> None:
            part.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/result/part={batch}")

        q = (changed.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return compacted(spark, base, ["user_id"], changed.schema.add("batch", IntegerType())).select("user_id", "n", "posterior_mean", "precision")
