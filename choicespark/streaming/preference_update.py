"""Online preference update (D14): decisions arriving as an event stream.

The state per user is three running sums — count, Σw and Σw·x — so the
posterior (precision-weighted) mean is ``Σw·x / Σw``.  Built-in streaming
aggregation keeps that state (fault-tolerant through the checkpoint); no
custom state function is needed.  A batch twin computes the same numbers
from the table and defines correctness.

Weights: ``w = 1 / (1 + k / 100)`` with ``k`` read from the event's JSON
``props`` (missing → w = 1); the observed value is the event ``value``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from choicespark.session import ensure_checkpoint_dir

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def weight(props: Column) -> Column:
    k = F.get_json_object(props, "$.k").try_cast("double")
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + k / F.lit(100.0)), F.lit(1.0))


def _aggregate(df: DataFrame, keys: list[str]) -> DataFrame:
    w = weight(F.col("props"))
    staged = df.select(*keys, w.alias("w"), (w * F.col("value")).alias("wx"))
    return staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sum_w"),
                                      F.sum("wx").alias("sum_wx"))


def preference_update_batch(events: DataFrame) -> DataFrame:
    """Batch twin: per-user weighted mean over all events."""
    agg = _aggregate(events, ["user_id"])
    return agg.withColumn("posterior_mean", F.col("sum_wx") / F.col("sum_w"))


def preference_update_stream(spark: SparkSession, source_glob: str, watermark: str = "1 day",
                             window: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run the streaming update over the files available now and return its result table.

    ``ts`` is ``timestamp_ntz`` in the source and is cast to ``timestamp`` for the watermark.  Each
    micro-batch writes the rows it changed as one Parquet folder named by its batch id (a batch that
    is run again replaces its own folder); the result is the latest row of every key, and a run ends by
    merging the folders into one (:func:`compacted`).  Nothing is gathered on the driver.  With ``window`` the state is per (user, tumbling window) and the
    watermark releases windows that have closed.

    ``checkpoint`` is a folder that the whole cluster shares; a later call with the same one goes on
    where the last one stopped and reads only new files.  By default a new folder in the session's
    checkpoint folder is used.
    """
    base = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/pref-update-{uuid.uuid4().hex}"
    stream = (spark.readStream.schema(EVENTS_SCHEMA).parquet(source_glob)
              .withColumn("ts", F.col("ts").cast("timestamp"))
              .withWatermark("ts", watermark))
    if window is not None:
        stream = stream.withColumn("window", F.window("ts", window))
    keys = ["user_id"] if window is None else ["window", "user_id"]
    agg = _aggregate(stream, keys).withColumn("posterior_mean", F.col("sum_wx") / F.col("sum_w"))
    schema = agg.schema

    def write(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/result/part={batch}")

    q = (agg.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return compacted(spark, base, keys, schema.add("batch", IntegerType())).drop("batch")


def compacted(spark: SparkSession, base: str, keys: list[str], schema: StructType) -> DataFrame:
    """The latest row of every key under ``base``/result, merged into one folder; the merged parts are removed.

    The new folder carries the number of the last batch that it holds.  It is written under another
    name first, and parts are removed only when it is complete, so a run that stops half-way loses nothing.
    """
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = path(base).getFileSystem(conf)
    held = {}
    for kind in ("part", "merged"):
        for s in fs.globStatus(path(f"{base}/result/{kind}=*")) or []:
            if fs.exists(path(f"{s.getPath()}/_SUCCESS")):
                held[kind, int(s.getPath().getName().split("=")[1])] = s.getPath().toString()
    upto = max((b for kind, b in held if kind == "merged"), default=-1)
    live = [p for (kind, b), p in held.items() if (kind, b) == ("merged", upto) or (kind == "part" and b > upto)]
    if not live:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*live)
    values = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")
    last = max(b for _, b in held)
    if len(live) > 1:
        target, half = f"{base}/result/merged={last}", f"{base}/result/_half-{uuid.uuid4().hex}"
        latest.write.parquet(half)
        fs.delete(path(target), True)
        fs.rename(path(half), path(target))
        for p in held.values():
            if p.rstrip("/").rsplit("/", 1)[1] != f"merged={last}":
                fs.delete(path(p), True)
        latest = spark.read.schema(schema).parquet(target)
    return latest
