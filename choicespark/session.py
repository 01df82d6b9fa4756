"""Session helpers.

Library code never builds a session; callers pass one in.  ``get_session`` is
for tests, the bench and the smoke entry point.  ``ensure_checkpoint_dir`` reads the
cluster's ``spark.checkpoint.dir``; only a local-mode session without that
setting gets a scratch folder of its own.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                driver_memory: str | None = None) -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    builder = SparkSession.builder.master(master)
    if driver_memory:
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = (
        builder
        .appName("choicespark")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # split a hot join key even when the split needs one more exchange for the
        # following aggregate (that exchange sees map-side-combined rows only)
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a machine-local one only for a local-mode session without the setting.

    Off local mode every executor writes to its own disk, so an unset folder is an error there.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        wanted = tempfile.mkdtemp(prefix="choicespark-ckpt-")
    spark.sparkContext.setCheckpointDir(wanted)
    return spark.sparkContext.getCheckpointDir() or wanted


def cut_lineage(df: DataFrame, name: str = "table") -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder and read it back.

    One computation (an RDD checkpoint would compute the data twice unless
    cached), columnar storage, and a short lineage for everything downstream;
    the files live in the cluster's shared ``spark.checkpoint.dir``, so a lost
    executor does not lose them.
    """
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    out = spark.read.parquet(path)
    out._scratch_path = path
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return out


#: Paths of the intermediate tables of each application that are still there.
_scratch: dict[str, list[str]] = {}


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop_table(df: DataFrame) -> None:
    """Delete a table that :func:`cut_lineage` returned; nothing may read it afterwards."""
    spark, path = df.sparkSession, df._scratch_path
    _delete(spark, path)
    _scratch.get(spark.sparkContext.applicationId, [path]).remove(path)


def drop_scratch(spark: SparkSession) -> int:
    """Delete all intermediate tables of the session, when no result that reads them is needed any more; their number.

    Results are lazy, so the library cannot tell when a caller is done with one; a long session calls
    this between its jobs.
    """
    paths = _scratch.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        _delete(spark, p)
    return len(paths)
