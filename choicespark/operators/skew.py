"""Joins whose keys may be hot, without any session switch.

A heavy-hitter summary of the key column finds the keys that hold more than their share of the rows.
It is mergeable: every task keeps the counts of its most frequent keys (Misra-Gries), one row per
task and kept key is added up, and a key with more than ``1 / capacity`` of a task's rows cannot be
missing there.  The rows of a hot key are then dealt to several salts and the other side's rows of
that key are copied to all of them, so the key's rows meet in as many tasks; all other rows join as
they are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a task's summary holds.
CAPACITY = 4096


def _summary(capacity: int):
    """Per task: the Misra-Gries counts of the keys (as strings of bytes), and the number of rows seen."""
    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held: dict[int, int] = {}
        rows = 0
        for batch in batches:
            rows += batch.num_rows
            counted = pc.value_counts(batch.column("h"))
            for h, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
                held[h] = held.get(h, 0) + n
            if len(held) > capacity:
                n = np.fromiter(held.values(), dtype=np.int64, count=len(held))
                cut = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])  # taken off every key
                held = {h: c - cut for h, c in held.items() if c > cut}
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([None, *held], pa.int64()), pa.array([rows, *held.values()], pa.int64())], names=["h", "n"])
    return run


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def hot_keys(df: DataFrame, keys: Sequence[str], share: float, capacity: int = CAPACITY) -> list[tuple[int, float]]:
    """(hash of the key, share of the rows) of the keys with more than ``share`` of the rows; at most 1 / share of them.

    Shares may be understated by what a task's summary dropped, at most 1 / ``capacity`` of its rows; rows
    with a null in the key match nothing and do not count as hot.
    """
    rows = df.filter(F.lit(True) if not keys else ~F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).select(_key_hash(keys).alias("h"))
    found = rows.mapInArrow(_summary(capacity), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = found.filter("h is null").first()
    if total is None:
        return []
    floor = max(1.0, (share - 1 / capacity) * total["n"])
    return [(r["h"], r["n"] / total["n"]) for r in found.filter(F.col("h").isNotNull() & (F.col("n") > floor)).collect()]


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", tasks: int | None = None,
                spread_by: Sequence[str] | None = None, hot: list[tuple[int, float]] | None = None) -> DataFrame:
    """``left.join(right, on, how)`` in which no hot key of ``left`` is one task's work.

    A key is hot from half of one of ``tasks`` equal parts of the rows on (``tasks``: the shuffle
    partitions); its rows are dealt to salts, so that a salt holds about a quarter of such a part.  The
    salt is the hash of a row's columns ``spread_by`` (all of ``left``'s by default), so a task that
    runs again deals the rows alike; rows that are equal in them share a salt.  ``how`` is inner, left,
    left_semi or left_anti; rows of ``right`` are copied, so the kinds that keep unmatched rows of it are not possible.
    """
    if how not in ("inner", "left", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"{how}: the right side's rows are copied")
    spark, on = left.sparkSession, list(on)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(left, on, 0.5 / tasks) if hot is None else hot
    if not hot:
        return left.join(right, on, how)
    h, salts, salt = "_skew_hash", "_skew_salts", "_skew_salt"
    few = F.broadcast(spark.createDataFrame([(k, max(2, int(4 * tasks * s + 1))) for k, s in hot], f"{h} long, {salts} int"))  # at most 2 * tasks rows
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in (spread_by or left.columns)], F.lit(7)), F.col(salts)).cast("int")
    a = left.withColumn(h, _key_hash(on)).join(few, h, "left").withColumn(salt, F.coalesce(spread, F.lit(0))).drop(h, salts)
    b = right.withColumn(h, _key_hash(on)).join(few, h, "left").withColumn(
        salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1))).drop(h, salts)
    return a.join(b, [*on, salt], how).drop(salt)
