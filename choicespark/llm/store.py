"""Intermediate tables and small shared column helpers of the pipeline operators."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark.session import cut_lineage, drop_table

#: ASCII white space that separates words, as a Java / RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: lost executors lose nothing."""
    return cut_lineage(df, name)


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote and nothing reads any more."""
    for t in tables:
        drop_table(t)


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of finished jobs now: it acts when the driver collects garbage."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def setting(spark: SparkSession, key: str, value: int) -> Iterator[None]:
    """A session setting that holds for the jobs of a block."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def crc_bucket(col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def hidden(name: str) -> str:
    """A column name that a caller's table will not hold."""
    return f"__llm_{name}"


#: Lists of at most so many short rows are broadcast (some tens of MB at most); longer ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def small(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``ids`` with a broadcast hint when a count shows that it has at most ``rows`` rows."""
    return F.broadcast(ids) if ids.limit(rows + 1).count() <= rows else ids


def join_counted(rows: DataFrame, groups: DataFrame, on: list[str], n: str, how: str = "inner") -> DataFrame:
    """Inner or left join of ``rows`` with their groups, where column ``n`` holds each group's number of rows.

    Groups with more than 1 / 256 of all rows (at most 256 of them) are broadcast, the others meet
    their rows by shuffle, so no task receives a hot group.  ``groups`` must be a stored table.
    """
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(1.0, total / 256)
    values = [c for c in groups.columns if c not in on]
    few = F.broadcast(groups.filter(hot).select(*on, F.struct(*values).alias(hidden("hot"))))
    first = rows.join(few, on, "left")
    order = [*rows.columns, *values]
    near = first.filter(F.col(hidden("hot")).isNotNull()).select(*rows.columns, f"{hidden('hot')}.*")
    rest = first.filter(F.col(hidden("hot")).isNull()).drop(hidden("hot")).join(groups.filter(~hot), on, how)
    return near.select(*order).unionByName(rest.select(*order))
