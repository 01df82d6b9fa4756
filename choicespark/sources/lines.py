"""Row numbers over whole files, without gathering the rows or depending on the partitioning.

A first pass counts the rows of every split of the scan, prefix sums over (file, split offset) give
each split's first number, and a second pass adds a row's place within its split.  Only one row per
split passes through the sums; the rows themselves are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: Splits whose first numbers are broadcast (some tens of bytes each); more are joined by shuffle.
MAX_SPLITS = 200_000


def row_numbers(scan: DataFrame, into: str = "row_no", skip: Column | None = None) -> DataFrame:
    """``scan`` with the number of each row from 0, in the order of the files' paths and of the rows in them.

    ``scan`` is a file scan as read (text, CSV, Parquet), before any filter or shuffle.  Rows where
    ``skip`` holds are left out and not counted; they are the first of their split, as header rows are.
    Numbers are the same for every size of the splits.
    """
    file, start, place = "_rn_file", "_rn_start", "_rn_place"
    placed = scan.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.file_block_start").alias(start),
                         F.monotonically_increasing_id().alias(place))
    counted = F.lit(True) if skip is None else ~F.coalesce(skip, F.lit(False))
    splits = placed.groupBy(file, start).agg(F.min(place).alias("_rn_first"), F.count_if(counted).alias("_rn_n"),
                                             F.count_if(~counted).alias("_rn_skipped"))
    in_file = Window.partitionBy(file).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy(file).agg(F.sum("_rn_n").alias("_rn_rows"))
    # one row per file
    files = files.select(file, F.coalesce(F.sum("_rn_rows").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_rn_base"))
    firsts = splits.withColumn("_rn_base_in", F.coalesce(F.sum("_rn_n").over(in_file), F.lit(0))).join(files, file).select(
        file, start, (F.col("_rn_base") + F.col("_rn_base_in") - F.col("_rn_first") - F.col("_rn_skipped")).alias("_rn_add"))
    n_splits = scan.rdd.getNumPartitions() + len(scan.inputFiles())  # an upper bound, known without a job
    kept = placed if skip is None else placed.filter(counted)
    numbered = kept.join(F.broadcast(firsts) if n_splits <= MAX_SPLITS else firsts, [file, start])
    return numbered.select(*[F.col(f"`{c}`") for c in scan.columns], (F.col(place) + F.col("_rn_add")).alias(into))


def numbered_lines(spark: SparkSession, path: str, into: str = "line_no") -> DataFrame:
    """(value, line number from 0) of every line of text files, blank ones included; lines end in LF, CR LF or CR."""
    return row_numbers(spark.read.text(path), into)


def has_row_places(df: DataFrame) -> bool:
    """Whether ``df`` is a file scan, whose rows have places."""
    try:
        df.select("_metadata.file_path", "_metadata.file_block_start").schema
        return True
    except AnalysisException:
        return False
