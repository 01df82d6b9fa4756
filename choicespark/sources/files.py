"""File sinks and scans: CSV, JSON lines, JSON documents, training histories.

Intermediate files go to a fresh folder under the session's shared
checkpoint directory (``spark.checkpoint.dir``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from choicespark.session import ensure_checkpoint_dir
from choicespark.sources.lines import numbered_lines

CORRUPT = "_corrupt_record"


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/io-{name}-{uuid.uuid4().hex}"


#: CSV as Python, pandas and spreadsheets write it: quotes are doubled.  An empty string is quoted
#: and a null is an empty cell, so both survive a round trip.
CSV_OPTIONS = {"header": "true", "encoding": "UTF-8", "quote": '"', "escape": '"', "emptyValue": '""', "nullValue": "",
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: For reading, what stands for null must differ from the empty string that a quoted cell holds; cells
#: without anything are null whatever it is.
CSV_READ_OPTIONS = {**CSV_OPTIONS, "emptyValue": "", "nullValue": "\ue000"}


def write_csv(df: DataFrame, path: str) -> None:
    """IO3: CSV with header, UTF-8."""
    df.write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = False) -> DataFrame:
    """IO4: CSV scan with a declared schema.

    ``multi_line`` is for files whose quoted cells hold line breaks; such a file cannot be split
    between tasks.
    """
    return (spark.read.schema(schema).options(**CSV_READ_OPTIONS).option("multiLine", multi_line).csv(path))


def write_jsonl(df: DataFrame, path: str) -> None:
    """IO5/IO6: JSON lines, null fields kept (N17), non-ASCII written raw."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str,
               max_samples: int | None = None) -> tuple[DataFrame, DataFrame]:
    """IO7: JSON-lines scan; malformed lines are kept aside, blank lines ignored.

    Returns (good rows, bad lines).  ``max_samples`` keeps what the first so many lines of the files
    hold, in the order of the files' paths; malformed and blank lines count, as they have numbers too.
    """
    s = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = s.add(CORRUPT, "string")
    if max_samples:
        lines = numbered_lines(spark, path).filter((F.col("line_no") < max_samples) & (F.trim("value") != ""))
        options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
        raw = lines.select(F.from_json("value", full, options).alias("r")).select("r.*")
    else:
        raw = (spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
               .json(path))
    good = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = raw.filter(F.col(CORRUPT).isNotNull())
    return good, bad


def read_json_document(spark: SparkSession, path: str, schema: StructType | str, explode_col: str | None = None,
                       multi_line: bool = True) -> DataFrame:
    """IO5: whole-file JSON documents (``multiLine``) or one document per line; a list field can be inlined."""
    df = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    if explode_col:
        keep = [c for c in df.columns if c != explode_col]
        return df.select(*keep, F.inline(explode_col))
    return df


def read_training_history(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """IO8: trainer-state documents → one row per ``log_history`` entry; absent keys are null."""
    schema = ("run_id string, log_history array<struct<step:bigint, epoch:double, loss:double, eval_loss:double,"
              " learning_rate:double, grad_norm:double>>")
    return read_json_document(spark, path, schema, "log_history", multi_line)
