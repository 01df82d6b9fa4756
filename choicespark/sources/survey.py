"""Survey sources: dialect detection, renames, ids, item selection, multi-source union.

Column presence is resolved once against ``df.columns`` when the plan is
built; nothing is decided per row.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from choicespark.functions.nulls import zfill
from choicespark.sources.lines import has_row_places, row_numbers

ECHO_MARKER = "Start Date"


def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the columns named in ``mapping`` that exist; leave the others."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def question_text(codes: Column, mapping: Mapping[str, str]) -> Column:
    """Reverse lookup code → question text; unknown codes map to themselves."""
    rev = {v: k for k, v in mapping.items()}
    if not rev:
        return codes
    m = F.create_map(*[x for k, v in rev.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, codes), codes)


def make_persona_id(tag: Column | str, key: Column, width: int = 4) -> Column:
    """``{tag}_{key:0{width}}``, padded but never truncated."""
    t = F.lit(tag) if isinstance(tag, str) else tag
    return F.concat(t, F.lit("_"), zfill(key, width))


def select_items(df: DataFrame, items: Sequence[str], meta: Sequence[str] = ("persona_id", "country")
                 ) -> tuple[DataFrame, list[str]]:
    """Meta columns plus the configured items that exist, and the list of missing items (P5)."""
    present = [c for c in items if c in df.columns]
    missing = [c for c in items if c not in df.columns]
    return df.select(*[c for c in meta if c in df.columns], *present), missing


def normalise_dialect(df: DataFrame, tag: str, mapping: Mapping[str, str], key_col: str,
                      alt_key_col: str | None = None) -> DataFrame:
    """IO1: pick the dialect by column presence.

    * ``key_col`` present (question-text dialect): rename through ``mapping``,
      tag the source, build ids from the row key.
    * otherwise (platform dialect): drop the header-echo row by value,
      tag, build ids from ``alt_key_col`` when present, else from the row's
      number in the file, counted from 0 without the echo row; the same on
      every read.  Only a table that is no file scan has no such numbers: its
      ids are made up (``monotonically_increasing_id``) and flagged in ``id_stable``.
    """
    if key_col in df.columns:
        out = rename_present(df, mapping)
        return out.withColumn("country", F.lit(tag)).withColumn(
            "persona_id", make_persona_id(tag, F.col(key_col))).withColumn("id_stable", F.lit(True))
    is_echo = F.coalesce(F.col(f"`{df.columns[0]}`").cast("string") == ECHO_MARKER, F.lit(False))
    if alt_key_col and alt_key_col in df.columns:
        out, key, stable = df.filter(~is_echo), F.col(alt_key_col), True
    elif has_row_places(df):
        out, key, stable = row_numbers(df, "_row", skip=is_echo), F.col("_row"), True
    else:
        out, key, stable = df.filter(~is_echo), F.monotonically_increasing_id(), False
    return out.withColumn("country", F.lit(tag)).withColumn("persona_id", make_persona_id(tag, key)).withColumn(
        "id_stable", F.lit(stable)).drop("_row")


def union_sources(loaders: Mapping[str, Callable[[], DataFrame]]) -> tuple[DataFrame, list[str]]:
    """IO2: build each source lazily, skip the ones that fail to resolve, fail if none.

    Returns the by-name union (missing columns filled with null) and the skipped tags.
    """
    frames, skipped = [], []
    for tag, load in loaders.items():
        try:
            df = load()
            df.schema  # resolve now: a missing path or column fails here, not mid-job
            frames.append(df)
        except (AnalysisException, FileNotFoundError, OSError):
            skipped.append(tag)
    if not frames:
        raise ValueError("no source could be loaded")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out, skipped


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, multi_line: bool = False,
               **options) -> DataFrame:
    """Scan a survey file: Parquet, or CSV/JSON (with a schema, or all strings by header).

    ``multi_line`` is for CSV files with line breaks inside quoted headers or cells; such a file
    cannot be split between tasks.
    """
    from choicespark.sources.files import CSV_READ_OPTIONS

    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.options(**CSV_READ_OPTIONS).option("multiLine", multi_line)
    for k, v in options.items():
        r = r.option(k, v)
    df = r.load(path)
    last = df.columns[-1]
    if fmt == "csv" and last.endswith("\r"):
        # lines end in \r\n, but a header with a bare line break made the reader take \n as the end
        df = df.withColumnRenamed(last, last[:-1]).withColumn(last[:-1], F.regexp_replace(F.col(last[:-1]), "\r$", ""))
    return df


#: Survey codes whose answers stay text: the multi-choice question.
TEXT_CODES = ("Q10",)


def typed_answers(df: DataFrame) -> DataFrame:
    """Question columns as integers (text that is no number becomes null), apart from ``TEXT_CODES``.

    ``Q31 = "2"`` and ``"2.0"`` are both 2.
    """
    from choicespark import config as cfg
    from choicespark.questionnaire import QUESTION_CODES

    codes = [c for c in [*QUESTION_CODES.values(), cfg.COMPLETION_TIME_COLUMN, cfg.ROW_NUMBER_COLUMN]
             if c in df.columns and c not in TEXT_CODES]
    return df.withColumns({c: F.col(c).try_cast("double").try_cast("int") for c in codes})


def load_survey(spark: SparkSession, path: str, country: str, fmt: str = "csv", schema=None,
                mapping: Mapping[str, str] | None = None, multi_line: bool = True) -> DataFrame:
    """IO1: scan one country's survey export and normalise it (renamed to Q-codes, tagged, keyed).

    Without a schema the columns are found by their header text, whatever their order, and the
    answers get their types after the rename.  Survey headers hold line breaks, hence ``multi_line``.
    """
    from choicespark import config as cfg
    from choicespark.questionnaire import QUESTION_CODES

    raw = read_table(spark, path, fmt, schema, multi_line)
    out = normalise_dialect(raw, country, QUESTION_CODES if mapping is None else mapping,
                            key_col=cfg.ROW_NUMBER_COLUMN, alt_key_col=cfg.PLATFORM_KEY_COLUMN)
    return typed_answers(out) if schema is None else out


def clean_survey(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The reference's cleaning step: quality rules → report, then derived features on the kept rows."""
    from choicespark.operators.features import derive_survey_features
    from choicespark.operators.quality import quality_filter, quality_report, skipped_survey_rules, survey_rules

    rules = survey_rules(df)
    if skipped := skipped_survey_rules(df):
        warnings.warn(f"rules without their columns are skipped: {', '.join(skipped)}", stacklevel=2)
    return derive_survey_features(quality_filter(df, rules)), quality_report(df, rules)
