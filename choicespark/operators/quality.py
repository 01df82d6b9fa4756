"""Data-quality filters, attrition report, null profile and reliability.

The reference applies its filters one after another and counts, for each,
the rows that survive the earlier rules but fail this one.  Here that is one
pass: a ``first_failed_rule`` CASE column, then a single aggregate.  A
missing value fails a rule (pandas mask rule, N1).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark.functions.nulls import safe_pred

Rule = tuple[str, Column]


def first_failed_rule(rules: Sequence[Rule]) -> Column:
    expr = None
    for name, pred in rules:
        fail = ~safe_pred(pred)
        expr = F.when(fail, F.lit(name)) if expr is None else expr.when(fail, F.lit(name))
    return F.lit(None).cast("string") if expr is None else expr


def quality_filter(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows passing every rule (Q1–Q4)."""
    cond = F.lit(True)
    for _, pred in rules:
        cond = cond & safe_pred(pred)
    return df.filter(cond)


def quality_report(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Sequential attrition in one aggregate (Q5).

    Rows: one per rule ``(step, n)`` in rule order — including rules that
    filtered nothing — then ``initial_count``, ``final_count``,
    ``total_filtered``; every row carries ``retention_rate``.
    """
    ff = first_failed_rule(rules)
    tagged = df.select(ff.alias("_fail"))
    aggs = [F.count_if(F.col("_fail") == name).alias(f"r{i}") for i, (name, _) in enumerate(rules)]
    wide = tagged.agg(F.count(F.lit(1)).alias("initial"), F.count_if(F.col("_fail").isNull()).alias("final"), *aggs)
    items = [F.struct(F.lit(name).alias("step"), F.lit(i + 1).alias("step_order"), F.col(f"r{i}").alias("n"))
             for i, (name, _) in enumerate(rules)]
    k = len(rules)
    items += [
        F.struct(F.lit("initial_count").alias("step"), F.lit(k + 1).alias("step_order"), F.col("initial").alias("n")),
        F.struct(F.lit("final_count").alias("step"), F.lit(k + 2).alias("step_order"), F.col("final").alias("n")),
        F.struct(F.lit("total_filtered").alias("step"), F.lit(k + 3).alias("step_order"),
                 (F.col("initial") - F.col("final")).alias("n")),
    ]
    rate = F.try_divide(F.col("final").cast("double"), F.col("initial").cast("double"))
    return wide.select(F.explode(F.array(*items)).alias("s"), rate.alias("retention_rate")).select(
        "s.step", "s.step_order", "s.n", "retention_rate")


def quality_flags(df: DataFrame, flags: Sequence[Rule]) -> DataFrame:
    """Flag counts and percentages without filtering (D2): one aggregate, one row per flag."""
    aggs = [F.count_if(safe_pred(pred)).alias(f"f{i}") for i, (_, pred) in enumerate(flags)]
    wide = df.agg(F.count(F.lit(1)).alias("total"), *aggs)
    items = [F.struct(F.lit(name).alias("flag"), F.col(f"f{i}").alias("flagged")) for i, (name, _) in enumerate(flags)]
    return wide.select("total", F.explode(F.array(*items)).alias("s")).select(
        F.col("s.flag").alias("flag"), F.col("s.flagged").alias("flagged"),
        F.coalesce(F.try_divide(F.col("s.flagged") * 100.0, F.col("total").cast("double")), F.lit(0.0)).alias("percentage"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count per column, keeping columns with at least one null (Q6); one aggregate."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    stack = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_count")) for c in cols]))
    return wide.select(stack.alias("s")).select("s.column", "s.null_count").filter(F.col("null_count") > 0)


def consistency_label(inconsistent: Column, suspicious: Column) -> Column:
    """inconsistent / suspicious / ok (D3)."""
    return F.when(safe_pred(inconsistent), "inconsistent").when(safe_pred(suspicious), "suspicious").otherwise("ok")


def cronbach_alpha(df: DataFrame, items: Sequence[str]) -> DataFrame:
    """Cronbach's alpha of an item set in one aggregate (D8), sample variances, complete rows only."""
    complete = df.select(*items).dropna()
    total = sum((F.col(c).cast("double") for c in items), F.lit(0.0))
    agg = complete.agg(*[F.var_samp(c).alias(f"v{i}") for i, c in enumerate(items)], F.var_samp(total).alias("vt"))
    k = len(items)
    sum_items = sum((F.col(f"v{i}") for i in range(k)), F.lit(0.0))
    return agg.select(
        (F.lit(k / (k - 1)) * (F.lit(1.0) - F.try_divide(sum_items, F.col("vt")))).alias("cronbach_alpha"),
        F.lit(k).alias("n_items"),
    )


def survey_rules(df: DataFrame) -> list[Rule]:
    """The four survey rules, each kept only when its columns exist (Q1–Q4)."""
    from choicespark import config as cfg
    from choicespark.functions.nulls import guarded_ratio

    rules: list[Rule] = []
    if cfg.COMPLETION_TIME_COLUMN in df.columns:
        rules.append(("completion_time_too_short", F.col(cfg.COMPLETION_TIME_COLUMN) >= cfg.MIN_COMPLETION_TIME))
    if cfg.ATTENTION_CHECK_COLUMN in df.columns:
        rules.append(("attention_check_failed", F.col(cfg.ATTENTION_CHECK_COLUMN) == cfg.ATTENTION_CHECK_ANSWER))
    if "Q1" in df.columns and "Q2" in df.columns:
        rules.append(("commute_time_abnormal",
                      (F.col("Q1") <= cfg.MAX_COMMUTE_TIME) & (F.col("Q2") <= cfg.MAX_COMMUTE_TIME)))
    if "Q21" in df.columns and "Q42" in df.columns:
        rules.append(("delay_threshold_inconsistent", guarded_ratio("Q42", "Q21") < cfg.MAX_DELAY_RATIO))
    return rules


def skipped_survey_rules(df: DataFrame) -> list[str]:
    """Names of the four survey rules that ``survey_rules`` leaves out because a column is missing."""
    names = ["completion_time_too_short", "attention_check_failed", "commute_time_abnormal", "delay_threshold_inconsistent"]
    kept = {name for name, _ in survey_rules(df)}
    return [n for n in names if n not in kept]


def survey_flags() -> list[Rule]:
    """The survey's six documented quality flags (D2); a flag is raised where its condition holds."""
    from choicespark import config as cfg

    return [
        ("too_fast", F.col(cfg.COMPLETION_TIME_COLUMN) < 180),
        ("attention_check_failed", F.col(cfg.ATTENTION_CHECK_COLUMN) != 2),
        ("tolerance_inconsistent", F.try_divide(F.col("Q42").cast("double"), F.col("Q21").cast("double")) > 3),
        ("low_evacuation_willingness", F.col("Q48") < 3),
        ("odd_commute_time", (F.col("Q1") > 120) | (F.col("Q2") > 120)),
        ("bold_and_cautious", (F.col("Q40") >= 4) & (F.col("Q41") >= 4)),
    ]


def reroute_consistency() -> Column:
    """The documented consistency label of reroute answers (D3): inconsistent, suspicious or ok."""
    commute = (F.col("Q43") + F.col("Q44")) / 2
    top = F.greatest("Q43", "Q44", "Q45")
    return (F.when(F.abs(commute - F.col("Q7")) > 3, "inconsistent").when(F.col("Q48") < top, "suspicious")
            .otherwise("ok"))
