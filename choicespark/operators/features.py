"""Derived survey features (scale reversal, guarded ratios, multi-choice, decoding, banding).

All operators are column expressions resolved once against ``df.columns`` at
plan-build time; a step whose inputs are absent is skipped (and reported by
:func:`skipped_steps`), never evaluated per row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark.functions.nulls import clip_keep_null, guarded_ratio, row_mean, safe_pred


def reverse_scale(df: DataFrame, cols: Sequence[str], max_value: int = 5, suffix: str = "_reversed") -> DataFrame:
    """Likert reversal ``(max+1) - x``; null stays null."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({f"{c}{suffix}": F.lit(max_value + 1) - F.col(c) for c in present})


def ratio_clip(df: DataFrame, out: str, num: str, den: str, lo: float, hi: float) -> DataFrame:
    """``clip(num / nz(den), lo, hi)`` keeping null (X2, rules N2 and N4)."""
    if num not in df.columns or den not in df.columns:
        return df
    return df.withColumn(out, clip_keep_null(guarded_ratio(num, den), lo, hi))


def abs_diff(df: DataFrame, out: str, a: str, b: str) -> DataFrame:
    if a not in df.columns or b not in df.columns:
        return df
    return df.withColumn(out, F.abs(F.col(a) - F.col(b)))


def with_row_mean(df: DataFrame, out: str, cols: Sequence[str]) -> DataFrame:
    """Row mean skipping nulls, only when every column exists."""
    if not all(c in df.columns for c in cols):
        return df
    return df.withColumn(out, row_mean(cols))


def parse_multi_choice(c: Column, sep: str = ",") -> Column:
    """``"1, 2,8"`` → ``["1","2","8"]``; null or empty → empty array."""
    s = F.trim(c.cast("string"))
    return F.when(c.isNull() | (s == ""), F.array().cast("array<string>")).otherwise(
        F.transform(F.split(s, sep), lambda x: F.trim(x))
    )


def multi_choice(df: DataFrame, col: str, out: str = "info_channels", count_out: str = "info_channel_count",
                 sep: str = ",") -> DataFrame:
    if col not in df.columns:
        return df
    arr = parse_multi_choice(F.col(col), sep)
    return df.withColumn(out, arr).withColumn(count_out, F.size(F.col(out)))


def choice_flags(df: DataFrame, col: str, flags: Mapping[str, str]) -> DataFrame:
    """Substring flags on the raw multi-choice text; ``"12"`` contains ``"2"`` (X6, kept quirk)."""
    if col not in df.columns:
        return df
    return df.withColumns({name: safe_pred(F.col(col).cast("string").contains(token)) for name, token in flags.items()})


def channel_onehot(df: DataFrame, col: str, channels: Mapping[str, str], sep: str = ",") -> DataFrame:
    """Exact-membership one-hot from the multi-choice text."""
    arr = parse_multi_choice(F.col(col), sep)
    return df.withColumns({name: F.array_contains(arr, code) for name, code in channels.items()})


def decode(c: Column, mapping: Mapping[object, object], default: object) -> Column:
    """Lookup through a small literal map; unknown and missing codes take ``default``."""
    if not mapping:
        return F.lit(default)
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, c), F.lit(default))


def bucket_members(c: Column, buckets: Mapping[str, Sequence[int]], default: str = "unknown") -> Column:
    """Name of the bucket whose member list contains the code."""
    expr = None
    for name, members in buckets.items():
        cond = c.isin(list(members))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def band(c: Column, cuts: Sequence[tuple[float, str]], default: str) -> Column:
    """Descending strict-threshold banding: first ``c > cut`` wins."""
    expr = None
    for cut, label in cuts:
        expr = F.when(c > cut, F.lit(label)) if expr is None else expr.when(c > cut, F.lit(label))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


#: FIXED VALUES: channel codes of the multi-choice information question, in code order.
CHANNELS = {"1": "radio", "2": "navigation_app", "3": "vms", "4": "web", "5": "social_media", "6": "friends",
            "7": "experience", "8": "other"}


def channel_names(codes: Column, names: Mapping[str, str] = CHANNELS) -> Column:
    """Array of multi-choice codes → channel names; unknown codes become ``unknown``."""
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.transform(codes, lambda c: F.coalesce(F.try_element_at(m, F.trim(c)), F.lit("unknown")))


def uncertainty_level(delay: Column) -> Column:
    """>15 high, >5 moderate, else low."""
    return band(delay, [(15, "high"), (5, "moderate")], "low")


def familiarity_band(fam: Column) -> Column:
    return band(fam, [(0.8, "High - your usual route"), (0.5, "Medium")], "Low - unfamiliar")


def delay_level(delay: Column) -> Column:
    """0 none, <8 minor, <16 moderate, else severe (X11)."""
    return (F.when(delay == 0, "none").when(delay < 8, "minor").when(delay < 16, "moderate")
            .otherwise("severe"))


def period_from_template(template: Column) -> Column:
    """Template name → abstract time period."""
    return (F.when(template == "commute_morning", "morning rush hour")
            .when(template == "commute_evening", "evening rush hour")
            .otherwise("off-peak hours"))


def period_from_hour(hour: Column) -> Column:
    """Real timestamps: 7–9 morning rush, 17–19 evening rush, else off-peak."""
    return (F.when(hour.between(7, 9), "morning rush hour")
            .when(hour.between(17, 19), "evening rush hour")
            .otherwise("off-peak hours"))


def period_stats_key(period: Column) -> Column:
    """Period text → statistics key by substring."""
    return (F.when(period.contains("morning"), "morning_rush")
            .when(period.contains("evening"), "evening_rush")
            .otherwise("off_peak"))


def default_ints(df: DataFrame, defaults: Mapping[str, tuple[str, int]]) -> DataFrame:
    """``out = int(src)`` when present and parseable, else the default."""
    exprs = {}
    for out, (src, d) in defaults.items():
        exprs[out] = F.coalesce(F.col(src).try_cast("int"), F.lit(d)) if src in df.columns else F.lit(d)
    return df.withColumns(exprs)


def purpose_weights(df: DataFrame, id_col: str, cols: Sequence[str], scale: float = 5.0) -> DataFrame:
    """Long table (id, purpose, weight = x / scale)."""
    stacked = df.select(id_col, *cols).unpivot(id_col, list(cols), "purpose", "raw")
    return stacked.withColumn("weight", F.col("raw").cast("double") / F.lit(scale)).drop("raw")


def skipped_steps(df: DataFrame, steps: Mapping[str, Sequence[str]]) -> list[str]:
    """Names of steps whose input columns are absent (plan-build-time report)."""
    return [name for name, cols in steps.items() if not all(c in df.columns for c in cols)]


def attach_statistics(df: DataFrame, aggs: Mapping[str, Column]) -> DataFrame:
    """Attach one-row global statistics to every row.

    The statistics are one global aggregate (partial aggregates per task, one
    row in the end), broadcast and attached by a join whose build side is that
    single row, so each input row yields exactly one output row.  Kept in the
    same plan as the rows so the shared upstream exchanges are computed once.
    """
    stats = df.agg(*[c.alias(k) for k, c in aggs.items()])
    return df.join(F.broadcast(stats), how="inner")


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_z") -> DataFrame:
    """``(x - mean) / std_pop`` with std 0 → 1 (F2, rule N12); one aggregate for all columns."""
    aggs = {**{f"_m_{c}": F.avg(c) for c in cols}, **{f"_s_{c}": F.stddev_pop(c) for c in cols}}
    j = attach_statistics(df, aggs)
    return j.withColumns({
        f"{c}{suffix}": (F.col(c) - F.col(f"_m_{c}"))
        / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}"))
        for c in cols
    }).drop(*aggs)


def impute_median(df: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Exact median imputation (F1, N13): all columns' medians from the same three passes, then ``coalesce``."""
    from choicespark.operators.aggregates import exact_quantiles_of

    median = exact_quantiles_of(df, cols, [0.5])
    return df.withColumns({f"{c}{suffix}": F.coalesce(F.col(c), F.lit(median[c][0]).cast("double")) for c in cols})


def derive_survey_features(df: DataFrame) -> DataFrame:
    """The cleaning step's derived columns, each only when its inputs exist.

    Reversed Q23/Q40, congestion ratios clipped to [0, 1], commute asymmetry,
    delay-tolerance ratio clipped to [0, 5], parsed information channels with
    their count and the two substring flags, and the mean trip-purpose answer.
    """
    from choicespark import config as cfg

    out = reverse_scale(df, ["Q23", "Q40"], max_value=5)
    out = ratio_clip(out, "congestion_ratio_morning", "Q4", "Q1", 0, 1)
    out = ratio_clip(out, "congestion_ratio_afternoon", "Q5", "Q2", 0, 1)
    out = abs_diff(out, "commute_asymmetry", "Q1", "Q2")
    out = ratio_clip(out, "delay_tolerance_ratio", "Q42", "Q21", 0, 5)
    out = multi_choice(out, "Q10")
    out = choice_flags(out, "Q10", {"use_nav_app": "2", "use_vms": "3"})
    return with_row_mean(out, "avg_reroute_willingness", cfg.TRIP_PURPOSE_ITEMS)
