"""Persona assembly: defaults, decoding, descriptive text, factor struct.

One row in, one row out; no shuffle.  Rows whose required integers are
missing are split off with a reason instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.functions.nulls import safe_pred
from choicespark.functions.text import fragments, int_text
from choicespark.operators.features import bucket_members, decode


def _f(df: DataFrame, name: str) -> Column:
    """Factor value, or null when the factor column is absent."""
    return F.col(name) if name in df.columns else F.lit(None).cast("double")


def _q(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None)


# FIXED VALUES: the fragments of the next two functions must equal the texts being reproduced.

def preference_text(df: DataFrame) -> Column:
    """Transportation-preference sentence (X13): fragments joined by ``"; "``."""
    parts = []
    if "Q22" in df.columns:
        parts.append(F.when(F.col("Q22") >= 4, "prefer familiar routes"))
    if "risk_aversion" in df.columns:
        ra = F.col("risk_aversion")
        parts.append(F.when(ra > 0.5, "high risk aversion").when(ra < -0.5, "risk-tolerant"))
    if "information_dependency" in df.columns:
        idp = F.col("information_dependency")
        parts.append(F.when(idp > 0.5, "rely heavily on navigation apps")
                     .when(idp < -0.5, "prefer self-judgment over navigation"))
    if "Q29" in df.columns:
        parts.append(F.when(F.col("Q29") >= 4, "prefer smooth routes over fast but uncertain ones"))
    if "Q21" in df.columns:
        t = F.col("Q21").cast("int")
        parts.append(F.when(t <= 10, F.concat(F.lit("willing to reroute if delay >"), int_text(t), F.lit("min")))
                     .otherwise(F.concat(F.lit("patient with delays up to "), int_text(t), F.lit("min"))))
    if "Q30" in df.columns:
        parts.append(F.when(F.col("Q30") >= 4, "immediately reroute to save time"))
    if "use_nav_app" in df.columns:
        parts.append(F.when(safe_pred(F.col("use_nav_app")), "use navigation apps regularly"))
    return fragments("; ", parts, "balanced decision-maker")


def personality_text(df: DataFrame) -> Column:
    """Trait list joined by ``", "`` (X14); all comparisons strict."""
    ra = _f(df, "risk_aversion")
    parts = [
        F.when(ra > 0.5, "cautious").when(ra < -0.5, "bold"),
        F.when(_f(df, "time_sensitivity") > 0.5, "time-sensitive"),
        F.when(_f(df, "information_dependency") > 0.5, "information-dependent"),
        F.when(_f(df, "route_flexibility") > 0.5, "flexible"),
        F.when(_f(df, "rerouting_proactiveness") > 0.5, "proactive"),
    ]
    return fragments(", ", parts, "rational, balanced")


def assign_name(persona_id: Column, gender_code: Column | None = None, country: Column | None = None,
                pools: dict | None = None, seed: int = cfg.SEED) -> Column:
    """``User_<suffix>`` unless name pools are given."""
    suffix = F.concat(F.lit("User_"), F.split(persona_id, "_").getItem(1))
    if not pools or gender_code is None or country is None:
        return suffix
    from choicespark.functions.draws import pick, uniform

    u = uniform(seed, "name", persona_id)
    expr = None
    for ctry, by_gender in pools.items():
        for gender, names in by_gender.items():
            cond = (country == ctry) & (F.when(gender_code == 1, "male").otherwise("female") == gender)
            expr = F.when(cond, pick(u, names)) if expr is None else expr.when(cond, pick(u, names))
    return suffix if expr is None else expr.otherwise(suffix)


def reject_reason(df: DataFrame, required: Sequence[str] = ("Q21", "Q49", "Q52")) -> Column:
    """First required integer that is missing (Q7); null for a valid row."""
    expr = None
    for c in required:
        if c not in df.columns:
            continue
        cond = F.col(c).isNull()
        expr = F.when(cond, F.lit(f"missing {c}")) if expr is None else expr.when(cond, F.lit(f"missing {c}"))
    return F.lit(None).cast("string") if expr is None else expr


def split_rejected(df: DataFrame, required: Sequence[str] = ("Q21", "Q49", "Q52")) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reject_reason``) from one boolean column."""
    tagged = df.withColumn("reject_reason", reject_reason(df, required))
    return (tagged.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            tagged.filter(F.col("reject_reason").isNotNull()))


def factor_struct(df: DataFrame, names: Sequence[str] = cfg.FACTOR_NAMES) -> Column:
    return F.struct(*[_f(df, n).cast("double").alias(n) for n in names])


#: Derived survey features that a persona carries as they are.
RATIOS = ("congestion_ratio_morning", "congestion_ratio_afternoon", "delay_tolerance_ratio")


def build_personas(df: DataFrame) -> DataFrame:
    """Survey rows (Q-columns + factor columns) → persona rows.

    The derived ratios (``RATIOS``) are kept when the survey has them; a missing value stays null.
    """
    ints = {out: (F.coalesce(F.col(src).try_cast("int"), F.lit(d)) if src in df.columns else F.lit(d))
            for out, (src, d) in cfg.PERSONA_INT_DEFAULTS.items()}
    income = (bucket_members(F.col("Q52").cast("int"), cfg.INCOME_LEVEL)
              if "Q52" in df.columns else F.lit("middle"))
    return df.select(
        F.col("persona_id"),
        assign_name(F.col("persona_id")).alias("name"),
        ints["age"].alias("age"),
        decode(_q(df, "Q49"), cfg.GENDER, "male").alias("gender"),
        F.col("country"),
        decode(_q(df, "Q54"), cfg.EDUCATION, "bachelor").alias("education"),
        decode(_q(df, "Q53"), cfg.OCCUPATION, "professional").alias("occupation"),
        preference_text(df).alias("preferences_in_transportation"),
        personality_text(df).alias("innate"),
        *[ints[k].alias(k) for k in ("commute_time_morning", "commute_time_afternoon",
                                     "congestion_duration_morning", "congestion_duration_afternoon")],
        decode(_q(df, "Q3"), cfg.ROUTE_TYPE, "arterial").alias("main_route_type"),
        income.alias("household_income"),
        decode(_q(df, "Q57"), cfg.LOCATION, "urban").alias("home_location"),
        decode(_q(df, "Q58"), cfg.LOCATION, "urban").alias("work_location"),
        decode(_q(df, "Q56"), cfg.HAS_NAVIGATION, True).alias("has_navigation"),
        F.lit(True).alias("licensed_driver"),
        *[ints[k].alias(k) for k in ("delay_tolerance_planned", "delay_tolerance_realtime",
                                     "reroute_threshold_construction", "reroute_threshold_special_event",
                                     "reroute_threshold_weather", "reroute_threshold_congestion",
                                     "reroute_threshold_accident")],
        factor_struct(df).alias("preference_factors"),
        *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in RATIOS if c in df.columns],
    )


def dominant_factor(factors: Column, names: Sequence[str] = cfg.FACTOR_NAMES) -> Column:
    """Name of the factor with the largest absolute value; first wins a tie.

    Missing factors are skipped; with none present the default is ``time_sensitivity``.
    """
    cands = F.array(*[
        F.struct(F.abs(factors.getField(n)).alias("a"), F.lit(-i).alias("p"), F.lit(n).alias("name"))
        for i, n in enumerate(names)
    ])
    present = F.filter(cands, lambda s: s.getField("a").isNotNull())
    return F.coalesce(F.array_max(present).getField("name"), F.lit("time_sensitivity"))


def personas_from_survey(clean: DataFrame, k: int = cfg.N_FACTORS, items: Sequence[str] = cfg.ATTITUDE_ITEMS):
    """Cleaned survey → factor model on the attitude items → persona rows.

    Items absent from the survey are skipped (and returned), missing answers
    take the exact item median, the model is fitted from the distributed
    correlation matrix, scores are joined back on (persona_id, country).
    Returns (personas, rejected rows, fitted model, missing items).
    """
    from choicespark.operators.factors import factor_scores, fit_factor_model
    from choicespark.operators.features import impute_median
    from choicespark.operators.joins import join_inner_2key
    from choicespark.sources.survey import select_items

    subset, missing = select_items(clean, items)
    present = [c for c in items if c in clean.columns]
    k = min(k, len(present))
    if k == 0:  # no attitude items at all: personas without factor scores
        valid, rejected = split_rejected(clean)
        return build_personas(valid), rejected, None, missing
    imputed = impute_median(subset.withColumns({c: F.col(c).cast("double") for c in present}), present)
    with_items = imputed.withColumn("_items", F.array(*[F.col(c) for c in present]))
    model = fit_factor_model(with_items, "_items", k)
    names = list(cfg.FACTOR_NAMES[:k])
    scores = factor_scores(with_items, "_items", model, names).select("persona_id", "country", *names)
    joined = join_inner_2key(clean.drop(*[n for n in names if n in clean.columns]), scores)
    valid, rejected = split_rejected(joined)
    return build_personas(valid), rejected, model, missing
