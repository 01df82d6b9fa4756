"""Persona → scenario → decision plans over the driver tables, with oracle SQL.

Doubles that two engines may sum in a different order are compared as
``round(x * 1e6)`` bigints (``_ppm`` columns); everything else is exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.functions import draws as D
from choicespark.functions.nulls import scaled
from choicespark.operators import choice as C
from choicespark.operators.calibration import decide_calibrated
from choicespark.operators.features import derive_survey_features
from choicespark.operators.personas import RATIOS, build_personas, split_rejected
from choicespark.operators.scenarios import flatten_scenarios, generate_scenarios, scenario_stats
from choicespark.plans.corpus_sql import DECISIONS_SQL, SCENARIOS_SQL
from choicespark.plans.registry import query, table
from choicespark.plans.survey_view import PERSONAS_SQL, SURVEY_SQL, customer_survey


def personas(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid, _ = split_rejected(customer_survey(spark, sf_dir))
    return build_personas(valid)


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate_scenarios(personas(spark, sf_dir))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario rows carrying persona columns, with decision columns added (no join)."""
    return C.decide_rows(generate_scenarios(personas(spark, sf_dir), keep_persona=True))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("scenario_id", "persona_id", "chosen_route", "reroute", "reasoning",
                                         "utility_scores", "overridden")


# ------------------------------------------------------------------ personas

@query("persona_struct", "WITH " + PERSONAS_SQL + """
SELECT persona_id, name, age, gender, country, education, occupation, commute_time_morning,
       commute_time_afternoon, household_income, delay_tolerance_planned, delay_tolerance_realtime,
       CAST(round(time_sensitivity * 1e6) AS BIGINT) AS time_sensitivity_ppm,
       CAST(round(risk_aversion * 1e6) AS BIGINT) AS risk_aversion_ppm
FROM personas""")
def q_persona_struct(spark, sf_dir):
    p = personas(spark, sf_dir)
    return p.select("persona_id", "name", "age", "gender", "country", "education", "occupation",
                    "commute_time_morning", "commute_time_afternoon", "household_income",
                    "delay_tolerance_planned", "delay_tolerance_realtime",
                    scaled("preference_factors.time_sensitivity").alias("time_sensitivity_ppm"),
                    scaled("preference_factors.risk_aversion").alias("risk_aversion_ppm"))


#: Columns that play the congestion answers Q4 and Q5 (minutes of the commutes Q1 and Q2).
_CONGESTED = {"Q4": "Q29", "Q5": "Q30"}


@query("persona_ratios", "WITH " + SURVEY_SQL + """
SELECT persona_id, CASE WHEN Q29 IS NOT NULL AND Q1 IS NOT NULL THEN CAST(round(least(greatest(CAST(Q29 AS DOUBLE) / (CASE WHEN Q1 = 0 THEN 1 ELSE Q1 END), 0.0), 1.0) * 1e6) AS BIGINT) END AS congestion_ratio_morning_ppm,
       CASE WHEN Q30 IS NOT NULL AND Q2 IS NOT NULL THEN CAST(round(least(greatest(CAST(Q30 AS DOUBLE) / (CASE WHEN Q2 = 0 THEN 1 ELSE Q2 END), 0.0), 1.0) * 1e6) AS BIGINT) END AS congestion_ratio_afternoon_ppm,
       CASE WHEN Q42 IS NOT NULL AND Q21 IS NOT NULL THEN CAST(round(least(greatest(CAST(Q42 AS DOUBLE) / (CASE WHEN Q21 = 0 THEN 1 ELSE Q21 END), 0.0), 5.0) * 1e6) AS BIGINT) END AS delay_tolerance_ratio_ppm
FROM survey WHERE Q21 IS NOT NULL AND Q49 IS NOT NULL AND Q52 IS NOT NULL""")
def q_persona_ratios(spark, sf_dir):
    """The ratios that the cleaning step derives, as the personas carry them."""
    survey = customer_survey(spark, sf_dir, with_factors=False)
    survey = derive_survey_features(survey.withColumns({q: F.col(src) for q, src in _CONGESTED.items()}))
    p = build_personas(split_rejected(survey)[0])
    return p.select("persona_id", *[scaled(c).alias(f"{c}_ppm") for c in RATIOS])


@query("preference_text", "WITH " + PERSONAS_SQL + """
SELECT persona_id, preferences_in_transportation FROM personas""")
def q_preference_text(spark, sf_dir):
    return personas(spark, sf_dir).select("persona_id", "preferences_in_transportation")


@query("personality_text", "WITH " + PERSONAS_SQL + """
SELECT persona_id, innate FROM personas""")
def q_personality_text(spark, sf_dir):
    return personas(spark, sf_dir).select("persona_id", "innate")


@query("assign_name", "WITH " + PERSONAS_SQL + """
SELECT persona_id, name FROM personas""")
def q_assign_name(spark, sf_dir):
    return personas(spark, sf_dir).select("persona_id", "name")


# customers in debt did not answer the income question; every seventh customer's tolerance is missing
_GAPS_SQL = """,
gaps AS (SELECT s.* REPLACE (CASE WHEN acctbal < 0 THEN NULL ELSE Q52 END AS Q52,
                             CASE WHEN right(persona_id, 1) = '7' THEN NULL ELSE Q21 END AS Q21) FROM sv0 s)"""


def _with_gaps(spark, sf_dir):
    sv = customer_survey(spark, sf_dir, with_factors=False)
    return sv.withColumns({"Q52": F.when(~(F.col("acctbal") < 0), F.col("Q52")),
                           "Q21": F.when(~F.col("persona_id").endswith("7"), F.col("Q21"))})


@query("reject_rows", "WITH " + SURVEY_SQL + _GAPS_SQL + """
SELECT persona_id, CASE WHEN Q21 IS NULL THEN 'missing Q21' WHEN Q49 IS NULL THEN 'missing Q49'
                        WHEN Q52 IS NULL THEN 'missing Q52' END AS reject_reason
FROM gaps WHERE Q21 IS NULL OR Q49 IS NULL OR Q52 IS NULL""")
def q_reject_rows(spark, sf_dir):
    _, rejected = split_rejected(_with_gaps(spark, sf_dir))
    return rejected.select("persona_id", "reject_reason")


@query("default_ints", "WITH " + SURVEY_SQL + _GAPS_SQL + """
SELECT persona_id, coalesce(Q1, 30) AS commute_time_morning, coalesce(TRY_CAST(nullif(Q2 % 10, 3) AS INTEGER), 30) AS commute_time_afternoon,
       coalesce(Q50, 30) AS age, coalesce(Q21, 10) AS delay_tolerance_planned,
       coalesce(Q42, 15) AS delay_tolerance_realtime, 3 AS reroute_threshold_construction
FROM gaps""")
def q_default_ints(spark, sf_dir):
    """Answers as text: some missing, some no number (``Q2`` ending in 3 reads ``n/a``)."""
    from choicespark.operators.features import default_ints
    sv = _with_gaps(spark, sf_dir)
    last = F.col("Q2") % 10
    sv = sv.withColumns({"Q2": F.when(last == 3, "n/a").otherwise(last.cast("string")), "Q21": F.col("Q21").cast("string")})
    d = {k: cfg.PERSONA_INT_DEFAULTS[k] for k in ("commute_time_morning", "commute_time_afternoon", "age",
                                                  "delay_tolerance_planned", "delay_tolerance_realtime",
                                                  "reroute_threshold_construction")}
    return default_ints(sv, d).select("persona_id", *d.keys())


def _pool_sql() -> str:
    whens = []
    for country, by_gender in cfg.NAME_POOLS.items():
        for gender, names in by_gender.items():
            pool = ", ".join(f"'{n}'" for n in names)
            u = D.sql_uniform(cfg.SEED, "name", "persona_id")
            whens.append(f"WHEN country = '{country}' AND gender = '{gender}' THEN ([{pool}])[CAST(floor({u} * {len(names)}) AS INTEGER) + 1]")
    return "CASE " + " ".join(whens) + " ELSE 'User_' || split_part(persona_id, '_', 2) END"


@query("assign_name_pools", f"""
WITH p AS (SELECT 'C_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS persona_id,
                  CASE c_nationkey % 5 WHEN 0 THEN 'CN' WHEN 1 THEN 'US' WHEN 2 THEN 'UK' WHEN 3 THEN 'AU' ELSE 'XX' END AS country,
                  CASE WHEN 1 + c_custkey % 2 = 1 THEN 'male' ELSE 'female' END AS gender FROM customer)
SELECT persona_id, {_pool_sql()} AS name FROM p""")
def q_assign_name_pools(spark, sf_dir):
    """Names from the pools; a country without a pool falls back to the id."""
    from choicespark.operators.personas import assign_name
    from choicespark.sources.survey import make_persona_id

    c = table(spark, sf_dir, "customer")
    country = F.element_at(F.array(*[F.lit(x) for x in ("CN", "US", "UK", "AU", "XX")]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    p = c.select(make_persona_id("C", F.col("c_custkey")).alias("persona_id"), country.alias("country"), (1 + F.col("c_custkey") % 2).alias("gender"))
    return p.select("persona_id", assign_name(F.col("persona_id"), F.col("gender"), F.col("country"), cfg.NAME_POOLS).alias("name"))


# ------------------------------------------------------------------ scenarios

_SCEN_OUT = ["scenario_id", "persona_id", "origin", "destination", "time_period", "trip_purpose", "a_normal",
             "a_delay", "a_time", "a_uncertainty", "b_normal", "b_delay", "b_time", "b_uncertainty", "event_type",
             "event_severity", "event_location", "weather", "is_rush_hour", "has_important_meeting", "time_buffer",
             "redrawn", "still_invalid"]


@query("scenario_struct", "WITH " + SCENARIOS_SQL + f"""
SELECT {", ".join(_SCEN_OUT)},
       CAST(round(a_familiarity * 1e6) AS BIGINT) AS a_familiarity_ppm,
       CAST(round(b_familiarity * 1e6) AS BIGINT) AS b_familiarity_ppm
FROM scen""")
def q_scenario_struct(spark, sf_dir):
    f = flatten_scenarios(scenarios(spark, sf_dir))
    return f.select(*_SCEN_OUT, scaled("a_familiarity").alias("a_familiarity_ppm"),
                    scaled("b_familiarity").alias("b_familiarity_ppm"))


@query("fan_out", "WITH " + PERSONAS_SQL + f"""
SELECT persona_id, CAST(i AS INTEGER) AS scenario_idx, persona_id || '_S' || lpad(CAST(i AS VARCHAR), 2, '0') AS scenario_id
FROM personas, range(1, {cfg.SCENARIOS_PER_PERSONA + 1}) t(i)""")
def q_fan_out(spark, sf_dir):
    from choicespark.operators.scenarios import fan_out
    return fan_out(personas(spark, sf_dir).select("persona_id")).select("persona_id", "scenario_idx", "scenario_id")


@query("redraw_once", "WITH " + SCENARIOS_SQL + """
SELECT redrawn, still_invalid, count(*) AS n FROM scen GROUP BY redrawn, still_invalid""")
def q_redraw_once(spark, sf_dir):
    return scenarios(spark, sf_dir).groupBy("redrawn", "still_invalid").agg(F.count(F.lit(1)).alias("n"))


@query("scenario_stats", "WITH " + SCENARIOS_SQL + """,
keyed AS (
  SELECT CASE WHEN a_delay = 0 THEN 'none' WHEN a_delay < 8 THEN 'minor' WHEN a_delay < 16 THEN 'moderate'
              ELSE 'severe' END AS delay_levels,
         coalesce(event_type, 'none') AS event_types, trip_purpose AS trip_purposes,
         CASE WHEN time_period LIKE '%morning%' THEN 'morning_rush' WHEN time_period LIKE '%evening%' THEN 'evening_rush'
              ELSE 'off_peak' END AS time_periods
  FROM scen),
long AS (
  SELECT 'delay_levels' AS category, delay_levels AS key FROM keyed UNION ALL
  SELECT 'event_types', event_types FROM keyed UNION ALL
  SELECT 'trip_purposes', trip_purposes FROM keyed UNION ALL
  SELECT 'time_periods', time_periods FROM keyed),
counts AS (SELECT category, key, count(*) AS count FROM long GROUP BY category, key)
SELECT category, key, count,
       CAST(round((CAST(count AS DOUBLE) * 100.0) / sum(count) OVER (PARTITION BY category) * 1e6) AS BIGINT) AS share_ppm
FROM counts""")
def q_scenario_stats(spark, sf_dir):
    return scenario_stats(scenarios(spark, sf_dir)).select("category", "key", "count",
                                                          scaled("share").alias("share_ppm"))


# ------------------------------------------------------------------ decisions

_DEC_SQL_OUT = """scenario_id, persona_id, chosen_route, reroute, reasoning, overridden,
       CAST(round(util_a * 1e6) AS BIGINT) AS util_a_ppm, CAST(round(util_b * 1e6) AS BIGINT) AS util_b_ppm"""


def _dec_out(d: DataFrame) -> DataFrame:
    return d.select("scenario_id", "persona_id", "chosen_route", "reroute", "reasoning", "overridden",
                    scaled(F.col("utility_scores")["A"]).alias("util_a_ppm"),
                    scaled(F.col("utility_scores")["B"]).alias("util_b_ppm"))


@query("decide", "WITH " + DECISIONS_SQL + f"\nSELECT {_DEC_SQL_OUT} FROM decisions_r")
def q_decide(spark, sf_dir):
    return _dec_out(decisions(spark, sf_dir))


@query("reasoning_text", "WITH " + DECISIONS_SQL + "\nSELECT scenario_id, reasoning FROM decisions_r")
def q_reasoning_text(spark, sf_dir):
    return decisions(spark, sf_dir).select("scenario_id", "reasoning")


@query("decision_stats", "WITH " + DECISIONS_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE reroute) AS reroute_count,
       count(*) FILTER (WHERE NOT reroute) AS keep_count,
       CAST(count(*) FILTER (WHERE reroute) AS DOUBLE) / count(*) AS reroute_rate,
       (CAST(count(*) FILTER (WHERE reroute) AS DOUBLE) / count(*)) BETWEEN 0.35 AND 0.65 AS rate_in_range
FROM decisions""")
def q_decision_stats(spark, sf_dir):
    st = C.decision_stats(decisions(spark, sf_dir))
    return st.withColumn("rate_in_range", C.rate_in_range(F.col("reroute_rate")))


@query("route_distribution", "WITH " + DECISIONS_SQL + """
SELECT chosen_route, count(*) AS count, CAST(round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () * 1e6) AS BIGINT) AS share_ppm
FROM decisions GROUP BY chosen_route""")
def q_route_distribution(spark, sf_dir):
    d = C.route_distribution(decisions(spark, sf_dir))
    return d.select("chosen_route", "count", scaled("share").alias("share_ppm"))


@query("keyword_coverage", "WITH " + DECISIONS_SQL + f""",
kw AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {i})" for i, k in enumerate(cfg.REASON_KEYWORDS))}) t(keyword, pos))
SELECT keyword, count(d.scenario_id) AS count,
       coalesce((CAST(count(d.scenario_id) AS DOUBLE) * 100.0) / CAST((SELECT count(*) FROM decisions_r) AS DOUBLE), 0.0)
         AS percentage
FROM kw LEFT JOIN decisions_r d ON contains(d.reasoning, kw.keyword)
GROUP BY keyword""")
def q_keyword_coverage(spark, sf_dir):
    return C.keyword_coverage(decisions(spark, sf_dir))


@query("rate_in_range", "WITH " + DECISIONS_SQL + """
SELECT CAST(round(CAST(count(*) FILTER (WHERE reroute) AS DOUBLE) / count(*) * 1e6) AS BIGINT) AS reroute_rate_ppm,
       (CAST(count(*) FILTER (WHERE reroute) AS DOUBLE) / count(*)) BETWEEN 0.35 AND 0.65 AS in_range
FROM decisions""")
def q_rate_in_range(spark, sf_dir):
    st = C.decision_stats(decisions(spark, sf_dir))
    return st.select(scaled("reroute_rate").alias("reroute_rate_ppm"), C.rate_in_range(F.col("reroute_rate")).alias("in_range"))


@query("rate_calibrated", "WITH " + DECISIONS_SQL + """
SELECT count(*) AS total, CAST(floor(count(*) * 0.5 + 0.5) AS BIGINT) AS reroute_count, true AS in_range FROM decisions""")
def q_rate_calibrated(spark, sf_dir):
    """Decisions simulated with the knobs that bring the reroute rate to the middle of the target range."""
    rows = generate_scenarios(personas(spark, sf_dir), keep_persona=True)
    st = C.decision_stats(decide_calibrated(rows, target=0.5)[0])
    return st.select("total", "reroute_count", C.rate_in_range(F.col("reroute_rate")).alias("in_range"))
