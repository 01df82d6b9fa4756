"""Join, keyed-draw and scenario-check plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.functions import draws as D
from choicespark.functions.draws import dbl
from choicespark.functions.nulls import scaled, zfill
from choicespark.operators import joins as J
from choicespark.operators.choice import preference_consistency
from choicespark.operators.scenarios import cover_scenarios, coverage_check, flatten_scenarios, scenario_valid
from choicespark.operators.skew import salted_join
from choicespark.plans.corpus import decided, personas, scenarios
from choicespark.plans.corpus_sql import DECISIONS_SQL, SCENARIOS_SQL
from choicespark.plans.registry import query, table
from choicespark.plans.survey_view import PERSONAS_SQL, SURVEY_SQL, customer_survey

_PID = "'C_' || lpad(CAST(o_custkey AS VARCHAR), CAST(greatest(4, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0')"


# ------------------------------------------------------------------ joins

@query("join_inner_2key", "WITH " + SURVEY_SQL + """
SELECT a.persona_id, a.country, a.Q21, CAST(round(b.risk_aversion * 1e6) AS BIGINT) AS risk_aversion_ppm
FROM sv0 a JOIN survey b ON a.persona_id = b.persona_id AND a.country = b.country""")
def q_join_inner_2key(spark, sf_dir):
    answers = customer_survey(spark, sf_dir, with_factors=False).select("persona_id", "country", "Q21")
    factors = customer_survey(spark, sf_dir).select("persona_id", "country", "risk_aversion")
    j = J.join_inner_2key(answers, factors)
    return j.select("persona_id", "country", "Q21", scaled("risk_aversion").alias("risk_aversion_ppm"))


@query("join_lookup", "WITH " + PERSONAS_SQL + f"""
SELECT o_orderkey, p.persona_id, p.delay_tolerance_planned FROM orders JOIN personas p ON p.persona_id = {_PID}""")
def q_join_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("C_"), zfill(F.col("o_custkey"), 4))
                                              .alias("persona_id"))
    hits, _ = J.lookup(o, personas(spark, sf_dir).select("persona_id", "delay_tolerance_planned"), "persona_id")
    return hits.select("o_orderkey", "persona_id", "delay_tolerance_planned")


@query("join_misses", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_join_misses(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    _, misses = J.lookup(o, li, "o_orderkey")
    return misses


@query("join_three_way", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, c_mktsegment
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def q_join_three_way(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return J.three_way(li, o, "l_orderkey", c, "o_custkey")


# ------------------------------------------------------------------ keyed draws on order keys

def _okey():
    return F.col("o_orderkey")


def _u(stream):
    return D.uniform(cfg.SEED, stream, _okey())


def _us(stream):
    return D.sql_uniform(cfg.SEED, stream, "o_orderkey")


_TEMPLATES = [(t[0], t[4]) for t in cfg.TEMPLATES]
_BANDS = [(b[0], b[3]) for b in cfg.DELAY_BANDS]


@query("weighted_draw", f"""
SELECT o_orderkey, {D.sql_weighted_choice(_us('template'), _TEMPLATES)} AS template,
       {D.sql_weighted_choice(_us('delay_band'), _BANDS)} AS delay_band FROM orders""")
def q_weighted_draw(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.weighted_choice(_u("template"), _TEMPLATES).alias("template"),
                    D.weighted_choice(_u("delay_band"), _BANDS).alias("delay_band"))


@query("weighted_draw_many", f"""
SELECT o_orderkey, {D.sql_weighted_choice(_us('event_type'), cfg.EVENT_TYPES)} AS event_type,
       {D.sql_weighted_choice(_us('event_severity'), cfg.EVENT_SEVERITY)} AS severity,
       {D.sql_weighted_choice(_us('weather'), cfg.WEATHER)} AS weather FROM orders""")
def q_weighted_draw_many(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.weighted_choice(_u("event_type"), cfg.EVENT_TYPES).alias("event_type"),
                    D.weighted_choice(_u("event_severity"), cfg.EVENT_SEVERITY).alias("severity"),
                    D.weighted_choice(_u("weather"), cfg.WEATHER).alias("weather"))


@query("int_draw", f"""
SELECT o_orderkey, {D.sql_int_draw(cfg.SEED, 'buffer', 'o_orderkey', 0, 30)} AS time_buffer,
       {D.sql_int_draw(cfg.SEED, 'delay', 'o_orderkey', 8, 16)} AS moderate_delay FROM orders""")
def q_int_draw(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.int_draw(cfg.SEED, "buffer", _okey(), 0, 30).alias("time_buffer"),
                    D.int_draw(cfg.SEED, "delay", _okey(), 8, 16).alias("moderate_delay"))


@query("real_draw", f"""
SELECT o_orderkey, CAST(round({D.sql_real_draw(cfg.SEED, 'ratio', 'o_orderkey', 0.8, 1.2)} * 1e6) AS BIGINT) AS ratio_ppm
FROM orders""")
def q_real_draw(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", scaled(D.real_draw(cfg.SEED, "ratio", _okey(), 0.8, 1.2)).alias("ratio_ppm"))


@query("bool_draw", f"""
SELECT o_orderkey, {D.sql_bool_draw(cfg.SEED, 'meeting', 'o_orderkey', cfg.IMPORTANT_MEETING_PROB)} AS meeting,
       {D.sql_bool_draw(cfg.SEED, 'force_reroute', 'o_orderkey', cfg.FORCE_REROUTE_PROB)} AS force FROM orders""")
def q_bool_draw(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.bool_draw(cfg.SEED, "meeting", _okey(), cfg.IMPORTANT_MEETING_PROB).alias("meeting"),
                    D.bool_draw(cfg.SEED, "force_reroute", _okey(), cfg.FORCE_REROUTE_PROB).alias("force"))


@query("pick_from_list", f"""
SELECT o_orderkey, {D.sql_pick(_us('event_location'), cfg.EVENT_LOCATIONS)} AS location FROM orders""")
def q_pick_from_list(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", D.pick(_u("event_location"), cfg.EVENT_LOCATIONS).alias("location"))


#: A third of all order lines belong to one order.
_HOT_LINES = "SELECT CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_orderkey END AS o_orderkey, l_orderkey, l_linenumber, l_partkey FROM lineitem"


@query("join_skewed", f"""
SELECT l_orderkey, l_linenumber, l_partkey, o_orderkey, o_custkey, o_totalprice FROM ({_HOT_LINES}) JOIN orders USING (o_orderkey)""")
def q_join_skewed(spark, sf_dir):
    """Lines with their orders, where one order holds a third of all lines."""
    li = table(spark, sf_dir, "lineitem").selectExpr("CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE l_orderkey END AS o_orderkey", "l_orderkey", "l_linenumber", "l_partkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return salted_join(li, o, ["o_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "o_orderkey", "o_custkey", "o_totalprice")


# ------------------------------------------------------------------ scenario checks

@query("route_columns", "WITH " + SCENARIOS_SQL + """
SELECT scenario_id, a_normal, a_delay, a_time, b_normal, b_delay, b_time FROM scen""")
def q_route_columns(spark, sf_dir):
    f = flatten_scenarios(scenarios(spark, sf_dir))
    return f.select("scenario_id", "a_normal", "a_delay", "a_time", "b_normal", "b_delay", "b_time")


@query("scenario_valid", "WITH " + SCENARIOS_SQL + f"""
SELECT scenario_id, (a_time BETWEEN {cfg.MIN_TRAVEL_TIME} AND {cfg.MAX_TRAVEL_TIME}
             AND (a_normal <= 0 OR CAST(a_delay AS DOUBLE) / a_normal <= {dbl(cfg.MAX_DELAY_TO_NORMAL)})
             AND b_time BETWEEN {cfg.MIN_TRAVEL_TIME} AND {cfg.MAX_TRAVEL_TIME}
             AND (b_normal <= 0 OR CAST(b_delay AS DOUBLE) / b_normal <= {dbl(cfg.MAX_DELAY_TO_NORMAL)})) AS valid
FROM scen""")
def q_scenario_valid(spark, sf_dir):
    sc = scenarios(spark, sf_dir)
    return sc.select("scenario_id", scenario_valid(F.col("routes")).alias("valid"))


@query("coverage_check", "WITH " + SCENARIOS_SQL + """
SELECT persona_id, n_delay_levels, n_event_types, n_periods,
       n_delay_levels >= 3 AND n_event_types >= 2 AND n_periods >= 2 AS covered
FROM (SELECT persona_id,
             count(DISTINCT CASE WHEN a_delay = 0 THEN 'none' WHEN a_delay < 8 THEN 'minor' WHEN a_delay < 16 THEN 'moderate'
                                 ELSE 'severe' END) AS n_delay_levels,
             count(DISTINCT coalesce(event_type, 'none')) AS n_event_types,
             count(DISTINCT CASE WHEN time_period LIKE '%morning%' THEN 'morning_rush'
                                 WHEN time_period LIKE '%evening%' THEN 'evening_rush' ELSE 'off_peak' END) AS n_periods
      FROM scen GROUP BY persona_id)""")
def q_coverage_check(spark, sf_dir):
    return coverage_check(scenarios(spark, sf_dir))


@query("coverage_enforced", "WITH " + SCENARIOS_SQL + f"""
SELECT persona_id, count(*) AS n_scenarios, true AS covered FROM scen GROUP BY persona_id""")
def q_coverage_enforced(spark, sf_dir):
    """Scenarios drawn again until every persona's cover the limits; as many scenarios as before."""
    sc, _ = cover_scenarios(personas(spark, sf_dir))
    n = sc.groupBy("persona_id").agg(F.count_distinct("scenario_id").alias("n_scenarios"))
    return coverage_check(sc).select("persona_id", "covered").join(n, "persona_id")


@query("preference_consistency", "WITH " + DECISIONS_SQL + """
SELECT band, count(*) AS n, count(*) FILTER (WHERE reroute) AS reroutes,
       CAST(round(CAST(count(*) FILTER (WHERE reroute) AS DOUBLE) / count(*) * 1e6) AS BIGINT) AS reroute_rate_ppm
FROM (SELECT reroute, CASE WHEN time_sensitivity > 0.5 THEN 'high' WHEN time_sensitivity < -0.5 THEN 'low'
                           ELSE 'mid' END AS band FROM decisions)
GROUP BY band""")
def q_preference_consistency(spark, sf_dir):
    d = decided(spark, sf_dir)
    g = preference_consistency(d, F.col("preference_factors.time_sensitivity"))
    return g.select("band", "n", "reroutes", scaled("reroute_rate").alias("reroute_rate_ppm"))
