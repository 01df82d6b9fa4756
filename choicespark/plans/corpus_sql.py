"""DuckDB twins of the scenario and decision plans (oracle SQL text).

Built from the same parameters and the same keyed-draw arithmetic as the
Spark operators (:mod:`choicespark.functions.draws`).
"""

from __future__ import annotations

from choicespark import config as cfg
from choicespark.functions import draws as D
from choicespark.functions.draws import dbl
from choicespark.plans.survey_view import PERSONAS_SQL

SEED = cfg.SEED


def _u(stream: str, attempt: int) -> str:
    return D.sql_uniform(SEED, f"{stream}#{attempt}", "scenario_id")


def _arr(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def _idx(stream: str, attempt: int, weights) -> str:
    return "(" + D.sql_weighted_choice(_u(stream, attempt), [(i, w) for i, w in enumerate(weights)]) + " + 1)"


def _unc(d: str) -> str:
    return f"CASE WHEN {d} > 15 THEN 'high' WHEN {d} > 5 THEN 'moderate' ELSE 'low' END"


def attempt_sql(k: int) -> str:
    r0, r1 = cfg.TRAVEL_TIME_RATIO
    fu0, fu1 = cfg.FAMILIARITY_USUAL
    fa0, fa1 = cfg.FAMILIARITY_ALT
    t_idx = _idx("template", k, [t[4] for t in cfg.TEMPLATES])
    b_idx = _idx("delay_band", k, [b[3] for b in cfg.DELAY_BANDS])
    return f"""
att{k}_raw AS (
  SELECT scenario_id, persona_id, commute_time_morning AS c, {t_idx} AS t_idx, {b_idx} AS b_idx,
         {_u('delay', k)} AS u_delay,
         CAST(trunc(commute_time_morning * ({dbl(r0)} + {_u('a_ratio', k)} * {dbl(r1 - r0)})) AS INTEGER) AS a_normal,
         ({dbl(fu0)} + {_u('a_fam', k)} * {dbl(fu1 - fu0)}) AS a_fam,
         CAST(floor({_u('b_delay', k)} * {dbl(cfg.ALT_SMALL_DELAY[1] - cfg.ALT_SMALL_DELAY[0])}) AS INTEGER) AS b_small,
         CAST(trunc(commute_time_morning * ({dbl(r0)} + {_u('b_ratio', k)} * {dbl(r1 - r0)})) AS INTEGER)
           + CAST(floor({_u('b_diff', k)} * {dbl(cfg.ALT_TIME_DIFFERENCE[1] - cfg.ALT_TIME_DIFFERENCE[0])}) AS INTEGER) AS b_normal,
         ({dbl(fa0)} + {_u('b_fam', k)} * {dbl(fa1 - fa0)}) AS b_fam,
         {D.sql_pick(_u('event_location', k), cfg.EVENT_LOCATIONS)} AS ev_location,
         {D.sql_weighted_choice(_u('event_type', k), cfg.EVENT_TYPES)} AS ev_type,
         {D.sql_weighted_choice(_u('event_severity', k), cfg.EVENT_SEVERITY)} AS ev_severity,
         {D.sql_weighted_choice(_u('weather', k), cfg.WEATHER)} AS weather,
         ({_u('meeting', k)} < {dbl(cfg.IMPORTANT_MEETING_PROB)}) AS meeting,
         CAST(floor({_u('buffer', k)} * {dbl(cfg.TIME_BUFFER_RANGE[1] - cfg.TIME_BUFFER_RANGE[0])}) AS INTEGER) AS time_buffer
  FROM fan),
att{k}_d AS (
  SELECT *, CAST({_arr([b[1] for b in cfg.DELAY_BANDS])}[b_idx] + floor(u_delay * ({_arr([b[2] for b in cfg.DELAY_BANDS])}[b_idx]
                  - {_arr([b[1] for b in cfg.DELAY_BANDS])}[b_idx] + 1)) AS INTEGER) AS delay
  FROM att{k}_raw),
att{k} AS (
  SELECT scenario_id, persona_id,
         {_arr([t[0] for t in cfg.TEMPLATES])}[t_idx] AS template,
         {_arr([t[1] for t in cfg.TEMPLATES])}[t_idx] AS origin,
         {_arr([t[2] for t in cfg.TEMPLATES])}[t_idx] AS destination,
         {_arr([t[3] for t in cfg.TEMPLATES])}[t_idx] AS trip_purpose,
         delay AS a_delay, a_normal, a_normal + delay AS a_time, {_unc('delay')} AS a_uncertainty, a_fam AS a_familiarity,
         CASE WHEN delay > 5 THEN 0 ELSE b_small END AS b_delay, b_normal,
         b_normal + CASE WHEN delay > 5 THEN 0 ELSE b_small END AS b_time,
         {_unc('CASE WHEN delay > 5 THEN 0 ELSE b_small END')} AS b_uncertainty, b_fam AS b_familiarity,
         CASE WHEN delay > 0 THEN ev_type END AS event_type,
         CASE WHEN delay > 0 THEN ev_severity END AS event_severity,
         CASE WHEN delay > 0 THEN ev_location END AS event_location,
         weather, meeting AS has_important_meeting, time_buffer
  FROM att{k}_d),
att{k}_v AS (
  SELECT *, (a_time BETWEEN {cfg.MIN_TRAVEL_TIME} AND {cfg.MAX_TRAVEL_TIME}
             AND (a_normal <= 0 OR CAST(a_delay AS DOUBLE) / a_normal <= {dbl(cfg.MAX_DELAY_TO_NORMAL)})
             AND b_time BETWEEN {cfg.MIN_TRAVEL_TIME} AND {cfg.MAX_TRAVEL_TIME}
             AND (b_normal <= 0 OR CAST(b_delay AS DOUBLE) / b_normal <= {dbl(cfg.MAX_DELAY_TO_NORMAL)})) AS valid
  FROM att{k})"""


SCEN_COLS = ["template", "origin", "destination", "trip_purpose", "a_delay", "a_normal", "a_time", "a_uncertainty",
             "a_familiarity", "b_delay", "b_normal", "b_time", "b_uncertainty", "b_familiarity", "event_type",
             "event_severity", "event_location", "weather", "has_important_meeting", "time_buffer"]

SCENARIOS_SQL = PERSONAS_SQL + f""",
fan AS (
  SELECT persona_id, commute_time_morning,
         persona_id || '_S' || lpad(CAST(i AS VARCHAR), 2, '0') AS scenario_id
  FROM personas, range(1, {cfg.SCENARIOS_PER_PERSONA + 1}) t(i)),
{attempt_sql(0)},
{attempt_sql(1)},
scenarios AS (
  SELECT s0.scenario_id, s0.persona_id,
         {", ".join(f"CASE WHEN s0.valid THEN s0.{c} ELSE s1.{c} END AS {c}" for c in SCEN_COLS)},
         NOT s0.valid AS redrawn,
         (NOT s0.valid AND NOT s1.valid) AS still_invalid
  FROM att0_v s0 JOIN att1_v s1 USING (scenario_id)),
scen AS (
  SELECT *, CASE WHEN template = 'commute_morning' THEN 'morning rush hour'
                 WHEN template = 'commute_evening' THEN 'evening rush hour' ELSE 'off-peak hours' END AS time_period,
            template IN ('commute_morning', 'commute_evening') AS is_rush_hour
  FROM scenarios)"""


def _unc_cost(level: str) -> str:
    whens = " ".join(f"WHEN {level} = '{k}' THEN {dbl(float(v))}" for k, v in cfg.UNCERTAINTY_COST.items())
    return f"(CASE {whens} ELSE 0.0 END)"


def utility_sql(time: str, delay: str, level: str, fam: str, meeting: str, ts: str, ra: str, fp: str) -> str:
    boost = f"(CASE WHEN coalesce({meeting}, FALSE) THEN {dbl(cfg.MEETING_BOOST)} ELSE 1.0 END)"
    ts, ra, fp = (f"coalesce({x}, 0.0)" for x in (ts, ra, fp))
    return (f"(((({dbl(cfg.W_TIME)} * CAST({time} AS DOUBLE)) * {boost})"
            f" + ((({dbl(cfg.W_DELAY)} * {ts}) * CAST({delay} AS DOUBLE)) * {boost}))"
            f" + (({dbl(cfg.W_UNCERTAINTY)} * {ra}) * {_unc_cost(level)}))"
            f" + (({dbl(cfg.W_FAMILIARITY)} * {fp}) * {fam})")


def noise_sql(key: str, route: str) -> str:
    return D.sql_gumbel(SEED, "gumbel", f"({key} || '|' || {route})", cfg.GUMBEL_SCALE)


REASONING_SQL = """coalesce(nullif(concat_ws('; ',
    CASE WHEN a_delay > tol THEN 'delay exceeds tolerance threshold' WHEN a_delay > 5 THEN 'moderate delay on usual route' END,
    CASE WHEN time_sensitivity > 0.5 THEN 'time-sensitive' END,
    CASE WHEN risk_aversion > 0.5 THEN 'risk-averse (prefer predictability)' END,
    CASE WHEN familiar_route_preference > 0.5 THEN 'prefer familiar routes' END,
    CASE WHEN coalesce(has_important_meeting, FALSE) THEN 'urgent meeting' END,
    CASE WHEN chosen_route <> 'A' THEN
         CASE WHEN a_time - chosen_time > 0 THEN 'saves ' || CAST(a_time - chosen_time AS VARCHAR) || ' minutes'
              ELSE 'avoids uncertainty' END
         ELSE 'within tolerance' END), ''), 'balanced choice')"""

DECISIONS_SQL = SCENARIOS_SQL + f""",
sj AS (
  SELECT s.*, p.delay_tolerance_planned, coalesce(p.delay_tolerance_planned, 10) AS tol,
         p.time_sensitivity, p.risk_aversion, p.familiar_route_preference, p.commute_time_morning,
         p.preferences_in_transportation, p.innate, p.name, p.age, p.gender, p.country, p.occupation, p.education,
         p.rerouting_proactiveness, p.information_dependency, p.time_reliability_preference,
         p.external_info_sensitivity, p.route_flexibility,
         {utility_sql('a_time', 'a_delay', 'a_uncertainty', 'a_familiarity', 'has_important_meeting',
                      'p.time_sensitivity', 'p.risk_aversion', 'p.familiar_route_preference')}
           + {noise_sql('scenario_id', "'A'")} AS util_a,
         {utility_sql('b_time', 'b_delay', 'b_uncertainty', 'b_familiarity', 'has_important_meeting',
                      'p.time_sensitivity', 'p.risk_aversion', 'p.familiar_route_preference')}
           + {noise_sql('scenario_id', "'B'")} AS util_b,
         {D.sql_uniform(SEED, 'force_reroute', 'scenario_id')} < {dbl(cfg.FORCE_REROUTE_PROB)} AS force_u
  FROM scen s JOIN personas p USING (persona_id)),
sd AS (
  SELECT *, CASE WHEN b_delay < a_delay THEN 'B' ELSE 'A' END AS least_delay,
            CASE WHEN util_b > util_a THEN 'B' ELSE 'A' END AS best
  FROM sj),
so AS (
  SELECT *, (a_delay > tol AND force_u AND least_delay <> 'A') AS overridden FROM sd),
sc AS (
  SELECT *, CASE WHEN overridden THEN least_delay ELSE best END AS chosen_route FROM so),
decisions AS (
  SELECT *, chosen_route <> 'A' AS reroute,
         CASE WHEN chosen_route = 'A' THEN a_time ELSE b_time END AS chosen_time
  FROM sc),
decisions_r AS (
  SELECT *, {REASONING_SQL} AS reasoning FROM decisions)"""
