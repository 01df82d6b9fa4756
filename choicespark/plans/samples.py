"""Training-sample plans: render, chat-format, statistics and exact splits.

The samples are rendered in the same narrow pass as the decisions (scenario
rows already carry persona and decision columns), so rendering adds no
shuffle; only the split's bucket counts aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.operators import render as R
from choicespark.operators import split as S
from choicespark.operators.personas import dominant_factor
from choicespark.plans.corpus import decided, personas
from choicespark.plans.corpus_sql import DECISIONS_SQL
from choicespark.functions.nulls import scaled
from choicespark.plans.registry import query, table

NL = "chr(10)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personas → scenarios (persona columns ride along) → decisions → rendered samples; one narrow pass."""
    return R.sample_rows(decided(spark, sf_dir))


def samples_from_tables(scen: DataFrame, persona_rows: DataFrame, decisions_df: DataFrame) -> DataFrame:
    """Samples when scenarios, personas and decisions are separate tables (J3): two key lookups,
    decisions de-duplicated first so a repeated scenario id cannot multiply rows (N8)."""
    from choicespark.operators.joins import dedupe_last

    d = dedupe_last(decisions_df, ["scenario_id"], ["chosen_route"], ["reroute"]).drop("n_copies")
    return R.sample_rows(scen.join(persona_rows, "persona_id", "inner").join(d, "scenario_id", "inner"))


# ------------------------------------------------------------------ SQL twin

def _fam(x: str) -> str:
    return f"CASE WHEN {x} > 0.8 THEN 'High - your usual route' WHEN {x} > 0.5 THEN 'Medium' ELSE 'Low - unfamiliar' END"


def _route_block(rid: str, name: str, desc: str, p: str) -> str:
    return (f"'Route {rid} ({name}):' || {NL} || '- Description: {desc}' || {NL}"
            f" || '- Normal travel time: ' || CAST({p}_normal AS VARCHAR) || ' minutes' || {NL}"
            f" || '- Current travel time: ' || CAST({p}_time AS VARCHAR) || ' minutes (delay: '"
            f" || CAST({p}_delay AS VARCHAR) || ' min)' || {NL}"
            f" || '- Familiarity: ' || {_fam(p + '_familiarity')} || {NL}"
            f" || '- Uncertainty: ' || {p}_uncertainty || {NL}")


PROMPT_SQL = f"""concat_ws({NL},
  'You play the role of the person:',
  'Name: ' || coalesce(CAST(name AS VARCHAR), 'None') || ' | Age: ' || coalesce(CAST(age AS VARCHAR), 'None')
    || ' | Gender: ' || coalesce(gender, 'None') || ' | Country: ' || coalesce(country, 'None'),
  'Occupation: ' || coalesce(occupation, 'None') || ' | Education: ' || coalesce(education, 'None'),
  '',
  'Transportation preferences: ' || coalesce(preferences_in_transportation, 'None'),
  'Personality traits: ' || coalesce(innate, 'None'),
  '',
  'Current situation:',
  'Time period: ' || time_period,
  'Location: ' || origin,
  'Destination: ' || destination,
  'Purpose: ' || replace(trip_purpose, '_', ' '),
  CASE WHEN coalesce(has_important_meeting, FALSE) THEN '⚠️ Important: You have an urgent meeting and cannot be late.' END,
  '',
  'Available routes:',
  {_route_block(*cfg.ROUTES[0], 'a')},
  {_route_block(*cfg.ROUTES[1], 'b')},
  CASE WHEN a_delay > 0 THEN 'Current traffic conditions:' || {NL} || '- ' || upper(left(event_type, 1))
       || lower(substr(event_type, 2)) || ' at ' || event_location || ': ' || event_severity
       || ' severity, expected ' || CAST(a_delay AS VARCHAR) || '-minute delay' || {NL} END,
  CASE WHEN weather <> 'clear' THEN 'Weather: ' || weather || {NL} END,
  'What route would you choose and why? Respond in JSON format:',
  '{{',
  '    "thinking": "your step-by-step analysis of the situation",',
  '    "reflection": "your final reasoning and decision-making process",',
  '    "plan": "your route choice (use ''none'' to keep Route A, or ''update path: <route_description>'' to switch)",',
  '    "concepts": []',
  '}}')"""

THINKING_SQL = f"""concat_ws({NL},
  'Let me analyze the current situation:',
  '- Route A (usual): ' || CAST(a_time AS VARCHAR) || 'min (delay: ' || CAST(a_delay AS VARCHAR) || 'min, uncertainty: '
    || a_uncertainty || ')',
  '- Route B (alternative): ' || CAST(b_time AS VARCHAR) || 'min (delay: ' || CAST(b_delay AS VARCHAR)
    || 'min, uncertainty: ' || b_uncertainty || ')',
  {NL} || 'Considering my preferences:',
  CASE WHEN coalesce(time_sensitivity, 0.0) > 0.3 THEN '- I prioritize time efficiency' END,
  CASE WHEN coalesce(risk_aversion, 0.0) > 0.3 THEN '- I prefer predictable routes over uncertain ones' END,
  CASE WHEN coalesce(familiar_route_preference, 0.0) > 0.3 THEN '- I prefer sticking with familiar routes' END,
  CASE WHEN coalesce(rerouting_proactiveness, 0.0) > 0.3 THEN '- I tend to actively seek alternative routes' END,
  CASE WHEN coalesce(has_important_meeting, FALSE) THEN '- I have an urgent meeting, cannot afford to be late' END,
  {NL} || 'The delay (' || CAST(a_delay AS VARCHAR) || 'min) '
    || CASE WHEN a_delay > tol THEN 'exceeds' ELSE 'is within' END
    || ' my tolerance threshold (' || CAST(tol AS VARCHAR) || 'min).')"""

_ABS = ", ".join(f"abs({f})" for f in cfg.FACTOR_NAMES)
DOMINANT_SQL = ("CASE " + " ".join(f"WHEN abs({f}) = greatest({_ABS}) THEN '{f}'" for f in cfg.FACTOR_NAMES)
                + " ELSE 'time_sensitivity' END")

REFLECTION_SQL = f"""concat_ws(' ',
  'I am currently at ' || origin || ', planning to travel to ' || destination || ' during ' || time_period || '.',
  CASE WHEN a_delay > 0 THEN 'My usual route (Route A) shows '
         || CASE WHEN a_delay > 15 THEN 'a significant' WHEN a_delay > 5 THEN 'a moderate' ELSE 'a minor' END
         || ' ' || CAST(a_delay AS VARCHAR) || '-minute delay'
         || CASE WHEN event_type IS NOT NULL THEN ' due to ' || event_type || ' at ' || event_location ELSE '' END || '.'
       ELSE 'My usual route (Route A) is currently clear with normal travel time of ' || CAST(a_normal AS VARCHAR)
         || ' minutes.' END,
  CASE {" ".join(f"WHEN dominant = '{k}' AND {k} > 0.3 THEN '{v.replace(chr(39), chr(39) * 2)}'"
                 for k, v in R.PREFERENCE_SENTENCES.items())} END,
  CASE WHEN coalesce(has_important_meeting, FALSE) THEN 'Given that I have an important meeting and cannot afford to be late, time reliability is especially critical.' END,
  CASE WHEN reroute THEN
         CASE WHEN a_time - b_time > 0 THEN 'Therefore, I will switch to Route ' || chosen_route || ', which saves '
                || CAST(a_time - b_time AS VARCHAR) || ' minutes and avoids the congested area.'
              ELSE 'Therefore, I will switch to Route ' || chosen_route
                || ' for better reliability, even though it may take slightly longer.' END
       WHEN a_delay > 0 THEN 'However, the delay is still within my tolerance (threshold: ' || CAST(tol AS VARCHAR)
         || ' minutes), so I will stick with my usual route.'
       ELSE 'Therefore, I will continue with my usual Route A.' END)"""

PLAN_SQL = (f"CASE WHEN NOT reroute THEN 'none' ELSE 'update path: ' || replace(replace("
            f"CASE chosen_route WHEN 'A' THEN '{cfg.ROUTES[0][2]}' ELSE '{cfg.ROUTES[1][2]}' END, 'via ', ''), ' and ', ', ') END")

SAMPLES_SQL = DECISIONS_SQL + f""",
dom AS (SELECT *, {DOMINANT_SQL} AS dominant FROM decisions),
samples AS (
  SELECT scenario_id AS id, persona_id, scenario_id, dominant,
         {PROMPT_SQL} AS prompt, {THINKING_SQL} AS thinking, {REFLECTION_SQL} AS reflection, {PLAN_SQL} AS plan
  FROM dom)"""


# ------------------------------------------------------------------ queries

@query("render_prompt", "WITH " + SAMPLES_SQL + "\nSELECT id, prompt FROM samples")
def q_render_prompt(spark, sf_dir):
    return samples(spark, sf_dir).select("id", "prompt")


@query("render_thinking", "WITH " + SAMPLES_SQL + "\nSELECT id, thinking FROM samples")
def q_render_thinking(spark, sf_dir):
    return samples(spark, sf_dir).select("id", "thinking")


@query("render_reflection", "WITH " + SAMPLES_SQL + "\nSELECT id, reflection FROM samples")
def q_render_reflection(spark, sf_dir):
    return samples(spark, sf_dir).select("id", "reflection")


@query("plan_text", "WITH " + SAMPLES_SQL + "\nSELECT id, plan FROM samples")
def q_plan_text(spark, sf_dir):
    return samples(spark, sf_dir).select("id", "plan")


@query("dominant_factor", "WITH " + SAMPLES_SQL.split(",\nsamples AS")[0] + """
SELECT DISTINCT persona_id, dominant FROM dom""")
def q_dominant_factor(spark, sf_dir):
    return personas(spark, sf_dir).select("persona_id", dominant_factor(F.col("preference_factors")).alias("dominant"))


@query("chat_format", "WITH " + SAMPLES_SQL + f"""
SELECT id, scenario_id,
       '<|im_start|>user' || {NL} || prompt || '<|im_end|>' || {NL} || '<|im_start|>assistant' || {NL}
       || '{{' || {NL} || '  "thinking": ' || CAST(to_json(thinking) AS VARCHAR) || ',' || {NL}
       || '  "reflection": ' || CAST(to_json(reflection) AS VARCHAR) || ',' || {NL}
       || '  "plan": ' || CAST(to_json(plan) AS VARCHAR) || ',' || {NL}
       || '  "concepts": []' || {NL} || '}}' || '<|im_end|>' || {NL} AS text
FROM samples""")
def q_chat_format(spark, sf_dir):
    s = samples(spark, sf_dir)
    return s.select("id", "scenario_id",
                    R.chat_text(F.col("prompt"), F.col("thinking"), F.col("reflection"), F.col("plan")).alias("text"))


@query("sample_stats", "WITH " + SAMPLES_SQL + r""",
per AS (
  SELECT len(list_filter(regexp_split_to_array(prompt, '\s+'), lambda w: w <> '')) AS pw,
         len(list_filter(regexp_split_to_array(reflection, '\s+'), lambda w: w <> '')) AS rw,
         CASE WHEN starts_with(plan, 'update path') THEN 'update_path' WHEN plan = 'none' THEN 'none'
              ELSE 'other' END AS plan_type
  FROM samples)
SELECT plan_type, count(*) AS n, CAST(sum(pw) AS BIGINT) AS prompt_words, CAST(sum(rw) AS BIGINT) AS reflection_words
FROM per GROUP BY plan_type""")
def q_sample_stats(spark, sf_dir):
    return R.sample_stats(samples(spark, sf_dir))


@query("sample_means", "WITH " + SAMPLES_SQL + r""",
per AS (
  SELECT len(list_filter(regexp_split_to_array(prompt, '\s+'), lambda w: w <> '')) AS pw,
         len(list_filter(regexp_split_to_array(reflection, '\s+'), lambda w: w <> '')) AS rw FROM samples)
SELECT count(*) AS n, CAST(round(avg(pw) * 1e6) AS BIGINT) AS prompt_ppm, CAST(round(avg(rw) * 1e6) AS BIGINT) AS reflection_ppm
FROM per""")
def q_sample_means(spark, sf_dir):
    return R.sample_means(samples(spark, sf_dir)).select(
        "n", scaled("mean_prompt_words").alias("prompt_ppm"), scaled("mean_reflection_words").alias("reflection_ppm"))


@query("train_val_split", "WITH " + SAMPLES_SQL + f""",
ordered AS (
  SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', '{cfg.SEED}', id)), id) AS pos, count(*) OVER () AS n
  FROM samples)
SELECT id, CASE WHEN pos <= CAST(floor(n * {cfg.TRAIN_RATIO}) AS BIGINT) THEN 'train' ELSE 'validation' END AS split
FROM ordered""")
def q_train_val_split(spark, sf_dir):
    return S.train_val_split(samples(spark, sf_dir).select("id")).select("id", "split")


_ORDER_SQL = f"row_number() OVER (ORDER BY md5(concat_ws('|', '{cfg.SEED}', CAST(o_orderkey AS VARCHAR))), o_orderkey)"


@query("three_way_split", f"""
WITH ordered AS (SELECT o_orderkey, {_ORDER_SQL} AS pos, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN pos <= CAST(floor(n * 0.8) AS BIGINT) THEN 'train'
                        WHEN pos <= CAST(floor(n * 0.9) AS BIGINT) THEN 'validation' ELSE 'test' END AS split
FROM ordered""")
def q_three_way_split(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return S.three_way_split(o, "o_orderkey").select("o_orderkey", "split")


@query("keyed_shuffle", f"SELECT o_orderkey, {_ORDER_SQL} AS shuffle_pos FROM orders")
def q_keyed_shuffle(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return S.keyed_shuffle(o, "o_orderkey").select("o_orderkey", "shuffle_pos")


@query("chat_segments", """
SELECT conv_id, turn, '<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS segment
FROM conversations""")
def q_chat_segments(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", R.chat_segment(F.col("role"), F.col("text")).alias("segment"))


@query("chat_lengths", """
SELECT conv_id, count(*) AS turns,
       CAST(sum(length('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10))) AS BIGINT) AS chars
FROM conversations GROUP BY conv_id""")
def q_chat_lengths(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    seg = R.chat_segment(F.col("role"), F.col("text"))
    return c.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum(F.length(seg)).alias("chars"))
