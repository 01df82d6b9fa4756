"""Long-table choice plans: orders are scenarios, order lines their alternatives.

Role map: persona = customer (via the survey view), scenario = ``orders``
row, alternative = ``lineitem`` row, with quantity as travel time, tax (in
percent) as delay, return flag as uncertainty, discount × 10 as familiarity
and an urgent order priority as the important meeting.

Plan shape (what ``explain`` shows at scale):

    orders ⋈ personas on custkey      (broadcast only when AQE measures the
                                        persona side small; else sort-merge)
    ⋈ lineitem on orderkey            (sort-merge; both sides hashed on orderkey)
    → groupBy(orderkey)               (reuses the join's partitioning: no exchange)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.functions import draws as D
from choicespark.functions.draws import dbl
from choicespark.functions.nulls import scaled, zfill
from choicespark.operators import choice as C
from choicespark.operators.joins import dedupe_last
from choicespark.plans.corpus import personas
from choicespark.plans.corpus_sql import utility_sql
from choicespark.plans.registry import query, table
from choicespark.plans.survey_view import PERSONAS_SQL

KEY = "o_orderkey"


def alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = personas(spark, sf_dir)
    pf = p.select(
        F.col("persona_id"),
        F.col("delay_tolerance_planned").alias("tolerance"),
        F.col("preference_factors.time_sensitivity").alias("time_sensitivity"),
        F.col("preference_factors.risk_aversion").alias("risk_aversion"),
        F.col("preference_factors.familiar_route_preference").alias("familiar_pref"),
    )
    orders = table(spark, sf_dir, "orders").select(
        KEY, F.concat(F.lit("C_"), zfill(F.col("o_custkey"), 4)).alias("persona_id"), "o_orderpriority")
    scen = orders.join(pf, "persona_id", "inner").select(
        KEY, "persona_id", (F.col("o_orderpriority") == "1-URGENT").alias("meeting"),
        "tolerance", "time_sensitivity", "risk_aversion", "familiar_pref")
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias(KEY), "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax",
        "l_discount", "l_returnflag")
    # Co-partition lines and scenarios on the order key: the join and the decision
    # aggregate (grouped on the same key) then share one exchange, and the
    # per-line utility work runs spread over all shuffle partitions instead of
    # inside the scan's tasks.  Orders are never broadcast: at scale the order
    # side grows with the data.  AQE splits skewed join partitions.
    alts = li.join(scen.hint("merge"), KEY, "inner")
    return alts.select(
        KEY, "persona_id",
        F.concat_ws("-", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"),
                    F.col("l_suppkey").cast("string")).alias("alt_id"),
        F.col("l_linenumber").alias("alt_pos"),
        F.col("l_quantity").cast("int").alias("time"),
        F.round(F.col("l_tax") * 100).cast("int").alias("delay"),
        F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "moderate")
        .otherwise("low").alias("uncertainty_level"),
        (F.col("l_discount") * 10).alias("familiarity"),
        "meeting", "tolerance", "time_sensitivity", "risk_aversion", "familiar_pref",
    )


ALTS_SQL = PERSONAS_SQL + f""",
scen_o AS (
  SELECT o_orderkey, p.persona_id, o_orderpriority = '1-URGENT' AS meeting, p.delay_tolerance_planned AS tolerance,
         p.time_sensitivity, p.risk_aversion, p.familiar_route_preference AS familiar_pref
  FROM orders JOIN personas p
    ON p.persona_id = 'C_' || lpad(CAST(o_custkey AS VARCHAR),
                                   CAST(greatest(4, length(CAST(o_custkey AS VARCHAR))) AS INTEGER), '0')),
alts AS (
  SELECT s.*, CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR)
           AS alt_id,
         l_linenumber AS alt_pos, CAST(trunc(l_quantity) AS INTEGER) AS time,
         CAST(round(l_tax * 100) AS INTEGER) AS delay,
         CASE WHEN l_returnflag = 'R' THEN 'high' WHEN l_returnflag = 'A' THEN 'moderate' ELSE 'low' END
           AS uncertainty_level,
         l_discount * 10 AS familiarity
  FROM lineitem JOIN scen_o s ON l_orderkey = s.o_orderkey),
scored AS (
  SELECT *, {utility_sql('time', 'delay', 'uncertainty_level', 'familiarity', 'meeting', 'time_sensitivity',
                         'risk_aversion', 'familiar_pref')} AS u_plain,
         {utility_sql('time', 'delay', 'uncertainty_level', 'familiarity', 'meeting', 'time_sensitivity',
                      'risk_aversion', 'familiar_pref')}
           + {D.sql_gumbel(cfg.SEED, 'gumbel', "(CAST(o_orderkey AS VARCHAR) || '|' || alt_id)", cfg.GUMBEL_SCALE)}
           AS utility
  FROM alts),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY utility DESC, alt_pos ASC, alt_id DESC) AS r_best,
            row_number() OVER (PARTITION BY o_orderkey ORDER BY delay ASC, alt_pos ASC, alt_id ASC) AS r_delay,
            row_number() OVER (PARTITION BY o_orderkey ORDER BY alt_pos ASC, alt_id ASC) AS r_usual,
            count(*) OVER (PARTITION BY o_orderkey) AS n_alternatives
  FROM scored),
per AS (
  SELECT o_orderkey, max(n_alternatives) AS n_alternatives,
         max(CASE WHEN r_best = 1 THEN alt_id END) AS best_id,
         max(CASE WHEN r_best = 1 THEN utility END) AS best_utility,
         max(CASE WHEN r_delay = 1 THEN alt_id END) AS least_id,
         max(CASE WHEN r_usual = 1 THEN alt_id END) AS usual_id,
         max(CASE WHEN r_usual = 1 THEN delay END) AS usual_delay,
         max(CASE WHEN r_usual = 1 THEN tolerance END) AS usual_tol
  FROM ranked GROUP BY o_orderkey),
dec_long AS (
  SELECT *, (usual_delay > usual_tol AND {D.sql_uniform(cfg.SEED, 'force_reroute', 'o_orderkey')} < {dbl(cfg.FORCE_REROUTE_PROB)}
             AND least_id <> usual_id) AS overridden
  FROM per),
dec_final AS (
  SELECT *, CASE WHEN overridden THEN least_id ELSE best_id END AS chosen_alt FROM dec_long)"""


def decisions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.decide_long(alternatives(spark, sf_dir), key=KEY)


@query("decide_alternatives", "WITH " + ALTS_SQL + """
SELECT o_orderkey, n_alternatives, chosen_alt, chosen_alt <> usual_id AS reroute, overridden,
       CAST(round(best_utility * 1e6) AS BIGINT) AS best_utility_ppm
FROM dec_final""")
def q_decide_alternatives(spark, sf_dir):
    d = decisions_long(spark, sf_dir)
    return d.select(KEY, "n_alternatives", "chosen_alt", "reroute", "overridden",
                    scaled("best_utility").alias("best_utility_ppm"))


@query("utility_score", "WITH " + ALTS_SQL + """
SELECT o_orderkey, alt_id, CAST(round(u_plain * 1e6) AS BIGINT) AS utility_ppm FROM scored""")
def q_utility_score(spark, sf_dir):
    a = alternatives(spark, sf_dir)
    return a.select(KEY, "alt_id", scaled(C.utility_of(KEY, noisy=False)).alias("utility_ppm"))


@query("utility_noisy", "WITH " + ALTS_SQL + """
SELECT o_orderkey, alt_id, CAST(round(utility * 1e6) AS BIGINT) AS utility_ppm FROM scored""")
def q_utility_noisy(spark, sf_dir):
    a = alternatives(spark, sf_dir)
    return a.select(KEY, "alt_id", scaled(C.utility_of(KEY, noisy=True)).alias("utility_ppm"))


@query("argmax_choice", "WITH " + ALTS_SQL + """
SELECT o_orderkey, best_id AS best_alt FROM per""")
def q_argmax_choice(spark, sf_dir):
    return C.argmax_choice(alternatives(spark, sf_dir).withColumn("utility", C.utility_of(KEY)), KEY)


@query("threshold_override", "WITH " + ALTS_SQL + """
SELECT o_orderkey, overridden, least_id AS least_delay_alt FROM dec_long""")
def q_threshold_override(spark, sf_dir):
    a = alternatives(spark, sf_dir)
    agg = a.groupBy(KEY).agg(F.min(F.struct("delay", "alt_pos", "alt_id")).alias("least"),
                             F.min(F.struct("alt_pos", "alt_id", "delay", "tolerance")).alias("usual"))
    ov = ((F.col("usual.delay") > F.col("usual.tolerance")) & C.force_draw(F.col(KEY))
          & (F.col("least.alt_id") != F.col("usual.alt_id")))
    return agg.select(KEY, ov.alias("overridden"), F.col("least.alt_id").alias("least_delay_alt"))


@query("preference_pairs", "WITH " + ALTS_SQL + """
SELECT a.o_orderkey, d.chosen_alt AS chosen, a.alt_id AS rejected
FROM alts a JOIN dec_final d ON a.o_orderkey = d.o_orderkey WHERE a.alt_id <> d.chosen_alt""")
def q_preference_pairs(spark, sf_dir):
    a = alternatives(spark, sf_dir)
    return C.preference_pairs(a, C.decide_long(a, key=KEY), key=KEY)


@query("decision_stats_long", "WITH " + ALTS_SQL + """
SELECT count(*) AS total, count(*) FILTER (WHERE chosen_alt <> usual_id) AS reroute_count,
       count(*) FILTER (WHERE chosen_alt = usual_id) AS keep_count,
       CAST(count(*) FILTER (WHERE chosen_alt <> usual_id) AS DOUBLE) / count(*) AS reroute_rate
FROM dec_final""")
def q_decision_stats_long(spark, sf_dir):
    return C.decision_stats(decisions_long(spark, sf_dir))


@query("dedupe_last", """
SELECT l_orderkey, l_linenumber, l_partkey AS kept_partkey, l_suppkey AS kept_suppkey, n_copies FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC) AS rn,
         count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n_copies
  FROM lineitem) WHERE rn = 1""")
def q_dedupe_last(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    d = dedupe_last(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"], ["l_partkey", "l_suppkey"])
    return d.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("kept_partkey"),
                    F.col("l_suppkey").alias("kept_suppkey"), "n_copies")


@query("rule_probability", "WITH " + ALTS_SQL + f"""
SELECT o_orderkey, CAST(round(p * 1e6) AS BIGINT) AS p_ppm,
       {D.sql_uniform(cfg.SEED, 'rule_reroute', 'o_orderkey')} < p AS reroute
FROM (SELECT o_orderkey,
             least(greatest(CASE WHEN usual_delay > 15 THEN 0.8 WHEN usual_delay > 5 THEN 0.4 ELSE 0.1 END
                            + CASE WHEN meeting THEN 0.2 ELSE 0.0 END
                            - CASE WHEN coalesce(time_sensitivity, 0.0) < -0.5 THEN 0.15 ELSE 0.0 END, 0.0), 1.0) AS p
      FROM (SELECT o_orderkey, delay AS usual_delay, meeting, time_sensitivity FROM ranked WHERE r_usual = 1))""")
def q_rule_probability(spark, sf_dir):
    a = alternatives(spark, sf_dir)
    usual = a.groupBy(KEY).agg(F.min(F.struct("alt_pos", "alt_id", "delay", "meeting", "time_sensitivity")).alias("u"))
    p = C.rule_probability(F.col("u.delay"), F.col("u.meeting"), F.col("u.time_sensitivity"))
    return usual.select(KEY, scaled(p).alias("p_ppm"),
                        (D.uniform(cfg.SEED, "rule_reroute", F.col(KEY)) < p).alias("reroute"))
