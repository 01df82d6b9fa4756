"""Survey-shaped view of the driver tables (role map: persona = customer).

Each customer becomes one questionnaire row whose answers are derived from
its orders and order lines; the eight preference factors are standardised
per-customer behaviour metrics.  Work grows with ``lineitem``/``orders``:

    lineitem --(partial agg by order)--> order stats
    orders ⋈ order stats --(agg by customer)--> customer stats
    customer ⋈ nation (25 rows, broadcast) ⋈ customer stats --> survey rows

Lines are aggregated per order *before* the join so the big side shuffles
one small row per order, not every line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.functions.nulls import zfill
from choicespark.operators.features import standardize
from choicespark.plans.registry import table

# factor name → per-customer metric it is standardised from (binding choice)
FACTOR_METRICS = {
    "rerouting_proactiveness": "urgent_share",
    "information_dependency": "n_orders",
    "time_reliability_preference": "avg_price",
    "risk_aversion": "return_share",
    "familiar_route_preference": "acctbal",
    "time_sensitivity": "avg_qty",
    "external_info_sensitivity": "avg_disc_pct",
    "route_flexibility": "avg_tax_pct",
}


def order_line_stats(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.count(F.lit(1)).alias("n_lines"),
        F.sum(F.round(F.col("l_discount") * 100).cast("int")).alias("disc_pct"),
        F.sum(F.round(F.col("l_tax") * 100).cast("int")).alias("tax_pct"),
        F.count_if(F.col("l_returnflag") == "R").alias("n_ret"),
        F.max("l_quantity").alias("max_qty"),
    )


def customer_stats(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    ls = order_line_stats(lineitem.select("l_orderkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"))
    o = orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    j = o.join(ls, o.o_orderkey == ls.l_orderkey, "left")
    return j.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.avg("o_totalprice").alias("avg_price"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"),
        F.sum("sum_qty").alias("sum_qty"),
        F.sum("n_lines").alias("n_lines"),
        F.sum("disc_pct").alias("disc_pct"),
        F.sum("tax_pct").alias("tax_pct"),
        F.sum("n_ret").alias("n_ret"),
        F.max("max_qty").alias("max_qty"),
    )


def customer_survey(spark: SparkSession, sf_dir: str, with_factors: bool = True) -> DataFrame:
    cust = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    stats = customer_stats(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    j = (cust.join(F.broadcast(nation), cust.c_nationkey == nation.n_nationkey, "left")
         .join(stats, cust.c_custkey == stats.o_custkey, "left"))
    lines = F.col("n_lines")
    out = j.select(
        F.concat(F.lit("C_"), zfill(F.col("c_custkey"), 4)).alias("persona_id"),
        F.col("n_name").alias("country"),
        F.try_divide(F.col("sum_qty"), lines).cast("int").alias("Q1"),
        F.col("max_qty").cast("int").alias("Q2"),
        F.expr("(2 * disc_pct) div n_lines").cast("int").alias("Q21"),
        (F.lit(5) + F.expr("(2 * tax_pct) div n_lines")).cast("int").alias("Q42"),
        F.least(F.lit(5), F.lit(1) + F.expr("n_orders div 4")).cast("int").alias("Q22"),
        F.least(F.lit(5), F.lit(1) + F.col("n_urgent")).cast("int").alias("Q29"),
        F.least(F.lit(5), F.lit(1) + F.expr("n_ret div 5")).cast("int").alias("Q30"),
        (F.lit(1) + F.col("c_nationkey") % 2).alias("Q49"),
        (F.lit(18) + F.floor(F.abs(F.col("c_acctbal"))) % 60).cast("int").alias("Q50"),
        (F.lit(1) + F.floor((F.col("c_acctbal") + 1000) / 1600)).cast("int").alias("Q52"),
        (F.lit(1) + F.col("c_nationkey") % 7).alias("Q53"),
        (F.lit(1) + F.col("c_nationkey") % 5).alias("Q54"),
        F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY").alias("use_nav_app"),
        # behaviour metrics behind the factors
        F.try_divide(F.col("n_urgent").cast("double"), F.col("n_orders").cast("double")).alias("urgent_share"),
        F.col("n_orders").cast("double").alias("n_orders"),
        F.col("avg_price"),
        F.try_divide(F.col("n_ret").cast("double"), lines.cast("double")).alias("return_share"),
        F.col("c_acctbal").alias("acctbal"),
        F.try_divide(F.col("sum_qty"), lines.cast("double")).alias("avg_qty"),
        F.try_divide(F.col("disc_pct").cast("double"), lines.cast("double")).alias("avg_disc_pct"),
        F.try_divide(F.col("tax_pct").cast("double"), lines.cast("double")).alias("avg_tax_pct"),
    )
    if not with_factors:
        return out
    # The survey rows feed both the factor statistics and the rows themselves.  One grouping by
    # customer holds every column in a struct, so both branches read the very same exchange
    # (column pruning would otherwise make two different ones) and it is computed once.
    rest = [c for c in out.columns if c != "persona_id"]
    out = out.groupBy("persona_id").agg(F.any_value(F.struct(*rest)).alias("r")).select("persona_id", "r.*")
    metrics = list(FACTOR_METRICS.values())
    z = standardize(out, metrics, suffix="_z")
    return z.select(*[c for c in out.columns if c not in metrics],
                    *[F.col(f"{m}_z").alias(f) for f, m in FACTOR_METRICS.items()])


# ------------------------------------------------------------------ SQL twin

SURVEY_SQL = f"""
ls AS (
  SELECT l_orderkey, sum(l_quantity) AS sum_qty, count(*) AS n_lines,
         sum(CAST(round(l_discount * 100) AS INTEGER)) AS disc_pct,
         sum(CAST(round(l_tax * 100) AS INTEGER)) AS tax_pct,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_ret, max(l_quantity) AS max_qty
  FROM lineitem GROUP BY l_orderkey),
cs AS (
  SELECT o_custkey, count(*) AS n_orders, avg(o_totalprice) AS avg_price,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
         sum(sum_qty) AS sum_qty, sum(n_lines) AS n_lines, sum(disc_pct) AS disc_pct, sum(tax_pct) AS tax_pct,
         sum(n_ret) AS n_ret, max(max_qty) AS max_qty
  FROM orders LEFT JOIN ls ON o_orderkey = l_orderkey GROUP BY o_custkey),
sv0 AS (
  SELECT 'C_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0') AS persona_id,
         n_name AS country,
         CAST(trunc(sum_qty / n_lines) AS INTEGER) AS Q1,
         CAST(trunc(max_qty) AS INTEGER) AS Q2,
         CAST((2 * disc_pct) // n_lines AS INTEGER) AS Q21,
         CAST(5 + (2 * tax_pct) // n_lines AS INTEGER) AS Q42,
         CAST(least(5, 1 + n_orders // 4) AS INTEGER) AS Q22,
         CAST(least(5, 1 + n_urgent) AS INTEGER) AS Q29,
         CAST(least(5, 1 + n_ret // 5) AS INTEGER) AS Q30,
         1 + c_nationkey % 2 AS Q49,
         CAST(18 + CAST(floor(abs(c_acctbal)) AS BIGINT) % 60 AS INTEGER) AS Q50,
         CAST(1 + floor((c_acctbal + 1000) / 1600) AS INTEGER) AS Q52,
         1 + c_nationkey % 7 AS Q53,
         1 + c_nationkey % 5 AS Q54,
         c_mktsegment IN ('AUTOMOBILE', 'MACHINERY') AS use_nav_app,
         CAST(n_urgent AS DOUBLE) / n_orders AS urgent_share,
         CAST(n_orders AS DOUBLE) AS n_orders,
         avg_price,
         CAST(n_ret AS DOUBLE) / n_lines AS return_share,
         c_acctbal AS acctbal,
         sum_qty / n_lines AS avg_qty,
         CAST(disc_pct AS DOUBLE) / n_lines AS avg_disc_pct,
         CAST(tax_pct AS DOUBLE) / n_lines AS avg_tax_pct
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN cs ON c_custkey = o_custkey),
zs AS (
  SELECT {", ".join(f"avg({m}) AS m_{m}, stddev_pop({m}) AS s_{m}" for m in FACTOR_METRICS.values())} FROM sv0),
survey AS (
  SELECT sv0.persona_id, country, Q1, Q2, Q21, Q42, Q22, Q29, Q30, Q49, Q50, Q52, Q53, Q54, use_nav_app,
         {", ".join(f"({m} - m_{m}) / (CASE WHEN s_{m} = 0 THEN 1 ELSE s_{m} END) AS {f}" for f, m in FACTOR_METRICS.items())}
  FROM sv0, zs)"""


def _sql_decode(expr: str, mapping: dict, default) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        return f"'{v}'" if isinstance(v, str) else str(v)
    whens = " ".join(f"WHEN {expr} = {k} THEN {lit(v)}" for k, v in mapping.items())
    return f"CASE {whens} ELSE {lit(default)} END"


def _sql_income(expr: str) -> str:
    whens = " ".join(f"WHEN {expr} IN ({', '.join(map(str, v))}) THEN '{k}'" for k, v in cfg.INCOME_LEVEL.items())
    return f"CASE {whens} ELSE 'unknown' END"


PREFERENCE_SQL = """coalesce(nullif(concat_ws('; ',
    CASE WHEN Q22 >= 4 THEN 'prefer familiar routes' END,
    CASE WHEN risk_aversion > 0.5 THEN 'high risk aversion' WHEN risk_aversion < -0.5 THEN 'risk-tolerant' END,
    CASE WHEN information_dependency > 0.5 THEN 'rely heavily on navigation apps'
         WHEN information_dependency < -0.5 THEN 'prefer self-judgment over navigation' END,
    CASE WHEN Q29 >= 4 THEN 'prefer smooth routes over fast but uncertain ones' END,
    CASE WHEN Q21 <= 10 THEN 'willing to reroute if delay >' || CAST(Q21 AS VARCHAR) || 'min'
         ELSE 'patient with delays up to ' || CAST(Q21 AS VARCHAR) || 'min' END,
    CASE WHEN Q30 >= 4 THEN 'immediately reroute to save time' END,
    CASE WHEN coalesce(use_nav_app, FALSE) THEN 'use navigation apps regularly' END), ''), 'balanced decision-maker')"""

PERSONALITY_SQL = """coalesce(nullif(concat_ws(', ',
    CASE WHEN risk_aversion > 0.5 THEN 'cautious' WHEN risk_aversion < -0.5 THEN 'bold' END,
    CASE WHEN time_sensitivity > 0.5 THEN 'time-sensitive' END,
    CASE WHEN information_dependency > 0.5 THEN 'information-dependent' END,
    CASE WHEN route_flexibility > 0.5 THEN 'flexible' END,
    CASE WHEN rerouting_proactiveness > 0.5 THEN 'proactive' END), ''), 'rational, balanced')"""

PERSONAS_SQL = SURVEY_SQL + f""",
valid_survey AS (SELECT * FROM survey WHERE Q21 IS NOT NULL AND Q49 IS NOT NULL AND Q52 IS NOT NULL),
personas AS (
  SELECT persona_id,
         'User_' || split_part(persona_id, '_', 2) AS name,
         coalesce(Q50, 30) AS age,
         {_sql_decode('Q49', cfg.GENDER, 'male')} AS gender,
         country,
         {_sql_decode('Q54', cfg.EDUCATION, 'bachelor')} AS education,
         {_sql_decode('Q53', cfg.OCCUPATION, 'professional')} AS occupation,
         {PREFERENCE_SQL} AS preferences_in_transportation,
         {PERSONALITY_SQL} AS innate,
         coalesce(Q1, 30) AS commute_time_morning,
         coalesce(Q2, 30) AS commute_time_afternoon,
         {_sql_income('Q52')} AS household_income,
         coalesce(Q21, 10) AS delay_tolerance_planned,
         coalesce(Q42, 15) AS delay_tolerance_realtime,
         {", ".join(cfg.FACTOR_NAMES)}
  FROM valid_survey)"""
