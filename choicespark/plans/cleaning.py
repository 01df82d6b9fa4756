"""Cleaning and feature plans on the driver tables (quality rules, nulls, features).

Role map: ``lineitem`` plays the survey (quantity as completion time and
minutes, line status as the attention check, discount / tax as the two
tolerance answers); driver tables have no nulls, so nulls are introduced
with ``nullif`` to exercise the missing-value rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark.functions.nulls import guarded_ratio, row_mean, scaled
from choicespark.operators import features as X
from choicespark.operators import quality as Q
from choicespark.operators.aggregates import describe, value_counts
from choicespark import config as cfg
from choicespark.plans.registry import query, table

LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def lineitem_rules():
    return [
        ("completion_time_too_short", F.col("l_quantity") >= 5),
        ("attention_check_failed", F.col("l_linestatus") == "O"),
        ("commute_time_abnormal", (F.col("l_extendedprice") <= 90000) & (F.col("l_quantity") <= 45)),
        ("delay_threshold_inconsistent", guarded_ratio(F.col("l_discount") * 100, F.col("l_tax") * 100) < 5),
    ]


_RULES_SQL = [
    ("completion_time_too_short", "l_quantity >= 5"),
    ("attention_check_failed", "l_linestatus = 'O'"),
    ("commute_time_abnormal", "l_extendedprice <= 90000 AND l_quantity <= 45"),
    ("delay_threshold_inconsistent",
     "CAST(l_discount * 100 AS DOUBLE) / (CASE WHEN l_tax * 100 = 0 THEN 1 ELSE l_tax * 100 END) < 5"),
]
_FIRST_FAIL_SQL = "CASE " + " ".join(f"WHEN NOT coalesce({p}, FALSE) THEN '{n}'" for n, p in _RULES_SQL) + " END"


@query("quality_filter", f"""
SELECT {", ".join(LI_KEY)} FROM lineitem WHERE {" AND ".join(f"coalesce({p}, FALSE)" for _, p in _RULES_SQL)}""")
def q_quality_filter(spark, sf_dir):
    return Q.quality_filter(lineitem(spark, sf_dir), lineitem_rules()).select(*LI_KEY)


_RATE = "CAST(final AS DOUBLE) / initial AS retention_rate"
_REPORT_ROWS = [(n, i + 1, f"r{i}") for i, (n, _) in enumerate(_RULES_SQL)] + [
    ("initial_count", 5, "initial"), ("final_count", 6, "final"), ("total_filtered", 7, "initial - final")]


@query("quality_report", f"""
WITH t AS (SELECT {_FIRST_FAIL_SQL} AS f FROM lineitem),
w AS (SELECT count(*) AS initial, count(*) FILTER (WHERE f IS NULL) AS final,
             {", ".join(f"count(*) FILTER (WHERE f = '{n}') AS r{i}" for i, (n, _) in enumerate(_RULES_SQL))} FROM t)
{" UNION ALL ".join(f"SELECT '{n}' AS step, {o} AS step_order, {e} AS n, {_RATE} FROM w" for n, o, e in _REPORT_ROWS)}""")
def q_quality_report(spark, sf_dir):
    return Q.quality_report(lineitem(spark, sf_dir), lineitem_rules())


def _flags():
    return [
        ("ratio_above_3", guarded_ratio(F.col("l_discount") * 100, F.col("l_tax") * 100) > 3),
        ("returned_but_open", (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O")),
        ("quantity_high", F.col("l_quantity") > 45),
        ("price_high", F.col("l_extendedprice") > 90000),
        ("no_discount", F.col("l_discount") == 0),
        ("no_tax", F.col("l_tax") == 0),
    ]


_FLAGS_SQL = [
    ("ratio_above_3", "CAST(l_discount * 100 AS DOUBLE) / (CASE WHEN l_tax * 100 = 0 THEN 1 ELSE l_tax * 100 END) > 3"),
    ("returned_but_open", "l_returnflag = 'R' AND l_linestatus = 'O'"),
    ("quantity_high", "l_quantity > 45"),
    ("price_high", "l_extendedprice > 90000"),
    ("no_discount", "l_discount = 0"),
    ("no_tax", "l_tax = 0"),
]


@query("quality_flags", " UNION ALL ".join(
    f"SELECT '{n}' AS flag, count(*) FILTER (WHERE {p}) AS flagged, "
    f"CAST(count(*) FILTER (WHERE {p}) AS DOUBLE) * 100.0 / CAST(count(*) AS DOUBLE) AS percentage FROM lineitem"
    for n, p in _FLAGS_SQL))
def q_quality_flags(spark, sf_dir):
    return Q.quality_flags(lineitem(spark, sf_dir), _flags())


@query("null_profile", """
SELECT * FROM (
  SELECT 'l_discount' AS "column", count(*) FILTER (WHERE l_discount = 0) AS null_count FROM lineitem
  UNION ALL SELECT 'l_tax', count(*) FILTER (WHERE l_tax = 0) FROM lineitem
  UNION ALL SELECT 'l_quantity', count(*) FILTER (WHERE l_quantity IS NULL) FROM lineitem) WHERE null_count > 0""")
def q_null_profile(spark, sf_dir):
    li = lineitem(spark, sf_dir).select(F.expr("nullif(l_discount, 0)").alias("l_discount"),
                                        F.expr("nullif(l_tax, 0)").alias("l_tax"), "l_quantity")
    return Q.null_profile(li)


@query("consistency_label", """
SELECT label, count(*) AS n FROM (
  SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'inconsistent'
              WHEN l_discount > l_tax THEN 'suspicious' ELSE 'ok' END AS label FROM lineitem) GROUP BY label""")
def q_consistency_label(spark, sf_dir):
    li = lineitem(spark, sf_dir)
    lab = Q.consistency_label((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"),
                              F.col("l_discount") > F.col("l_tax"))
    return li.groupBy(lab.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("cronbach_alpha", """
WITH t AS (SELECT l_quantity AS a, l_extendedprice / 1000 AS b, l_discount * 100 AS c, l_tax * 100 AS d FROM lineitem)
SELECT CAST(round((4.0 / 3.0) * (1 - (var_samp(a) + var_samp(b) + var_samp(c) + var_samp(d))
                                 / var_samp(a + b + c + d)) * 1e6) AS BIGINT) AS alpha_ppm, 4 AS n_items
FROM t""")
def q_cronbach_alpha(spark, sf_dir):
    li = lineitem(spark, sf_dir).select(F.col("l_quantity").alias("a"), (F.col("l_extendedprice") / 1000).alias("b"),
                                        (F.col("l_discount") * 100).alias("c"), (F.col("l_tax") * 100).alias("d"))
    r = Q.cronbach_alpha(li, ["a", "b", "c", "d"])
    return r.select(scaled("cronbach_alpha").alias("alpha_ppm"), "n_items")


# ------------------------------------------------------------------ features

@query("reverse_scale", f"SELECT {', '.join(LI_KEY)}, 8 - l_linenumber AS l_linenumber_reversed FROM lineitem")
def q_reverse_scale(spark, sf_dir):
    return X.reverse_scale(lineitem(spark, sf_dir), ["l_linenumber"], max_value=7).select(
        *LI_KEY, "l_linenumber_reversed")


@query("ratio_clip", f"""
SELECT {", ".join(LI_KEY)},
       CASE WHEN nullif(l_tax, 0) IS NOT NULL THEN
         CAST(round(least(greatest(l_discount / (CASE WHEN nullif(l_tax, 0) = 0 THEN 1 ELSE nullif(l_tax, 0) END), 0), 1)
                    * 1e6) AS BIGINT) END AS ratio_ppm,
       CAST(round(least(greatest(l_quantity / (CASE WHEN l_linenumber = 0 THEN 1 ELSE l_linenumber END), 0), 5)
                  * 1e6) AS BIGINT) AS tolerance_ppm
FROM lineitem""")
def q_ratio_clip(spark, sf_dir):
    li = lineitem(spark, sf_dir).withColumn("tax_n", F.expr("nullif(l_tax, 0)"))
    li = X.ratio_clip(li, "ratio", "l_discount", "tax_n", 0, 1)
    li = X.ratio_clip(li, "tolerance", "l_quantity", "l_linenumber", 0, 5)
    return li.select(*LI_KEY, scaled("ratio").alias("ratio_ppm"), scaled("tolerance").alias("tolerance_ppm"))


@query("abs_diff", f"SELECT {', '.join(LI_KEY)}, abs(l_quantity - l_linenumber * 5) AS asymmetry FROM lineitem")
def q_abs_diff(spark, sf_dir):
    li = lineitem(spark, sf_dir).withColumn("l5", F.col("l_linenumber") * 5)
    return X.abs_diff(li, "asymmetry", "l_quantity", "l5").select(*LI_KEY, "asymmetry")


@query("row_mean", f"""
SELECT {", ".join(LI_KEY)}, CAST(round(
  (coalesce(nullif(l_discount, 0), 0) + coalesce(nullif(l_tax, 0), 0) + coalesce(l_quantity / 100, 0))
  / NULLIF((CASE WHEN nullif(l_discount, 0) IS NULL THEN 0 ELSE 1 END) + (CASE WHEN nullif(l_tax, 0) IS NULL THEN 0 ELSE 1 END)
           + 1, 0) * 1e6) AS BIGINT) AS mean_ppm
FROM lineitem""")
def q_row_mean(spark, sf_dir):
    li = lineitem(spark, sf_dir).select(*LI_KEY, F.expr("nullif(l_discount, 0)").alias("d"),
                                        F.expr("nullif(l_tax, 0)").alias("t"), (F.col("l_quantity") / 100).alias("q"))
    return li.select(*LI_KEY, scaled(row_mean(["d", "t", "q"])).alias("mean_ppm"))


@query("impute_median", f"""
WITH m AS (SELECT median(nullif(l_discount, 0)) AS med FROM lineitem)
SELECT {", ".join(LI_KEY)}, CAST(round(coalesce(nullif(l_discount, 0), med) * 1e6) AS BIGINT) AS discount_ppm
FROM lineitem, m""")
def q_impute_median(spark, sf_dir):
    li = lineitem(spark, sf_dir).select(*LI_KEY, F.expr("nullif(l_discount, 0)").alias("discount"))
    return X.impute_median(li, ["discount"]).select(*LI_KEY, scaled("discount").alias("discount_ppm"))


@query("standardize", """
WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd FROM customer)
SELECT c_custkey, CAST(round((c_acctbal - m) / (CASE WHEN sd = 0 THEN 1 ELSE sd END) * 1e6) AS BIGINT) AS acctbal_z_ppm
FROM customer, s""")
def q_standardize(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return X.standardize(c, ["c_acctbal"]).select("c_custkey", scaled("c_acctbal_z").alias("acctbal_z_ppm"))


@query("describe_col", """
SELECT count(c_acctbal) AS count, CAST(round(avg(c_acctbal) * 1e6) AS BIGINT) AS mean_ppm,
       CAST(round(stddev_samp(c_acctbal) * 1e6) AS BIGINT) AS std_ppm,
       CAST(round(min(c_acctbal) * 1e6) AS BIGINT) AS min_ppm,
       CAST(round(quantile_cont(c_acctbal, 0.25) * 1e6) AS BIGINT) AS q25_ppm,
       CAST(round(quantile_cont(c_acctbal, 0.5) * 1e6) AS BIGINT) AS q50_ppm,
       CAST(round(quantile_cont(c_acctbal, 0.75) * 1e6) AS BIGINT) AS q75_ppm,
       CAST(round(max(c_acctbal) * 1e6) AS BIGINT) AS max_ppm
FROM customer""")
def q_describe_col(spark, sf_dir):
    d = describe(table(spark, sf_dir, "customer"), "c_acctbal")
    return d.select("count", *[scaled(c).alias(f"{c}_ppm") for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("value_counts", "SELECT o_orderstatus AS value, count(*) AS count FROM orders GROUP BY o_orderstatus")
def q_value_counts(spark, sf_dir):
    return value_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


PRIORITY_CODES = {1: "urgent", 2: "high", 3: "medium", 4: "not_specified"}


@query("decode_codes", """
SELECT o_orderkey, CASE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) WHEN 1 THEN 'urgent' WHEN 2 THEN 'high'
                        WHEN 3 THEN 'medium' WHEN 4 THEN 'not_specified' ELSE 'unknown' END AS priority
FROM orders""")
def q_decode_codes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    code = F.substring("o_orderpriority", 1, 1).try_cast("int")
    return o.select("o_orderkey", X.decode(code, PRIORITY_CODES, "unknown").alias("priority"))


SIZE_BUCKETS = {"small": list(range(1, 11)), "medium": list(range(11, 31)), "large": list(range(31, 46))}


@query("bucket_members", """
SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size BETWEEN 11 AND 30 THEN 'medium'
                       WHEN p_size BETWEEN 31 AND 45 THEN 'large' ELSE 'unknown' END AS size_bucket
FROM part""")
def q_bucket_members(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.bucket_members(F.col("p_size"), SIZE_BUCKETS).alias("size_bucket"))


@query("multi_choice", """
SELECT p_partkey, CAST(len(parts) AS INTEGER) AS n_choices, array_to_string(parts, '|') AS choices FROM (
  SELECT p_partkey, CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN []::VARCHAR[]
                         ELSE list_transform(string_split(trim(p_name), ' '), lambda x: trim(x)) END AS parts FROM part)""")
def q_multi_choice(spark, sf_dir):
    p = X.multi_choice(table(spark, sf_dir, "part"), "p_name", "choices", "n_choices", sep=" ")
    return p.select("p_partkey", "n_choices", F.array_join("choices", "|").alias("choices"))


@query("choice_flags", """
SELECT p_partkey, coalesce(contains(p_name, 'ring'), FALSE) AS has_ring, coalesce(contains(p_name, 'red'), FALSE) AS has_red
FROM part""")
def q_choice_flags(spark, sf_dir):
    p = X.choice_flags(table(spark, sf_dir, "part"), "p_name", {"has_ring": "ring", "has_red": "red"})
    return p.select("p_partkey", "has_ring", "has_red")


@query("channel_onehot", """
SELECT p_partkey, list_contains(parts, 'ring') AS is_ring, list_contains(parts, 'red') AS is_red FROM (
  SELECT p_partkey, CASE WHEN p_name IS NULL OR trim(p_name) = '' THEN []::VARCHAR[]
                         ELSE list_transform(string_split(trim(p_name), ' '), lambda x: trim(x)) END AS parts FROM part)""")
def q_channel_onehot(spark, sf_dir):
    p = X.channel_onehot(table(spark, sf_dir, "part"), "p_name", {"is_ring": "ring", "is_red": "red"}, sep=" ")
    return p.select("p_partkey", "is_ring", "is_red")


@query("band_uncertainty", """
SELECT CASE WHEN l_quantity > 15 THEN 'high' WHEN l_quantity > 5 THEN 'moderate' ELSE 'low' END AS uncertainty,
       count(*) AS n FROM lineitem GROUP BY 1""")
def q_band_uncertainty(spark, sf_dir):
    li = lineitem(spark, sf_dir)
    return li.groupBy(X.uncertainty_level(F.col("l_quantity")).alias("uncertainty")).agg(F.count(F.lit(1)).alias("n"))


@query("delay_level", """
SELECT CASE WHEN q = 0 THEN 'none' WHEN q < 8 THEN 'minor' WHEN q < 16 THEN 'moderate' ELSE 'severe' END AS level,
       count(*) AS n FROM (SELECT CAST(trunc(l_quantity) AS INTEGER) % 20 AS q FROM lineitem) GROUP BY 1""")
def q_delay_level(spark, sf_dir):
    li = lineitem(spark, sf_dir).select((F.col("l_quantity").cast("int") % 20).alias("q"))
    return li.groupBy(X.delay_level(F.col("q")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query("time_period", """
SELECT CASE WHEN hour(ts) BETWEEN 7 AND 9 THEN 'morning rush hour' WHEN hour(ts) BETWEEN 17 AND 19
            THEN 'evening rush hour' ELSE 'off-peak hours' END AS time_period, count(*) AS n
FROM events GROUP BY 1""")
def q_time_period(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(X.period_from_hour(F.hour("ts")).alias("time_period")).agg(F.count(F.lit(1)).alias("n"))


@query("purpose_weights", """
SELECT purpose, CAST(sum(CAST(round(raw / 5.0 * 1000) AS BIGINT)) AS BIGINT) AS weight_milli, count(*) AS n FROM (
  SELECT 'quantity' AS purpose, l_quantity / 10 AS raw FROM lineitem
  UNION ALL SELECT 'discount', l_discount * 50 FROM lineitem
  UNION ALL SELECT 'tax', l_tax * 50 FROM lineitem) GROUP BY purpose""")
def q_purpose_weights(spark, sf_dir):
    li = lineitem(spark, sf_dir).select(F.monotonically_increasing_id().alias("rid"),
                                        (F.col("l_quantity") / 10).alias("quantity"),
                                        (F.col("l_discount") * 50).alias("discount"), (F.col("l_tax") * 50).alias("tax"))
    w = X.purpose_weights(li, "rid", ["quantity", "discount", "tax"])
    return w.groupBy("purpose").agg(F.sum(scaled("weight", 1000)).alias("weight_milli"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ documented survey checks on derived answers

_ANSWERS = {"Q1": ("l_quantity", 140), "Q2": ("l_partkey", 150), "Q7": ("l_linenumber", 5), "Q21": ("l_suppkey", 9), "Q31": ("l_orderkey", 3),
            "Q40": ("l_partkey", 6), "Q41": ("l_suppkey", 6), "Q42": ("l_orderkey", 40), "Q43": ("l_quantity", 5), "Q44": ("l_partkey", 5),
            "Q45": ("l_suppkey", 5), "Q48": ("l_orderkey", 6), cfg.COMPLETION_TIME_COLUMN: ("l_partkey", 400)}
_ANSWERS_SQL = ("a AS (SELECT " + ", ".join(LI_KEY) + ", " + ", ".join(
    f'CAST({src} AS BIGINT) % {m} AS "{q}"' for q, (src, m) in _ANSWERS.items()) + " FROM lineitem)")


def _answers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(*LI_KEY, *[(F.col(src).cast("bigint") % m).alias(q) for q, (src, m) in _ANSWERS.items()])


@query("survey_flags", "WITH " + _ANSWERS_SQL + f"""
SELECT flag, count(*) FILTER (WHERE raised) AS raised, count(*) AS n FROM (
  SELECT unnest(['too_fast', 'attention_check_failed', 'tolerance_inconsistent', 'low_evacuation_willingness', 'odd_commute_time',
                 'bold_and_cautious']) AS flag,
         unnest(["{cfg.COMPLETION_TIME_COLUMN}" < 180, Q31 <> 2, coalesce(CAST(Q42 AS DOUBLE) / nullif(Q21, 0) > 3, FALSE), Q48 < 3,
                 Q1 > 120 OR Q2 > 120, Q40 >= 4 AND Q41 >= 4]) AS raised
  FROM a) GROUP BY flag""")
def q_survey_flags(spark, sf_dir):
    from choicespark.operators.quality import survey_flags

    flags = F.array(*[F.struct(F.lit(name).alias("flag"), F.coalesce(cond, F.lit(False)).alias("raised")) for name, cond in survey_flags()])
    long = _answers(spark, sf_dir).select(F.inline(flags))
    return long.groupBy("flag").agg(F.count_if("raised").alias("raised"), F.count(F.lit(1)).alias("n"))


@query("reroute_consistency", "WITH " + _ANSWERS_SQL + f"""
SELECT {", ".join(LI_KEY)}, CASE WHEN abs((Q43 + Q44) / 2 - Q7) > 3 THEN 'inconsistent' WHEN Q48 < greatest(Q43, Q44, Q45) THEN 'suspicious'
       ELSE 'ok' END AS label FROM a""")
def q_reroute_consistency(spark, sf_dir):
    from choicespark.operators.quality import reroute_consistency

    return _answers(spark, sf_dir).select(*LI_KEY, reroute_consistency().alias("label"))


@query("channel_names", """
SELECT event_id, array_to_string([CASE c WHEN 0 THEN 'unknown' WHEN 1 THEN 'radio' WHEN 2 THEN 'navigation_app' WHEN 3 THEN 'vms' WHEN 4 THEN 'web'
       WHEN 5 THEN 'social_media' WHEN 6 THEN 'friends' WHEN 7 THEN 'experience' WHEN 8 THEN 'other' ELSE 'unknown' END
       FOR c IN [event_id % 10, user_id % 9]], '|') AS names
FROM events""")
def q_channel_names(spark, sf_dir):
    """A two-code answer such as ``3, 8`` decoded into channel names."""
    ev = table(spark, sf_dir, "events")
    answer = F.concat((F.col("event_id") % 10).cast("string"), F.lit(", "), (F.col("user_id") % 9).cast("string"))
    return ev.select("event_id", F.array_join(X.channel_names(F.split(answer, ",")), "|").alias("names"))
