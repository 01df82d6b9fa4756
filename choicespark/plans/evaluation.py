"""Evaluation plans: predictions and truths derived from ``events``; training
logs are ``events`` per user ordered by ``event_id`` (loss = ``value``).

Prediction text per event type (binding): purchase → a Side_St plan, click →
``none``, view → a Main_Ave plan, signup → ``Route B via Main_Ave`` (B wins),
error → text without a JSON object (unparseable).  Within these, the event id
modulo 20 gives a response in single quotes (2), a raw newline inside a string (3)
and trailing JSON (4), which are malformed; a plan in capitals (5), no plan (6),
the shortest path (7) and a departure time (8).  Truth plans come from
``value`` bands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark.functions.nulls import scaled
from choicespark.operators import evaluation as V
from choicespark.plans.registry import query, table

PRED_PLANS = {
    "purchase": "update path: Side_St, Local_Road_2",
    "click": "none",
    "view": "update path: Main_Ave",
    "signup": "update path: Route B via Main_Ave",
}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    k = F.col("event_id") % 20
    plan = (F.when(k == 5, "UPDATE PATH: Side_St").when(k == 7, "update path: shortest").when(k == 8, "update departure time: 07:30"))
    for name, v in PRED_PLANS.items():
        plan = plan.when(F.col("event_type") == name, v)
    thinking = F.when(F.col("value") < 10, F.lit("")).otherwise(F.concat(F.lit("meta "), F.col("props")))
    thinking = F.concat(F.replace(thinking, F.lit('"'), F.lit("'")), F.when(k == 3, "\n").otherwise(""))
    body = F.concat(F.lit('{"thinking": "'), thinking, F.lit('", "reflection": "r"'),
                    F.when(k == 6, "").otherwise(F.concat(F.lit(', "plan": "'), plan, F.lit('"'))), F.lit(', "concepts": []}'))
    body = F.when(k == 2, "{'plan': 'none'}").when(k == 4, F.concat(body, F.lit(' {"plan": "none"}'))).otherwise(body)
    raw = F.when(F.col("event_type") == "error", F.lit("assistant\nsorry } no json {")).otherwise(F.concat(
        F.lit("user prompt\nassistant\n"), body, F.lit(" trailing")))
    p = ev.select(F.col("event_id").alias("sample_id"), raw.alias("raw_text"), "value", "props", "event_type", "user_id")
    parsed = p.withColumn("response", V.parse_response(F.col("raw_text")))
    return parsed.select("sample_id", "raw_text", "response", F.col("response.plan").alias("pred_plan"),
                         F.col("response").isNotNull().alias("pred_ok"), "value", "props", "event_type", "user_id")


def truths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("event_id").alias("sample_id"), truth_plan_col().alias("truth_plan"))


def truth_plan_col():
    v = F.col("value")
    return (F.when(v > 100, "update path: Side_St, Local_Road_2").when(v > 50, "update path: x")
            .otherwise("none"))


PRED_SQL = f"""
pp AS (
  SELECT event_id AS sample_id, value, props, event_type, user_id, event_id % 20 AS k,
         CASE WHEN event_id % 20 = 5 THEN 'UPDATE PATH: Side_St' WHEN event_id % 20 = 7 THEN 'update path: shortest'
              WHEN event_id % 20 = 8 THEN 'update departure time: 07:30'
              {" ".join(f"WHEN event_type = '{k}' THEN '{v}'" for k, v in PRED_PLANS.items())} END AS plan0,
         replace(CASE WHEN value < 10 THEN '' ELSE 'meta ' || props END, '"', chr(39))
           || CASE WHEN event_id % 20 = 3 THEN chr(10) ELSE '' END AS thinking0
  FROM events),
pb AS (
  SELECT *, '{{"thinking": "' || thinking0 || '", "reflection": "r"'
            || CASE WHEN k = 6 THEN '' ELSE ', "plan": "' || plan0 || '"' END || ', "concepts": []}}' AS body FROM pp),
pr AS (
  SELECT *, CASE WHEN event_type = 'error' THEN 'assistant' || chr(10) || 'sorry }} no json {{'
                 ELSE 'user prompt' || chr(10) || 'assistant' || chr(10)
                      || CASE WHEN k = 2 THEN replace('{{~plan~: ~none~}}', '~', chr(39))
                              WHEN k = 4 THEN body || ' {{"plan": "none"}}' ELSE body END
                      || ' trailing' END AS raw_text
  FROM pb),
py AS (SELECT *, nullif(regexp_extract(raw_text, '(?s)\\{{.*\\}}', 0), '') AS js0 FROM pr),
px AS (SELECT *, CASE WHEN json_valid(js0) THEN js0 END AS js FROM py),
preds AS (
  SELECT sample_id, raw_text, value, props, event_type, user_id,
         coalesce(json_type(js) = 'OBJECT', FALSE) AS pred_ok,
         CASE WHEN json_type(js) = 'OBJECT' THEN json_extract_string(js, '$.plan') END AS pred_plan,
         CASE WHEN json_type(js) = 'OBJECT' THEN json_extract_string(js, '$.thinking') END AS pred_thinking
  FROM px),
truths AS (
  SELECT event_id AS sample_id, CASE WHEN value > 100 THEN 'update path: Side_St, Local_Road_2'
                                     WHEN value > 50 THEN 'update path: x' ELSE 'none' END AS truth_plan
  FROM events),
paired AS (SELECT t.sample_id, t.truth_plan, p.pred_plan, p.pred_ok, p.pred_thinking FROM truths t LEFT JOIN preds p USING (sample_id))"""


def _route_sql(p: str) -> str:
    low = f"lower(coalesce({p}, ''))"
    b = " OR ".join(f"contains({low}, '{m}')" for m in ("route b", "ave_2", "side_st"))
    a = " OR ".join(f"contains({low}, '{m}')" for m in ("route a", "ave_1", "main_ave"))
    return (f"CASE WHEN {p} = 'none' THEN 'A' WHEN contains({low}, 'update path') AND ({b}) THEN 'B' "
            f"WHEN contains({low}, 'update path') AND ({a}) THEN 'A' ELSE 'unknown' END")


METRICS_SQL = f"""
per AS (
  SELECT coalesce(pred_ok, FALSE) AS ok, {_route_sql('truth_plan')} AS gt, {_route_sql('pred_plan')} AS pr FROM paired),
agg AS (
  SELECT count(*) AS total_samples,
         count(*) FILTER (WHERE ok AND pr = gt AND pr <> 'unknown') AS correct_route,
         count(*) FILTER (WHERE ok AND gt <> 'A' AND pr <> 'A') AS reroute_tp,
         count(*) FILTER (WHERE ok AND pr <> 'A' AND gt = 'A') AS reroute_fp,
         count(*) FILTER (WHERE ok AND gt <> 'A' AND pr = 'A') AS reroute_fn
  FROM per),
m AS (
  SELECT *, CASE WHEN total_samples > 0 THEN CAST(correct_route AS DOUBLE) / total_samples ELSE 0.0 END AS acc,
         CASE WHEN reroute_tp + reroute_fp > 0 THEN CAST(reroute_tp AS DOUBLE) / (reroute_tp + reroute_fp) ELSE 0.0 END AS prec,
         CASE WHEN reroute_tp + reroute_fn > 0 THEN CAST(reroute_tp AS DOUBLE) / (reroute_tp + reroute_fn) ELSE 0.0 END AS rec
  FROM agg)"""


@query("extract_json", "WITH " + PRED_SQL + "\nSELECT sample_id, pred_ok AS parsed, pred_plan AS plan FROM preds")
def q_extract_json(spark, sf_dir):
    return predictions(spark, sf_dir).select("sample_id", F.col("pred_ok").alias("parsed"), F.col("pred_plan").alias("plan"))


@query("assistant_tail", "WITH " + PRED_SQL + """
SELECT sample_id, trim(string_split(raw_text, 'assistant')[-1]) AS tail FROM preds""")
def q_assistant_tail(spark, sf_dir):
    return predictions(spark, sf_dir).select("sample_id", V.assistant_tail(F.col("raw_text")).alias("tail"))


@query("route_from_plan", "WITH " + PRED_SQL + f"""
SELECT sample_id, {_route_sql('pred_plan')} AS pred_route, {_route_sql('truth_plan')} AS truth_route FROM paired""")
def q_route_from_plan(spark, sf_dir):
    j = V.pair(truths(spark, sf_dir), predictions(spark, sf_dir).select("sample_id", "pred_plan"), "sample_id")
    return j.select("sample_id", V.route_from_plan(F.col("pred_plan")).alias("pred_route"),
                    V.route_from_plan(F.col("truth_plan")).alias("truth_route"))


@query("join_pred_truth", "WITH " + PRED_SQL + "\nSELECT sample_id, truth_plan, pred_plan, pred_ok FROM paired")
def q_join_pred_truth(spark, sf_dir):
    j = V.pair(truths(spark, sf_dir), predictions(spark, sf_dir).select("sample_id", "pred_plan", "pred_ok"),
               "sample_id")
    return j.select("sample_id", "truth_plan", "pred_plan", "pred_ok")


@query("parse_plan", "WITH " + PRED_SQL + """,
b AS (SELECT sample_id, trim(coalesce(pred_plan, '')) AS p FROM preds),
c AS (SELECT sample_id, p, lower(p) AS low, trim(string_split(p, ':')[-1]) AS body FROM b),
d AS (SELECT *, CASE WHEN low = 'none' THEN 'keep' WHEN starts_with(low, 'update path: shortest') THEN 'shortest'
                     WHEN starts_with(low, 'update path:') THEN 'update_path'
                     WHEN starts_with(low, 'update departure time:') THEN 'update_departure_time' ELSE 'keep' END AS action
      FROM c)
SELECT sample_id, action,
       CASE WHEN action = 'update_path' THEN array_to_string(list_filter(list_transform(string_split(body, ','),
            lambda x: trim(x)), lambda x: x <> ''), '|') ELSE '' END AS roads,
       CASE WHEN action = 'update_departure_time' THEN body END AS departure_time
FROM d""")
def q_parse_plan(spark, sf_dir):
    s = V.parse_plan(F.col("pred_plan"))
    return predictions(spark, sf_dir).select("sample_id", s.getField("action").alias("action"),
                                            F.array_join(s.getField("roads"), "|").alias("roads"),
                                            s.getField("departure_time").alias("departure_time"))


def _metrics(spark, sf_dir):
    j = V.pair(truths(spark, sf_dir), predictions(spark, sf_dir).select("sample_id", "pred_plan", "pred_ok"),
               "sample_id")
    return V.decision_metrics(j)


@query("decision_metrics", "WITH " + PRED_SQL + "," + METRICS_SQL + """
SELECT CAST(round(acc * 1e6) AS BIGINT) AS accuracy_ppm, CAST(round(prec * 1e6) AS BIGINT) AS precision_ppm,
       CAST(round(rec * 1e6) AS BIGINT) AS recall_ppm,
       CAST(round(CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END * 1e6) AS BIGINT) AS f1_ppm,
       total_samples, correct_route, reroute_tp, reroute_fp, reroute_fn
FROM m""")
def q_decision_metrics(spark, sf_dir):
    m = _metrics(spark, sf_dir)
    return m.select(scaled("route_selection_accuracy").alias("accuracy_ppm"),
                    scaled("reroute_precision").alias("precision_ppm"), scaled("reroute_recall").alias("recall_ppm"),
                    scaled("reroute_f1").alias("f1_ppm"), "total_samples", "correct_route", "reroute_tp",
                    "reroute_fp", "reroute_fn")


@query("plan_distribution", "WITH " + PRED_SQL + """,
sides AS (
  SELECT 'prediction' AS side, contains(lower(coalesce(pred_plan, '')), 'update path') AS has_update FROM preds WHERE pred_ok
  UNION ALL SELECT 'truth', contains(lower(truth_plan), 'update path') FROM truths),
c AS (SELECT side, has_update, count(*) AS n FROM sides GROUP BY side, has_update)
SELECT side, has_update, n, CAST(round(CAST(n AS DOUBLE) * 100.0 / sum(n) OVER (PARTITION BY side) * 1e6) AS BIGINT) AS pct_ppm
FROM c""")
def q_plan_distribution(spark, sf_dir):
    p = predictions(spark, sf_dir).filter("pred_ok").select(F.lit("prediction").alias("side"), F.col("pred_plan").alias("plan"))
    t = truths(spark, sf_dir).select(F.lit("truth").alias("side"), F.col("truth_plan").alias("plan"))
    d = V.plan_distribution(p.unionByName(t), "side", "plan")
    return d.select("side", "has_update", "n", scaled(F.col("share") * 100).alias("pct_ppm"))


@query("field_coverage", "WITH " + PRED_SQL + """
SELECT count(*) FILTER (WHERE pred_ok AND coalesce(pred_thinking, '') <> '') AS with_thinking,
       count(*) FILTER (WHERE pred_ok) AS parsed FROM preds""")
def q_field_coverage(spark, sf_dir):
    c = V.field_coverage(predictions(spark, sf_dir), "pred_ok", F.col("response.thinking"))
    return c.select(F.col("with_field").alias("with_thinking"), "parsed")


@query("plan_match", "WITH " + PRED_SQL + """
SELECT CAST(round(avg(CASE WHEN coalesce(pred_plan = truth_plan, FALSE) THEN 1.0 ELSE 0.0 END) * 1e6) AS BIGINT)
       AS plan_match_ppm, count(*) AS n FROM paired""")
def q_plan_match(spark, sf_dir):
    j = V.pair(truths(spark, sf_dir), predictions(spark, sf_dir).select("sample_id", "pred_plan"), "sample_id")
    return V.plan_match(j).select(scaled("plan_match").alias("plan_match_ppm"), "n")


@query("perplexity", """
SELECT event_type, CAST(round(exp(sum(value / 100 * length(props)) / sum(length(props))) * 1e6) AS BIGINT)
       AS perplexity_ppm, CAST(sum(length(props)) AS BIGINT) AS tokens
FROM events GROUP BY event_type""")
def q_perplexity(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", (F.col("value") / 100).alias("loss"),
                                               F.length("props").cast("bigint").alias("n_tokens"))
    r = V.perplexity(ev, by=["event_type"])
    return r.select("event_type", scaled("perplexity").alias("perplexity_ppm"), "tokens")


TUNED_SQL = """
tuned AS (
  SELECT event_id AS sample_id, CASE WHEN value > 30 THEN 'update path: Side_St, Local_Road_2' ELSE 'none' END AS pred_plan,
         TRUE AS pred_ok FROM events)"""


@query("compare_runs", "WITH " + PRED_SQL + "," + METRICS_SQL + "," + TUNED_SQL + f""",
tper AS (SELECT {_route_sql('t.truth_plan')} AS gt, {_route_sql('u.pred_plan')} AS pr
         FROM truths t LEFT JOIN tuned u USING (sample_id)),
tagg AS (SELECT count(*) AS total, count(*) FILTER (WHERE pr = gt AND pr <> 'unknown') AS correct,
                count(*) FILTER (WHERE gt <> 'A' AND pr <> 'A') AS tp, count(*) FILTER (WHERE pr <> 'A' AND gt = 'A') AS fp,
                count(*) FILTER (WHERE gt <> 'A' AND pr = 'A') AS fn FROM tper),
tm AS (SELECT CAST(correct AS DOUBLE) / total AS acc,
              CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS prec,
              CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS rec FROM tagg),
ppl AS (SELECT exp(sum(value / 100 * length(props)) / sum(length(props))) AS b_ppl,
               exp(sum(value / 200 * length(props)) / sum(length(props))) AS t_ppl FROM events),
v AS (
  SELECT m.acc AS b_acc, CASE WHEN m.prec + m.rec > 0 THEN 2 * m.prec * m.rec / (m.prec + m.rec) ELSE 0.0 END AS b_f1,
         tm.acc AS t_acc, CASE WHEN tm.prec + tm.rec > 0 THEN 2 * tm.prec * tm.rec / (tm.prec + tm.rec) ELSE 0.0 END AS t_f1,
         b_ppl, t_ppl FROM m, tm, ppl)
SELECT 'route_selection_accuracy' AS metric, CAST(round((t_acc - b_acc) * 1e6) AS BIGINT) AS delta_ppm,
       t_acc > b_acc AS improved, t_acc >= 0.75 AS meets_target FROM v
UNION ALL SELECT 'reroute_f1', CAST(round((t_f1 - b_f1) * 1e6) AS BIGINT), t_f1 > b_f1, t_f1 >= 0.8 FROM v
UNION ALL SELECT 'perplexity', CAST(round((t_ppl - b_ppl) * 1e6) AS BIGINT), t_ppl < b_ppl, t_ppl < 10 FROM v""")
def q_compare_runs(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    t = truths(spark, sf_dir)
    base = V.decision_metrics(V.pair(t, predictions(spark, sf_dir).select("sample_id", "pred_plan", "pred_ok"),
                                     "sample_id"))
    tuned_pred = ev.select(F.col("event_id").alias("sample_id"),
                           F.when(F.col("value") > 30, "update path: Side_St, Local_Road_2").otherwise("none")
                           .alias("pred_plan"), F.lit(True).alias("pred_ok"))
    tuned = V.decision_metrics(V.pair(t, tuned_pred, "sample_id"))
    toks = ev.select((F.col("value") / 100).alias("l1"), (F.col("value") / 200).alias("l2"),
                     F.length("props").cast("bigint").alias("n_tokens"))
    bp = V.perplexity(toks.withColumnRenamed("l1", "loss"))
    tp = V.perplexity(toks.withColumnRenamed("l2", "loss"))
    b = base.withColumn("_k", F.lit(1)).join(bp.withColumn("_k", F.lit(1)), "_k").drop("_k")
    tt = tuned.withColumn("_k", F.lit(1)).join(tp.withColumn("_k", F.lit(1)), "_k").drop("_k")
    r = V.compare_runs(b, tt)
    return r.select("metric", scaled("delta").alias("delta_ppm"), "improved", "meets_target")


@query("eval_preview", """
SELECT doc_id, substr(text, 1, 300) || '...' AS text_preview FROM documents ORDER BY doc_id LIMIT 20""")
def q_eval_preview(spark, sf_dir):
    return V.preview(table(spark, sf_dir, "documents"), "doc_id", "text", 20, 300)


@query("filter_by_id", "SELECT event_id, user_id, event_type FROM events WHERE event_id = 42")
def q_filter_by_id(spark, sf_dir):
    return table(spark, sf_dir, "events").filter(F.col("event_id") == 42).select("event_id", "user_id", "event_type")


@query("head_n", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 3")
def q_head_n(spark, sf_dir):
    return V.head_n(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 3)


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of one run per user; ``signup`` events are evaluations, which have no training loss."""
    is_eval = F.col("event_type") == "signup"
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("step"), (F.col("event_id") / 1000).alias("epoch"),
        F.when(~is_eval, F.col("value")).alias("loss"), F.when(is_eval, F.col("value")).alias("eval_loss"))


_LOG_SQL = """
lg AS (SELECT user_id AS run_id, event_id AS step, value AS loss,
              row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
              count(*) OVER (PARTITION BY user_id) AS len FROM events WHERE event_type <> 'signup')"""


@query("loss_summary", "WITH " + _LOG_SQL + """,
tr AS (
  SELECT run_id, max(loss) FILTER (WHERE rn = 1) AS first_loss, max(loss) FILTER (WHERE rn = len) AS last_loss,
         min(loss) AS min_loss,
         CAST(round((max(loss) FILTER (WHERE rn = 1) - max(loss) FILTER (WHERE rn = len)) * 1e6) AS BIGINT) AS drop_ppm,
         CAST(round(avg(loss) FILTER (WHERE least(100, len // 10) = 0 OR rn > len - least(100, len // 10)) * 1e6) AS BIGINT)
           AS tail_mean_ppm,
         max(len) AS n_points
  FROM lg GROUP BY run_id),
ev AS (
  SELECT user_id AS run_id, max(event_id) AS last_step, max(event_id / 1000) AS epoch,
         count(value) FILTER (WHERE event_type = 'signup') AS n_evals, min(value) FILTER (WHERE event_type = 'signup') AS best_eval_loss,
         arg_max(value, event_id) FILTER (WHERE event_type = 'signup') AS latest_eval_loss
  FROM events GROUP BY user_id)
SELECT run_id, first_loss, last_loss, min_loss, drop_ppm, tail_mean_ppm, coalesce(n_points, 0) AS n_points, last_step, n_evals,
       best_eval_loss, latest_eval_loss, epoch
FROM ev LEFT JOIN tr USING (run_id)""")
def q_loss_summary(spark, sf_dir):
    s = V.loss_summary(train_log(spark, sf_dir), eval_loss="eval_loss", epoch="epoch")
    return s.select("run_id", "first_loss", "last_loss", "min_loss", scaled("drop").alias("drop_ppm"),
                    scaled("tail_mean").alias("tail_mean_ppm"), "n_points", "last_step", "n_evals", "best_eval_loss",
                    "latest_eval_loss", "epoch")


@query("moving_avg", "WITH " + _LOG_SQL + """,
lw AS (SELECT *, least(50, len // 10) AS w FROM lg)
SELECT a.run_id, a.step, CAST(round(avg(b.loss) * 1e6) AS BIGINT) AS moving_avg_ppm, CAST(a.w AS INTEGER) AS window
FROM lw a JOIN lw b ON a.run_id = b.run_id AND b.rn BETWEEN a.rn - a.w + 1 AND a.rn
WHERE a.len > 10 AND a.rn >= a.w
GROUP BY a.run_id, a.step, a.w""")
def q_moving_avg(spark, sf_dir):
    m = V.moving_average(train_log(spark, sf_dir))
    return m.select("run_id", "step", scaled("moving_avg").alias("moving_avg_ppm"), "window")
