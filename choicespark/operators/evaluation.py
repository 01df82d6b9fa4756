"""Evaluation: parse model output, map plans to routes, decision metrics, training logs.

Predictions are paired with truths by key (a left join from the truths, so
a missing or unparseable prediction stays in the denominator), never by
position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.session import cut_lineage

RESPONSE_SCHEMA = "struct<thinking:string,reflection:string,plan:string,concepts:array<string>>"


def extract_json_text(raw: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; null when there is none."""
    m = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.when(m != "", m)


def parse_response(raw: Column) -> Column:
    """Parsed response struct, or null when the JSON is absent or malformed.

    Strict JSON: single quotes and raw control characters inside strings are malformed
    (the parser's corrupt-record field says so).  Text after the object is caught by
    wrapping it in brackets, which must give an array of one element.
    """
    js = extract_json_text(raw)
    parsed = F.from_json(js, f"{RESPONSE_SCHEMA[:-1]},{_CORRUPT}:string>",
                         {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": _CORRUPT})
    whole = F.coalesce(F.json_array_length(F.concat(F.lit("["), js, F.lit("]"))), F.lit(0)) == 1
    # an object whose values have other types is JSON all the same: its keys can be listed
    valid = parsed.isNotNull() & whole & (parsed.getField(_CORRUPT).isNull() | _other_types(js))
    return F.when(valid, F.struct(*[parsed.getField(f).alias(f) for f in ("thinking", "reflection", "plan", "concepts")]))


_CORRUPT = "_corrupt"


def _other_types(js: Column) -> Column:
    """True for strict JSON objects that only miss the response's types."""
    any_map = F.from_json(js, f"struct<{_CORRUPT}:string>", {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": _CORRUPT})
    return any_map.isNotNull() & any_map.getField(_CORRUPT).isNull()


def assistant_tail(text: Column) -> Column:
    """Text after the last ``assistant`` marker, trimmed."""
    return F.trim(F.substring_index(text, "assistant", -1))


def route_from_plan(plan: Column) -> Column:
    """``none`` → A; ``update path`` + B/A markers → B or A (B tested first); else unknown."""
    low = F.lower(F.coalesce(plan, F.lit("")))
    is_b = low.contains("route b") | low.contains("ave_2") | low.contains("side_st")
    is_a = low.contains("route a") | low.contains("ave_1") | low.contains("main_ave")
    return (F.when(plan == "none", "A")
            .when(low.contains("update path") & is_b, "B")
            .when(low.contains("update path") & is_a, "A")
            .otherwise("unknown"))


def parse_plan(plan: Column) -> Column:
    """Plan text → action struct (D5): keep / update_path / update_departure_time / shortest; fallback keep."""
    p = F.trim(F.coalesce(plan, F.lit("")))
    low = F.lower(p)
    body = F.trim(F.substring_index(p, ":", -1))
    roads = F.filter(F.transform(F.split(body, ","), lambda x: F.trim(x)), lambda x: x != "")
    action = (F.when(low == "none", "keep")
              .when(low.startswith("update path: shortest"), "shortest")
              .when(low.startswith("update path:"), "update_path")
              .when(low.startswith("update departure time:"), "update_departure_time")
              .otherwise("keep"))
    return F.struct(
        action.alias("action"),
        F.when(action == "update_path", roads).otherwise(F.array().cast("array<string>")).alias("roads"),
        F.when(action == "update_departure_time", body).alias("departure_time"),
    )


def pair(truths: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Truth ⟕ prediction on the sample key."""
    return truths.join(predictions, key, "left")


def decision_metrics(paired: DataFrame, truth_plan: str = "truth_plan", pred_plan: str = "pred_plan",
                     pred_ok: str = "pred_ok") -> DataFrame:
    """Route accuracy and reroute precision / recall / F1 in one aggregate.

    Rows whose prediction did not parse are skipped but stay in ``total``;
    ``unknown`` counts as a reroute on both sides and is never a correct route.
    """
    gt = route_from_plan(F.col(truth_plan))
    pr = route_from_plan(F.col(pred_plan))
    ok = F.coalesce(F.col(pred_ok), F.lit(False))
    g_re, p_re = gt != "A", pr != "A"
    per = paired.select(
        ok.alias("ok"),
        (ok & (pr == gt) & (pr != "unknown")).alias("correct"),
        (ok & g_re & p_re).alias("tp"), (ok & p_re & ~g_re).alias("fp"), (ok & g_re & ~p_re).alias("fn"))
    agg = per.agg(F.count(F.lit(1)).alias("total_samples"), F.count_if("correct").alias("correct_route"),
                  F.count_if("tp").alias("reroute_tp"), F.count_if("fp").alias("reroute_fp"),
                  F.count_if("fn").alias("reroute_fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))

    prec = ratio(F.col("reroute_tp"), F.col("reroute_tp") + F.col("reroute_fp"))
    rec = ratio(F.col("reroute_tp"), F.col("reroute_tp") + F.col("reroute_fn"))
    return agg.select(
        ratio(F.col("correct_route"), F.col("total_samples")).alias("route_selection_accuracy"),
        prec.alias("reroute_precision"), rec.alias("reroute_recall"),
        F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0)).alias("reroute_f1"),
        "total_samples", "correct_route", "reroute_tp", "reroute_fp", "reroute_fn",
    )


def perplexity(df: DataFrame, loss: str = "loss", n_tokens: str = "n_tokens", by: list[str] | None = None) -> DataFrame:
    """Token-weighted perplexity ``exp(Σ loss·n / Σ n)`` (A10)."""
    g = df.groupBy(*(by or []))
    return g.agg(F.exp(F.try_divide(F.sum(F.col(loss) * F.col(n_tokens)), F.sum(n_tokens).cast("double")))
                 .alias("perplexity"), F.sum(n_tokens).alias("tokens"))


def compare_runs(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """Deltas between two one-row metric tables, better/worse flags and target flags."""
    metrics = ["route_selection_accuracy", "reroute_f1", "perplexity"]
    b = base.select(*[F.col(m).alias(f"b_{m}") for m in metrics])
    t = tuned.select(*[F.col(m).alias(f"t_{m}") for m in metrics])
    j = b.withColumn("_k", F.lit(1)).join(t.withColumn("_k", F.lit(1)), "_k").drop("_k")
    rows = []
    for m in metrics:
        delta = F.col(f"t_{m}") - F.col(f"b_{m}")
        better = (delta < 0) if m == "perplexity" else (delta > 0)
        target = {"route_selection_accuracy": F.col(f"t_{m}") >= cfg.TARGET_ACCURACY,
                  "reroute_f1": F.col(f"t_{m}") >= cfg.TARGET_F1,
                  "perplexity": F.col(f"t_{m}") < cfg.TARGET_PERPLEXITY}[m]
        rows.append(F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("baseline"), F.col(f"t_{m}").alias("tuned"),
                             delta.alias("delta"), better.alias("improved"), target.alias("meets_target")))
    return j.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def loss_summary(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "loss",
                 eval_loss: str | None = None, epoch: str | None = None, salt_buckets: int = 64) -> DataFrame:
    """Per-run loss summary (A14): first, last, min, drop, drop %, tail mean.

    Tail length n = min(100, len // 10); when n is 0 the tail is the whole run.
    First / last / min / length are aggregates combined map-side.  The tail
    needs the n ≤ 100 latest steps of each run; they are found without putting
    a run into one task: the top 100 per (run, salt) first (a hot run is split
    ``salt_buckets`` ways), then the top n among those ≤ 100 × salts candidates.

    ``last_step`` is the last step of the whole log, with or without a loss.  With
    ``eval_loss`` the evaluations are summarised too (``n_evals``, ``best_eval_loss``,
    ``latest_eval_loss``), and with ``epoch`` the last one reached.
    """
    rows = log.filter(F.col(loss).isNotNull()).select(run, step, loss)
    whole = [F.max(step).alias("last_step")]
    if eval_loss:
        whole += [F.count(eval_loss).alias("n_evals"), F.min(eval_loss).alias("best_eval_loss"),
                  F.max_by(F.col(eval_loss), F.when(F.col(eval_loss).isNotNull(), F.col(step))).alias("latest_eval_loss")]
    if epoch:
        whole.append(F.max(epoch).alias("epoch"))
    has = F.col(loss).isNotNull()
    at = F.when(has, F.col(step))  # positions of the losses: rows without one do not count
    base = log.groupBy(run).agg(
        F.min_by(loss, at).alias("first_loss"), F.max_by(loss, at).alias("last_loss"),
        F.min(loss).alias("min_loss"), F.count(loss).alias("n_points"), *whole,
        F.avg(loss).alias("_all_mean"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(step)), F.lit(salt_buckets)))
    w1 = Window.partitionBy(run, "_salt").orderBy(F.col(step).desc())
    cand = salted.withColumn("_r1", F.row_number().over(w1)).filter(F.col("_r1") <= 100)
    w2 = Window.partitionBy(run).orderBy(F.col(step).desc())
    ranked = cand.select(run, loss, F.row_number().over(w2).alias("_r2"))
    tail_n = F.least(F.lit(100), F.floor(F.col("n_points") / 10)).cast("int")
    tails = ranked.join(base.select(run, tail_n.alias("_n")), run).filter(F.col("_r2") <= F.col("_n")).groupBy(
        run).agg(F.avg(loss).alias("_tail_mean"))
    agg = base.join(tails, run, "left")
    drop = F.col("first_loss") - F.col("last_loss")
    return agg.select(run, "first_loss", "last_loss", "min_loss", drop.alias("drop"),
                      ((F.lit(1.0) - F.try_divide(F.col("last_loss"), F.col("first_loss"))) * 100).alias("drop_pct"),
                      F.coalesce(F.col("_tail_mean"), F.col("_all_mean")).alias("tail_mean"), "n_points",
                      *[c for c in ("last_step", "n_evals", "best_eval_loss", "latest_eval_loss", "epoch") if c in agg.columns])


def moving_average(log: DataFrame, run: str = "run_id", step: str = "step", loss: str = "loss",
                   max_window: int = 50, rows_per_chunk: int = 100_000) -> DataFrame:
    """Trailing moving average, ``valid`` mode.

    Window per run = min(50, len // 10), only for runs longer than 10 points;
    the first w − 1 points have no value and are dropped.  Rows without a loss (evaluation
    entries) do not count.  Steps are unique per run.

    The log is range-partitioned on (run, step), so a partition holds about equally many rows
    whatever the lengths of the runs and wherever their steps cluster.  The partitioned rows are
    stored (their number of partitions grows with the log): both the counts and the averages need
    the very same borders.  A run's part of one partition is a segment; segments are counted (one row
    each), running sums over them give the positions, and the last w − 1 rows of a segment are copied
    to the following segments whose windows reach over the border.  Each segment then averages its
    own rows with a bounded frame.
    """
    spark = log.sparkSession
    base = log.filter(F.col(loss).isNotNull()).select(run, step, loss)
    # a few segments to each later task, so that tasks are even
    n_parts = max(-(-base.count() // rows_per_chunk), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut_lineage(base.repartitionByRange(n_parts, run, step).withColumn("_part", F.spark_partition_id()), "ranges")
    # one row per segment: no more than runs and partitions together
    segments = rows.groupBy(run, "_part").agg(F.count(F.lit(1)).alias("_cnt"))
    order = Window.partitionBy(run).orderBy("_part")
    length = F.sum("_cnt").over(Window.partitionBy(run))
    segments = segments.withColumns({
        "_len": length, "_w": F.least(F.lit(max_window), F.floor(length / 10)).cast("int"),
        "_start": F.coalesce(F.sum("_cnt").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1,
    }).filter(F.col("_len") > 10)
    segments = segments.withColumn("_end", F.col("_start") + F.col("_cnt") - 1).withColumn(
        "_next", F.collect_list(F.struct(F.col("_part").alias("p"), F.col("_start").alias("s"))).over(order.rowsBetween(1, max_window - 1)))
    reach = F.filter("_next", lambda t: t.getField("s") <= F.col("_end") + F.col("_w") - 1)
    # segments are at most one partition of rows each, and so are the keys of the join and of the windows
    placed = rows.join(segments.select(run, "_part", "_start", "_end", "_w", reach.alias("_to")), [run, "_part"]).withColumn(
        "_p", F.col("_start") - 1 + F.row_number().over(Window.partitionBy(run, "_part").orderBy(step)))
    # a row goes to its own segment and, near the end, to those whose first windows need it
    goes = F.filter("_to", lambda t: F.col("_p") >= t.getField("s") - F.col("_w") + 1)
    targets = F.concat(F.array(F.col("_part")), F.transform(goes, lambda t: t.getField("p")))
    staged = placed.select(run, step, loss, "_p", "_w", F.col("_part").alias("_own"), F.explode(targets).alias("_part"))
    frame = Window.partitionBy(run, "_part").orderBy("_p").rowsBetween(-(max_window - 1), 0)
    win = F.col("_w")
    avg = F.aggregate(F.col("_tail"), F.lit(0.0), lambda acc, x: acc + x) / win
    return (staged.withColumn("_last", F.collect_list(loss).over(frame)).filter((F.col("_own") == F.col("_part")) & (F.col("_p") >= win))
            .withColumn("_tail", F.slice("_last", -win, win)).select(run, step, avg.alias("moving_avg"), win.alias("window")))


def plan_distribution(plans: DataFrame, side: str, plan: str) -> DataFrame:
    """Count and share of plans that update the path, per side.

    Lower-cased; a missing plan counts as no change.
    """
    from choicespark.operators.aggregates import shares

    has = F.lower(F.coalesce(F.col(plan), F.lit(""))).contains("update path")
    counts = plans.groupBy(side, has.alias("has_update")).agg(F.count(F.lit(1)).alias("n"))
    return shares(counts, "n", [side])


def field_coverage(predictions: DataFrame, ok: str, field: Column) -> DataFrame:
    """Parsed predictions, and those whose field is not empty."""
    return predictions.agg(F.count_if(F.col(ok) & (F.coalesce(field, F.lit("")) != "")).alias("with_field"),
                           F.count_if(ok).alias("parsed"))


def plan_match(paired: DataFrame, pred_plan: str = "pred_plan", truth_plan: str = "truth_plan") -> DataFrame:
    """Share of truths whose prediction has the very same plan; a missing one does not match."""
    same = F.coalesce(F.col(pred_plan) == F.col(truth_plan), F.lit(False))
    return paired.agg(F.avg(F.when(same, 1.0).otherwise(0.0)).alias("plan_match"), F.count(F.lit(1)).alias("n"))


def head_n(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """First n rows in key order; n = 0 means all."""
    ordered = df.orderBy(*order_by)
    return ordered if n == 0 else ordered.limit(n)


def preview(df: DataFrame, id_col: str, text_col: str, n: int = 20, width: int = 300) -> DataFrame:
    """Report preview: text cut to ``width`` chars, ``...`` always appended, first n by id."""
    cut = F.concat(F.substring(F.col(text_col), 1, width), F.lit("..."))
    return head_n(df.select(id_col, cut.alias(f"{text_col}_preview")), [id_col], n)
