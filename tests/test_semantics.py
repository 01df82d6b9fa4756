"""Hand fixtures for the missing-value, text and metric rules."""

import json

import pytest
from pyspark.sql import functions as F

from choicespark.functions import nulls as N
from choicespark.functions.text import capitalize, word_count
from choicespark.operators import evaluation as V
from choicespark.operators import features as X
from choicespark.operators import quality as Q
from choicespark.operators import render as R
from choicespark.operators.personas import build_personas, dominant_factor, split_rejected


def test_null_rules(spark):
    df = spark.createDataFrame([(None, 0.0, 3.0), (2.0, 0.0, None), (4.0, 2.0, 1.0), (None, None, None)],
                               "a double, b double, c double")
    out = df.select(
        N.clip_keep_null(N.guarded_ratio("a", "b"), 0, 1).alias("clip"),          # N2 + N4
        N.row_mean(["a", "b", "c"]).alias("mean"),                                # N3
        (~N.safe_pred(F.col("a") > 1)).alias("filtered"),                          # N1
    ).collect()
    assert [r.clip for r in out] == [None, 1.0, 1.0, None]
    assert [r.mean for r in out] == [1.5, 1.0, 7.0 / 3.0, None]
    assert [r.filtered for r in out] == [True, False, False, True]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(float("nan"),), (7.0,)], "x double")
    out = df.select(N.nan_to_null("x").alias("x")).collect()
    assert out[0].x is None and out[1].x == 7.0


def test_zfill_never_truncates(spark):
    df = spark.createDataFrame([(7,), (12345,)], "k int")
    assert [r.z for r in df.select(N.zfill("k", 4).alias("z")).collect()] == ["0007", "12345"]


def test_multi_choice_and_flags(spark):
    df = spark.createDataFrame([(None,), ("",), ("2",), ("12",), ("1, 2",)], "Q10 string")
    out = X.choice_flags(X.multi_choice(df, "Q10"), "Q10", {"use_nav_app": "2"})
    out = X.channel_onehot(out, "Q10", {"nav_exact": "2"}).collect()
    assert [r.info_channel_count for r in out] == [0, 0, 1, 1, 2]
    assert [r.use_nav_app for r in out] == [False, False, True, True, True]      # substring quirk kept
    assert [r.nav_exact for r in out] == [False, False, True, False, True]       # exact membership


def test_quality_report_sequential_attrition(spark):
    rows = [(200, 2, 10, 10, 5.0, 1), (179, 2, 10, 10, 5.0, 1), (180, 3, 10, 10, 5.0, 1), (200, 2, 121, 10, 5.0, 1),
            (200, 2, 10, 10, 5.0, 0), (200, 2, 10, 10, 4.99, 1), (None, 2, 10, 10, 5.0, 1)]
    df = spark.createDataFrame(rows, "t int, Q31 int, Q1 int, Q2 int, Q42 double, Q21 int")
    rules = [("time", F.col("t") >= 180), ("attention", F.col("Q31") == 2),
             ("commute", (F.col("Q1") <= 120) & (F.col("Q2") <= 120)),
             ("ratio", N.guarded_ratio("Q42", "Q21") < 5)]
    rep = {r.step: r.n for r in Q.quality_report(df, rules).collect()}
    # null completion time fails the first rule; Q21 = 0 is replaced by 1 → 5/1 fails
    assert rep == {"time": 2, "attention": 1, "commute": 1, "ratio": 2, "initial_count": 7, "final_count": 1,
                   "total_filtered": 6}


def test_persona_rejection_and_defaults(spark):
    df = spark.createDataFrame(
        [("CN_0001", "CN", 12, 1, 3, None, 0.7, -0.6), ("CN_0002", "CN", None, 1, 3, 2, 0.0, 0.0),
         ("CN_0003", "CN", 5, 2, 9, 40, 0.5, -0.5)],
        "persona_id string, country string, Q21 int, Q49 int, Q52 int, Q1 int, risk_aversion double, "
        "time_sensitivity double")
    valid, rejected = split_rejected(df)
    assert [r.reject_reason for r in rejected.collect()] == ["missing Q21"]
    p = {r.persona_id: r for r in build_personas(valid).collect()}
    assert p["CN_0001"].commute_time_morning == 30                  # default when missing
    assert p["CN_0001"].preferences_in_transportation == "high risk aversion; patient with delays up to 12min"
    assert p["CN_0001"].innate == "cautious"
    assert p["CN_0003"].innate == "rational, balanced"              # ±0.5 exactly does not fire
    assert p["CN_0003"].household_income == "unknown"               # code outside 1–7
    assert p["CN_0003"].gender == "female" and p["CN_0003"].name == "User_0003"


def test_dominant_factor_tie_goes_to_first(spark):
    df = spark.createDataFrame([(0.4, -0.4), (None, None), (0.1, -0.9)], "a double, b double")
    s = F.struct(F.col("a").alias("rerouting_proactiveness"), F.col("b").alias("information_dependency"))
    out = [r.d for r in df.select(dominant_factor(s, ["rerouting_proactiveness", "information_dependency"])
                                  .alias("d")).collect()]
    assert out == ["rerouting_proactiveness", "time_sensitivity", "information_dependency"]


def test_capitalize_word_count_and_json(spark):
    df = spark.createDataFrame([("special_EVENT", '  two  words\\n', 'a "q"\nb ⚠️')], "t string, w string, j string")
    r = df.select(capitalize(F.col("t")).alias("c"), word_count(F.col("w")).alias("n"),
                  R.json_string(F.col("j")).alias("js")).first()
    assert r.c == "Special_event" and r.n == 2
    assert r.js == json.dumps('a "q"\nb ⚠️', ensure_ascii=False)


def test_response_json_matches_python_indent2(spark):
    df = spark.createDataFrame([("t1\nt2", "r", "none")], "t string, r string, p string")
    got = df.select(R.response_json(F.col("t"), F.col("r"), F.col("p")).alias("j")).first().j
    want = json.dumps({"thinking": "t1\nt2", "reflection": "r", "plan": "none", "concepts": []},
                      ensure_ascii=False, indent=2)
    assert got == want


@pytest.mark.parametrize("plan,route", [
    ("none", "A"), ("None", "unknown"), ("update path: Side_St, Local_Road_2", "B"), ("update path: Main_Ave", "A"),
    ("update path: Route B via Main_Ave", "B"), ("update path: x", "unknown"), ("", "unknown"), (None, "unknown")])
def test_route_from_plan(spark, plan, route):
    df = spark.createDataFrame([(plan,)], "p string")
    assert df.select(V.route_from_plan(F.col("p")).alias("r")).first().r == route


def test_extract_json_cases(spark):
    texts = ["no brace", "} before {", 'x {"plan": "none"} y', '{"plan": "a"} and {"plan": "b"}',
             '{"plan": "none", "thinking": "t"} trailing prose']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r.p for r in df.select(V.parse_response(F.col("t")).getField("plan").alias("p")).collect()]
    assert out == [None, None, "none", None, "none"]


def test_decision_metrics_zero_guards(spark):
    df = spark.createDataFrame([("none", "none", True), ("none", None, False)],
                               "truth_plan string, pred_plan string, pred_ok boolean")
    m = V.decision_metrics(df).first()
    assert m.total_samples == 2 and m.correct_route == 1
    assert (m.reroute_precision, m.reroute_recall, m.reroute_f1) == (0.0, 0.0, 0.0)


def test_loss_summary_short_run_uses_whole_tail(spark):
    df = spark.createDataFrame([("r", i, float(10 - i)) for i in range(5)], "run_id string, step bigint, loss double")
    s = V.loss_summary(df).first()
    assert s.tail_mean == 8.0 and s.first_loss == 10.0 and s.last_loss == 6.0
    assert V.moving_average(df).count() == 0          # ≤ 10 points: no moving average


def test_moving_average_valid_mode(spark):
    import numpy as np

    vals = [float(v) for v in np.random.default_rng(1).normal(size=120)]
    df = spark.createDataFrame([("r", i, v) for i, v in enumerate(vals)], "run_id string, step bigint, loss double")
    got = [r.moving_avg for r in V.moving_average(df).orderBy("step").collect()]
    want = np.convolve(vals, np.ones(12) / 12, mode="valid")
    assert len(got) == len(want) and np.allclose(got, want)


def test_loss_summary_tail_mean_on_a_long_run(spark):
    import numpy as np

    vals = [float(v) for v in np.random.default_rng(2).normal(size=250)]
    rows = [("hot", i, v) for i, v in enumerate(vals)] + [("small", i, float(i)) for i in range(12)]
    df = spark.createDataFrame(rows, "run_id string, step bigint, loss double")
    got = {r.run_id: r for r in V.loss_summary(df, salt_buckets=7).collect()}
    assert got["hot"].tail_mean == pytest.approx(np.mean(vals[-25:]))
    assert got["small"].tail_mean == pytest.approx(11.0)          # n = 1: the last point only
    assert got["hot"].n_points == 250 and got["hot"].last_step == 249


def test_survey_csv_scan_and_cleaning(spark, tmp_path):
    """Question-text dialect CSV (header with newlines) → renamed, keyed, cleaned (IO1, Q1–Q5, X1–X6)."""
    import csv

    from choicespark.questionnaire import QUESTION_CODES
    from choicespark.sources.survey import clean_survey, load_survey

    text = {v: k for k, v in QUESTION_CODES.items()}
    cols = ["序号", "所用+C1:D851时间"] + [text[q] for q in ("Q1", "Q2", "Q4", "Q5", "Q10", "Q21", "Q23", "Q31", "Q42")]
    rows = [[1, 200, 30, 40, 10, 50, "1,2,8", 10, 2, 2, 20],
            [2, 179, 30, 40, 10, 5, "", 10, 2, 2, 20],
            [12345, 300, 0, 40, 10, 5, "12", 0, 5, 2, 3],
            [4, 300, 30, 40, 10, 5, None, 10, None, 3, 20]]
    path = tmp_path / "CN_dataset.csv"
    with open(path, "w", newline="", encoding="utf-8-sig") as f:
        w = csv.writer(f)
        w.writerow(cols)
        w.writerows(rows)
    schema = ", ".join(f"`{c}` {'string' if c == text['Q10'] else 'int'}" for c in cols)
    df = load_survey(spark, str(path), "CN", schema=schema)
    assert "Q43" not in df.columns and "Q10" in df.columns
    clean, report = clean_survey(df)
    rep = {r.step: r.n for r in report.collect()}
    assert rep["completion_time_too_short"] == 1 and rep["attention_check_failed"] == 1 and rep["final_count"] == 2
    got = {r.persona_id: r for r in clean.collect()}
    assert set(got) == {"CN_0001", "CN_12345"}
    a, b = got["CN_0001"], got["CN_12345"]
    assert a.Q23_reversed == 4 and a.info_channel_count == 3 and a.use_nav_app and not a.use_vms
    assert a.congestion_ratio_afternoon == 1.0 and a.delay_tolerance_ratio == 2.0 and a.commute_asymmetry == 10
    assert b.congestion_ratio_morning == 1.0 and b.delay_tolerance_ratio == 3.0 and b.use_nav_app


@pytest.mark.parametrize("time,normal,delay,ok", [
    (4, 4, 0, False), (5, 5, 0, True), (180, 170, 10, True), (181, 171, 10, False),
    (30, 10, 20, True), (31, 10, 21, False), (8, 0, 8, True)])
def test_route_validity_boundaries(spark, time, normal, delay, ok):
    from choicespark.operators.scenarios import route_ok, scenario_valid

    df = spark.createDataFrame([(time, normal, delay)], "t int, n int, d int")
    r = df.select(route_ok(F.col("t"), F.col("n"), F.col("d")).alias("a"),
                  scenario_valid(F.array(F.struct(F.col("t").alias("current_travel_time"),
                                                  F.col("n").alias("normal_travel_time"),
                                                  F.col("d").alias("current_delay")))).alias("b")).first()
    assert r.a is ok and r.b is ok


def _route(rid, t, d, unc, fam):
    return (rid, t - d, d, t, unc, fam)


def test_decision_ties_and_threshold(spark):
    from choicespark.operators.choice import decide_rows

    schema = ("scenario_id string, persona_id string, delay_tolerance_planned int, "
              "routes array<struct<id:string,normal_travel_time:int,current_delay:int,current_travel_time:int,"
              "uncertainty_level:string,familiarity:double>>, context struct<has_important_meeting:boolean>, "
              "preference_factors struct<time_sensitivity:double,risk_aversion:double,familiar_route_preference:double>")
    same = [_route("A", 30, 0, "low", 0.9), _route("B", 30, 0, "low", 0.9)]
    rows = [("tie", "p", 10, same, (False,), (0.0, 0.0, 0.0)),
            ("at_tol", "p", 10, [_route("A", 40, 10, "moderate", 0.9), _route("B", 35, 0, "low", 0.6)], (False,),
             (0.0, 0.0, 0.0))]
    df = spark.createDataFrame(rows, schema)
    out = {r.scenario_id: r for r in decide_rows(df, noisy=False).collect()}
    assert out["tie"].chosen_route == "A" and not out["tie"].reroute          # equal utilities: A wins
    assert not out["at_tol"].overridden                                         # delay == tolerance: no override
    assert out["at_tol"].utility_scores["A"] == pytest.approx(-0.5 * 40)


def test_samples_from_tables_dedupes_decisions(spark):
    from choicespark.operators.scenarios import generate_scenarios
    from choicespark.operators.choice import decide
    from choicespark.operators.personas import build_personas
    from choicespark.plans.samples import samples_from_tables

    p = build_personas(spark.createDataFrame([("CN_0001", "CN", 12, 1, 3, 40)],
                                             "persona_id string, country string, Q21 int, Q49 int, Q52 int, Q1 int"))
    sc = generate_scenarios(p, n=3)
    d = decide(sc, p)
    doubled = d.unionByName(d)                       # a repeated scenario id must not multiply samples
    s = samples_from_tables(sc, p, doubled)
    assert s.count() == 3 and s.select("id").distinct().count() == 3


def test_stream_update_matches_batch_per_window(spark, tmp_path):
    from choicespark.streaming.preference_update import preference_update_batch, preference_update_stream

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path = str(tmp_path / "events")
    ev.write.parquet(path)
    got = preference_update_stream(spark, path, window="1 day")
    got = {(r.window.start.date().isoformat(), r.user_id): (r.n, round(r.posterior_mean, 9)) for r in got.collect()}
    day = ev.withColumn("day", F.to_date("ts"))
    w = F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.get_json_object("props", "$.k").cast("double") / 100.0), F.lit(1.0))
    batch = day.groupBy("day", "user_id").agg(F.count(F.lit(1)).alias("n"),
                                              (F.sum(w * F.col("value")) / F.sum(w)).alias("m"))
    want = {(r.day.isoformat(), r.user_id): (r.n, round(r.m, 9)) for r in batch.collect()}
    assert got == want
    totals = {r.user_id: r.n for r in preference_update_batch(ev).collect()}
    assert sum(totals.values()) == ev.count()


@pytest.mark.parametrize("chunk", [7, 13, 10000])
def test_moving_average_chunked_equals_numpy(spark, chunk):
    import numpy as np

    rng = np.random.default_rng(5)
    vals = [float(v) for v in rng.normal(size=300)]
    steps = sorted(rng.choice(10 ** 6, size=300, replace=False).tolist())
    rows = [("a", int(s), v) for s, v in zip(steps, vals)] + [("b", i, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "run_id string, step bigint, loss double")
    out = V.moving_average(df, rows_per_chunk=chunk)
    got_a = [r.moving_avg for r in out.filter("run_id = 'a'").orderBy("step").collect()]
    want_a = np.convolve(vals, np.ones(30) / 30, mode="valid")
    assert len(got_a) == len(want_a) and np.allclose(got_a, want_a)
    got_b = [r.moving_avg for r in out.filter("run_id = 'b'").orderBy("step").collect()]
    assert np.allclose(got_b, np.convolve(np.arange(40.0), np.ones(4) / 4, mode="valid"))


def test_readme_flow_on_a_survey_csv(spark, tmp_path):
    """CSV survey → cleaning → factors → personas → scenarios → decisions → samples → exact split."""
    import csv

    import numpy as np

    from choicespark.operators.choice import decide_rows
    from choicespark.operators.personas import personas_from_survey
    from choicespark.operators.scenarios import generate_scenarios
    from choicespark.operators.split import train_val_split
    from choicespark.questionnaire import QUESTION_CODES
    from choicespark.sources.survey import clean_survey, load_survey

    text = {v: k for k, v in QUESTION_CODES.items()}
    items = ["Q6", "Q7", "Q8", "Q9", "Q12", "Q13"]
    cols = ["序号", "所用+C1:D851时间"] + [text[q] for q in ["Q1", "Q2", "Q21", "Q31", "Q42", "Q49", "Q52"] + items]
    rng = np.random.default_rng(0)
    path = tmp_path / "CN.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(cols)
        for i in range(1, 61):
            w.writerow([i, 300, 40, 45, 12, 2, 20, 1, 4] + list(rng.integers(1, 6, size=len(items))))
    survey = load_survey(spark, str(path), "CN", schema=", ".join(f"`{c}` int" for c in cols))
    clean, _ = clean_survey(survey)
    personas, rejected, model, _ = personas_from_survey(clean, k=2)
    samples = train_val_split(R.sample_rows(decide_rows(generate_scenarios(personas, keep_persona=True))), "id")
    counts = {r.split: r["count"] for r in samples.groupBy("split").count().collect()}
    assert rejected.count() == 0 and model.loadings.shape == (6, 2)
    assert counts == {"train": 540, "validation": 60}


def test_moving_average_and_loss_summary_with_evaluation_entries(spark):
    rows = [("r", 10 * i, float(i), None, i / 10) for i in range(40)]
    rows += [("r", 10 * i + 5, None, e, i / 10) for i, e in ((9, 3.0), (19, 2.0), (29, 2.5))] + [("r", 500, None, 4.0, 5.0)]
    df = spark.createDataFrame(rows, "run_id string, step bigint, loss double, eval_loss double, epoch double")
    got = [r.moving_avg for r in V.moving_average(df).orderBy("step").collect()]
    assert got == [i + 1.5 for i in range(37)]
    s = V.loss_summary(df, eval_loss="eval_loss", epoch="epoch").first()
    assert (s.last_step, s.n_points, s.first_loss, s.last_loss) == (500, 40, 0.0, 39.0)
    assert (s.n_evals, s.best_eval_loss, s.latest_eval_loss, s.epoch) == (4, 2.0, 4.0, 5.0)


def test_only_strict_json_is_accepted(spark):
    texts = ["{'plan': 'none'}", '{"plan": "a\nb"}', '{"plan": "a\\nb"}', '{"plan": 5}', '{"plan": "none"} {"x": 1}', '{"plan": "none",}',
             '{"plan": ["x"]}', "{}", '{"thinking": "t"}', None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    ok = [r.ok for r in df.select("i", V.parse_response(F.col("t")).isNotNull().alias("ok")).orderBy("i").collect()]
    want = []
    for t in texts:
        try:
            want.append(t is not None and isinstance(json.loads(t), dict))
        except ValueError:
            want.append(False)
    assert ok == want


def test_plan_distribution_lowers_case_and_counts_missing_plans(spark):
    df = spark.createDataFrame([("a", "UPDATE PATH: x"), ("a", None), ("a", "none"), ("b", "update path: y")], "side string, plan string")
    got = {(r.side, r.has_update): r.n for r in V.plan_distribution(df, "side", "plan").collect()}
    assert got == {("a", True): 1, ("a", False): 2, ("b", True): 1}


def test_csv_round_trip_keeps_quotes_breaks_and_empty_strings(spark, tmp_path):
    from choicespark.sources import files as IO

    rows = [(1, 'a "quoted" b'), (2, ""), (3, None), (4, "line\nbreak, comma"), (5, ' "" '), (6, "\\N")]
    df = spark.createDataFrame(rows, "i int, t string")
    IO.write_csv(df, str(tmp_path / "x"))
    back = IO.read_csv(spark, str(tmp_path / "x"), "i int, t string", multi_line=True)
    assert sorted((r.i, r.t) for r in back.collect()) == rows


def test_survey_csv_with_all_real_headers(spark, tmp_path):
    """Headers as Python's csv writes them, columns found by header in any order, all four rules kept."""
    import csv
    import random

    from choicespark import config as cfg
    from choicespark.operators.quality import survey_rules
    from choicespark.questionnaire import QUESTION_CODES
    from choicespark.sources.survey import clean_survey, load_survey

    heads = [cfg.ROW_NUMBER_COLUMN, cfg.COMPLETION_TIME_COLUMN, *QUESTION_CODES]
    random.Random(1).shuffle(heads)
    path = tmp_path / "CN.csv"
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(heads)
        for i in range(1, 9):
            row = {h: 3 for h in heads} | {cfg.ROW_NUMBER_COLUMN: i, cfg.COMPLETION_TIME_COLUMN: 300}
            by_code = {c: h for h, c in QUESTION_CODES.items()}
            row |= {by_code["Q31"]: 2 if i != 3 else 4, by_code["Q21"]: 10, by_code["Q42"]: 12, by_code["Q10"]: '1,"2",8'}
            w.writerow([row[h] for h in heads])
    survey = load_survey(spark, str(path), "CN")
    assert set(QUESTION_CODES.values()) <= set(survey.columns) and len(QUESTION_CODES) == 58
    assert len(survey_rules(survey)) == 4
    clean, report = clean_survey(survey)
    assert clean.count() == 7 and {r.step: r.n for r in report.collect()}["total_filtered"] == 1


def test_missing_rule_columns_are_reported(spark):
    from choicespark.operators.quality import skipped_survey_rules, survey_rules

    df = spark.createDataFrame([(1, 2)], "Q1 int, Q2 int")
    assert len(survey_rules(df)) + len(skipped_survey_rules(df)) == 4 and "attention_check_failed" in skipped_survey_rules(df)


@pytest.mark.parametrize("values", [[], [5.0], [1.0, 2.0], [-0.0, 0.0, 1e-300, -1e300, 1e300], [3.0] * 50 + [4.0], "normal", "heavy"])
def test_exact_quantiles_equal_numpy(spark, values):
    import numpy as np

    from choicespark.operators.aggregates import exact_quantiles

    rng = np.random.default_rng(3)
    values = {"normal": lambda: rng.normal(size=2000), "heavy": lambda: rng.pareto(0.3, size=2000)}[values]() if isinstance(values, str) else values
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double")
    got = exact_quantiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0])
    want = [None] * 5 if not len(values) else np.quantile(np.array(values), [0.0, 0.25, 0.5, 0.9, 1.0]).tolist()
    assert got == pytest.approx(want)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    from choicespark.streaming.preference_update import preference_update_batch, preference_update_stream

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    path, state = str(tmp_path / "events"), str(tmp_path / "state")
    show = lambda df: {r.user_id: (r.n, round(r.posterior_mean, 9)) for r in df.collect()}
    ev.filter("event_id % 3 = 0").write.parquet(path)
    first = show(preference_update_stream(spark, path, watermark="1000 days", checkpoint=state))
    assert first == show(preference_update_batch(ev.filter("event_id % 3 = 0")))
    ev.filter("event_id % 3 <> 0").write.mode("append").parquet(path)
    assert show(preference_update_stream(spark, path, watermark="1000 days", checkpoint=state)) == show(preference_update_batch(ev))


def test_channel_names(spark):
    from choicespark.operators.features import channel_names

    df = spark.createDataFrame([(["1", " 8", "12", ""],), (None,)], "c array<string>")
    assert [r.n for r in df.select(channel_names(F.col("c")).alias("n")).collect()] == [["radio", "other", "unknown", "unknown"], None]
