"""Numeric checks for the driver-side model fits, partition invariance and plan shape."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicespark.operators import clusters as K
from choicespark.operators import factors as FA
from choicespark.operators import split as S

import __spark_entry__ as E
from conftest import SF_SMALL


def _fixture_matrix(n=200, seed=7):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 2))
    load = np.array([[0.9, 0.0], [0.8, 0.1], [0.7, 0.0], [0.0, 0.9], [0.1, 0.8], [0.0, 0.7]])
    x = z @ load.T + 0.3 * rng.normal(size=(n, 6))
    return x


def _fa_by_svd(x, k, tol=1e-2, max_iter=1000):
    n, p = x.shape
    var = x.var(0)
    psi = np.ones(p)
    old = -np.inf
    const = p * np.log(2 * np.pi) + k
    for _ in range(max_iter):
        sq = np.sqrt(psi)
        _, s, vt = np.linalg.svd(x / (sq * np.sqrt(n)), full_matrices=False)
        s2 = s ** 2
        w = (np.sqrt(np.maximum(s2[:k] - 1.0, 0.0))[:, None] * vt[:k]) * sq
        ll = -n / 2 * (const + np.log(s2[:k]).sum() + (s2.sum() - s2[:k].sum()) + np.log(psi).sum())
        if ll - old < tol:
            break
        old = ll
        psi = np.maximum(var - (w ** 2).sum(0), 1e-12)
    return psi, w.T


def test_factor_fit_matches_direct_numpy(spark):
    x = _fixture_matrix()
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    m = FA.fit_factor_model(df, "v", 2)
    # independent reference: the same EM run by SVD on the standardised n × p data
    xs = (x - x.mean(0)) / x.std(0)
    psi, W = _fa_by_svd(xs, 2)
    assert np.allclose(m.noise, psi, atol=1e-6)
    assert np.allclose(m.loadings @ m.loadings.T, W @ W.T, atol=1e-6)
    # the fitted two-factor model reproduces the off-diagonal correlations (rotation is not applied)
    R = np.corrcoef(xs, rowvar=False)
    implied = m.loadings @ m.loadings.T + np.diag(m.noise)
    off = ~np.eye(6, dtype=bool)
    assert np.abs(implied - R)[off].max() < 0.05
    scores = np.array([[r[n] for n in ("f1", "f2")] for r in
                       FA.factor_scores(df, "v", m, ["f1", "f2"]).orderBy("id").collect()])
    want = xs @ m.score_matrix
    assert np.allclose(scores, want, atol=1e-9)


def test_silhouette_closed_form_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.normal(loc=c, size=(15, 3)) for c in (0, 3, 6)])
    labels = np.repeat([0, 1, 2], 15)
    df = spark.createDataFrame([(int(c), [float(v) for v in row]) for c, row in zip(labels, x)],
                               "label int, v array<double>")
    got = K.silhouette_squared(df, "v", "label").first().silhouette
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    s = []
    for i in range(len(x)):
        own = labels == labels[i]
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in set(labels) if c != labels[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s), abs=1e-12)


@pytest.mark.parametrize("parts", [1, 7, 50])
def test_split_is_partition_invariant(spark, parts):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey").repartition(parts)
    out = {r.o_orderkey: r.split for r in S.train_val_split(o, "o_orderkey").collect()}
    n = len(out)
    assert sum(v == "train" for v in out.values()) == int(n * 0.9)
    ref = {r.o_orderkey: r.split for r in
           S.train_val_split(spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey"),
                             "o_orderkey").collect()}
    assert out == ref


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["decide_alternatives", "decide", "render_prompt", "train_val_split",
                                  "quality_report", "silhouette_sq", "moving_avg", "dedupe_last"])
def test_plans_have_no_pairs_python_or_single_partition(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (name, bad)
    # the only nested-loop joins allowed attach a one-row global statistic (keyless aggregate)
    for node in _nodes(E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan()):
        if node.nodeName() == "BroadcastNestedLoopJoin":
            build = node.right() if node.buildSide().toString() == "BuildRight" else node.left()
            assert "(keys=[]" in build.toString(), (name, build.toString()[:500])


def _nodes(plan):
    stack = [plan]
    while stack:
        n = stack.pop()
        if n.nodeName() == "AdaptiveSparkPlan":
            n = n.executedPlan()
        yield n
        kids = n.children()
        stack.extend(kids.apply(i) for i in range(kids.size()))


def test_filters_and_columns_reach_the_scan(spark):
    df = E.queries()["filter_by_id"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), EqualTo(event_id,42)]" in plan
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan


def test_personas_from_survey_end_to_end(spark):
    from choicespark.operators.personas import personas_from_survey

    x = _fixture_matrix(120)
    likert = np.clip(np.round(3 + x), 1, 5).astype(int)
    items = ["Q6", "Q7", "Q15", "Q8", "Q9", "Q11"]
    rows = [(f"CN_{i + 1:04d}", "CN", 12, 1, 3, *[int(v) for v in row]) for i, row in enumerate(likert)]
    df = spark.createDataFrame(rows, "persona_id string, country string, Q21 int, Q49 int, Q52 int, "
                               + ", ".join(f"{c} int" for c in items))
    personas, rejected, model, missing = personas_from_survey(df, k=2)
    assert rejected.count() == 0 and personas.count() == 120
    assert "Q16" in missing and model.loadings.shape == (6, 2)
    r = personas.filter(F.col("persona_id") == "CN_0001").first()
    assert r.preference_factors.rerouting_proactiveness is not None and r.name == "User_0001"


def test_split_by_group_keeps_groups_together(spark):
    rows = [(f"p{g}", f"p{g}_S{i:02d}") for g in range(40) for i in range(10)]
    df = spark.createDataFrame(rows, "persona_id string, id string")
    out = S.train_val_split(df, "id", by="persona_id").collect()
    assert sum(r.split == "train" for r in out) == 360
    sides = {}
    for r in out:
        sides.setdefault(r.persona_id, set()).add(r.split)
    assert sum(len(v) > 1 for v in sides.values()) <= 1


@pytest.mark.parametrize("parts", [1, 7])
def test_scenarios_are_partition_invariant(spark, parts):
    from choicespark.operators.scenarios import flatten_scenarios, generate_scenarios
    from choicespark.plans.corpus import personas

    p = personas(spark, SF_SMALL)
    base = {tuple(r) for r in flatten_scenarios(generate_scenarios(p)).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        other = {tuple(r) for r in flatten_scenarios(generate_scenarios(p.repartition(parts))).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert base == other


def test_flagship_aggregate_reuses_join_partitioning(spark):
    df = E.queries()["decide_alternatives"](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = [ln.strip() for ln in plan.split("\n")]
    join_at = next(i for i, ln in enumerate(lines) if "ShuffledHashJoin" in ln or "SortMergeJoin" in ln)
    agg_at = next(i for i, ln in enumerate(lines) if "Aggregate(key=[o_orderkey" in ln)
    between = lines[agg_at:join_at]
    assert not any("Exchange" in ln for ln in between), between


def test_a_constant_item_is_left_out_and_reported(spark):
    x = _fixture_matrix()
    with_constant = np.insert(x, 4, 7.0, axis=1)
    make = lambda m: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "id int, v array<double>")
    a, b = FA.fit_factor_model(make(x), "v", 2), FA.fit_factor_model(make(with_constant), "v", 2)
    assert b.constant == (4,) and a.constant == ()
    assert b.noise_variance_total == pytest.approx(a.noise_variance_total)
    assert np.allclose(np.delete(b.loadings, 4, axis=0), a.loadings) and not b.score_matrix[4].any()


def test_cold_start_model_survives_storage(spark, tmp_path):
    from choicespark.operators import cold_start as CS

    x = _fixture_matrix(60)
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    model = CS.ColdStartModel(FA.fit_factor_model(df, "v", 2), ["f1", "f2"], [np.array([1.0, 0.0]), np.array([-1.0, 0.0])], {0: "up", 1: "down"})
    CS.save(spark, model, str(tmp_path / "m"))
    new = spark.createDataFrame([(900, [9.0] * 6), (901, [-9.0] * 6)], "id int, v array<double>")
    show = lambda m: [(r.id, r.f1, r.cluster, r.type_label) for r in CS.score(new, "v", m).orderBy("id").collect()]
    assert show(CS.load(spark, str(tmp_path / "m"))) == show(model)


def test_building_a_query_writes_nothing(spark):
    """Queries outside the file and stream plans (which write files as their feature) only plan."""
    import os

    from choicespark.plans import corpus, links, samples  # noqa: F401
    from choicespark.plans.registry import QUERIES
    from choicespark.session import ensure_checkpoint_dir

    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    files = lambda: sum(len(f) for _, _, f in os.walk(base))
    for name in ("decide", "argmax_choice", "preference_consistency", "render_prompt", "train_val_split", "decide_alternatives", "scenario_stats"):
        before = files()
        QUERIES[name](spark, SF_SMALL)
        assert files() == before, name


def test_survey_rows_and_their_statistics_share_one_exchange(spark):
    df = E.queries()["decide"](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    text = plan.toString()
    assert "ReusedExchange" in text or text.count("FileScan") <= 4


def test_split_input_is_read_twice_at_most(spark):
    o = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_orderkey", "o_totalprice")
    df = S.train_val_split(o, "o_orderkey")
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    assert final.count("FileScan") <= 2, final
