"""Round 3: restarts that share passes, packed stream state, word counts without regular expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def _points(spark, n=400):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 5)) + 3 * rng.normal(size=(7, 5))[rng.integers(0, 7, n)]
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "id long, v array<double>").repartition(3, "id")
    from choicespark.operators.factors import vectorize

    return x, vectorize(df, "v")


def test_kmeans_restarts_share_their_passes_and_equal_mllib(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    from choicespark.operators import clusters as K

    x, df = _points(spark)
    cached = df.select("features").persist()
    fits = [KMeans(k=4, seed=42 + r, maxIter=300, tol=1e-4).fit(cached) for r in range(5)]
    want = min(fits, key=lambda m: m.summary.trainingCost)
    passes, step = [], K._step
    monkeypatch.setattr(K, "_step", lambda blocks, runs: passes.append(len(runs)) or step(blocks, runs))
    model, remap, centres = K.kmeans_fit(df, k=4, restarts=5)
    assert model.cost == pytest.approx(want.summary.trainingCost, rel=1e-9)
    assert np.allclose(sorted(map(tuple, centres)), sorted(map(tuple, want.clusterCenters())), atol=1e-9)
    assert len(passes) == max(m.summary.numIter for m in fits) + 1 and passes[0] == 5      # one more for the sizes
    rows = K.assign(df, model, remap).collect()
    near = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert all(r["cluster"] == near[r["id"]] for r in rows) and len(rows) == len(x)
    cached.unpersist()


def test_kmeans_of_few_points_and_a_warning_at_the_limit(spark):
    from choicespark.operators import clusters as K

    _, df = _points(spark)
    with pytest.warns(UserWarning, match="limit of 1"):
        K.kmeans_fit(df, k=4, restarts=2, max_iter=1)
    same = df.filter("id < 1").crossJoin(spark.range(9).select(F.col("id").alias("copy")))
    model, remap, centres = K.kmeans_fit(same, k=2, restarts=1)      # one point: one centre
    assert {r["cluster"] for r in K.assign(same, model, remap).collect()} == {0} and len(centres) == 1


def test_a_stream_call_reads_and_writes_a_users_state_once():
    import pandas as pd

    from choicespark.streaming.ordered_update import Update, _Believer

    class State:
        value, calls = None, []

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, v):
            self.calls.append("update")
            self.value = v

    class Handle:
        timers, state = [], State()
        getValueState = lambda self, *a: self.state
        registerTimer = lambda self, t: self.timers.append(t)
        deleteTimer = lambda self, t: self.timers.remove(t)

    class Clock:
        getCurrentWatermarkInMs = lambda self: 500

    update, handle = Update(0.3, 2.0, 0.7), Handle()
    p = _Believer(update)
    p.init(handle)
    at = [(k * 7919 % 1000) * 1000 + 1 for k in range(1000)]
    part = pd.DataFrame({"at": at, "event_id": range(1000), "w": 1.0, "x": np.arange(1000) / 7})
    out = pd.concat(p.handleInputRows((5,), iter([part[:600], part[600:]]), None))
    events = list(zip(at, range(1000), [1.0] * 1000, (np.arange(1000) / 7).tolist()))
    m, t, n, last = update.apply((0.3, 2.0, 0, 0), events)
    assert out.iloc[0].tolist() == [5, n, m, t, last, 1000]
    assert handle.state.calls == ["get", "update"] and handle.timers == [1]
    handle.timers.clear()
    list(p.handleExpiredTimer((5,), Clock(), None))
    assert handle.state.calls == ["get", "update"] * 2 and handle.timers == [501]
    again = pd.concat(p.handleInputRows((5,), iter([part[:0].astype({"at": "int64"})]), None))
    assert again.iloc[0].tolist() == [5, n, m, t, last, 500]


def test_word_count_cuts_at_a_character(spark):
    from choicespark.functions.text import word_count

    texts = ["", " ", "a", " a\tb\n\nc \x0b\x0c\r d ", "x y", "  z", "one  two\r\nthree", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", word_count(F.col("t")).alias("n"))
    old = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select(
        "id", F.size(F.filter(F.split("t", r"\s+"), lambda w: w != "")).alias("n"))
    assert sorted(df.collect()) == sorted(old.collect())
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_generated_methods_of_decisions_are_small_enough_to_compile(spark):
    """The JVM interprets methods above 8,000 bytes."""
    import contextlib
    import io
    import re

    from choicespark.operators.choice import decide_rows, decision_margins
    from choicespark.operators.scenarios import generate_scenarios
    from choicespark.plans.corpus import personas
    from choicespark.session import cut_lineage

    rows = generate_scenarios(cut_lineage(personas(spark, "/root/testdata/sf0.001")), keep_persona=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else the code is not shown
    try:
        for df in (decision_margins(rows), decide_rows(rows).select("reroute")):
            with contextlib.redirect_stdout(io.StringIO()) as out:
                df.explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", out.getvalue())]
            assert len(sizes) > 1 and max(sizes) < 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
