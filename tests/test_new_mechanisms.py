"""Row numbers, quantiles of many columns, rotations, skewed joins, calibration, coverage, ordered updates, Euclidean silhouette."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path / uuid.uuid4().hex)


@pytest.fixture()
def conf(spark):
    kept = {}

    def put(key, value):
        kept.setdefault(key, spark.conf.get(key, None))
        spark.conf.set(key, value)
    yield put
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# ------------------------------------------------------------------ row numbers

@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_line_numbers_do_not_depend_on_the_splits(spark, conf, tmp_path, split):
    from choicespark.sources.lines import numbered_lines

    conf("spark.sql.files.maxPartitionBytes", str(split))
    conf("spark.sql.files.openCostInBytes", "0")
    lines = [["a%d" % i * (i % 7) for i in range(100)], ["b\r"[: 1 + i % 2] for i in range(50)], ["", "", "end"]]
    for k, part in enumerate(lines):
        (tmp_path / f"f{k}.txt").write_bytes("\n".join(part).encode())
    got = [(r.line_no, r.value) for r in numbered_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    want = [x.rstrip("\r") for part in lines for x in part]
    assert got == list(enumerate(want))


def test_max_samples_counts_bad_and_blank_lines(spark, tmp_path):
    from choicespark.sources.files import read_jsonl

    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken{\n\n{"a": 4}\n{"a": 5}\n[1]\n{"a": 7}\n')
    for cap, good, bad in ((1, [1], 0), (2, [1], 1), (4, [1, 4], 1), (5, [1, 4, 5], 1), (100, [1, 4, 5, 7], None)):
        rows, wrong = read_jsonl(spark, str(tmp_path), "a int", max_samples=cap)
        assert sorted(r.a for r in rows.collect() if r.a is not None) == good
        assert bad is None or wrong.count() == bad


def test_platform_ids_are_the_same_on_every_read(spark, conf, tmp_path):
    from choicespark.sources.survey import normalise_dialect, read_table

    (tmp_path / "s.csv").write_text("StartDate,Q1\nStart Date,what\n" + "".join(f"2024,{i}\n" for i in range(300)))
    for split in ("256", "1000000"):
        conf("spark.sql.files.maxPartitionBytes", split)
        df = normalise_dialect(read_table(spark, str(tmp_path), "csv"), "UK", {}, key_col="absent")
        got = {r.persona_id: r.Q1 for r in df.collect()}
        assert got == {f"UK_{i:04d}": str(i) for i in range(300)}
        assert df.filter("not id_stable").count() == 0


# ------------------------------------------------------------------ quantiles

def test_quantiles_of_many_columns_in_three_scans(spark, monkeypatch):
    from choicespark.operators import aggregates as A

    rng = np.random.default_rng(4)
    n = 30_000  # more than the sketch's accuracy, so brackets are real
    data = {"u": rng.random(n), "dup": rng.integers(0, 5, n).astype(float), "heavy": np.exp(rng.normal(0, 6, n)), "one": np.full(n, 2.5),
            "tail": np.where(rng.random(n) < 0.999, 0.0, 1e300)}
    rows = [tuple(float(v[i]) for v in data.values()) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).withColumn("none", F.lit(None).cast("double"))
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = A.exact_quantiles_of(df, [*data, "none"], probs)
    for c, v in data.items():
        assert got[c] == pytest.approx(list(np.quantile(v, probs)), rel=1e-12, abs=0), c
    assert got["none"] == [None] * 5
    monkeypatch.setattr(A, "LISTED", 5)  # brackets are narrowed again and again
    again = A.exact_quantiles_of(df, ["u", "dup", "heavy"], [0.5])
    assert [again[c][0] for c in ("u", "dup", "heavy")] == pytest.approx([np.median(data[c]) for c in ("u", "dup", "heavy")], rel=1e-12)


def test_median_imputation_of_64_columns(spark):
    from choicespark.operators.features import impute_median

    rng = np.random.default_rng(1)
    x = rng.integers(1, 6, (200, 64)).astype(float)
    rows = [tuple(None if (i + j) % 9 == 0 else float(x[i, j]) for j in range(64)) for i in range(200)]
    cols = [f"c{j}" for j in range(64)]
    got = impute_median(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), cols).collect()
    for j, c in enumerate(cols):
        med = float(np.median([r[j] for r in rows if r[j] is not None]))
        assert [r[c] for r in got].count(None) == 0 and sum(1 for i, r in enumerate(rows) if r[j] is None and got[i][c] != med) == 0


# ------------------------------------------------------------------ factor rotation

def _loadings():
    rng = np.random.default_rng(7)
    simple = np.zeros((12, 3))
    for j in range(12):
        simple[j, j % 3] = 0.6 + 0.02 * j
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return simple, simple @ q


def test_varimax_finds_simple_structure():
    from choicespark.operators import factors as FA

    simple, mixed = _loadings()
    turned = mixed @ FA.varimax(mixed)
    assert FA.varimax_criterion(turned) >= FA.varimax_criterion(mixed)
    assert (turned ** 2).sum(axis=1) == pytest.approx((mixed ** 2).sum(axis=1))
    assert np.sort(np.abs(turned), axis=1)[:, :2].max() < 0.02      # one loading per item is left
    assert mixed @ FA.procrustes(mixed, simple) == pytest.approx(simple, abs=1e-9)


def test_names_follow_the_items():
    from choicespark.operators import factors as FA

    simple, _ = _loadings()
    items, names = [f"q{j}" for j in range(12)], ["first", "second", "third"]
    content = {n: {f"q{j}": 1.0 for j in range(12) if j % 3 == i} for i, n in enumerate(names)}
    target = FA.content_target(items, names, content)
    fitted = FA.FactorModel(simple[:, [2, 0, 1]] * [1, -1, 1], np.ones(12), simple[:, [2, 0, 1]] * [1, -1, 1], np.zeros(12), np.ones(12), 0.0, 1)
    named = FA.name_by_content(fitted, target)
    assert named.loadings == pytest.approx(simple) and named.score_matrix == pytest.approx(simple)


def test_best_assignment_equals_all_permutations():
    from itertools import permutations

    from choicespark.operators.factors import best_assignment

    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5):
        for _ in range(20):
            g = np.round(rng.random((n, n)), 1)
            got = best_assignment(g)
            assert sorted(got) == list(range(n))
            assert sum(g[i, c] for i, c in enumerate(got)) == pytest.approx(max(sum(g[i, c] for i, c in enumerate(p)) for p in permutations(range(n))))


def test_loading_checks_fail_for_other_numbers(spark):
    from choicespark.operators import factors as FA

    rng = np.random.default_rng(3)
    f = rng.normal(size=(400, 2))
    x = f @ rng.normal(size=(2, 6)) + 0.5 * rng.normal(size=(400, 6))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")
    m = FA.fit_factor_model(df, "v", 2)
    for model in (m, FA.varimax_rotation(m)):
        cov, mean, n = FA.score_covariances(df, "v", model)
        assert n == 400 and abs(cov - model.loadings).max() < 1e-9 and abs(mean).max() < 1e-9
    from dataclasses import replace
    for wrong in (replace(m, loadings=rng.normal(size=(6, 2))), replace(m, score_matrix=rng.normal(size=(6, 2)))):
        cov, _, _ = FA.score_covariances(df, "v", wrong)
        assert abs(cov - wrong.loadings).max() > 1e-3


# ------------------------------------------------------------------ moving average

def test_moving_average_of_a_clustered_run_is_even(spark, conf):
    from choicespark.operators import evaluation as V

    conf("spark.sql.shuffle.partitions", "2")
    steps = [*range(3000), 10 ** 12]          # steps cluster, one far outlier
    rows = [("hot", s, float(s % 17)) for s in steps] + [("cold", s * 10, float(s)) for s in range(40)] + [("short", 1, 1.0)]
    out = V.moving_average(spark.createDataFrame(rows, "run_id string, step long, loss double"), rows_per_chunk=100)
    got = {(r.run_id, r.step): r.moving_avg for r in out.collect()}
    want = {}
    for run, w in (("hot", 50), ("cold", 4)):
        own = sorted((s, x) for r, s, x in rows if r == run)
        for i in range(w - 1, len(own)):
            want[run, own[i][0]] = sum(x for _, x in own[i - w + 1 : i + 1]) / w
    assert got == pytest.approx(want)


# ------------------------------------------------------------------ skewed joins

def _hot(spark, n=30_000):
    left = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"), F.col("id").alias("row"))
    right = spark.range(0, n, 2).select((F.col("id") + 1).alias("k"), (F.col("id") * 10).alias("v")).unionByName(spark.createDataFrame([(7, 1), (None, 2)], "k long, v long"))
    return left, right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    from choicespark.operators.skew import salted_join

    left, right = _hot(spark, 2000)
    got, want = salted_join(left, right, ["k"], how), left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_salted_join_has_no_hot_task(spark, conf):
    from choicespark.operators.skew import hot_keys, salted_join

    for k, v in {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "8"}.items():
        conf(k, v)
    left, right = _hot(spark)
    assert len(hot_keys(left, ["k"], 0.1)) == 1
    tasks = lambda df: sorted(r["count"] for r in df.filter("k is not null").groupBy(F.spark_partition_id()).count().collect())
    plain, salted = tasks(left.join(right.hint("merge"), "k", "left")), tasks(salted_join(left, right.hint("merge"), ["k"], "left"))
    assert plain[-1] > 2 * np.median(plain) and salted[-1] <= 2 * np.median(salted)


def test_heavy_hitters_of_many_keys(spark):
    from choicespark.operators.skew import hot_keys

    df = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, -1).otherwise(F.col("id")).alias("k"))
    ((_, share),) = hot_keys(df, ["k"], 0.2, capacity=64)
    assert 0.25 - 1 / 64 <= share <= 0.25
    assert hot_keys(df.filter("k > 0"), ["k"], 0.2, capacity=64) == [] and hot_keys(df.limit(0), ["k"], 0.2) == []


# ------------------------------------------------------------------ calibration and coverage

@pytest.fixture(scope="module")
def people(spark):
    rows = [(f"C_{i:04d}", 20 + i % 40, 5 + i % 20, (float(i % 5 - 2) / 2, float(i % 3 - 1), float(i % 7 - 3) / 3)) for i in range(40)]
    return spark.createDataFrame(rows, "persona_id string, commute_time_morning int, delay_tolerance_planned int, "
                                       "preference_factors struct<time_sensitivity:double,risk_aversion:double,familiar_route_preference:double>")


def test_calibration_meets_the_rate_to_one_decision(spark, people):
    from choicespark.operators.calibration import calibrate, decide_calibrated
    from choicespark.operators.scenarios import generate_scenarios
    from choicespark.session import cut_lineage

    rows = cut_lineage(generate_scenarios(people, keep_persona=True))
    for target in (0.1, 0.5, 0.9):
        decided, knobs = decide_calibrated(rows, target)
        n = decided.filter("reroute").count()
        assert n == knobs.reroutes_after == int(400 * target + 0.5)
    now = calibrate(rows, lo=0.0, hi=1.0)
    assert (now.inertia, now.reroutes_before) == (0.0, now.reroutes_after)
    assert calibrate(rows.limit(0)).total == 0


def test_coverage_is_enforced_under_any_partitioning(spark, conf, people):
    from choicespark.operators.scenarios import cover_scenarios, coverage_check, generate_scenarios

    n = 7
    before = coverage_check(generate_scenarios(people, n)).filter("covered").count()
    seen = []
    for parts in ("2", "8"):
        conf("spark.sql.shuffle.partitions", parts)
        sc, left = cover_scenarios(people, n)
        assert left.count() == 0 and sc.count() == 40 * n
        assert coverage_check(sc).filter("covered").count() == 40 > before
        seen.append(sorted(map(str, sc.collect())))
    assert seen[0] == seen[1]


def test_coverage_that_cannot_be_met_is_reported(spark, people):
    from choicespark.operators.scenarios import cover_scenarios

    sc, left = cover_scenarios(people.limit(3), 2, max_rounds=2)
    assert sc.count() == 6 and left.count() == 3 and left.filter("score < 7").count() == 3


# ------------------------------------------------------------------ ordered update

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, rows):
    return spark.createDataFrame([(i, None if s is None else s, u, "x", v, p) for i, s, u, v, p in rows], "event_id long, s double, user_id long, event_type string, value double, props string").select(
        "event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", "props")


def _replay(update, rows):
    out = {}
    for u in {r[2] for r in rows if r[2] is not None}:
        own = []
        for i, s, w_u, v, p in rows:
            if w_u == u and s is not None and v is not None:
                k = None if p is None else float(p.split(":")[1].strip(" }"))
                own.append((round(s * 1e6), i, 1.0 if k is None else 1 / (1 + k / 100), v))
        m, t, n, _ = update.apply((update.mean, update.precision, 0, 0), own)
        out[u] = (n, m, t)
    return out


def _as_dict(df):
    return {r.user_id: (r.n, r.posterior_mean, r.precision) for r in df.collect()}


def _close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k][0] == b[k][0] and a[k][1:] == pytest.approx(b[k][1:], rel=1e-9)


def _history(n=300):
    rng = np.random.default_rng(9)
    return [(i, float(rng.integers(0, 40_000)), int(rng.integers(0, 3)), float(rng.normal()), '{"k": %d}' % rng.integers(0, 50) if i % 4 else None) for i in range(n)]


@pytest.mark.parametrize("idle", [None, 900.0])
def test_ordered_batch_equals_sequential_replay(spark, idle):
    from choicespark.streaming.ordered_update import Update, ordered_update_batch

    rows = [*_history(), (900, None, 1, 1.0, None), (901, 5.0, None, 1.0, None), (902, 5.0, 2, None, None)]
    update = Update(0.3, 2.0, 0.7, idle)
    _close(_as_dict(ordered_update_batch(_events(spark, rows), update)), _replay(update, rows))


@pytest.mark.parametrize("idle", [None, 900.0])
def test_ordered_stream_takes_late_and_unordered_events_and_resumes(spark, folder, idle):
    from choicespark.streaming.ordered_update import Update, ordered_update_stream

    update, rows = Update(0.3, 2.0, 0.7, idle), _history()
    # arrival in three batches, events out of order by up to 10,000 s
    arrival = sorted(rows, key=lambda r: r[1] + (r[0] * 7919 % 10_000))
    thirds = [arrival[:100], arrival[100:200], arrival[200:]]
    run = lambda: ordered_update_stream(spark, f"{folder}/in/*", update, "20000 seconds", checkpoint=f"{folder}/cp")
    for k, part in enumerate(thirds):
        _events(spark, part).coalesce(1).write.parquet(f"{folder}/in/p{k}")
        got = _as_dict(run())
        _close(got, _replay(update, [r for p in thirds[: k + 1] for r in p]))
    late = (1000, 1.0, 0, 1e6, None)      # far behind the watermark by now: dropped
    _events(spark, [late, (1001, 90_000.0, 0, 0.5, None)]).coalesce(1).write.parquet(f"{folder}/in/p3")
    _close(_as_dict(run()), _replay(update, [*rows, (1001, 90_000.0, 0, 0.5, None)]))
    import os
    assert len([d for d in os.listdir(f"{folder}/cp/result") if not d.startswith(".")]) == 1      # merged, not grown


# ------------------------------------------------------------------ Euclidean silhouette

def _silhouette(x, label):
    out = []
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        means = {c: d[label == c].sum() / max(1, (label == c).sum() - (c == label[i])) for c in set(label)}
        if (label == label[i]).sum() <= 1:
            out.append(0.0)
            continue
        a, b = means[label[i]], min(m for c, m in means.items() if c != label[i])
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


def test_euclidean_silhouette_exact_and_sampled(spark):
    from choicespark.operators import clusters as K

    rng = np.random.default_rng(5)
    label = np.array([0] * 500 + [1] * 300 + [2] * 30 + [3])
    x = rng.normal(size=(len(label), 4)) + 2.5 * rng.normal(size=(4, 4))[label]
    x[:100] = x[0]                              # a hot vector
    df = spark.createDataFrame([(x[i].tolist(), int(label[i])) for i in range(len(label))], "v array<double>, c int")
    want = _silhouette(x, label)
    assert K.silhouette_euclidean(df, "v", "c").first()["silhouette"] == pytest.approx(want, abs=1e-9)
    error = math.sqrt(18 * math.log(200) / 200)
    got = K.silhouette_euclidean(df, "v", "c", size=200).first()
    assert got["n"] == len(label) and abs(got["silhouette"] - want) < 0.05 < 2 * error / abs(1 - error)
    assert K.coreset_size(0.1) == 9537
