import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from choicespark.llm import queries as Q
from choicespark.llm import toxicity as T
from choicespark.llm.store import crc_bucket
from choicespark.llm.words import word_blocks
from llm_fixtures import documents, edges, make_docs, sf  # noqa: F401


def test_held_out_quality_at_a_larger_scale(spark):
    sf = "/root/testdata/sf0.1"
    scored = Q.QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    y, s = np.array([r.toxic for r in scored]), np.array([r.score for r in scored])
    auc = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert auc > 0.96 and ((s >= 0.5) == (y == 1)).mean() > 0.96 and (s[y == 0] >= 0.5).mean() < 0.01


def test_scores_do_not_see_labels_language_source_or_id(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = T.fit_toxicity(documents, labels, crc_bucket("doc_id", 5) != 0)
    a = {r.text: r.toxicity for r in T.with_score(documents, model).collect()}
    other = documents.select((F.col("doc_id") + 7).alias("doc_id"), "text", F.lit("x").alias("lang"))
    assert all(a[r.text] == r.toxicity for r in T.with_score(other, model).collect())


def test_fit_reads_training_rows_only(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    train = crc_bucket("doc_id", 5) != 0
    flipped = labels.withColumn("toxic", F.when(train, F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = T.fit_toxicity(documents, labels, train), T.fit_toxicity(documents, flipped, train)
    assert a.intercept == b.intercept and (a.bucket == b.bucket).all() and (a.weight == b.weight).all()


def test_weights_are_sparse(spark):
    sf = "/root/testdata/sf0.01"
    model = T.fit_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert 0 < len(model.weight) < 1 << 14


@pytest.mark.parametrize("labels", [[], [(4, 0), (None, 1), (5, None)], [(4, 1), (4, 0), (5, 0), (77, 1)]])
def test_edges(spark, edges, make_docs, labels):
    model = T.fit_toxicity(edges, spark.createDataFrame(labels, "doc_id long, toxic int"))
    rows = T.with_score(edges.withColumn("label", F.lit(None).cast("string")), model).collect()
    assert len(rows) == edges.count() and all(0 <= r.toxicity <= 1 for r in rows)
    blank = [r.toxicity for r in rows if not (r.text or "").strip()]
    assert len(set(blank)) == 1
    assert T.with_score(make_docs([]), model).count() == 0


def test_sample_bound(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = T.fit_toxicity(documents, labels, params=T.FtrlParams(max_rows=30))
    assert T.with_score(documents, model).filter("toxicity is null").count() == 0


def ftrl(rows, p):
    """The same fit with dictionaries, one coordinate at a time; rows are (label, buckets) in order."""
    seen = {}
    for _, f in rows:
        for b in f:
            seen[b] = seen.get(b, 0) + 1
    rows = [(y, [b for b in f if seen[b] >= p.min_docs]) for y, f in rows]

    def train(found, epochs, l1, l2):
        z, n = {}, {}

        def weight(b):
            zb = z.get(b, 0.0)
            return 0.0 if abs(zb) <= l1 else -(zb - math.copysign(l1, zb)) / ((p.beta + math.sqrt(n.get(b, 0.0))) / p.alpha + l2)

        for _ in range(epochs):
            for y, f in found:
                w = {b: weight(b) for b in [*f, "top"]}
                g = 1 / (1 + math.exp(-sum(w.values()))) - y
                for b in w:
                    was = n.get(b, 0.0)
                    z[b] = z.get(b, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / p.alpha * w[b]
                    n[b] = was + g * g
        return {b: weight(b) for b in z}

    chosen = {b for b, w in train(rows, p.epochs, p.l1 * len(rows) ** 0.5, p.l2).items() if w and b != "top"}
    return {b: w for b, w in train([(y, [b for b in f if b in chosen]) for y, f in rows], p.refit_epochs, 0.0, p.refit_l2).items() if w}


def test_fit_and_scores_equal_ftrl_with_dictionaries(spark, make_docs):
    rng = random.Random(3)
    calm, bad = ["sun", "tree", "river", "walk", "bread", "song"], ["vile", "scum", "trash"]
    texts = [" ".join(rng.choices(calm + bad * (i % 3 == 0), k=12)) for i in range(50)]
    labels = [int(any(w in bad for w in t.split())) for t in texts]
    params = T.FtrlParams(bits=14, min_docs=2, l1=0.05)
    model = T.fit_toxicity(make_docs(list(enumerate(texts))), spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"), params=params)

    def buckets(text):
        (_, _, at, h), = word_blocks(pa.array([text]))
        return sorted(set(T._features(h, at, params.bits)[1].tolist()))

    pick = {r.id: r.p for r in spark.range(50).select("id", F.xxhash64("id", F.lit(9)).alias("p")).collect()}
    rows = [(labels[i], buckets(texts[i])) for i in sorted(range(50), key=lambda i: pick[i])]
    want = ftrl(rows, params)
    assert model.intercept == pytest.approx(want.pop("top"), rel=1e-9)
    assert dict(zip(model.bucket.tolist(), model.weight.tolist())) == pytest.approx(want, rel=1e-9) and want
    scores = {r.doc_id: r.s for r in T.with_score(make_docs(list(enumerate(texts))), model, into="s").collect()}
    for i, t in enumerate(texts):
        total = model.intercept + sum(want.get(b, 0.0) for b in buckets(t))
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)


def test_a_taken_name_and_long_texts(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    with pytest.raises(ValueError, match="toxicity"):
        T.with_score(documents.withColumn("toxicity", F.lit(1)), T.fit_toxicity(documents, labels.limit(0)))
    small = T.fit_toxicity(documents, labels, params=T.FtrlParams(max_bytes=20_000))
    whole = T.fit_toxicity(documents, labels)
    assert len(small.weight) != len(whole.weight)


def test_a_worker_holds_the_features_of_little_text_at_once():
    import tracemalloc

    texts = pa.array([" ".join(f"w{i * j % 977}" for j in range(500)) for i in range(4_000)])  # some 8 MB
    weights = np.zeros(1 << 20)
    weights[::7] = 0.01
    run = T._feature_rows(20)
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(texts), pa.int32()), pa.array([0] * len(texts), pa.int64()), texts], names=["label", "pick", "text"])
    for work in (lambda: T.score_texts(texts, 20, 0.0, weights), lambda: sum(len(b) for b in run(iter([batch])))):
        work()
        tracemalloc.start()
        work()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60e6
