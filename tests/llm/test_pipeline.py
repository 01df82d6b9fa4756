import zlib

import corpus_pipeline as P
from pyspark.sql import functions as F

from choicespark.llm import queries as Q
from choicespark.llm import toxicity
from test_decontaminate import plain as leaks
from test_exact_dedup import norm
from test_simhash import bits, roots, simhash
from llm_fixtures import documents, edges, make_docs, sf  # noqa: F401


def test_stages_in_order_with_the_brute_force_result(spark, sf, documents):
    """Each stage's kept ids, recomputed from its own input."""
    docs = documents
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = P.ensure_checkpoint_dir(spark) + f"/test-{name}"
        stage(spark, docs, sf).write.mode("overwrite").parquet(out)
        before, docs = docs, spark.read.parquet(out)
        assert docs.columns == documents.columns
        rows = [(r.doc_id, r.text) for r in before.collect()]
        kept[name] = sorted(r.doc_id for r in docs.collect())
        if name == "toxicity":
            model = Q.toxicity_model(spark, before, sf)
            want = [r.doc_id for r in toxicity.with_score(before, model).filter("toxicity < 0.5").collect()]
        elif name == "exact_dedup":
            want = [min((r for r in rows if norm(r[1]) == norm(t)), key=lambda r: (-len(r[1] or ""), r[0]))[0] for _, t in rows]
        elif name == "simhash_dedup":
            fps = [simhash(t) for _, t in rows]
            group = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bits(fps[i], fps[j]) <= 3])
            want = [min(rows[j][0] for j in range(len(rows)) if group[j] == g) for g in group]
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            hit = {i for i, _ in leaks(rows, items)}
            want = [i for i, _ in rows if i not in hit]
        assert kept[name] == sorted(set(want))
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert sorted({r.doc_id for r in packed.collect()}) == kept["decontamination"]
    whole = P.run(spark, sf)
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(whole) == key(packed)


def test_stage_names_and_edges(spark, sf, edges):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontamination", "packing"]
    docs = edges
    for name, stage in P.STAGES:
        for part in (docs, docs.limit(0)):
            out = P.ensure_checkpoint_dir(spark) + f"/edge-{name}"
            stage(spark, part.withColumn("score", F.lit(1)) if name != "packing" else part, sf).write.mode("overwrite").parquet(out)
            if part is docs and name != "packing":
                assert spark.read.parquet(out).columns == [*edges.columns, "score"]


def test_held_out_rows_are_those_of_the_checksum(spark, sf):
    for name, n in (("op1_lm_scoring", 10), ("op9_toxicity", 5)):
        rows = Q.QUERIES[name](spark, sf).select("doc_id", "held_out").collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == 0) for r in rows)
