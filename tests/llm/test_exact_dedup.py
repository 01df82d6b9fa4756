import hashlib
import re

import pytest
from pyspark.sql import functions as F

from choicespark.llm import exact_dedup as X
from llm_fixtures import edges, make_docs  # noqa: F401


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def test_groups_match_brute_force_on_edges(edges):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    got = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.digest).hex(), r.keep_id, r.n_rows, r.kept) for r in X.exact_groups(edges).collect())
    want = []
    for i, t in rows:
        group = [(j, u) for j, u in rows if norm(u) == norm(t)]
        best = min(group, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        want.append((-1 if i is None else i, hashlib.sha256(norm(t).encode()).hexdigest(), best[0], len(group), i == best[0]))
    assert got == sorted(want)


@pytest.mark.parametrize("few", [True, False])
def test_keep_first_leaves_one_row_of_each_text_and_all_columns(edges, monkeypatch, few):
    if not few:  # ids joined by shuffle instead of a broadcast
        monkeypatch.setattr(X, "small", lambda df: df)
    kept = X.keep_first(edges.withColumn("digest", F.lit("clash")).withColumn("keep_id", F.lit(1)))
    assert kept.columns == [*edges.columns, "digest", "keep_id"]
    texts = [norm(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({norm(r.text) for r in edges.collect()})


def test_index_persists_and_drops_what_an_older_batch_holds(spark, make_docs, tmp_path):
    path = str(tmp_path / "index")
    index = X.DigestIndex(spark, path, 4)
    first = make_docs([(10, "a b"), (11, "ab "), (12, "c")])
    assert sorted(r.doc_id for r in X.keep_first(first, index=index, batch=0).collect()) == [10, 12]
    again = X.DigestIndex(spark, path, 4)  # another session would open it like this
    assert again.rows().count() == 2
    second = make_docs([(1, "a  b"), (2, "d"), (3, " d"), (4, None)])
    assert sorted(r.doc_id for r in X.keep_first(second, index=again, batch=1).collect()) == [3, 4]
    assert X.DigestIndex(spark, path, 4).rows().count() == 4


def test_the_anti_join_does_not_move_the_index(spark, make_docs, tmp_path):
    index = X.DigestIndex(spark, str(tmp_path / "index"), 16)
    index.commit(X.group_digests(X.digests(make_docs([(1, "a"), (2, "b")]))), 0)
    groups = X.group_digests(X.digests(make_docs([(3, "a")])))
    plan = groups.hint("merge").join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    right = plan[plan.index("SortMergeJoin"):].split("FileScan")[-1]
    assert "Bucketed: true" in right


def test_empty_table(make_docs):
    empty = make_docs([])
    assert X.exact_groups(empty).count() == 0 and X.keep_first(empty).count() == 0


@pytest.mark.parametrize("parts", ["5", "8", "16"])
def test_index_opens_with_its_own_buckets(spark, make_docs, tmp_path, parts):
    path, before = str(tmp_path / "index"), spark.conf.get("spark.sql.shuffle.partitions")
    rows = [(i, f"text {i % 40}") for i in range(60)]
    X.keep_first(make_docs(rows), index=X.DigestIndex(spark, path, 8), batch=0)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        again = X.DigestIndex(spark, path)
        assert again.buckets == 8
        new = make_docs([*rows, (100, "new"), (101, "n ew")])
        seen = X.exact_groups(new, index=again, batch=1).collect()
        assert len(seen) == 62 and [r.doc_id for r in seen if r.kept] == [101]
        assert X.DigestIndex(spark, path).rows().count() == 41
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="8 buckets"):
        X.DigestIndex(spark, path, 4)


def test_a_batch_number_is_taken_once(spark, make_docs, tmp_path):
    index = X.DigestIndex(spark, str(tmp_path / "index"), 4)
    docs = make_docs([(1, "a"), (2, "b")])
    X.exact_groups(docs, index=index, batch=7)
    with pytest.raises(ValueError, match="batch 7"):
        X.exact_groups(docs, index=index, batch=7)
    assert [r.kept for r in X.exact_groups(docs, index=index, batch=8).collect()] == [False, False]
    index.close()
    assert index.name not in [t.name for t in spark.catalog.listTables()]
