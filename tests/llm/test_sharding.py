import hashlib
from collections import defaultdict

import pytest

from choicespark.llm import sharding as H
from llm_fixtures import documents, edges, make_docs, sf  # noqa: F401


def plain(rows, limit):
    """Split only buckets above the limit, bit by bit."""
    def key(i, t):
        inner = hashlib.md5((t or "").encode()).hexdigest()
        return f"{int(hashlib.md5(f'{"" if i is None else i}:{inner}'.encode()).hexdigest()[:15], 16):060b}"
    done, todo = {}, {"": [(key(i, t), len((t or "").encode())) for i, t in rows]}
    while todo:
        path, group = todo.popitem()
        if sum(n for _, n in group) <= limit or len(group) == 1:
            done[path] = group
            continue
        for bit in "01":
            part = [g for g in group if g[0][len(path)] == bit]
            if part:
                todo[path + bit] = part
    return done


@pytest.mark.parametrize("limit", [2_000, 20_000, 1 << 30])
def test_matches_bitwise_splitting(documents, limit):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = plain(rows, limit)
    got = defaultdict(list)
    for r in H.shard(documents, limit).collect():
        got[r.shard].append((f"{r.h:060b}", r.n_bytes))
        assert r.shard_rows == len(want[r.shard]) and r.shard_bytes == sum(n for _, n in want[r.shard])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_a_hot_key_is_split_until_it_fits(make_docs):
    df = make_docs([(1, "the same row")] * 500 + [(2, "z" * 5000), (None, None)])
    rows = H.shard(df, 100).collect()
    assert len(rows) == 502
    size = defaultdict(int)
    for r in rows:
        size[r.shard] += r.n_bytes
    assert all(size[r.shard] == r.shard_bytes for r in rows)
    assert all(n <= 100 or n == 5000 for n in size.values())


def test_edges_and_empty(edges, make_docs):
    rows = H.shard(edges, 1000).collect()
    assert len(rows) == edges.count() and all(r.shard_bytes <= 1000 or r.shard_rows == 1 for r in rows)
    assert H.shard(make_docs([]), 1000).count() == 0


def test_written_shards_hold_every_row(spark, documents, tmp_path):
    path = str(tmp_path / "shards")
    directory = {r.shard: r.shard_rows for r in H.write_shards(documents.withColumnRenamed("source", "path"), path, 20_000).collect()}
    back = spark.read.option("recursiveFileLookup", "false").schema("doc_id long, text string, shard string").parquet(path)
    assert {r.shard: r["count"] for r in back.groupBy("shard").count().collect()} == directory
    assert back.count() == documents.count()


def test_no_python_in_the_plan(documents):
    assert "Python" not in H.shard(documents, 20_000)._jdf.queryExecution().toString()


def test_written_shards_of_a_hot_key_keep_their_assignment(spark, make_docs, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "shards")
    df = make_docs([(1, "the same row")] * 500 + [(None, "no id")] * 90 + [(2, "z" * 5000), (None, None), (3, "alone")])
    directory = {r.shard: (r.shard_bytes, r.shard_rows) for r in H.write_shards(df, path, 100).collect()}
    back = spark.read.schema("doc_id long, text string, shard string").parquet(path)
    size = F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("b")
    assert {r.shard: (r.b, r.n) for r in back.groupBy("shard").agg(size, F.count("*").alias("n")).collect()} == directory
    assert back.count() == df.count() and all(b <= 100 or n == 1 for b, n in directory.values())


def test_a_column_named_shard_is_not_overwritten(make_docs, tmp_path):
    with pytest.raises(ValueError, match="shard"):
        H.write_shards(make_docs([(1, "a")]).withColumnRenamed("source", "Shard"), str(tmp_path / "shards"), 100)
