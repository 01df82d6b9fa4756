import numpy as np
import pytest

from choicespark.llm import simhash as S
from choicespark.llm.components import components
from helpers import roots, simhash
from llm_fixtures import documents, edges, make_docs, rng, sf  # noqa: F401


def bits(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count()


def check(df, radius=3):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fps = [simhash(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bits(fps[i], fps[j]) <= radius])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(x for x in (least.get(r), i) if x is not None) if i is not None or r in least and least[r] is not None else None
    want = sorted((str(i), f, str(least[r])) for (i, _), f, r in zip(rows, fps, root))
    got = sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in S.near_groups(df).collect())
    assert got == want


def test_fingerprints_and_components_match_brute_force(documents):
    check(documents)


def test_edges(edges):
    check(edges)


def test_empty_table(make_docs):
    assert S.near_groups(make_docs([])).count() == 0
    assert S.keep_one(make_docs([])).count() == 0


def clustered(rng, n):
    out = set()
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            out.add(c)
            for _ in range(rng.randint(0, 2)):
                c ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("radius", [1, 3])
def test_tree_finds_every_link(rng, radius):
    fps = clustered(rng, 400)
    got = S.local_roots(np.array(fps, dtype=np.uint64), radius).tolist()
    assert got == roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bits(fps[i], fps[j]) <= radius])


@pytest.mark.parametrize("shard, blocks_for", [(20_000, 400), (3, 400), (20_000, 1 << 23), (20_000, 1 << 31)])
def test_shards_lose_no_link(spark, rng, monkeypatch, shard, blocks_for):
    """Also with hot shards cut into parts, and with the blocks that larger tables use."""
    masks = S.block_masks
    monkeypatch.setattr(S, "block_masks", lambda r, n: masks(r, blocks_for))
    fps = clustered(rng, 400) + [0]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = components(S.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 3, shard)).collect()
    root = {r.node: r.root for r in found}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bits(fps[i], fps[j]) <= 3])
    groups = lambda xs: sorted(sorted(g) for g in {k: [f for f, x in zip(signed, xs) if x == k] for k in xs}.values())
    assert groups([root.get(f, f) for f in signed]) == groups(want)


def test_components_of_a_long_chain(spark, rng):
    ids = list(range(300))
    rng.shuffle(ids)
    links = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:])] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in ids}, 1000: 1000, 1001: 1000}


def test_keep_one_leaves_one_row_of_each_component(edges):
    kept = S.keep_one(edges)
    assert kept.columns == edges.columns
    fps = [simhash(r.text) for r in edges.collect()]
    n = len(set(roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bits(fps[i], fps[j]) <= 3])))
    left = [simhash(r.text) for r in kept.collect()]
    assert len(left) == n
    assert all(bits(a, b) > 3 for i, a in enumerate(left) for b in left[:i])
