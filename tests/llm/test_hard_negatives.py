import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicespark.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, every=100, n=5):
    """(anchor, positive, rank, negative, positive score, negative score) by plain integers."""
    kept = set()
    for i, v, c in rows:
        if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) and abs(x) < 32768 for x in v):
            kept.add((i, tuple(math.floor(256 * x) for x in v), c))
    kept, out = sorted(kept), []
    for a in kept:
        if a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[1], b[1])), b[0], b) for b in kept if b != a]
        positives = sorted(s[:2] for s in scored if s[2][2] == a[2])[:n]
        for ps, pid in positives:
            negatives = sorted(s[:2] for s in scored if s[2][2] != a[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps)[:n]
            out += [(a[0], pid, k + 1, nid, -ps, -ns) for k, (ns, nid) in enumerate(negatives)]
    return sorted(out)


def mined(spark, rows, every=100, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("a")).withColumn("q", F.lit(1)).withColumn("is_anchor", F.lit(True))
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect()))


def vectors(seed, n, d, labels, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.1, (labels, d))
    rows = []
    for i in range(n):
        c = int(rng.integers(0, labels))
        v = centres[c] + rng.normal(0, 0.12, d) if i >= hot else centres[0]
        rows.append((i, [float(x) for x in v], c))
    return rows


@pytest.mark.parametrize("d", [1, 7, 8, 64])
def test_equal_to_brute_force_across_blocks(spark, d):
    rows = vectors(d, 400, d, 4, hot=60)
    want = brute(rows, 20)
    assert want and mined(spark, rows, 20) == want
    assert mined(spark, rows, 20, candidates=37, anchors=6) == want


def test_undefined_rows_ties_repeats_and_wide_values(spark):
    rows = vectors(3, 150, 6, 3)
    nan, inf = float("nan"), float("inf")
    rows += [(None, [0.1] * 6, 1), (1000, None, 1), (1001, [0.1] * 6, None), (1002, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1), (1003, [nan] * 6, 1), (1004, [inf] * 6, 1),
             (1005, [1e6] * 6, 1), rows[20], rows[20], (20, [0.3] * 6, 2), (40, [], 1), (60, [0.2, 0.2], 1), (80, [30000.5] * 6, 1), (81, [-30000.5] * 6, 2), (82, [30000.5] * 6, 0),
             (-20, [0.1] * 6, 0), *[(2000 + i, [0.25] * 6, i % 2) for i in range(30)]]
    assert mined(spark, rows, 20, candidates=50, anchors=4) == brute(rows, 20)


def test_empty_table_and_lonely_anchors(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [0.5], 1), (1, [0.5], 2)]) == []


def test_table_scores_equal_inner_products():
    rng = np.random.default_rng(0)
    for top in (3, 400, 70_000, 8_000_000):
        a, c = rng.integers(-top, top, (9, 24)).astype(np.int32), rng.integers(-top, top, (13, 24)).astype(np.int32)
        planes = 1 + max(int(c.max()).bit_length(), int(-1 - c.min()).bit_length())
        got = H.table_scores(H.subset_sums(a), H.bit_planes(c, planes))
        assert (got == c.astype(np.int64) @ a.astype(np.int64).T).all()
