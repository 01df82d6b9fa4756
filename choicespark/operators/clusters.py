"""Clustering: MLlib k-means with restarts, nearest centre, silhouette, profiles.

Per-cluster statistics (count, vector sum, sum of squared norms) come from
one grouped ``Summarizer`` aggregate; they are bounded by the number of
clusters × dimensions and are applied back to rows as literal arrays, so no
row ever meets every other row (no pairs, no cross join).
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lit_array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)


@dataclass(frozen=True)
class Centres:
    """A finished k-means run: its centres, the cost of the last assignment, the iterations it took."""

    centres: np.ndarray
    cost: float
    iterations: int


def _packed(df: DataFrame, vec_col: str) -> DataFrame:
    """The vectors as raw doubles, about ``BLOCK`` bytes of them a row."""
    def run(batches):
        for batch in batches:
            x = batch.column("x")
            width = len(x.values) // len(x) if len(x) else 0
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            step = max(1, BLOCK // max(8, 8 * width))
            yield pa.RecordBatch.from_arrays([pa.array([x[i : i + step].tobytes() for i in range(0, len(x), step)], pa.binary())], names=["block"])

    return df.select(vector_to_array(F.col(vec_col)).alias("x")).mapInArrow(run, "block binary")


#: Bytes of vectors that a task handles at once: with the distances to the centres of all runs they stay in the cache.
BLOCK = 1 << 18


#: Restarts that draw their first centres at the same time: their jobs are many and short.
STARTS = 4


def _step(blocks: DataFrame, runs: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Per run: the vector sum and the number of rows of every centre, and the cost, in one pass over the rows.

    Rows go to the nearest centre, the first of equals.  The passes' results are k rows per run and task.
    """
    sizes = [(r, len(c)) for r, c in runs.items()]
    every = np.concatenate(list(runs.values()))
    shared = blocks.sparkSession.sparkContext.broadcast((sizes, every))

    def run(batches):
        sizes, every = shared.value
        half, turned = (every * every).sum(axis=1) / 2, every.T.copy()
        total, count, cost = np.zeros(every.shape), np.zeros(len(every), dtype=np.int64), np.zeros(len(every))
        for batch in batches:
            for raw in batch.column("block"):
                x = np.frombuffer(raw.as_buffer(), dtype=np.float64).reshape(-1, every.shape[1])
                near = half - x @ turned  # half the squared distance, less that from the origin
                norm, mine = (x * x).sum(axis=1), np.zeros(near.shape)
                at = 0
                for _, k in sizes:
                    best = near[:, at : at + k].argmin(axis=1) + at
                    mine[np.arange(len(x)), best] = 1.0
                    least = np.maximum(0.0, norm + 2 * near[np.arange(len(x)), best])
                    cost[at : at + k] += np.bincount(best - at, least, minlength=k)
                    count[at : at + k] += np.bincount(best - at, minlength=k)
                    at += k
                total += mine.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(len(every)), pa.int32()), pa.array(list(total), pa.list_(pa.float64())), pa.array(count), pa.array(cost)],
                                         names=["at", "total", "n", "cost"])

    parts = blocks.mapInArrow(run, "at int, total array<double>, n long, cost double")
    rows = parts.groupBy("at").agg(Summarizer.sum(array_to_vector("total")).alias("total"), F.sum("n").alias("n"), F.sum("cost").alias("cost")).collect()
    shared.destroy()
    total, count, cost = np.zeros(every.shape), np.zeros(len(every), dtype=np.int64), np.zeros(len(every))
    for row in rows:
        total[row["at"]], count[row["at"]], cost[row["at"]] = row["total"].toArray(), row["n"], row["cost"]
    out, at = {}, 0
    for r, k in sizes:
        out[r] = total[at : at + k], count[at : at + k], float(cost[at : at + k].sum())
        at += k
    return out


def kmeans_fit(df: DataFrame, vec_col: str = "features", k: int = 6, restarts: int = 10, seed: int = 42,
               max_iter: int = 300, tol: float = 1e-4):
    """k-means with ``restarts`` seeds, keeping the lowest training cost.

    Every restart begins at the k-means|| centres that MLlib draws for its seed and takes Lloyd's
    steps from there.  All restarts take a step in the same pass over the rows, so the number of passes is
    that of the longest restart, not of all together.

    Cluster ids are renumbered by size (desc), then by centre, so labels do
    not depend on which seed won.  Returns (:class:`Centres`, id remap dict, centres by new id).
    A restart ends when no centre moves by more than ``tol``; a warning says when the
    kept one stopped at ``max_iter`` instead.
    """
    cached = df.select(vec_col).persist()
    cached.count()

    def first(r: int) -> np.ndarray:
        return np.array(KMeans(k=k, seed=seed + r, featuresCol=vec_col, maxIter=0).fit(cached).clusterCenters())

    with ThreadPoolExecutor(STARTS) as pool:
        runs = dict(enumerate(pool.map(inheritable_thread_target(df.sparkSession)(first), range(restarts))))
    blocks = _packed(cached, vec_col).persist()
    blocks.count()
    cached.unpersist()
    best = None
    for step in range(1, max_iter + 1):
        found, going = _step(blocks, runs), {}
        for r, (total, n, cost) in found.items():
            moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], runs[r])  # a centre without rows stays
            if step == max_iter or (((moved - runs[r]) ** 2).sum(axis=1) <= tol * tol).all():
                if best is None or (cost, r) < best[:2]:
                    best = (cost, r, Centres(moved, cost, step))
            else:
                going[r] = moved
        runs = going
        if not runs:
            break
    model = best[2]
    if model.iterations >= max_iter:
        warnings.warn(f"k-means stopped at the limit of {max_iter} iterations", stacklevel=2)
    sizes = _step(blocks, {0: model.centres})[0][1]
    blocks.unpersist()
    order = sorted(range(len(model.centres)), key=lambda c: (-sizes[c], tuple(np.round(model.centres[c], 12))))
    remap = {old: new for new, old in enumerate(order)}
    return model, remap, [model.centres[old] for old in order]


def assign(df: DataFrame, model: Centres, remap: dict, vec_col: str = "features", out: str = "cluster") -> DataFrame:
    """The cluster of every row: that of its nearest centre, the first of equals, renumbered."""
    centres, ids = model.centres, np.array([remap[c] for c in range(len(model.centres))], dtype=np.int32)

    @F.arrow_udf("int")
    def nearest(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
        return pa.array(ids[np.stack([((rows - c) ** 2).sum(axis=1) for c in centres]).argmin(axis=0)])

    return df.withColumn(out, nearest(vector_to_array(F.col(vec_col))))


#: Clusters whose statistics the driver takes; a label with more values is no cluster label.
MAX_CLUSTERS = 10_000


def cluster_stats(df: DataFrame, array_col: str, cluster_col: str) -> list[tuple[int, int, np.ndarray, float]]:
    """(cluster, n, vector sum, sum of squared norms) per cluster — one grouped aggregate, at most ``MAX_CLUSTERS`` rows."""
    v = df.select(cluster_col, array_to_vector(F.col(array_col).cast("array<double>")).alias("_v"),
                  sq_norm(F.col(array_col).cast("array<double>")).alias("_sq"))
    rows = v.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("n"), Summarizer.sum(F.col("_v")).alias("s"),
                                      F.sum("_sq").alias("psi")).limit(MAX_CLUSTERS + 1).collect()
    if len(rows) > MAX_CLUSTERS:
        raise ValueError(f"{cluster_col} has more than {MAX_CLUSTERS} values")
    return sorted((int(r[cluster_col]), int(r["n"]), r["s"].toArray(), float(r["psi"])) for r in rows)


def nearest_centre(x: Column, centres: Sequence[tuple[int, np.ndarray]]) -> Column:
    """Id of the nearest centre by squared distance; ties go to the lower id (F8)."""
    cands = F.array(*[
        F.struct(F.aggregate(F.zip_with(x, _lit_array(c), lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                             lambda acc, d: acc + d).alias("d"), F.lit(cid).alias("id"))
        for cid, c in centres])
    return F.array_min(cands).getField("id")


def silhouette_squared(df: DataFrame, array_col: str, cluster_col: str) -> DataFrame:
    """Mean silhouette with squared Euclidean distance, closed form.

    For x in cluster i: d(x, C) = (n_C‖x‖² − 2 x·Y_C + Ψ_C) / n_C; a uses n_i − 1;
    a singleton scores 0.  Same definition as MLlib's ``ClusteringEvaluator``.
    """
    stats = cluster_stats(df, array_col, cluster_col)
    x = F.col(array_col).cast("array<double>")
    staged = df.select(F.col(cluster_col).alias("_c"), x.alias("_x"), sq_norm(x).alias("_xx"))
    dists = [F.struct(F.lit(cid).alias("c"), F.lit(n).alias("n"),
                      ((F.lit(float(n)) * F.col("_xx") - 2 * _dot(F.col("_x"), _lit_array(y)) + F.lit(psi))
                       / F.lit(float(n))).alias("d"))
             for cid, n, y, psi in stats]
    staged = staged.withColumn("_d", F.array(*dists))
    own = F.filter("_d", lambda s: s.getField("c") == F.col("_c"))[0]
    others = F.filter("_d", lambda s: s.getField("c") != F.col("_c"))
    a = own.getField("d") * own.getField("n") / (own.getField("n") - 1)
    b = F.array_min(F.transform(others, lambda s: s.getField("d")))
    s = (F.when(own.getField("n") <= 1, F.lit(0.0))
         .when(a < b, F.lit(1.0) - a / b).when(a > b, b / a - F.lit(1.0)).otherwise(F.lit(0.0)))
    return staged.agg(F.avg(s).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def coreset_size(error: float, risk: float = 0.01) -> int:
    """Points per cluster for a relative error of any mean distance up to ``error`` but for a chance of ``risk``.

    A draw stands for at most six times the mean distance over the number of draws (see
    :func:`cluster_coresets`), so by Hoeffding's bound 18 ln(2 / risk) / error^2 draws are enough.
    """
    return math.ceil(18 * math.log(2 / risk) / error ** 2)


def cluster_coresets(df: DataFrame, array_col: str, cluster_col: str, size: int, seed: int = 42) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(cluster, n, points, weights): a weighted sample of about ``size`` rows of each cluster, all rows of smaller ones.

    Sensitivity sampling: a row is drawn with probability size / 2 * (1 / n + d / sum d), d its
    distance from the cluster's centre, and weighs its inverse.  For any x, the distance to x is at
    most |x - centre| + d, and both |x - centre| and mean d / 2 are at most the mean distance, which
    bounds every draw's share in the estimate.  Two aggregates and one pass that collects the sample;
    clusters are at most ``MAX_CLUSTERS`` and the sample at most ``MAX_CORESET`` rows.
    """
    stats = cluster_stats(df, array_col, cluster_col)
    centres = df.sparkSession.createDataFrame([(c, n, [float(x) for x in y / n]) for c, n, y, _ in stats], "_c long, _n long, _m array<double>")
    x = F.col(array_col).cast("array<double>")
    near = df.select(F.col(cluster_col).cast("long").alias("_c"), x.alias("_x")).join(F.broadcast(centres), "_c")
    near = near.withColumn("_d", F.sqrt(sq_norm(F.zip_with("_x", "_m", lambda a, b: a - b))))
    total = near.groupBy("_c").agg(F.sum("_d").alias("_sum"))
    far = {r["_c"]: r["_sum"] for r in total.collect()}  # a row per cluster
    sums = df.sparkSession.createDataFrame([(c, float(s)) for c, s in far.items()], "_c long, _sum double")
    p = F.when(F.col("_n") <= size, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(size / 2.0) * (1.0 / F.col("_n") + F.coalesce(F.try_divide("_d", F.col("_sum")), F.lit(0.0)))))
    drawn = near.join(F.broadcast(sums), "_c").withColumn("_p", p).filter(F.rand(seed) < F.col("_p"))
    rows = drawn.select("_c", "_n", "_x", (1.0 / F.col("_p")).alias("_w")).limit(MAX_CORESET + 1).collect()
    if len(rows) > MAX_CORESET:
        raise ValueError(f"the sample exceeds {MAX_CORESET} rows")
    out = []
    for c, n, _, _ in stats:
        mine = [r for r in rows if r["_c"] == c]
        w = np.array([r["_w"] for r in mine])
        out.append((c, n, np.array([r["_x"] for r in mine]), w * (n / w.sum()) if len(w) else w))
    return out


#: Rows of all clusters' samples together, which go to every task.
MAX_CORESET = 200_000


def silhouette_euclidean(df: DataFrame, array_col: str, cluster_col: str, size: int = 4096, seed: int = 42) -> DataFrame:
    """Mean silhouette with Euclidean distances (F9): every row is scored against a sample of every cluster.

    Clusters of at most ``size`` rows are compared whole, so their figures are exact; of larger ones the
    mean distances come from :func:`cluster_coresets`.  With a relative error e of the mean distances a
    row's figure is off by at most 2 e / (1 - e); the mean over the rows, whose errors differ in sign,
    by much less.  Work is rows times sample, never pairs of rows.  A singleton scores 0.
    """
    sets = cluster_coresets(df, array_col, cluster_col, size, seed)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast([(c, n, p, (p * p).sum(axis=1) if len(p) else w, w) for c, n, p, w in sets])

    def run(batches):
        for batch in batches:
            own = batch.column("c").to_numpy(zero_copy_only=False)
            x = batch.column("x")
            x = x.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.zeros((0, 1))
            total, count = 0.0, len(own)
            for i in range(0, len(own), 256):
                part, mine = x[i : i + 256], own[i : i + 256]
                sq = (part * part).sum(axis=1)
                a, b, alone = np.zeros(len(part)), np.full(len(part), np.inf), np.zeros(len(part), dtype=bool)
                for c, n, p, pp, w in shared.value:
                    d2 = sq[:, None] + pp[None, :] - 2 * (part @ p.T)
                    # cancellation leaves noise where points coincide; such distances are taken anew
                    close = d2 <= 1e-9 * (sq[:, None] + pp[None, :])
                    if close.any():
                        r, k = np.nonzero(close)
                        d2[r, k] = ((part[r] - p[k]) ** 2).sum(axis=1)
                    mean = np.sqrt(d2) @ w / n
                    inside = mine == c
                    alone |= inside & (n <= 1)
                    a = np.where(inside, mean * (n / max(n - 1, 1)), a)
                    b = np.where(inside, b, np.minimum(b, mean))
                worst = np.maximum(a, b)
                s = np.where(alone | (worst == 0) | ~np.isfinite(worst), 0.0, (b - a) / np.where((worst == 0) | ~np.isfinite(worst), 1.0, worst))
                total += float(s.sum())
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([count], pa.int64())], names=["s", "n"])

    rows = df.select(F.col(cluster_col).cast("long").alias("c"), F.col(array_col).cast("array<double>").alias("x"))
    parts = rows.mapInArrow(run, "s double, n long")
    return parts.agg((F.sum("s") / F.sum("n")).alias("silhouette"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def profile(df: DataFrame, cluster_col: str, cols: Sequence[str]) -> DataFrame:
    """Cluster size and mean of every factor."""
    return df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in cols])


def profile_long(long: DataFrame, cluster_col: str, item: str, value: str) -> DataFrame:
    """Cluster size and mean of every item, one row each, for a table of any number of items."""
    return long.groupBy(cluster_col, item).agg(F.count(F.lit(1)).alias("size"), F.avg(value).alias("mean"))


def sizes(df: DataFrame, cluster_col: str) -> DataFrame:
    """Cluster sizes and shares (A8); the share window runs over the k grouped rows only."""
    c = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
    return c.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy()))


def top_abs(long: DataFrame, group: str, item: str, value: str, n: int = 3) -> DataFrame:
    """Top-n items by |value| per group, signed value kept, ties to the lower item."""
    w = Window.partitionBy(group).orderBy(F.abs(F.col(value)).desc(), F.col(item))
    return long.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def unnest(df: DataFrame, keys: Sequence[str], array_col: str, prefix: str = "f") -> DataFrame:
    """One row per vector component: the keys, ``factor`` (prefix and position from 0) and ``x``."""
    long = df.select(*keys, F.posexplode(F.col(array_col).cast("array<double>")).alias("_i", "x"))
    return long.select(*keys, F.concat(F.lit(prefix), F.col("_i").cast("string")).alias("factor"), "x")


#: Ranges that ``histogram`` broadcasts; more groups than that meet their rows by shuffle.
MAX_RANGES = 100_000


def histogram(long: DataFrame, group: Sequence[str], value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over each group's own min–max, last bin closed.

    When min = max every row falls in bin 0 (flagged ``degenerate``).  The groups are
    few and hot, so their ranges go to the rows: they are counted first and broadcast
    up to ``MAX_RANGES``.
    """
    g = list(group)
    rng = long.groupBy(*g).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    few = rng.limit(MAX_RANGES + 1).collect()
    if len(few) <= MAX_RANGES:
        rng = F.broadcast(long.sparkSession.createDataFrame(few, rng.schema))
    j = long.join(rng, g, "inner")
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    b = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int"))
    return (j.withColumn("bin", b).groupBy(*g, "bin")
            .agg(F.count(F.lit(1)).alias("count"), F.max(F.col("_hi") == F.col("_lo")).alias("degenerate")))


def pca_2d(df: DataFrame, vec_col: str = "features") -> tuple[DataFrame, list[float]]:
    """Centre, then MLlib PCA to 2 components (F10, N14); sign fixed so each
    component's largest-magnitude coefficient is positive."""
    mean = df.select(Summarizer.mean(F.col(vec_col)).alias("m")).head()["m"].toArray()
    centred = df.withColumn("_c", array_to_vector(F.zip_with(vector_to_array(F.col(vec_col)), _lit_array(mean),
                                                             lambda a, b: a - b)))
    model = PCA(k=2, inputCol="_c", outputCol="_pc").fit(centred)
    pcs = model.pc.toArray()
    signs = np.sign(pcs[np.argmax(np.abs(pcs), axis=0), [0, 1]])
    signs[signs == 0] = 1.0
    out = model.transform(centred).withColumn("_pa", vector_to_array("_pc"))
    out = out.withColumn("pc1", F.col("_pa")[0] * float(signs[0])).withColumn("pc2", F.col("_pa")[1] * float(signs[1]))
    return out.drop("_c", "_pc", "_pa"), [float(x) for x in model.explainedVariance.toArray()]
