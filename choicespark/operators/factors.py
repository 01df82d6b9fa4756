"""Factor model from a distributed correlation matrix.

The data never leaves the executors: one MLlib pass builds the p × p
correlation matrix (``Correlation.corr`` → RowMatrix tree aggregation) and
one ``Summarizer`` pass the per-item means and variances.  The maximum-
likelihood factor iteration then runs on the p × p matrix on the driver
(size bounded by the item count, not the row count).  Scores are a linear
map of the standardised row, applied as array expressions on the executors.

Rotations (varimax, or towards a target that says which items a factor is about) turn the p × k
loadings and the score weights by one orthogonal k × k matrix; names can follow the items instead of
the positions.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FactorModel:
    loadings: np.ndarray      # p × k, columns sign-canonicalised
    noise: np.ndarray         # ψ, length p
    score_matrix: np.ndarray  # p × k, maps a standardised row to its scores
    mean: np.ndarray          # per-item mean of the raw data
    std: np.ndarray           # per-item population std (0 → 1)
    log_likelihood: float
    n_iter: int
    constant: tuple[int, ...] = ()  # positions of items without variance: left out of the fit, zero weights

    @property
    def noise_variance_total(self) -> float:
        return float(self.noise.sum())


def vectorize(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def correlation_matrix(df: DataFrame, vec_col: str = "features") -> np.ndarray:
    """Pearson correlation of the vector column (p × p, on the driver)."""
    m = Correlation.corr(df.select(vec_col), vec_col, "pearson").head()[0]
    return m.toArray()


def moments(df: DataFrame, vec_col: str = "features") -> tuple[np.ndarray, np.ndarray, int, tuple[int, ...]]:
    """Per-item mean and population std (N12, 0 → 1), the row count and the constant items, in one aggregate."""
    r = df.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(vec_col)).alias("s")).head()["s"]
    n = int(r["count"])
    mean = r["mean"].toArray()
    var_pop = r["variance"].toArray() * (n - 1) / n if n > 1 else np.zeros_like(mean)
    std = np.sqrt(var_pop)
    constant = tuple(int(j) for j in np.flatnonzero(std == 0))
    std[std == 0] = 1.0
    return mean, std, n, constant


def fit_from_correlation(R: np.ndarray, n: int, k: int, tol: float = 1e-2, max_iter: int = 1000) -> tuple:
    """ML factor analysis on a correlation matrix (Appendix B.1): ψ, W, ll, iterations."""
    p = R.shape[0]
    psi = np.ones(p)
    const = p * np.log(2 * np.pi) + k
    prev = -np.inf
    W = np.zeros((p, k))
    ll = prev
    it = 0
    for it in range(1, max_iter + 1):
        s = 1.0 / np.sqrt(psi)
        M = R * s[:, None] * s[None, :]
        vals, vecs = np.linalg.eigh(M)
        order = np.argsort(vals)[::-1][:k]
        lam, V = vals[order], vecs[:, order]
        W = np.sqrt(psi)[:, None] * V * np.sqrt(np.maximum(lam - 1.0, 0.0))[None, :]
        ll = -n / 2.0 * (const + np.sum(np.log(lam)) + (np.trace(M) - lam.sum()) + np.sum(np.log(psi)))
        if ll - prev < tol:
            break
        prev = ll
        psi = np.maximum(np.diag(R) - np.sum(W ** 2, axis=1), 1e-12)
    return psi, W, float(ll), it


def canonical_signs(W: np.ndarray) -> np.ndarray:
    """Flip each factor so its largest-magnitude loading is positive."""
    idx = np.argmax(np.abs(W), axis=0)
    signs = np.sign(W[idx, np.arange(W.shape[1])])
    signs[signs == 0] = 1.0
    return W * signs[None, :]


def fit_factor_model(df: DataFrame, array_col: str, k: int) -> FactorModel:
    """Two distributed passes (moments, correlation), then the p × p fit on the driver.

    Items without variance tell nothing: they are left out of the fit, get zero loadings,
    noise and weights, and are reported in ``constant``.
    """
    v = vectorize(df, array_col)
    mean, std, n, constant = moments(v)
    p = len(mean)
    keep = np.array([j for j in range(p) if j not in constant], dtype=int)
    loadings, noise, score = np.zeros((p, k)), np.zeros(p), np.zeros((p, k))
    ll, it = 0.0, 0
    if len(keep):
        R = np.nan_to_num(correlation_matrix(v)[np.ix_(keep, keep)], nan=0.0)
        np.fill_diagonal(R, 1.0)
        psi, W, ll, it = fit_from_correlation(R, n, k)
        W = canonical_signs(W)
        Wt_psi = W.T / psi[None, :]                           # k × p
        cov_z = np.linalg.inv(np.eye(k) + Wt_psi @ W)         # k × k
        loadings[keep], noise[keep], score[keep] = W, psi, Wt_psi.T @ cov_z
    return FactorModel(loadings, noise, score, mean, std, ll, it, constant)


def varimax_criterion(W: np.ndarray) -> float:
    """Sum over the factors of the variance of the squared loadings."""
    return float(np.var(W ** 2, axis=0).sum())


def varimax(W: np.ndarray, tol: float = 1e-10, max_iter: int = 1000) -> np.ndarray:
    """The k × k orthogonal matrix that turns the loadings to the largest :func:`varimax_criterion` (on the driver)."""
    p, k = W.shape
    R, last = np.eye(k), 0.0
    for _ in range(max_iter):
        L = W @ R
        u, s, vt = np.linalg.svd(W.T @ (L ** 3 - L * (L ** 2).mean(axis=0)))
        R = u @ vt
        if s.sum() <= last * (1 + tol):
            break
        last = s.sum()
    return R


def procrustes(W: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The k × k orthogonal matrix that brings the loadings closest to a p × k target (least squares)."""
    u, _, vt = np.linalg.svd(W.T @ target)
    return u @ vt


def content_target(items: list[str], names: list[str], content: dict[str, dict[str, float]]) -> np.ndarray:
    """p × k target from what each factor is about: its items and their signs (items that are absent are skipped)."""
    at = {q: j for j, q in enumerate(items)}
    T = np.zeros((len(items), len(names)))
    for i, n in enumerate(names):
        for q, sign in content.get(n, {}).items():
            if q in at:
                T[at[q], i] = sign
    return T


def congruence(W: np.ndarray, target: np.ndarray) -> np.ndarray:
    """k × k cosines between the columns of the loadings and of the target (0 for empty columns)."""
    size = np.linalg.norm(W, axis=0)[:, None] * np.linalg.norm(target, axis=0)[None, :]
    return np.divide(W.T @ target, size, out=np.zeros_like(size), where=size > 0)


def best_assignment(gain: np.ndarray) -> list[int]:
    """The column of each row with the greatest total gain, each column once (shortest augmenting paths)."""
    n = gain.shape[0]
    cost = gain.max(initial=0.0) - gain
    u, v, row_of = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        row_of[0], j, way = i, 0, np.zeros(n + 1, dtype=int)
        least, done = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool)
        while row_of[j]:
            done[j] = True
            here = cost[row_of[j] - 1] - u[row_of[j]] - v[1:]
            better = ~done[1:] & (here < least[1:])
            least[1:][better], way[1:][better] = here[better], j
            nxt = 1 + int(np.argmin(np.where(done[1:], np.inf, least[1:])))
            step = least[nxt]
            u[row_of[done]] += step
            v[done] -= step
            least[~done] -= step
            j = nxt
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    out = [0] * n
    for j in range(1, n + 1):
        out[row_of[j] - 1] = j - 1
    return out


def rotate(model: FactorModel, R: np.ndarray) -> FactorModel:
    """The model turned by an orthogonal matrix, signs made canonical; communalities, noise and likelihood stay.

    The weights turn with the loadings, so scores of the turned model are the turned scores.
    """
    W = model.loadings @ R
    idx = np.argmax(np.abs(W), axis=0)
    signs = np.where(W[idx, np.arange(W.shape[1])] < 0, -1.0, 1.0)
    return replace(model, loadings=W * signs, score_matrix=(model.score_matrix @ R) * signs)


def varimax_rotation(model: FactorModel) -> FactorModel:
    """The model with varimax-rotated factors, by falling sum of squared loadings."""
    turned = rotate(model, varimax(model.loadings))
    order = np.argsort(-(turned.loadings ** 2).sum(axis=0), kind="stable")
    return replace(turned, loadings=turned.loadings[:, order], score_matrix=turned.score_matrix[:, order])


def name_by_content(model: FactorModel, target: np.ndarray) -> FactorModel:
    """Factors in the order (and with the signs) of the target's columns that they are most congruent with.

    With ``names[i]`` about column i of the target, position i of the result is the factor that
    goes by that name, wherever the fit had put it.
    """
    c = congruence(model.loadings, target)
    column = best_assignment(np.abs(c))
    at = np.argsort(column)  # the fitted factor of each target column
    signs = np.where(c[at, np.arange(len(at))] < 0, -1.0, 1.0)
    return replace(model, loadings=model.loadings[:, at] * signs, score_matrix=model.score_matrix[:, at] * signs)


def score_covariances(df: DataFrame, array_col: str, model: FactorModel) -> tuple[np.ndarray, np.ndarray, int]:
    """Covariances of the standardised items with the scores (p × k), means of the scores, and the row count.

    One pass over the rows.  In a fitted model item j and factor i covary by exactly loading (j, i),
    before and after an orthogonal rotation; other loadings or weights do not.
    """
    k = model.loadings.shape[1]
    scored = df.withColumn("_z", standardized(array_col, model))
    both = scored.select(array_to_vector(F.concat("_z", F.array(*[_dot(F.col("_z"), model.score_matrix[:, i]) for i in range(k)]))).alias("features"))
    mean, std, n, constant = moments(both)
    std[list(constant)] = 0.0
    cov = np.nan_to_num(correlation_matrix(both)) * std[:, None] * std[None, :]
    p = len(mean) - k
    return cov[:p, p:], mean[p:], n


def _dot(arr: Column, weights: np.ndarray) -> Column:
    w = F.array(*[F.lit(float(x)) for x in weights])
    return F.aggregate(F.zip_with(arr, w, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def standardized(array_col: str, model: FactorModel) -> Column:
    m = F.array(*[F.lit(float(x)) for x in model.mean])
    s = F.array(*[F.lit(float(x)) for x in model.std])
    return F.zip_with(F.zip_with(F.col(array_col).cast("array<double>"), m, lambda x, mu: x - mu), s,
                      lambda d, sd: d / sd)


def factor_scores(df: DataFrame, array_col: str, model: FactorModel, names: list[str]) -> DataFrame:
    """Posterior-mean factor scores per row (F4); names attached by position."""
    z = standardized(array_col, model)
    staged = df.withColumn("_z", z)
    return staged.withColumns({n: _dot(F.col("_z"), model.score_matrix[:, i]) for i, n in enumerate(names)}).drop("_z")


def loadings_table(spark, model: FactorModel, items: list[str], names: list[str]) -> DataFrame:
    """Long (question, factor, loading) table (F5) — a model artefact of p × k rows."""
    rows = [(items[j], names[i], float(model.loadings[j, i])) for i in range(len(names)) for j in range(len(items))]
    return spark.createDataFrame(rows, "question string, factor string, loading double")
