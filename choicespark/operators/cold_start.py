"""Cold start: new rows scored by a stored factor model and stored cluster centres, without a refit.

The model is a few p × k matrices; it is stored as one small Parquet table of (part, i, j, x).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark import config as cfg
from choicespark.operators.clusters import nearest_centre
from choicespark.operators.factors import FactorModel, factor_scores


@dataclass(frozen=True)
class ColdStartModel:
    factors: FactorModel
    names: list[str]
    centres: list[np.ndarray]
    labels: dict[int, str] = field(default_factory=lambda: dict(cfg.TYPE_LABELS))


def save(spark: SparkSession, model: ColdStartModel, path: str) -> None:
    f = model.factors
    parts = {"loadings": f.loadings, "noise": f.noise[:, None], "score": f.score_matrix, "mean": f.mean[:, None], "std": f.std[:, None],
             "centres": np.array(model.centres), "constant": np.array(f.constant, dtype=float)[:, None],
             "fit": np.array([[f.log_likelihood, f.n_iter]])}
    rows = [(part, i, j, float(m[i, j]), None) for part, m in parts.items() for i in range(m.shape[0]) for j in range(m.shape[1])]
    rows += [("names", i, 0, None, n) for i, n in enumerate(model.names)] + [("labels", k, 0, None, v) for k, v in model.labels.items()]
    spark.createDataFrame(rows, "part string, i int, j int, x double, s string").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> ColdStartModel:
    rows = spark.read.parquet(path).collect()  # the model alone

    def matrix(part: str) -> np.ndarray:
        mine = [r for r in rows if r.part == part]
        out = np.zeros((max((r.i for r in mine), default=-1) + 1, max((r.j for r in mine), default=-1) + 1))
        for r in mine:
            out[r.i, r.j] = r.x
        return out

    fit = matrix("fit")[0]
    factors = FactorModel(matrix("loadings"), matrix("noise")[:, 0], matrix("score"), matrix("mean")[:, 0], matrix("std")[:, 0],
                          float(fit[0]), int(fit[1]), tuple(int(x) for x in matrix("constant").ravel()))
    names = [r.s for r in sorted((r for r in rows if r.part == "names"), key=lambda r: r.i)]
    return ColdStartModel(factors, names, list(matrix("centres")), {r.i: r.s for r in rows if r.part == "labels"})


def score(df: DataFrame, array_col: str, model: ColdStartModel) -> DataFrame:
    """``df`` with its factor scores, ``cluster`` (nearest stored centre) and ``type_label``."""
    out = factor_scores(df, array_col, model.factors, model.names)
    vec = F.array(*[F.col(n) for n in model.names])
    labels = F.create_map(*[F.lit(x) for kv in model.labels.items() for x in kv])
    out = out.withColumn("cluster", nearest_centre(vec, list(enumerate(model.centres))))
    return out.withColumn("type_label", F.try_element_at(labels, F.col("cluster")))
