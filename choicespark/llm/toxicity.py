"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the buckets of its words, adjacent pairs and pairs with one word between
(presence, not counts), so a score does not depend on a text's length alone.  Per-coordinate
learning rates and L1 leave few weights other than zero; those are what workers receive, and their
number is at most ``2 ** bits``.

The fit reads a bounded, hash-chosen sample of labelled rows (about ``max_rows`` rows and ``max_bytes`` bytes of
text, parameters) in one task; scoring covers every whole text.

Defined cases: a null or empty text has no features and scores the intercept; null labels and
labels of unknown rows are ignored; a document labelled twice counts as toxic if any label says so;
without labels of both classes the model is the smoothed class share; repeated rows score alike;
extra columns pass through ``with_score`` untouched, and a name for the score that one of them has is refused; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark.llm.store import setting, text_of
from choicespark.llm.words import give_back, pair, word_blocks


#: Rows that a fitting task takes from the executor at once, and bytes of text whose features a worker holds at once.
BATCH, BLOCK = 500, 1 << 19


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.25  # times the root of the number of rows, as chance correlations grow
    l2: float = 1.0
    epochs: int = 3
    refit_epochs: int = 12
    refit_l2: float = 0.3
    min_docs: int = 5
    max_rows: int = 20_000
    max_bytes: int = 64 << 20


@dataclass(frozen=True)
class ToxicityModel:
    """Intercept and the weights other than zero, by ascending bucket."""

    bits: int
    intercept: float
    bucket: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)

    def plain(self) -> tuple:
        """What workers receive: numbers and arrays only."""
        return self.bits, self.intercept, self.bucket, self.weight


def _features(h: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word, pair and skip-pair of a block; pairs stay in their document."""
    n = len(h)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    down = np.uint64(64 - bits)
    parts = [(doc, (pair(h, h, 1) >> down))]
    for gap in (1, 2):
        if n > gap:
            same = doc[gap:] == doc[:-gap]
            parts.append((doc[gap:][same], (pair(h[:-gap], h[gap:], 1 + gap) >> down)[same]))
    return np.concatenate([d for d, _ in parts]), np.concatenate([b for _, b in parts]).astype(np.int64)


def _feature_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, at, h in word_blocks(batch.column("text"), BLOCK):
                doc, bucket = _features(h, at, bits)
                key = np.unique((doc.astype(np.int64) << bits) | bucket)
                cut = np.searchsorted(key, np.arange(j - i + 1, dtype=np.int64) << bits)
                low = (key & ((1 << bits) - 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label").slice(i, j - i), batch.column("pick").slice(i, j - i),
                     pa.array([low[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())],
                    names=["label", "pick", "features"])
        give_back()
    return run


def _ftrl(p: FtrlParams):
    """One pass per epoch over the bounded sample, in the order of the sampling hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            rows += zip(batch.column("pick").to_pylist(), batch.column("label").to_pylist(), batch.column("features").to_pylist())
        rows.sort(key=lambda r: (r[0], r[2]))
        seen = np.zeros(1 << p.bits, dtype=np.int32)
        for _, _, raw in rows:
            seen[np.frombuffer(raw, dtype=np.int32)] += 1
        kept = seen >= p.min_docs
        for k, (_, y, raw) in enumerate(rows):  # one by one, so that a text's bytes go when its features are chosen
            f = np.frombuffer(raw, dtype=np.int32)
            rows[k] = (y, f[kept[f]])
        batch = raw = f = None
        give_back()
        last = np.array([1 << p.bits], dtype=np.int64)

        def train(found: list, epochs: int, l1: float, l2: float) -> np.ndarray:
            z, n = np.zeros((1 << p.bits) + 1), np.zeros((1 << p.bits) + 1)

            def weights(i):
                zi = z[i]
                return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((p.beta + np.sqrt(n[i])) / p.alpha + l2))

            for _ in range(epochs):
                for y, f in found:
                    i = np.concatenate((f, last))
                    w = weights(i)
                    g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                    ni = n[i]
                    z[i] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
                    n[i] = ni + g * g
            return weights(np.arange(len(z)))

        chosen = train(rows, p.epochs, p.l1 * len(rows) ** 0.5, p.l2) != 0.0
        # L1 chooses the weights but also shrinks them: the few chosen ones are fitted again without it
        w = train([(y, f[chosen[f]]) for y, f in rows], p.refit_epochs, 0.0, p.refit_l2)
        keep = np.flatnonzero(w)
        del rows, seen, kept
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array(w[keep], pa.float64())], names=["bucket", "weight"])
    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, *, doc_id: str = "doc_id",
                 text: str = "text", label: str = "toxic", params: FtrlParams | None = None) -> ToxicityModel:
    """Fit on the labelled rows of ``docs`` where ``train`` holds (all of them when it is None).

    ``train`` is a condition on the documents' columns.  At most about ``params.max_rows`` rows with about
    ``params.max_bytes`` bytes are used: those with the smallest hash of the id.
    """
    p = params or FtrlParams()
    known = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label")))
    chosen = docs.filter(train) if train is not None else docs
    ids = chosen.select(F.col(doc_id).alias("id"), F.octet_length(text_of(text)).cast("long").alias("size")).join(known, "id")
    n, positive, size = ids.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = (positive + 1) / (n + 2)
    if positive in (0, n):
        return ToxicityModel(p.bits, float(np.log(share / (1 - share))), np.zeros(0, np.int64), np.zeros(0))
    pick = F.xxhash64(F.col("id"), F.lit(9))
    sample = known.withColumn("pick", pick)
    part = min(p.max_rows / n, p.max_bytes / max(1, size))
    if part < 1:
        sample = sample.filter((F.col("pick") / F.lit(2.0**64) + 0.5) < F.lit(part))
    rows = (chosen.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).join(sample, "id")
            .select("text", "label", "pick")
            .mapInArrow(_feature_rows(p.bits), "label int, pick long, features binary"))
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH):
        found = rows.repartition(1).mapInArrow(_ftrl(p), "bucket long, weight double").collect()
    top = 1 << p.bits
    body = sorted((r.bucket, r.weight) for r in found if r.bucket < top)
    return ToxicityModel(p.bits, sum(r.weight for r in found if r.bucket == top),
                         np.array([b for b, _ in body], dtype=np.int64), np.array([w for _, w in body], dtype=np.float64))


def score_texts(texts: pa.Array, bits: int, intercept: float, weights: np.ndarray) -> np.ndarray:
    """Scores of whole texts; ``weights`` has a number for every bucket."""
    out = np.full(len(texts), intercept)
    for i, j, at, h in word_blocks(texts, BLOCK):
        doc, bucket = _features(h, at, bits)
        hit = weights[bucket] != 0.0
        key = np.unique((doc[hit].astype(np.int64) << bits) | bucket[hit])
        np.add.at(out, i + (key >> bits), weights[key & ((1 << bits) - 1)])
    return 1.0 / (1.0 + np.exp(-np.clip(out, -700, 700)))


def with_score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 in column ``into``; the sparse weights are broadcast."""
    if into in docs.columns:
        raise ValueError(f"the documents have a column {into}")
    shared = docs.sparkSession.sparkContext.broadcast(model.plain())

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bits, intercept, bucket, weight = shared.value
        dense = np.zeros(1 << bits)
        dense[bucket] = weight
        for texts in parts:
            yield pa.array(score_texts(texts, bits, intercept, dense), pa.float64())
            give_back()

    return docs.withColumn(into, score(F.col(text)))
