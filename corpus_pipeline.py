"""The corpus pipeline: toxic documents out, exact and near copies out, benchmark leaks out, the rest packed.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``.  All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from choicespark.llm import decontaminate, exact_dedup, packing, simhash, toxicity
from choicespark.llm.queries import TOKENIZER, toxicity_model
from choicespark.llm.store import hidden, table
from choicespark.llm.tokenizing import public_path
from choicespark.session import ensure_checkpoint_dir

#: A document with this toxicity or more goes.
TOXIC = 0.5

#: The stages are a trained model, iterated links and packing rounds: SQL has no form of them.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    score = hidden("score")
    scored = toxicity.with_score(docs, toxicity_model(spark, docs, sf_dir), into=score)
    return scored.filter(scored[score] < TOXIC).drop(score)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def simhash_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, width=3, radius=3)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_path(TOKENIZER), with_ids=True)


STAGES = [
    ("toxicity", toxicity_filter),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_dedup", simhash_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's result is a Parquet table in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    top = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
