"""Token counts: delta-maintained rollups by source, language and tokenizer version.

A change batch holds signed changes of documents: ``insert`` adds a count, ``delete`` takes it away,
``revise`` replaces an old count by a new one.  A batch is reduced to one delta per key before the
shuffle and written as one commit; totals are the sums of all commits, so no total is ever rewritten.

A commit is one Parquet folder named by its batch id, and it counts once its ``_SUCCESS`` marker is
there (the last thing the writer makes).  Committing an id again does nothing, and an attempt that
was cut off is replaced by the next one, so batches can be retried at any time.

Defined cases: null source, language or version form keys of their own; a null count adds 0; changes
without a known ``op`` raise; a batch may hold many changes of one document; keys whose documents and
tokens are all withdrawn stay with zeros; an empty batch is a commit without rows; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark.llm.store import WORD, hidden, text_of
from choicespark.llm.tokenizing import encoder
from choicespark.session import ensure_checkpoint_dir

KEY = ["source", "lang", "tokenizer"]
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def bpe_count(text: str, tokenizer: str) -> Column:
    """Number of ids of each whole text (null counts as empty) by a tokenizer file."""
    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        encode = encoder(tokenizer)
        return pa.array([len(encode(t.as_py() or "")) // 4 for t in texts], pa.int64())

    return count(F.col(text))


def word_count(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


class TokenRollup:
    """Commits of signed deltas below ``path`` (by default a new folder in the shared checkpoint folder)."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-rollup-{uuid.uuid4().hex}"

    def _folder(self, batch: str) -> str:
        return f"{self.path}/commit-{hashlib.sha256(batch.encode()).hexdigest()[:32]}"

    def _files(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def committed(self, batch: str) -> bool:
        fs, path = self._files()
        return fs.exists(path(f"{self._folder(batch)}/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes (op, source, lang, tokenizer, n_tokens, old_tokens); False if it was there already."""
        if self.committed(batch):
            return False
        op, new, old = F.col("op"), F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
        sign = (F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
                .otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null"))))))
        tokens = F.when(op == "insert", new).when(op == "delete", -new).otherwise(new - old)
        deltas = (changes.select(*KEY, sign.cast("long").alias("d"), tokens.cast("long").alias("t")).groupBy(*KEY)
                  .agg(F.sum("d").alias("n_docs"), F.sum("t").alias("n_tokens")))
        deltas.write.mode("overwrite").parquet(self._folder(batch))
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over every commit."""
        fs, path = self._files()
        done = [str(s.getPath().getParent()) for s in (fs.globStatus(path(f"{self.path}/commit-*/_SUCCESS")) or [])]
        rows = self.spark.read.schema(DELTA).parquet(*done) if done else self.spark.createDataFrame([], DELTA)
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def changes(counts: DataFrame, op: str, old: str | None = None) -> DataFrame:
    """Changes of one kind from rows (source, lang, tokenizer, n_tokens and, for a revision, the old count)."""
    return counts.select(F.lit(op).alias("op"), *KEY, F.col("n_tokens").cast("long").alias("n_tokens"),
                         (F.col(old) if old else F.lit(None)).cast("long").alias("old_tokens"))


def count_versions(docs: DataFrame, versions: dict[str, Column], *, guess: Column | None = None, doc_id: str = "doc_id", source: str = "source",
                   lang: str = "lang") -> DataFrame:
    """One row per document and tokenizer version: doc_id, source, lang, tokenizer, n_tokens and, if given, guess.

    ``guess`` is a provisional count of the same row; ids may be null or repeat, as nothing is joined.
    """
    each = hidden("each")
    more = [] if guess is None else [guess.cast("long").alias("guess")]
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("tokenizer"), v.alias("n_tokens"), *more) for k, v in versions.items()])).alias(each)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(lang).cast("string").alias("lang"), pairs).select(
        "doc_id", "source", "lang", f"{each}.tokenizer", f"{each}.n_tokens", *[f"{each}.guess" for _ in more])
