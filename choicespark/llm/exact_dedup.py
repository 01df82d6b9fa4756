"""Exact dedup: a persistent digest index, bucketed and sorted by digest.

Two texts are equal when they are identical after deleting ASCII white space; the digest is the
SHA-256 of what is left.  The index is a table of one row per digest, stored as Parquet in hash
buckets sorted by digest, so new batches join it by sort-merge without moving it: a batch is first
reduced to one row per digest (counts combine before the shuffle), an anti-join with the index
leaves the digests that are new, and those are appended.

Digests are kept whole (32 bytes); the texts themselves are never shuffled.

Defined cases: a null text counts as empty, and empty and blank texts are equal to each other; of
equal texts in a batch the one with the most code points, then the smallest id (null last) stays,
and an older batch's row always stays before a newer one's; a batch number that the index holds is refused; rows that repeat id and text form one
group, of which ``keep_first`` leaves one row; other columns pass through; an empty batch changes
nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark.llm.store import SPACE, hidden, join_counted, materialise, small, text_of
from choicespark.session import ensure_checkpoint_dir

DIGEST = "digest binary, keep_id long, n_points int, n_rows long, batch long"


def text_digest(text: str):
    """SHA-256 (binary) of the text without ASCII white space."""
    return F.unhex(F.sha2(F.regexp_replace(text_of(text), f"[{SPACE}]+", "").cast("binary"), 256))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_points) of every row, materialised: texts are read once."""
    return materialise(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_digest(text).alias("digest"),
                                   F.length(text_of(text)).alias("n_points")), "digests")


def group_digests(rows: DataFrame) -> DataFrame:
    """One row per digest: the id that stays, its length, and the number of rows."""
    best = F.struct(F.col("n_points").alias("p"), F.col("doc_id").isNotNull().alias("k"), (-F.col("doc_id")).alias("i"))
    return (rows.groupBy("digest").agg(F.max(best).alias("b"), F.count("*").alias("n_rows"))
            .select("digest", (-F.col("b.i")).alias("keep_id"), F.col("b.p").alias("n_points"), "n_rows"))


class DigestIndex:
    """A bucketed table of digests under ``path``; a path that holds an index is opened with its own buckets.

    Each batch is one bucketed append of the same table, so a join on ``digest`` reads the index
    without an exchange.  The number of buckets is stored beside the data: asking for another one is an
    error, as rows would be looked for in the wrong buckets.  ``commit`` is for one writer at a time
    and takes every batch number once.  ``close`` forgets the session's name of the table, not the data.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/digest-index-{uuid.uuid4().hex}"
        note = f"{self.path.rstrip('/')}.buckets"
        at = spark._jvm.org.apache.hadoop.fs.Path(note)
        held = None
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            held = spark.read.json(note, schema="buckets int").first()["buckets"]
        if held and buckets and held != buckets:
            raise ValueError(f"the index has {held} buckets, not {buckets}")
        self.buckets = held or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if not held:
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.json(note)
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({DIGEST}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) "
                  f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name)

    def commit(self, groups: DataFrame, batch: int) -> DataFrame:
        """Append the digests of ``groups`` (one row each) that the index lacks; returns the appended rows."""
        if self.rows().filter(F.col("batch") == batch).limit(1).count():
            raise ValueError(f"the index holds batch {batch} already")
        fresh = (groups.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")
                 .select("digest", "keep_id", "n_points", "n_rows", F.lit(batch).cast("long").alias("batch")))
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)
        return self.rows().filter(F.col("batch") == batch)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: DigestIndex | None = None,
                 batch: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, digest, keep_id, n_rows and ``kept``, after committing it to ``index``.

    ``n_rows`` counts the rows of the batch that brought the digest.  A digest that an older batch
    brought keeps none of this batch's rows.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    rows = digests(docs, doc_id, text)
    groups = group_digests(rows) if own else materialise(group_digests(rows), "digest-groups")
    index.commit(groups, batch)
    known = index.rows().select("digest", "keep_id", "n_rows", (F.col("batch") == batch).alias("is_new"))
    if own:  # a new index holds this batch's counts
        known = known.withColumn("n", F.col("n_rows"))
        known = materialise(known, "known")
        index.close()
    else:  # hot digests are those of this batch, whatever the index counted when it first saw them
        known = materialise(groups.select("digest", F.col("n_rows").alias("n")).hint("merge").join(known.hint("merge"), "digest"), "known")
    seen = join_counted(rows, known, ["digest"], "n").drop("n")
    return seen.withColumn("kept", F.col("is_new") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).drop("is_new")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", index: DigestIndex | None = None,
               batch: int = 0) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: one for each digest that the index did not hold.

    Rows to drop are usually few, so the texts are filtered by an anti-join with them; only rows that
    repeat id and text are dealt out again, to leave one of each.
    """
    index = index or DigestIndex(docs.sparkSession)
    seen = materialise(exact_groups(docs, doc_id, text, index, batch), "groups")
    i, d = hidden("id"), hidden("digest")
    pick = seen.filter("kept").groupBy("doc_id", "digest").agg(F.count("*").alias("n"))
    drop = seen.filter(~F.col("kept")).select(F.col("doc_id").alias(i), F.col("digest").alias(d)).distinct()
    twice = pick.filter("n > 1").select(F.col("doc_id").alias(i), F.col("digest").alias(d))
    cond = F.col(hidden("a")).eqNullSafe(F.col(i)) & (F.col(hidden("b")) == F.col(d))
    own = docs.withColumn(hidden("a"), F.col(doc_id).cast("long")).withColumn(hidden("b"), text_digest(text))
    left = own.join(small(drop), cond, "left_anti")
    if twice.limit(1).count():
        left = left.join(twice, cond, "left_anti").unionByName(
            left.join(twice, cond, "left_semi").dropDuplicates([hidden("a"), hidden("b")]))
    return left.drop(hidden("a"), hidden("b"))
