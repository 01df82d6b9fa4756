"""Sharding by extendible hashing: only oversized buckets split on another bit of the hash.

A row's key is its id and text; the directory is indexed by the leading bits of the key's hash.  A
bucket above the byte limit is split on the next bit, the others are left as they are, until every
bucket fits.  Splitting needs no pass per bit: bytes are summed once for cells of a few bits more
than an even spread would need, every cell's leading bits are its ancestors in the directory, and a
cell belongs to its first ancestor that fits.  Cells that are still too large (hot keys, chance) go
on with the remaining bits, and then with the bits of a number of their own, which tells apart rows
that repeat id and text; so a hot key is split too.

Only DataFrame operations are used.  :func:`shard` reads texts once and never shuffles them.

Defined cases: a null text has 0 bytes; a row above the limit is a shard of its own, marked by its
size; null ids hash like an id of their own; rows that repeat an id are placed one by one; buckets
without rows are not listed; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicespark.llm.store import hidden, materialise, small, text_of

BITS = 60


def key_hash(doc_id: str, text: str):
    """The first 60 bits of the MD5 of the id, a colon and the text's MD5."""
    key = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(text_of(text).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def _step(rows: DataFrame, source: str, used: int, bits: int, limit: int, keep: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that fit after ``bits`` more bits of ``source``, with their shard; and the rows that do not."""
    cell = F.shiftright(source, BITS - used - bits).bitwiseAND(F.lit((1 << bits) - 1))
    rows = rows.withColumn("cell", cell)
    cells = materialise(rows.groupBy("path", "cell").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n")), "cells")
    depths = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("d")).withColumn("node", F.expr(f"shiftright(cell, {bits} - d)"))
    fits = (depths.groupBy("path", "d", "node").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
            .filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1)))
    leaf = depths.join(fits, ["path", "d", "node"]).groupBy("path", "cell").agg(F.min(F.struct("d", "node", "shard_bytes", "shard_rows")).alias("leaf"))
    leaf = materialise(leaf, "leaves")
    placed = rows.join(small(leaf), ["path", "cell"], "left")
    name = F.concat("path", F.when(F.col("leaf.d") > 0, F.lpad(F.bin("leaf.node"), F.col("leaf.d"), F.lit("0"))).otherwise(F.lit("")))
    done = placed.filter("leaf is not null").select("doc_id", "h", "n_bytes", name.alias("shard"), "leaf.shard_bytes", "leaf.shard_rows", *keep)
    path = F.concat("path", F.lpad(F.bin("cell"), F.lit(bits), F.lit("0")))
    return done, placed.filter("leaf is null").withColumn("path", path).drop("cell", "leaf")


def shard(docs: DataFrame, limit: int, *, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per row: doc_id, h (60-bit key hash), n_bytes, shard (its bits, empty for the root), shard_bytes, shard_rows.

    Columns in ``keep`` go along with their row.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), key_hash(doc_id, text).alias("h"), F.octet_length(text_of(text)).cast("long").alias("n_bytes"), *keep)
    own = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - BITS)
    rows = materialise(rows.withColumn("own", own), "keys").withColumn("path", F.lit(""))
    parts = []
    for source in ("h", "own"):
        used = 0
        while used < BITS:
            total = rows.agg(F.sum("n_bytes"), F.count("*")).first()
            if not total[1]:
                break
            bits = BITS - used if used else min(BITS, 4 + ceil(log2(max(1, total[0] / limit))))
            done, rows = _step(rows, source, used, bits, limit, keep)
            parts.append(done)
            rows = materialise(rows, "oversized")
            used += bits
    out = parts[0] if parts else rows.select("doc_id", "h", "n_bytes", F.lit("").alias("shard"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_rows"), *keep)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_shards(docs: DataFrame, path: str, limit: int, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write ``docs`` as one folder per shard below ``path``; returns the directory (shard, shard_bytes, shard_rows).

    Rows are stored with a number of their own first, so each is written to the very shard that
    :func:`shard` gave it, rows of a hot key too.  The folders' column must not be one of ``docs``.
    """
    if "shard" in (c.lower() for c in docs.columns):
        raise ValueError("a column named 'shard' would be overwritten by the folders' names: rename it first")
    n = hidden("row")
    rows = materialise(docs.withColumn(n, F.monotonically_increasing_id()), "numbered-rows")
    placed = materialise(shard(rows, limit, doc_id=doc_id, text=text, keep=[n]), "placed")
    dealt = rows.join(placed.select(n, "shard"), n).drop(n)
    dealt.repartition("shard").write.partitionBy("shard").mode("overwrite").parquet(path)
    return placed.groupBy("shard").agg(F.max("shard_bytes").alias("shard_bytes"), F.max("shard_rows").alias("shard_rows"))
