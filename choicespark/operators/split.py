"""Keyed shuffle and exact-count splits without a global sort.

The order is ``md5(seed|id)`` (then ``id``): a pure function of the row, so
the split does not depend on partitioning.  The exact cut ``int(n * ratio)``
is found without ranking all rows in one partition:

1. bucket rows by the first 16 bits of the hash; count per bucket
   (≤ 65,536 rows, a bounded statistic, broadcast back);
2. a running sum over the bucket counts gives each bucket's start position;
3. only rows in a bucket that *contains* a cut are ranked, inside that
   bucket; all other rows are assigned from their bucket's position range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from choicespark import config as cfg

N_BUCKETS_BITS = 16


def order_hash(id_col: str | Column, seed: int = cfg.SEED) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.concat_ws("|", F.lit(str(seed)), c.cast("string")))


def _with_buckets(df: DataFrame, id_col: str, seed: int, by: str | None = None) -> DataFrame:
    return (df.withColumn("_h", order_hash(by or id_col, seed))
            .withColumn("_b", F.conv(F.substring("_h", 1, N_BUCKETS_BITS // 4), 16, 10).cast("int")))


def _bucket_ranges(staged: DataFrame) -> DataFrame:
    counts = staged.groupBy("_b").agg(F.count(F.lit(1)).alias("_cnt"))
    # ≤ 65,536 rows: the running sum runs in one small task by design
    w = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("_b", "_cnt", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_before"),
                         F.sum("_cnt").over(Window.partitionBy()).alias("_n"))


def positional_parts(df: DataFrame, id_col: str, ratios: Sequence[float], names: Sequence[str],
                     seed: int = cfg.SEED, by: str | None = None) -> DataFrame:
    """Assign each row to a part by its position in the keyed order.

    ``ratios`` are cumulative cut points (e.g. ``[0.9]`` or ``[0.8, 0.9]``);
    part k holds positions in ``(int(n*r_{k-1}), int(n*r_k)]``.  Adds ``split``.
    Ids are unique.  Only the order keys are shuffled and ranked, to find the last key
    before each cut; the rows themselves are compared with those few keys in one narrow
    pass, whatever else they carry.

    With ``by`` (e.g. a persona id) the order hashes that key first, so a
    group's rows are contiguous: counts stay exact and at most one group per
    cut is shared between two parts.  (A group's rows share one hash bucket, so
    a very large group is ranked inside one task; without ``by`` rows are spread by
    their own unique ids.)
    """
    staged = _with_buckets(df, id_col, seed, by)
    order = ["_h", *([by] if by else []), id_col]
    # both uses below read this exchange: the window needs every key column in either
    ranked = staged.select("_b", *order).withColumn("_rn", F.row_number().over(Window.partitionBy("_b").orderBy(*order)))
    counts = ranked.groupBy("_b").agg(F.max("_rn").cast("bigint").alias("_cnt"))
    # ≤ 65,536 rows: the running sum runs in one small task by design
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    ranges = counts.select("_b", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_before"),
                           F.sum("_cnt").over(Window.partitionBy()).alias("_n"))
    at = ranked.join(F.broadcast(ranges), "_b", "left")  # every bucket has its range; an inner join would filter one side first
    pos = F.col("_before") + F.col("_rn")
    cuts = [F.floor(F.col("_n").cast("double") * F.lit(float(r))).cast("bigint") for r in ratios]
    last = at.agg(*[F.max(F.when(pos == c, F.struct(*order))).alias(f"_cut{k}") for k, c in enumerate(cuts)])

    key = F.struct(*order)
    part = F.lit(0)
    for k in range(len(cuts)):  # a cut at position 0 has no last key: every row is behind it
        part = part + F.when(F.col(f"_cut{k}").isNull() | (key > F.col(f"_cut{k}")), 1).otherwise(0)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), part + 1)
    return (staged.join(F.broadcast(last), how="inner").withColumn("split", label)
            .drop("_h", "_b", *[f"_cut{k}" for k in range(len(cuts))]))


def train_val_split(df: DataFrame, id_col: str = "id", train_ratio: float = cfg.TRAIN_RATIO,
                    seed: int = cfg.SEED, by: str | None = None) -> DataFrame:
    """Exact-count split: the first ``int(n * ratio)`` rows of the keyed order are train.

    The reference splits by sample, so one persona can appear on both sides;
    pass ``by="persona_id"`` to keep personas together (all but at most one).
    """
    return positional_parts(df, id_col, [train_ratio], ["train", "validation"], seed, by)


def three_way_split(df: DataFrame, id_col: str = "id", ratios: Sequence[float] = (0.8, 0.9),
                    seed: int = cfg.SEED) -> DataFrame:
    """8:1:1 split with two exact cuts."""
    return positional_parts(df, id_col, list(ratios), ["train", "validation", "test"], seed)


def keyed_shuffle(df: DataFrame, id_col: str = "id", seed: int = cfg.SEED) -> DataFrame:
    """Exact position of each row in the keyed shuffled order (W9), ranked per hash bucket."""
    staged = _with_buckets(df, id_col, seed)
    ranges = F.broadcast(_bucket_ranges(staged))
    j = staged.join(ranges, "_b", "inner")
    rank_w = Window.partitionBy("_b").orderBy("_h", id_col)
    return (j.withColumn("shuffle_pos", F.col("_before") + F.row_number().over(rank_w))
            .drop("_h", "_b", "_cnt", "_before", "_n"))
