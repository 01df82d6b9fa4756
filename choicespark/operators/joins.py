"""Key joins, miss reports and last-wins de-duplication.

The reference indexes records in dicts (``persona_dict.get(id)``); in Spark
these are equi-joins.  A dict rebuilt from records keeps the *last* record
per key, so de-duplicate with an explicit order before joining (N8), or the
join multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedupe_last(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                payload: Sequence[str] = ()) -> DataFrame:
    """Keep the last row per key by ``order_cols``.

    Implemented as ``groupBy(keys).agg(max(struct(order, payload)))`` rather
    than a ranking window: the aggregate is combined map-side, so a key with
    millions of copies still leaves each map task as one row.
    """
    payload = [c for c in payload if c not in order_cols]
    agg = df.groupBy(*keys).agg(
        F.max(F.struct(*order_cols, *payload)).alias("_last"),
        F.count(F.lit(1)).alias("n_copies"),
    )
    return agg.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in [*order_cols, *payload]], "n_copies")


def lookup(left: DataFrame, right: DataFrame, keys: Sequence[str] | str) -> tuple[DataFrame, DataFrame]:
    """(matched rows, left rows without a match) — J2's hits and its miss report."""
    return left.join(right, keys, "inner"), left.join(right, keys, "left_anti")


def join_inner_2key(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("persona_id", "country")) -> DataFrame:
    """Inner equi-join on two keys."""
    return left.join(right, list(keys), "inner")


def three_way(facts: DataFrame, first: DataFrame, first_key: str, second: DataFrame, second_key: str) -> DataFrame:
    """Two lookups in a row; a miss on either drops the row."""
    return facts.join(first, first_key, "inner").join(second, second_key, "inner")


#: Labels that ``label_lookup`` broadcasts; a longer table is joined as the planner sees fit.
MAX_LABELS = 100_000


def label_lookup(df: DataFrame, labels: DataFrame, key: str = "cluster") -> DataFrame:
    """Cluster id → label from a label table (J6), broadcast when it has at most ``MAX_LABELS`` rows."""
    few = labels.limit(MAX_LABELS + 1).count() <= MAX_LABELS
    return df.join(F.broadcast(labels) if few else labels, key, "left")
