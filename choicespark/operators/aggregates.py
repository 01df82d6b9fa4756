"""Profile aggregates: value counts, describe, shares.

Counts and moments are single aggregates (partial aggregation map-side).  Exact quantiles
interpolate linearly between two order statistics, which are found without gathering a
column: a mergeable sketch brackets them, and only the values inside the brackets are counted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the quantile sketch: its ranks are right to one part in so many.
SKETCH = 10_000
#: Values of one bracket that are listed; a bracket that holds more is narrowed first.
LISTED = 200_000


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Count per distinct value (A1); nulls are a value of their own."""
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def exact_quantiles_of(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact linearly interpolated quantiles of numeric columns; nulls and NaN do not count, null without values.

    Three passes over ``df`` for any number of columns:

    1. one aggregate with a mergeable quantile sketch of every column brackets every position,
    2. one aggregate counts the values below and inside each bracket, which also proves the bracket,
    3. the values inside the brackets are counted one by one, summed up in order, and those at the
       wanted positions returned.

    A bracket holds about ``6 / SKETCH`` of a column's values.  Where that is more than ``LISTED``,
    the first two passes run again inside the brackets, for all such columns at once.
    """
    cols, probs = list(cols), list(probs)
    num = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in cols}
    xs = df.select(*[num[c].alias(f"x{i}") for i, c in enumerate(cols)])
    x = [F.col(f"x{i}") for i in range(len(cols))]
    # (column, probability) -> bracket, and how many values lie below and inside it
    ends = [0.0, *(q for p in probs for q in (max(0.0, p - 3 / SKETCH), min(1.0, p + 3 / SKETCH))), 1.0]
    got = xs.agg(*[F.count(c).alias(f"n{i}") for i, c in enumerate(x)],
                 *[F.percentile_approx(c, ends, SKETCH).alias(f"q{i}") for i, c in enumerate(x)]).first()
    n = [got[f"n{i}"] for i in range(len(cols))]
    bracket = {}
    for i in range(len(cols)):
        for j in range(len(probs)):
            if n[i]:
                q = got[f"q{i}"]
                wide = n[i] <= SKETCH  # few values: all of them
                bracket[i, j] = (q[0], q[-1]) if wide else (q[1 + 2 * j], q[2 + 2 * j])
    ranks = {(i, j): (int((n[i] - 1) * probs[j]), min(n[i] - 1, int((n[i] - 1) * probs[j]) + 1)) for i, j in bracket}

    def measured(these: dict) -> dict:
        """(values below, values inside) of every bracket, in one aggregate."""
        if not these:
            return {}
        row = xs.agg(*[F.count_if(x[i] < lo).alias(f"b{i}_{j}") for (i, j), (lo, _) in these.items()],
                     *[F.count_if(x[i].between(lo, hi)).alias(f"i{i}_{j}") for (i, j), (lo, hi) in these.items()]).first()
        return {(i, j): (row[f"b{i}_{j}"], row[f"i{i}_{j}"]) for i, j in these}

    size = measured(bracket)
    for key, (below, inside) in size.items():
        if not below <= ranks[key][0] <= ranks[key][1] < below + inside:  # a sketch that broke its promise
            bracket[key] = (got[f"q{key[0]}"][0], got[f"q{key[0]}"][-1])
            size[key] = (0, n[key[0]])
    while wide := {k: bracket[k] for k, (_, inside) in size.items() if inside > LISTED and bracket[k][0] < bracket[k][1]}:
        at = {k: [(r - size[k][0]) / size[k][1] for r in ranks[k]] for k in wide}
        row = xs.agg(*[F.percentile_approx(F.when(x[i].between(lo, hi), x[i]), [max(0.0, at[i, j][0] - 3 / SKETCH), min(1.0, at[i, j][1] + 3 / SKETCH)], SKETCH)
                       .alias(f"q{i}_{j}") for (i, j), (lo, hi) in wide.items()]).first()
        tried = {(i, j): tuple(row[f"q{i}_{j}"]) for i, j in wide}
        proven = measured(tried)
        held = {k for k, (below, inside) in proven.items() if below <= ranks[k][0] <= ranks[k][1] < below + inside and tried[k] != wide[k]}
        for k in held:
            bracket[k], size[k] = tried[k], proven[k]
        if not held:  # equal values only: they are one entry of the list
            break
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), x[i].alias("v"), F.lit(size[i, j][0]).alias("below"),
                                x[i].between(lo, hi).alias("inside")) for (i, j), (lo, hi) in bracket.items()]) if bracket else None
    found: dict[tuple[int, int, int], float] = {}
    if bracket:
        listed = xs.select(F.explode(F.filter(wanted, lambda s: s["inside"])).alias("s")).select("s.i", "s.j", "s.v", "s.below")
        counts = listed.groupBy("i", "j", "v", "below").agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("i", "j").orderBy("v")) + F.col("below")
        places = counts.withColumn("upto", upto).withColumn("from", F.col("upto") - F.col("n"))
        want = [(i, j, r) for (i, j), both in ranks.items() for r in sorted(set(both))]
        asked = df.sparkSession.createDataFrame(want, "i int, j int, r long")
        hit = places.join(F.broadcast(asked), ["i", "j"]).filter((F.col("r") >= F.col("from")) & (F.col("r") < F.col("upto")))
        found = {(r["i"], r["j"], r["r"]): r["v"] for r in hit.select("i", "j", "r", "v").collect()}
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(cols):
        out[c] = []
        for j, p in enumerate(probs):
            if not n[i]:
                out[c].append(None)
                continue
            a, b = (found[i, j, r] for r in ranks[i, j])
            at = (n[i] - 1) * p
            out[c].append(a if a == b else a + (b - a) * (at - int(at)))
    return out


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float]) -> list[float | None]:
    """Exact linearly interpolated quantiles of one column (see :func:`exact_quantiles_of`)."""
    return exact_quantiles_of(df, [col], probs)[col]


def describe(df: DataFrame, col: str) -> DataFrame:
    """count, mean, sample std, min, quartiles, max of one column (A2)."""
    c = F.col(col)
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"),
        *[F.lit(v).cast("double").alias(name) for v, name in zip(q, ("q25", "q50", "q75"))],
        F.max(c).alias("max"),
    )


def shares(counts: DataFrame, count_col: str = "count", by: list[str] | None = None) -> DataFrame:
    """Add ``share`` = count / total (within ``by`` groups) over an already-grouped, small table."""
    w = Window.partitionBy(*(by or []))
    return counts.withColumn("share", F.try_divide(F.col(count_col).cast("double"), F.sum(count_col).over(w)))
