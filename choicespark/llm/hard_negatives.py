"""Hard-negative mining with exact scores by the Four-Russians method.

Components are integers.  The dimensions are cut into groups of eight.  For a block of anchors, a
table per group holds the sums of all 256 subsets of an anchor's eight components.  Candidates are
stored as bit planes: byte (p, g) packs bit p of a candidate's eight components of group g.  So the
inner product is, over the planes, 2^p times the sum over the groups of the table entry that the
byte names; the plane of the sign counts negatively (two's complement).  Scores are exact integers.

Anchors and candidates are dealt to blocks by a hash of their row, and every block of anchors meets
every block of candidates in one task, whose memory the two block sizes bound.  A block passes on
at most the best ``n`` candidates of each of its anchors, so what is merged per anchor is small.  No
broadcast and no grouping by label: a label or a vector that holds a third of all rows is spread.

Two rounds: the best rows of the same label (positives), then, for every positive's score, the best
rows of other labels within its range (negatives).  A pair of rows is scored in one of the rounds.

Defined cases: rows with a null id, label or vector, or with a component that is null, not finite or
of 32,768 or more (the scores would leave 64 bits) take no part; rows that agree in id, label and
integer vector count once, other rows of one id are rows of their own (and each an anchor, if the
id is one); equal scores rank by id; a shorter vector is continued by zeros; an anchor without other rows of its label, or a
positive without negatives in range, gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark.llm.store import materialise
from choicespark.llm.words import give_back

#: Rows of a block of candidates and of a block of anchors.
CANDIDATES, ANCHORS = 8192, 16384
#: Anchors and candidates that are scored at once.
TILE, SLICE = 512, 512
SCALE = 256


def quantised(vector: Column) -> Column:
    """floor(256 * x) of every component, as int; null where the row takes no part."""
    fits = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < 32768.0, F.lit(False)))
    return F.when(fits, F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE).cast("int")))


def bit_planes(q: np.ndarray, planes: int) -> np.ndarray:
    """(planes, groups, rows) bytes of an integer matrix (rows, 8 * groups), lowest bit first, two's complement."""
    bits = (q[None, :, :] >> np.arange(planes, dtype=q.dtype)[:, None, None]) & 1
    return np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1))


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors) sums of all subsets of eight components of an integer matrix (anchors, 8 * groups)."""
    most = int(np.abs(anchors).sum(axis=1, dtype=np.int64).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    a = anchors.astype(kind)
    sums = np.zeros((a.shape[1] // 8, 256, len(a)), dtype=kind)
    for i in range(8):
        half = 1 << i
        sums[:, half : 2 * half] = sums[:, :half] + a[:, i::8].T[:, None, :]
    return sums


def table_scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(candidates, anchors) exact inner products by shift-add lookups."""
    n_planes, groups, rows = planes.shape
    out = np.zeros((rows, sums.shape[2]), dtype=np.int64 if sums.dtype != np.int16 or n_planes > 15 else np.int32)
    if not groups:
        return out
    plane, entry = np.empty((rows, sums.shape[2]), dtype=sums.dtype), np.empty((rows, sums.shape[2]), dtype=sums.dtype)
    for p in range(n_planes):
        np.take(sums[0], planes[p, 0], axis=0, out=plane, mode="clip")
        for g in range(1, groups):
            np.take(sums[g], planes[p, g], axis=0, out=entry, mode="clip")
            plane += entry
        shifted = plane.astype(out.dtype) << p
        out += -shifted if p == n_planes - 1 else shifted
    return out


def best(group: np.ndarray, score: np.ndarray, order: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` first entries of each group by falling score, then rising order."""
    by = np.lexsort((order, -score, group))
    g = group[by]
    first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.concatenate((first, [len(g)]))))
    return by[rank < n]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as a matrix of ``width`` columns; shorter rows end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    length = lists.value_lengths().to_numpy(zero_copy_only=False)
    values, out = lists.flatten().to_numpy(zero_copy_only=False), np.zeros((len(lists), width), dtype=np.int32)
    row = np.repeat(np.arange(len(lists)), length)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(length) - length, length)] = values
    return out


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _tiles(cand: pa.Table, anch: pa.Table, width: int, planes: int):
    """(candidate places, anchor places, scores) tile by tile; candidates are ordered by id and row."""
    packed = bit_planes(_matrix(cand.column("q"), width), planes)
    vectors = _matrix(anch.column("q"), width)

    def scored(c: np.ndarray, a: np.ndarray):
        for i in range(0, len(a), TILE):
            some = a[i : i + TILE]
            sums = subset_sums(vectors[some])
            for j in range(0, len(c), SLICE):
                part = c[j : j + SLICE]
                yield part, some, table_scores(sums, packed[:, :, part])

    return scored


def _positives(n: int, width: int, planes: int):
    """One block of candidates against one of anchors: the best ``n`` other rows of each anchor's label."""
    def run(cand: pa.Table, anch: pa.Table) -> pa.Table:
        cand = cand.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        row, own = _numbers(cand, "row"), _numbers(anch, "row")
        label, own_label = _numbers(cand, "label"), _numbers(anch, "label")
        scored, kept = _tiles(cand, anch, width, planes), [(np.zeros(0, np.int64),) * 3]
        floor = np.full(len(own), np.iinfo(np.int64).min)  # the n-th best so far
        for one in np.unique(own_label):
            for c, a, s in scored(np.flatnonzero(label == one), np.flatnonzero(own_label == one)):
                i, j = np.nonzero((s >= floor[a][None, :]) & (row[c][:, None] != own[a][None, :]))
                entries = a[j], s[i, j].astype(np.int64), c[i]
                top = best(*entries, n)
                entries = tuple(x[top] for x in entries)
                group, first, count = np.unique(entries[0], return_index=True, return_counts=True)
                full = count == n
                floor[group[full]] = np.maximum(floor[group[full]], entries[1][first[full] + n - 1])
                kept.append(entries)
        group, score, at = (np.concatenate(x) for x in zip(*kept))
        top = best(group, score, at, n)
        group, score, at = group[top], score[top], at[top]
        give_back()
        return pa.table({"row": own[group], "score": score, "vec_id": _numbers(cand, "vec_id")[at], "other": row[at]})
    return run


def _negatives(n: int, width: int, planes: int, low: int, high: int):
    """One block of candidates against one of anchors: the best ``n`` rows of other labels in each positive's range."""
    def run(cand: pa.Table, anch: pa.Table) -> pa.Table:
        cand = cand.sort_by([("vec_id", "ascending"), ("row", "ascending")])
        own, label, own_label = _numbers(anch, "row"), _numbers(cand, "label"), _numbers(anch, "label")
        wanted = anch.column("positive_scores").to_pylist()
        slots = max(map(len, wanted), default=0)
        want = np.zeros((slots, len(own)), dtype=np.int64)
        there = np.zeros((slots, len(own)), dtype=bool)
        for a, scores in enumerate(wanted):
            want[: len(scores), a] = scores
            there[: len(scores), a] = True
        # least score with low * want <= 100 * score, greatest with 100 * score <= high * want
        least = np.where(there, -((-low * want) // 100), np.iinfo(np.int64).max)
        most = np.where(there, (high * want) // 100, np.iinfo(np.int64).min)
        scored, kept = _tiles(cand, anch, width, planes), [(np.zeros(0, np.int64),) * 4]
        lo, hi = least.min(axis=0, initial=np.iinfo(np.int64).max), most.max(axis=0, initial=np.iinfo(np.int64).min)
        reach = np.flatnonzero(lo <= hi)
        for c, a, s in scored(np.arange(len(label)), reach):
            i, j = np.nonzero((s >= lo[a][None, :]) & (s <= hi[a][None, :]) & (label[c][:, None] != own_label[a][None, :]))
            group, score, at = a[j], s[i, j].astype(np.int64), c[i]
            for k in range(slots):
                fits = np.flatnonzero((score >= least[k][group]) & (score <= most[k][group]))
                top = fits[best(group[fits], score[fits], at[fits], n)]
                kept.append((group[top], score[top], at[top], np.full(len(top), k, dtype=np.int64)))
        group, score, at, slot = (np.concatenate(x) for x in zip(*kept))
        top = best(group * max(slots, 1) + slot, score, at, n)
        group, score, at, slot = group[top], score[top], at[top], slot[top]
        give_back()
        return pa.table({"row": own[group], "slot": slot, "score": score, "vec_id": _numbers(cand, "vec_id")[at],
                         "other": _numbers(cand, "row")[at]})
    return run


def hard_negatives(rows: DataFrame, anchor: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100,
                   candidates: int = CANDIDATES, anchors: int = ANCHORS) -> DataFrame:
    """Per anchor, positive and rank: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor`` is a condition on the id column.  Positives are the anchor's best rows of the same
    label; negatives the best rows of other labels with low * positive <= 100 * score <= high * positive.
    """
    taken = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
                        quantised(F.col(vector)).alias("q"), anchor.alias("is_anchor"))
    taken = taken.filter("vec_id is not null and label is not null and q is not null").distinct()
    taken = materialise(taken.withColumn("row", F.monotonically_increasing_id()), "vectors")
    facts = taken.agg(F.count("*").alias("n"), F.count(F.when(F.col("is_anchor"), 1)).alias("anchors"), F.max(F.size("q")).alias("width"),
                      F.max(F.array_max("q")).alias("top"), F.min(F.array_min("q")).alias("bottom")).first()
    width = -(-(facts["width"] or 0) // 8) * 8
    planes = 1 + max((facts["top"] or 0).bit_length(), (-1 - (facts["bottom"] or 0)).bit_length() if (facts["bottom"] or 0) < 0 else 0)
    n_cand, n_anch = max(1, -(-facts["n"] // candidates)), max(1, -(-facts["anchors"] // anchors))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    grid = lambda df, own, n_own, other, n_other: (
        df.withColumn(own, block(n_own)).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long")))))
    all_rows = grid(taken.select("row", "vec_id", "label", "q"), "c", n_cand, "a", n_anch).groupBy("c", "a")
    some = taken.filter("is_anchor").select("row", "vec_id", "label", "q").toDF("row", "vec_id", "label", "q")  # columns of its own

    found = all_rows.cogroup(grid(some, "a", n_anch, "c", n_cand).groupBy("c", "a")).applyInArrow(
        _positives(n_positives, width, planes), "row long, score long, vec_id long, other long")
    ranked = F.struct((-F.col("score")).alias("s"), F.col("vec_id").alias("v"), F.col("other").alias("o"))
    positives = materialise(found.groupBy("row").agg(F.slice(F.array_sort(F.collect_list(ranked)), 1, n_positives).alias("p"))
                            .select("row", F.transform("p", lambda p: p["v"]).alias("positive_ids"),
                                    F.transform("p", lambda p: -p["s"]).alias("positive_scores")), "positives")

    wanting = some.join(positives.select("row", "positive_scores"), "row").toDF("row", "vec_id", "label", "q", "positive_scores")
    found = all_rows.cogroup(grid(wanting, "a", n_anch, "c", n_cand).groupBy("c", "a")).applyInArrow(
        _negatives(n_negatives, width, planes, low, high), "row long, slot long, score long, vec_id long, other long")
    negatives = found.groupBy("row", "slot").agg(F.slice(F.array_sort(F.collect_list(ranked)), 1, n_negatives).alias("n"))
    named = some.select("row", F.col("vec_id").alias("anchor_id")).join(positives, "row")
    each = negatives.join(named, "row").select("anchor_id", "positive_ids", "positive_scores", "slot", F.posexplode("n").alias("at", "n"))
    at = (F.col("slot") + 1).cast("int")
    return each.select("anchor_id", F.element_at("positive_ids", at).alias("positive_id"), (F.col("at") + 1).alias("rank"),
                       F.col("n.v").alias("negative_id"), F.element_at("positive_scores", at).alias("positive_score"),
                       (-F.col("n.s")).alias("negative_score"))
