"""SimHash near-dedup: BK-trees over shards of the fingerprints.

Fingerprints of 64 bits come from the XXH64 (seed 42) of every word shingle of the whole text; a bit
is 1 when it is set in more than half of them.  Distinct fingerprints are cut into blocks of bits.
Two that differ in at most r bits agree on all but r of the blocks, so each fingerprint goes to one
shard per choice of the blocks that may agree.  A shard holds a BK-tree (children keyed by their
Hamming distance to the parent); its own members search it and follow only the edges whose key is
within r of their distance to the node.  Found links are merged to one star per local component
before they leave the task, and the stars' components are found by Spark joins.

The trees live in the tasks that hold their shards: a broadcast would carry the fingerprints of all
documents through the driver.  More blocks (and so smaller shards) are used for more fingerprints,
and a shard above ``SHARD`` fingerprints is cut into parts, each pair of parts being one task; both
find the same links.

Defined cases: null and empty texts have fingerprint 0, which links like any other; a text with
fewer words than a shingle is one shingle; equal fingerprints are one node; a null id is carried and
gets the component of its fingerprint (null when no document in it has an id); an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicespark.llm.components import components
from choicespark.llm.store import hidden, join_counted, materialise, small, text_of
from choicespark.llm.words import give_back

#: Fingerprints that one tree holds at most, unless a pair of parts is needed (twice as many then).
SHARD = 20_000


def fingerprint(text: bytes, width: int = 3) -> int:
    """The 64-bit SimHash of one whole text, as an unsigned integer."""
    words = text.lower().translate(_BLANK).split(b" ")
    words = [w for w in words if w]
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > width:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


_BLANK = bytes(0x20 if c in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) else c for c in range(256))


def with_fingerprint(docs: DataFrame, *, text: str = "text", width: int = 3, into: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary()) if not pa.types.is_large_string(texts.type) else texts.cast(pa.large_binary())
        out = np.array([fingerprint(t.as_py() or b"", width) for t in raw], dtype=np.uint64).view(np.int64)
        give_back()
        return pa.array(out, pa.int64())

    return docs.withColumn(into, fp(text_of(text)))


class BKTree:
    """A BK-tree of distinct 64-bit numbers, built and searched a whole level of members at a time."""

    __slots__ = ("at", "edges")

    def __init__(self, members: np.ndarray, fps: np.ndarray):
        self.at = int(members[0])
        rest = members[1:]
        if not len(rest):
            self.edges = {}
            return
        d = np.bitwise_count(fps[rest] ^ fps[self.at])
        self.edges = {int(k): BKTree(rest[d == k], fps) for k in np.unique(d)}

    def links(self, query: np.ndarray, fps: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(node, members within the radius of it) for every node that a query reaches."""
        todo = [(self, query)]
        while todo:
            node, q = todo.pop()
            d = np.bitwise_count(fps[q] ^ fps[node.at]).astype(np.int16)
            near = q[d <= radius]
            if len(near):
                yield node.at, near
            for k, child in node.edges.items():
                follow = q[np.abs(d - k) <= radius]
                if len(follow):
                    todo.append((child, follow))


def local_roots(fps: np.ndarray, radius: int) -> np.ndarray:
    """For each of the distinct fingerprints, the index of the smallest member of its component."""
    root = np.arange(len(fps))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    members = np.arange(len(fps))
    for at, near in BKTree(members, fps).links(members, fps, radius):
        if len(near) > 1:
            tops = {find(int(i)) for i in np.unique(root[near])} | {find(at)}
            low = min(tops)
            for t in tops:
                root[t] = low
            root[near] = low
    return np.array([find(int(i)) for i in members])


def _shard_links(radius: int):
    """Rows sorted by shard in, links (a, b) of each shard's components out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = None, []

        def out(parts: list[np.ndarray]) -> pa.RecordBatch | None:
            fps = np.unique(np.concatenate(parts))
            if len(fps) < 2:
                return None
            root = local_roots(fps.view(np.uint64), radius)
            i = np.flatnonzero(root != np.arange(len(fps)))
            return pa.RecordBatch.from_arrays([pa.array(fps[i]), pa.array(fps[root[i]])], names=["a", "b"]) if len(i) else None

        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "block", "part")])
            cut = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(fp)]))
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if a == b:
                    continue
                k = tuple(key[:, a].tolist())
                if k != held_key:
                    if held and (got := out(held)) is not None:
                        yield got
                    held_key, held = k, []
                held.append(fp[a:b])
        if held and (got := out(held)) is not None:
            yield got
        give_back()
    return run


def block_masks(radius: int, n: int) -> list[int]:
    """Bit masks, one per choice of blocks that may agree: few large blocks for small tables."""
    blocks = radius + (1 if n < 1 << 22 else 2 if n < 1 << 30 else 3)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:])]
    return [sum(c) for c in combinations(part, blocks - radius)]


def near_links(fps: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``fp`` whose bits differ in at most ``radius`` places."""
    masks = block_masks(radius, fps.count())
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    wide = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("choice", "block"))
    size = wide.groupBy("choice", "block").agg(F.count("*").alias("n")).filter("n > 1")
    size = materialise(size, "shards")
    busy = size.filter(F.col("n") > shard)
    plain = wide.join(size.filter(F.col("n") <= shard), ["choice", "block"]).select("choice", "block", F.lit(0).alias("part"), "fp")
    rows = plain
    if busy.limit(1).count():
        # at most (number of choices) * count / shard of them, so broadcast only when they are few
        parts = F.ceil(F.col("n") / F.lit(shard)).cast("int")
        cut = wide.join(small(busy), ["choice", "block"]).withColumn("k", parts).withColumn("own", F.pmod(F.xxhash64("fp"), "k").cast("int"))
        pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1),
                            lambda o: F.least(o, F.col("own")) * F.col("k") + F.greatest(o, F.col("own")))
        rows = rows.unionByName(cut.select("choice", "block", F.explode(pairs).alias("part"), "fp"))
    return (rows.repartition("choice", "block", "part").sortWithinPartitions("choice", "block", "part")
            .mapInArrow(_shard_links(radius), "a long, b long"))


def near_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """Per row: doc_id, fp (signed), component_id (the smallest id that links of ``radius`` bits reach) and root.

    ``root`` is the smallest fingerprint of the component; it tells components without any id apart.
    """
    rows = materialise(with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), width=width).select("doc_id", "fp"), "fps")
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct-fps")
    root = components(near_links(fps.select("fp"), radius)).withColumnRenamed("node", "fp")
    grouped = fps.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(grouped.join(ids, "root").select("fp", "root", "component_id", "n"), "named-fps")
    return join_counted(rows, named, ["fp"], "n").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of every component the one with the smallest id.

    Exactly one row is left for each component, also where rows repeat that id or no row has an id.
    """
    i = hidden("id")
    seen = materialise(near_groups(docs, doc_id=doc_id, text=text, width=width, radius=radius), "near-groups")
    ids = seen.groupBy("doc_id").agg(F.count("*").alias("n"), F.max((~F.col("doc_id").eqNullSafe(F.col("component_id"))).cast("int")).alias("gone"))
    odd = materialise(ids.filter("n > 1 or doc_id is null"), "odd-ids")  # repeated or absent ids
    drop = ids.filter("n = 1 and gone = 1 and doc_id is not null").select(F.col("doc_id").alias(i))
    own = docs.withColumn(hidden("own"), F.col(doc_id).cast("long"))
    same = F.col(hidden("own")).eqNullSafe(F.col(i))
    left = own.join(small(drop), F.col(hidden("own")) == F.col(i), "left_anti")
    odd_ids = odd.select(F.col("doc_id").alias(i))
    if odd.limit(1).count():
        f, k, r = hidden("fp"), hidden("k"), hidden("root")
        some = with_fingerprint(left.join(odd_ids, same, "left_semi"), text=text, width=width, into=f)
        stay = (seen.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
                .join(odd_ids, F.col("doc_id").eqNullSafe(F.col(i)), "left_semi")
                .select(F.col("doc_id").alias(i), F.col("fp").alias(k), F.col("root").alias(r)).distinct())
        picked = some.join(stay, same & (F.col(f) == F.col(k))).dropDuplicates([r]).drop(i, f, k, r)
        left = left.join(odd_ids, same, "left_anti").unionByName(picked)
    return left.drop(hidden("own"))
