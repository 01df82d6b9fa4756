"""Ranked lexical search over a pipeline of term owners.

Documents are dealt to shards of bounded size and the terms of the query items to owners: the rarest
terms to the first, the most common to the last (bands of the document frequency).  A bundle is a
group of items at one shard.  It carries, for each item, its terms and a sparse list of document
accumulators through the owners, one after the other: at each stage the bundles meet the owner's
postings of their shard in a cogroup, and every posting adds its integer contribution.  The best
documents of each item are selected after the last stage.

Contributions are integers and never negative, so between stages accumulators that cannot come into
the result any more are left out: an accumulator whose sum, with the greatest contributions that
the item's terms can still add, stays below the n-th best sum that the item already has in one
shard.  No document of the result is lost; equal sums are always kept.  As rare terms come first,
the common terms add to few accumulators.

The weight of a term with document frequency df among N documents with a term is
floor(1000 * ln((2N + 2) / (2 df + 1))); a document with n of all L terms has the length norm
m = 75 + (25 n N) div L; tf occurrences add weight * ((10^9 tf) div (1000 tf + 12 m)).

Memory: a task holds the postings and the accumulators of one bundle, both bounded by the shard
(``SHARD`` documents) and the bundle (``BUNDLE`` items).  Postings of a term that a third of all
documents hold are spread over all shards.

Defined cases: terms are runs of ASCII letters and digits and of all other characters beyond ASCII,
A-Z lower-cased, in whole texts; null texts have none; every row of the items is an item of its own,
also where ids repeat or are null, and so is every row of the documents; equal scores rank by id,
null ids last; items without a matching document have no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from choicespark.llm.store import BROADCAST_ROWS, join_counted, materialise, small
from choicespark.llm.words import give_back

#: Documents of a shard and items of a bundle.
SHARD, BUNDLE = 16384, 256
#: A term belongs to the first owner whose share of the documents (one in so many) it does not exceed, else to the last.
OWNERS = (256, 32, 4)
#: Bytes of a vocabulary that tasks get whole.
BROADCAST_BYTES = 1 << 23
#: Bytes of a text whose terms are listed at once.
BLOCK = 1 << 20

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_EDGE = re.compile(rb"[^0-9a-z\x80-\xff]")


def term_counts(data: bytes) -> tuple[int, Counter]:
    """Number of terms of a whole text, and the occurrences of each."""
    data, counts, n, i = data.lower(), Counter(), 0, 0
    while i < len(data):
        j = i + BLOCK
        if j < len(data):
            edge = _EDGE.search(data, j)
            j = edge.start() if edge else len(data)
        found = _TERM.findall(data, i, j)
        n += len(found)
        counts.update(found)
        i = max(j, i + 1)
    return n, counts


def _count_rows(wanted):
    """(id, text) in; per text with a term one row without a term, and one per term (of ``wanted``, if given)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if wanted is None else wanted.value
        schema = pa.schema([("nr", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("term", pa.binary()), ("tf", pa.int64())])
        nr, held, size = 0, [], 0
        def flush():
            many = np.array([len(h[3]) + 1 for h in held])
            own = [np.repeat(np.array([h[k] for h in held], dtype=np.int64), many) for k in (0, 2)]
            ids = pa.array([h[1] for h in held], pa.int64()).take(pa.array(np.repeat(np.arange(len(held)), many)))
            terms = [t for h in held for t in (None, *h[3])]
            tf = [c for h in held for c in (0, *h[3].values())]
            return pa.RecordBatch.from_arrays([pa.array(own[0]), ids, pa.array(own[1]), pa.array(terms, pa.binary()), pa.array(tf, pa.int64())], schema=schema)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
                n, counts = term_counts(text.as_py() or b"")
                nr += 1
                if n:
                    if keep is not None:
                        counts = {t: counts[t] for t in counts.keys() & keep}
                    held.append((nr, i, n, counts))
                    size += 1 + len(counts)
                    if size > 100_000:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()
        give_back()
    return run


def counted(docs: DataFrame, vocabulary: DataFrame | None, doc_id: str, text: str) -> DataFrame:
    """One read of the texts: (doc, id, n, term, tf), stored; ``doc`` numbers the rows, ``term`` null is the document itself."""
    wanted = None
    if vocabulary is not None:
        n, size = vocabulary.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
        if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:  # else all terms are counted, and those asked for are joined later
            wanted = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r[0]) for r in vocabulary.collect()))
    found = (docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
             .mapInArrow(_count_rows(wanted), "nr long, id long, n long, term binary, tf long"))
    doc = F.spark_partition_id().cast("long") * (1 << 40) + F.col("nr")
    rows = materialise(found.select(doc.alias("doc"), "id", "n", "term", "tf"), "term-counts")
    if wanted is not None:
        wanted.destroy()
    return rows


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate(parts), pa.int64()))


_NUMBERS = pa.list_(pa.int64())
_OWNED = pa.list_(pa.struct([("owner", pa.int32()), ("term", pa.int64()), ("times", pa.int64())]))
STATE = ("item long, bundle long, shard long, owned array<struct<owner:int,term:long,times:long>>, rest array<long>, "
         "floor long, docs array<long>, sums array<long>")


def _stage(owner: int, n: int):
    """Bundles of one shard meet the postings of an owner: sums grow, hopeless accumulators go."""
    def run(bundles: pa.Table, postings: pa.Table) -> pa.Table:
        types = pa.schema([*((c, pa.int64()) for c in ("item", "bundle", "shard")), ("owned", _OWNED), ("rest", _NUMBERS),
                           ("floor", pa.int64()), ("docs", _NUMBERS), ("sums", _NUMBERS)])
        if not bundles.num_rows:
            return types.empty_table()
        postings = postings.sort_by("term")
        term, value = postings.column("term").to_numpy(), postings.column("value").to_numpy()
        held = bundles.column("docs").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        docs, at = np.unique(np.concatenate((postings.column("doc").to_numpy(), held)), return_inverse=True)
        at, held_at = at[: len(term)], at[len(term) :]
        starts, firsts = np.unique(term, return_index=True)
        ends = dict(zip(starts.tolist(), zip(firsts.tolist(), [*firsts[1:].tolist(), len(term)])))
        sums = bundles.column("sums").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        size = np.concatenate(([0], np.cumsum(bundles.column("docs").combine_chunks().value_lengths().to_numpy(zero_copy_only=False))))
        out_docs, out_sums, out_floor = [], [], []
        for r, (owned, rest, floor) in enumerate(zip(*(bundles.column(c).to_pylist() for c in ("owned", "rest", "floor")))):
            total = np.zeros(len(docs), dtype=np.int64)
            total[held_at[size[r] : size[r + 1]]] = sums[size[r] : size[r + 1]]
            for t in owned:
                if t["owner"] == owner and t["term"] in ends:
                    a, b = ends[t["term"]]
                    total[at[a:b]] += t["times"] * value[a:b]
            alive = np.flatnonzero(total)
            if len(alive) >= n:
                floor = max(floor, int(np.partition(total[alive], len(alive) - n)[len(alive) - n]))
            alive = alive[total[alive] + rest[owner] >= floor]
            out_docs.append(docs[alive])
            out_sums.append(total[alive])
            out_floor.append(floor)
        done = {c: bundles.column(c) for c in ("item", "bundle", "shard", "owned", "rest")}
        give_back()
        return pa.table({**done, "floor": out_floor, "docs": _lists(out_docs), "sums": _lists(out_sums)}).cast(types)
    return run


def search(docs: DataFrame, items: DataFrame, n: int = 20, *, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", shard: int = SHARD, bundle: int = BUNDLE) -> DataFrame:
    """Per item its ``n`` best documents: item_id, rank (from 1), doc_id, score."""
    asked = counted(items, None, item_id, item_text).filter("term is not null").select(F.col("doc").alias("item"), F.col("id").alias("item_id"), "term", "tf")
    names = asked.select("item", "item_id").distinct()
    bundles = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-names.count() // bundle))))
    vocabulary = asked.groupBy("term").agg(F.collect_set(bundles).alias("bundles"))
    rows = counted(docs, vocabulary.select("term"), doc_id, text)

    facts = rows.filter("term is null").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n_docs, n_terms = facts["n"], max(1, facts["l"] or 0)
    m = F.lit(75) + F.expr(f"(25 * n * {n_docs}L) div {n_terms}L")
    impact = F.expr("(1000000000L * tf) div (1000 * tf + 12 * m)")
    hits = rows.filter("term is not null").withColumn("m", m).select("doc", "term", impact.alias("impact"))
    weight = F.floor(1000 * F.log(F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1)))
    owner = F.lit(len(OWNERS))
    for k, share in reversed(list(enumerate(OWNERS))):
        owner = F.when(F.col("df") * share <= n_docs, k).otherwise(owner)
    terms = hits.groupBy("term").agg(F.count("*").alias("df"), F.max("impact").alias("most")).join(vocabulary, "term", "left")
    terms = materialise(terms.select(F.col("term").alias("name"), "df", "bundles", owner.alias("owner"), weight.alias("weight"), "most",
                                     F.monotonically_increasing_id().alias("term")), "search-terms")

    n_shards = max(1, -(-n_docs // shard))
    named = terms.select(F.col("name").alias("term"), F.col("term").alias("number"), "df", "bundles", "owner", "weight")
    postings = join_counted(hits, named, ["term"], "df").filter("bundles is not null").select(
        "owner", F.pmod(F.xxhash64("doc"), F.lit(n_shards)).alias("shard"), F.explode("bundles").alias("bundle"),
        F.col("number").alias("term"), "doc", (F.col("weight") * F.col("impact")).alias("value"))
    postings = materialise(postings, "postings")

    last = len(OWNERS)
    each = asked.join(terms.select(F.col("name").alias("term"), F.col("term").alias("number"), "owner", (F.col("weight") * F.col("most")).alias("most")), "term")
    later = F.array(*[F.sum(F.when(F.col("owner") > k, F.col("tf") * F.col("most")).otherwise(0)) for k in range(last + 1)])
    state = each.groupBy("item").agg(F.collect_list(F.struct("owner", F.col("number").alias("term"), F.col("tf").alias("times"))).alias("owned"), later.alias("rest"))
    none = F.array().cast("array<long>")
    state = state.select("item", bundles.alias("bundle"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_shards - 1).cast("long"))).alias("shard"),
                         "owned", "rest", F.lit(0).cast("long").alias("floor"), none.alias("docs"), none.alias("sums"))
    for k in range(last + 1):
        met = state.groupBy("shard", "bundle").cogroup(postings.filter(F.col("owner") == k).groupBy("shard", "bundle"))
        state = materialise(met.applyInArrow(_stage(k, n), STATE), f"accumulators-{k}")
        floors = state.groupBy("item").agg(F.max("floor").alias("best"))  # the best floor of an item holds in all shards
        state = state.join(small(floors), "item").withColumn("floor", F.col("best")).drop("best")

    ids = rows.filter("term is null").select("doc", F.col("id").alias("doc_id"))
    found = state.select("item", "floor", F.explode(F.arrays_zip("docs", "sums")).alias("a")).select(
        "item", "floor", F.col("a.docs").alias("doc"), F.col("a.sums").alias("score")).filter("score >= floor")
    ranked = found.join(ids, "doc").withColumn("rank", F.row_number().over(
        Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc")))
    return ranked.filter(F.col("rank") <= n).join(small(names), "item").select("item_id", "rank", "doc_id", "score")
