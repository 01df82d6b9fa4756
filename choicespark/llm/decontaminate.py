"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

A document is contaminated by an item when one of its windows of as many words as the item (the
whole document when it is shorter) has a weighted Jaccard similarity of 0.8 or more with it, over
word shingles with their multiplicities (five words; all words of an item that has fewer).

Only DataFrame operations are used:

1. Every shingle of every whole text is looked up among the shingles of the benchmark.  A window
   that reaches the threshold holds at least that share of the item's shingles, so the windows to
   look at start at most the rest of them before such a hit; none is lost.
2. Each such window and each item gets a 64-bit SimHash over its shingles, the c-th occurrence of one
   hashed as a shingle of its own, so that repeated shingles weigh as they do in the similarity.  Fingerprints within ``radius`` bits agree
   on at least one of ``radius + 1`` blocks; a window and an item that has hit it are candidates when they agree
   on a block, and all within the radius are among them.
3. Candidates within the radius are verified by their exact weighted similarity.

Pairs at the threshold differ in about 10 of 64 bits (standard deviation 3), so the default radius of
24 leaves none out in practice; a smaller one trades that for fewer checks.

The benchmark is broadcast only after a count (:func:`small`); beyond that its shingles' hashes alone are,
up to ``PROBE_ROWS``, so that only the corpus's hits are shuffled; beyond that too, all its shingles are.  A shingle that very many documents share is looked up where the document is read, and each
window is grouped on its own, so a common passage makes many small groups.

Defined cases: null and empty texts, and items without words, match nothing; a repeated item id is
one item per distinct text and is reported once; rows that repeat id and text have one result, rows
that repeat an id only are told apart by their text; ties go to the earliest window; a null id is
reported as null; other columns pass through ``clean``; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark.llm.store import BROADCAST_ROWS, SPACE, hidden, materialise, small, text_of

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 24
#: Shingle hashes of a benchmark (8 bytes each) that are broadcast to leave other shingles out.
PROBE_ROWS = 4_000_000


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text_of(text)), f"[{SPACE}]+"), "")


def _at(words: str, pos: str, width: Column) -> Column:
    return F.xxhash64(F.slice(F.col(words), F.col(pos) + 1, width))


def _simhash(rows: DataFrame, keys: list[str], hash_col: str) -> DataFrame:
    """One 64-bit SimHash ``fp`` for each group: a bit is set when over half of the hashes set it.

    Two counters of 32 bits share each sum.
    """
    lanes = F.lit((1 << 32) | 1)
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n_sh"), *[
        F.sum(F.shiftrightunsigned(hash_col, b).bitwiseAND(lanes)).alias(f"s{b}") for b in range(32)])
    bits = []
    for b in range(32):
        low, high = F.col(f"s{b}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"s{b}", 32)
        top = 1 << (b + 32)
        bits += [F.when(2 * low > F.col("n_sh"), F.lit(1 << b)).otherwise(F.lit(0)),
                 F.when(2 * high > F.col("n_sh"), F.lit(top - (1 << 64) if top >> 63 else top)).otherwise(F.lit(0))]
    return sums.select(*keys, "n_sh", reduce(lambda x, y: x.bitwiseOR(y), [x.cast("long") for x in bits]).alias("fp"))


def _occurrences(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One hash ``sh`` for each occurrence of each shingle of a group; ``rows`` hold their counts ``c``."""
    each = rows.select(*keys, F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("i"), "sh")
    return each.select(*keys, F.when(F.col("i") == 1, F.col("sh")).otherwise(F.xxhash64("sh", "i")).alias("sh"))


def _blocks(rows: DataFrame, radius: int) -> DataFrame:
    """One row per block of the fingerprint: (block, value)."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    parts = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts[:-1], cuts[1:])]
    return rows.select("*", F.posexplode(F.array(*parts)).alias("block", "value"))


def benchmark_items(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = SHINGLE) -> DataFrame:
    """(item, key, w, size, k, n): the items' words, shingle width and number of shingles."""
    rows = items.select(F.col(item_id).alias("item"), _words(text).alias("w")).distinct().filter(F.size("w") > 0)
    return rows.select("item", F.xxhash64("w").alias("key"), "w", F.size("w").alias("size"),
                       F.least(F.lit(width), F.size("w")).alias("k")).withColumn("n", F.col("size") - F.col("k") + 1)


def contaminated(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", width: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """One row per (document, item) that match: doc_id, text_hash, item_id, similarity, start, n_words of the best window."""
    bench = materialise(benchmark_items(items, item_id, item_text, width), "items")
    shingled = bench.dropDuplicates(["key"]).select("key", "size", "k", "n", "w", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("p"))
    shingled = materialise(shingled.select("key", "size", "k", "n", _at("w", "p", F.col("k")).alias("sh")), "item-shingles")
    kinds = sorted(r.k for r in bench.select("k").distinct().collect())  # at most ``width`` numbers
    sized = shingled.select("k", "sh", "size", "n", "key").distinct()

    base = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text_of(text)).alias("th"), _words(text).alias("w"))
    hits = None
    for k in kinds:
        pos = (base.filter(F.size("w") >= k).select("doc", "th", "w", F.size("w").alias("len"), F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("p"))
               .select("doc", "th", "len", "p", _at("w", "p", F.lit(k)).alias("sh")))
        wanted = sized.filter(F.col("k") == k).drop("k")
        if wanted.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:  # other shingles of the corpus are left out before any shuffle
            pos = pos.join(small(wanted.select("sh").distinct(), PROBE_ROWS), "sh", "left_semi")
        found = pos.join(small(wanted), "sh").select("doc", "th", "len", "p", "size", "n", "key", F.lit(k).alias("k"))
        hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        hits = base.select("doc", "th", F.size("w").alias("len"), F.lit(0).alias("p"), F.lit(0).alias("size"), F.lit(0).alias("n"),
                           F.lit(0).cast("long").alias("key"), F.lit(0).alias("k")).limit(0)
    # a document's hits for one item are at most its own words; ``need`` of a window's shingles are hits,
    # so the others come before the first hit or after it (1 / 256 of room for rounding at the threshold)
    need = F.ceil(F.col("n") * F.lit(similarity) - F.lit(1 / 256)).cast("int")
    runs = (hits.groupBy("doc", "th", "len", "size", "n", "k", "key").agg(F.sort_array(F.collect_set("p")).alias("ps"))
            .withColumn("need", need).filter(F.size("ps") >= F.col("need")))
    first = runs.select("doc", "th", "len", "size", "n", "k", "key", "need", F.explode(F.transform("ps", lambda p, i: F.struct(
        p.alias("p"), F.when(i > 0, F.get("ps", i - 1)).alias("before"), F.get("ps", i + F.col("need") - 1).alias("last")))).alias("h"))
    first = first.filter(F.col("h.last") < F.col("h.p") + F.col("n"))
    low = F.greatest(F.lit(0), F.col("h.p") - (F.col("n") - F.col("need")), F.coalesce(F.col("h.before") + 1, F.lit(0)))
    starts = first.select("doc", "th", "len", "size", "k", "key", F.explode(F.sequence(low, F.col("h.p"))).alias("s"))
    fit = F.least(F.col("s"), F.greatest(F.lit(0), F.col("len") - F.col("size")))
    asked = materialise(starts.withColumn("s", fit).distinct(), "windows")  # windows, each with the items that hit it
    windows = asked.drop("key").distinct()

    own = windows.select("doc", "th").distinct()
    texts = base.join(small(own.select(F.col("doc").alias("d2"), F.col("th").alias("t2"))),
                      F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2")), "left_semi").dropDuplicates(["doc", "th"])
    cut = texts.select(F.col("doc").alias("d2"), F.col("th").alias("t2"), "w")
    within = windows.join(cut, F.col("doc").eqNullSafe(F.col("d2")) & (F.col("th") == F.col("t2"))).select("doc", "th", "len", "size", "k", "s", "w")
    end = F.least(F.col("s") + F.col("size"), F.col("len")) - F.col("k")
    rows = within.select("doc", "th", "size", "k", "s", "w", F.explode(F.sequence(F.col("s"), end)).alias("p"))
    win = ["doc", "th", "size", "s"]
    rows = materialise(rows.select(*win, _at("w", "p", F.col("k")).alias("sh")).groupBy(*win, "sh").agg(F.count("*").alias("c")), "window-shingles")

    windows_fp = _simhash(_occurrences(rows, win), win, "sh")
    counted = shingled.groupBy("key", "size", "sh").agg(F.count("*").alias("c"))
    items_fp = _simhash(_occurrences(counted, ["key", "size"]), ["key", "size"], "sh")
    same_window = reduce(lambda x, y: x & y, [F.col("doc").eqNullSafe(F.col("doc2")), *[F.col(c) == F.col(f"{c}2") for c in win[1:]]])
    pairs = asked.select("key", *[F.col(c).alias(f"{c}2") for c in win])
    fps = windows_fp.join(pairs, same_window).select(*win, "n_sh", "fp", "key")
    near = (_blocks(fps, radius).join(small(_blocks(items_fp.select("key", "size", "fp", F.col("n_sh").alias("n_item")), radius).withColumnRenamed("fp", "item_fp")),
                                      ["key", "size", "block", "value"])
            .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
            .select(*win, "key", "n_sh", "n_item").distinct())
    counts = shingled.groupBy("key", "sh").agg(F.count("*").alias("ci"))
    paired = near.join(rows.select(*[F.col(c).alias(f"{c}2") for c in win], "sh", "c"), same_window)
    both = (paired.join(small(counts), ["key", "sh"]).groupBy(*win, "key", "n_sh", "n_item")
            .agg(F.sum(F.least("c", "ci")).alias("o")))
    scored = both.withColumn("sim", F.col("o") / (F.col("n_sh") + F.col("n_item") - F.col("o"))).filter(F.col("sim") >= similarity)
    best = scored.groupBy("doc", "th", "key").agg(F.max(F.struct(F.col("sim"), (-F.col("s")).alias("s"), "size")).alias("b"))
    return (best.join(bench.select("key", "item").distinct(), "key").groupBy("doc", "th", "item").agg(F.max("b").alias("b"))
            .select(F.col("doc").alias("doc_id"), F.col("th").alias("text_hash"), F.col("item").alias("item_id"),
                    F.col("b.sim").alias("similarity"), (-F.col("b.s")).alias("start"), F.col("b.size").alias("n_words")))


def clean(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns."""
    i, t, a, b = (hidden(x) for x in ("id", "hash", "own", "text"))
    bad = materialise(contaminated(docs, items, doc_id=doc_id, text=text, **how), "contaminated")
    bad = bad.select(F.col("doc_id").alias(i), F.col("text_hash").alias(t)).distinct()
    own = docs.withColumn(a, F.col(doc_id)).withColumn(b, F.xxhash64(text_of(text)))
    return own.join(small(bad), F.col(a).eqNullSafe(F.col(i)) & (F.col(b) == F.col(t)), "left_anti").drop(a, b)
