"""Line dedup: a join of deletion neighbourhoods, verified by edit distance; the earliest line stays.

A line goes when an equal line, or one within one edit (insertion, deletion or substitution of a
character), stands earlier: in a document with a smaller id, or further up in the same one; at one
number of rows that share an id, the text's hash tells which is earlier.  Lines
shorter than ``FUZZY`` characters count as equal only when they are identical; blank lines stay.

1. Lines are reduced to distinct ones (128 bits of hash) with their first place, their count and a number.
2. A line and a neighbour agree in one half, and in all but one quarter of it, so each distinct line gets a key
   for each half left out, and those whose keys another line shares one for each quarter left out.  Lines whose keys nobody
   shares have no neighbour and are done; this loses none, and it leaves few lines to the next step.
   These are numbered again in the order of their places, so "earlier" is a comparison of numbers.
3. The others emit their deletion neighbourhood as hashed keys: the line itself, the line without any
   one character, and that with the character's position.  Lines with equal positioned variants
   differ by a substitution there; a line that equals a variant of another lacks one character of it.
   Per key only the earliest line of either kind is needed, so equal variants are joined with one
   aggregate row and never as all pairs.  A variant is a key and two numbers.
4. Each (line, earliest partner) is verified by its edit distance.

Tables of a step are deleted when the next one is written.

Defined cases: null and empty texts have no lines; a line keeps its carriage return; a null id sorts
last; rows that share an id (null included) are told apart by a hash of their text, so each loses its
own lines only; a line is dropped only for an earlier place, so rows equal in id and text stay alike
(exact dedup is what removes those); other columns pass through ``clean_lines``; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark.llm.store import BROADCAST_ROWS, SPACE, hidden, join_counted, materialise, release, small, text_of

#: Characters from which on one edit counts as equal; parts of a line of which one may differ, in the first look and the second.
FUZZY, HALVES, PARTS = 10, 2, 4


def _text_hash(text: str) -> Column:
    return F.xxhash64(text_of(text))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(place, line) of every line that is not blank; a place is (no id, id, number, hash of the text)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), _text_hash(text).alias("th"),
                       F.posexplode(F.split(text_of(text), "\n", -1)).alias("line_no", "line"))
    place = F.struct(F.col("doc").isNull().alias("none"), F.col("doc").alias("doc"), F.col("line_no").alias("line_no"), F.col("th").alias("th"))
    return rows.select(place.alias("at"), "line").filter(F.col("line").rlike(f"[^{SPACE}]"))


def _id(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def _part_keys(parts: int) -> list[Column]:
    """For the line's length and one less, a key of the line without each of its parts."""
    keys = []
    for shorter in (0, 1):
        m = F.col("n") - shorter
        for j in range(parts):
            a, b = F.floor(m * j / parts).cast("int"), F.floor(m * (j + 1) / parts).cast("int")
            key = F.xxhash64(F.expr("''") if j == 0 else F.left("line", a), F.right("line", m - b) if j < parts - 1 else F.expr("''"), m, F.lit(j))
            keys.append(key.alias(f"k{len(keys)}"))
    return keys


def first_lines(lines: DataFrame) -> DataFrame:
    """One row per distinct line: h1, h2, n (characters), copies, first place and the keys of its halves."""
    rows = lines.withColumn("n", F.length("line")).select("at", "n", *_id(F.col("line")), *_part_keys(HALVES))
    keys = [f"k{i}" for i in range(2 * HALVES)]
    return rows.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("at").alias("at"), F.max("n").alias("n"), *[F.max(k).alias(k) for k in keys])


def _sharing(lines: DataFrame, parts: int) -> DataFrame:
    """The numbers ``nr`` of the lines with a key that another line has too."""
    keyed = lines.select("nr", F.explode(F.array(*[f"k{i}" for i in range(2 * parts)])).alias("k"))
    shared = keyed.groupBy("k").agg(F.min("nr").alias("a"), F.max("nr").alias("b")).filter("a < b").select("k")
    return keyed.join(shared, "k", "left_semi").select("nr").distinct()


def near_partners(lines: DataFrame, first: DataFrame) -> DataFrame:
    """(h1, h2, earlier): for distinct lines with an earlier neighbour, the earliest such neighbour's place."""
    long = first.filter(F.col("n") >= FUZZY)
    some = materialise(long.join(small(_sharing(long, HALVES)), "nr", "left_semi").select("nr", "h1", "h2", "at", "n"), "line-candidates")
    texts = lines.select("line", *_id(F.col("line"))).join(small(some.select("h1", "h2")), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"])
    texts = materialise(texts.join(some, ["h1", "h2"]), "candidate-texts")
    keyed = texts.select("nr", *_part_keys(PARTS))
    left = texts.join(small(_sharing(keyed, PARTS)), "nr", "left_semi").drop("nr")
    cand = materialise(left.orderBy("at", "h1", "h2").withColumn("nr", F.monotonically_increasing_id()), "candidate-lines")
    release(some, texts)

    gone = F.concat(F.expr("left(line, i)"), F.expr("substring(line, i + 2)"))
    variants = cand.select("nr", F.xxhash64(F.lit(0), "line").alias("own"), "line", F.explode(F.sequence(F.lit(-1), F.col("n") - 1)).alias("i"))
    variants = variants.select("nr", "i", "own", F.when(F.col("i") >= 0, F.xxhash64(F.lit(0), gone)).alias("cut"))
    own, longer, placed = (F.lit(k).cast("byte") for k in (0, 1, 2))
    key = F.when(F.col("i") < 0, F.array(F.struct(own.alias("kind"), F.col("own").alias("v")))).otherwise(
        F.array(F.struct(longer.alias("kind"), F.col("cut").alias("v")), F.struct(placed.alias("kind"), F.xxhash64(F.lit(1), "cut", "i").alias("v"))))
    emitted = materialise(variants.select("nr", F.inline(key)), "variants")
    of = lambda k: F.min(F.when(F.col("kind") == k, F.col("nr")))
    tops = emitted.groupBy("v").agg(F.count("*").alias("rows"), F.min("nr").alias("a"), F.max("nr").alias("b"), of(0).alias("self"), of(1).alias("longer"), of(2).alias("placed"))
    tops = materialise(tops.filter("a < b").drop("a", "b"), "variant-groups")  # one line may have a variant twice
    few = tops.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = emitted.join(F.broadcast(tops), "v") if few else join_counted(emitted, tops, ["v"], "rows")
    partner = F.when(F.col("kind") == 0, F.col("longer")).when(F.col("kind") == 1, F.col("self")).otherwise(F.col("placed"))
    pairs = materialise(met.select("nr", partner.alias("p")).filter("p < nr").distinct(), "line-pairs")
    release(emitted, tops)
    a = cand.select("nr", "h1", "h2", F.col("line").alias("a"), F.col("n").alias("an"))
    b = cand.select(F.col("nr").alias("p"), F.col("at").alias("pat"), F.col("line").alias("b"), F.col("n").alias("bn"))
    near = pairs.join(a, "nr").join(b, "p").filter((F.least("an", "bn") >= FUZZY) & (F.levenshtein("a", "b", 1) == 1))
    return near.groupBy("h1", "h2").agg(F.min("pat").alias("earlier"))


def _same(a: str, b: str) -> Column:
    """Whether two places have one id and number."""
    return F.col(f"{a}.doc").eqNullSafe(F.col(f"{b}.doc")) & (F.col(f"{a}.line_no") == F.col(f"{b}.line_no"))


def _gone(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(at, keep, first): the places of a line that goes, of the earliest equal or near line, and of the first equal one."""
    lines = _lines(docs, doc_id, text)
    first = materialise(first_lines(lines).withColumn("nr", F.monotonically_increasing_id()), "distinct-lines")
    near = materialise(near_partners(lines, first), "near-lines")
    due = first.select("h1", "h2", "copies", "at").join(near, ["h1", "h2"], "left").filter("copies > 1 or earlier is not null")
    due = materialise(due.withColumnRenamed("at", "first"), "lines-due")
    release(first, near)
    met = join_counted(lines.select("at", *_id(F.col("line"))), due, ["h1", "h2"], "copies")
    keep = F.least("first", "earlier")  # skips null
    return met.select("at", keep.alias("keep"), "first").filter("keep < at")


def dropped_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line that goes: doc_id, line_no, keep_doc_id, keep_line_no and edits (0 or 1).

    The place named is the earliest equal or near line's; it reads like the line's own where rows share an id.
    """
    # an equal line at the place named counts as kept, also beside a near one with a smaller hash
    equal = (F.col("keep") == F.col("first")) | (_same("keep", "first") & ~_same("keep", "at"))
    return _gone(docs, doc_id, text).select(
        F.col("at.doc").alias("doc_id"), F.col("at.line_no").alias("line_no"), F.col("keep.doc").alias("keep_doc_id"),
        F.col("keep.line_no").alias("keep_line_no"), F.when(equal, 0).otherwise(1).alias("edits"))


def clean_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts; a text without any is left as it is, null included."""
    gone = materialise(_gone(docs, doc_id, text).select("at.doc", "at.th", "at.line_no"), "dropped-lines")
    i, h, g = hidden("id"), hidden("hash"), hidden("gone")
    per = gone.groupBy(F.col("doc").alias(i), F.col("th").alias(h)).agg(F.collect_set("line_no").alias(g))  # at most a document's own lines
    left = F.filter(F.split(F.col(text), "\n", -1), lambda x, n: ~F.coalesce(F.array_contains(F.col(g), n), F.lit(False)))
    out = docs.join(small(per), F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & (_text_hash(text) == F.col(h)), "left")
    return out.withColumn(text, F.when(F.col(g).isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))).drop(i, h, g)
