"""Best-fit packing: hierarchical residual packing of token sequences.

A document is its token ids and one end id.  Longer ones than a sequence are cut from the end into
whole pieces, so only the first piece may be shorter; whole pieces are sequences of their own.  The
rest are packed in rounds: every partition packs its items best-fit by decreasing size, bins that
are nearly full are done, and the others move up as single items to a round on fewer partitions.
Sizes are integers below the sequence length, so a partition needs one stack of open bins per free
space, whatever the number of items.

Rounds stop when one partition has taken the last items, or when a round on several partitions
merges next to none (sizes that do not fit together at all would otherwise go round for ever); every
item keeps its place either way.  Each round's placements are a table in the shared checkpoint
folder, and an item's final place is found by joining them upwards and adding offsets.

Defined cases: a null or empty text is the end id alone (one piece of length 1); a null id is
carried; rows that repeat an id are separate documents; special-token strings in a text are read as
the tokenizer reads them by default; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from choicespark.llm.store import materialise, setting
from choicespark.llm.tokenizing import encoder
from choicespark.llm.words import give_back

#: Free tokens up to which a bin counts as full, and items that one partition of a round takes.
NEARLY, ITEMS = 4, 100_000
#: Rows that a cutting task takes from the executor at once, and tokens that it holds at most before it returns them.
BATCH, HELD = 500, 1 << 20


def token_pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", length: int = 1024,
                 end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Pieces of every whole text: item (a number for the row), doc_id, piece, start, length, ids_crc32 and, if asked, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        tail = np.array([end_id], dtype="<u4").tobytes()
        item = TaskContext.get().partitionId() << 34
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for key, value in zip(batch.column("doc_id"), batch.column("text")):
                ids = encode(value.as_py() or "") + tail
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % length + 1, n + 1, length)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                    part = ids[4 * a : 4 * b]
                    out.append((item, key.as_py(), k, a, b - a, zlib.crc32(part), *([np.frombuffer(part, dtype="<u4").astype(np.int32)] if with_ids else [])))
                    item += 1
                held += n * with_ids
                if len(out) >= 20_000 or held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            give_back()

    names = ["item", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
    schema = "item long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def best_fit(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of every item, and the fill of every bin."""
    of, at, fill = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64), []
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]  # by free space
    spaces = 0  # bit f is set when a bin with f free tokens is open
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = spaces >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = open_bins[free].pop()
            if not open_bins[free]:
                spaces &= ~(1 << free)
        else:
            free, b = length, len(fill)
            fill.append(0)
        of[i], at[i] = b, fill[b]
        fill[b] += size
        free -= size
        if free:
            open_bins[free].append(b)
            spaces |= 1 << free
    return of, at, np.array(fill, dtype=np.int64)


def _round(length: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (level << 56) | (TaskContext.get().partitionId() << 32)
        held, n, made = [], 0, 0

        def out(batch: pa.Table) -> tuple[pa.RecordBatch, int]:
            order = np.argsort(batch.column("item").to_numpy(), kind="stable")
            item, size = batch.column("item").to_numpy()[order], batch.column("length").to_numpy()[order]
            of, at, fill = best_fit(size, length)
            return pa.RecordBatch.from_arrays([pa.array(item), pa.array(base + made + of), pa.array(at), pa.array(fill[of])],
                                              names=["item", "bin", "offset", "fill"]), len(fill)

        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= 2 * ITEMS:  # a partition that got far more than its share works in bounded runs
                done, bins = out(pa.Table.from_batches(held))
                yield done
                held, n, made = [], 0, made + bins
        if n:
            yield out(pa.Table.from_batches(held))[0]
    return run


def pack(pieces: DataFrame, length: int = 1024, *, nearly: int = NEARLY, items: int = ITEMS) -> DataFrame:
    """(item, sequence_id, offset) for every row of ``pieces`` (item, length), which must be a stored table."""
    whole = pieces.filter(F.col("length") >= length).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = pieces.filter(F.col("length") < length).select("item", "length")
    levels, n, alone = [], todo.count(), False
    while n:
        if levels:  # the first round packs the partitions as they are stored
            parts = -(-n // items)
            alone = parts == 1
            todo = todo.repartition(1) if alone else todo.repartition(parts, F.xxhash64("item", F.lit(len(levels))))
        placed = todo.mapInArrow(_round(length, len(levels) + 1), "item long, bin long, offset long, fill long")
        placed = materialise(placed, "placed")
        levels.append(placed)
        left = placed.filter(F.col("fill") < length - nearly).groupBy("bin").agg(F.max("fill").alias("length"))
        todo = materialise(left.select(F.col("bin").alias("item"), "length"), "left")
        was, n = n, todo.count()
        if alone or (len(levels) > 1 and n > 0.999 * was):
            break
    if not levels:
        return whole
    # from the last round down: where each bin ended up
    end = levels[-1].select("item", F.col("bin").alias("sequence_id"), "offset")
    for placed in reversed(levels[:-1]):
        up = end.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("shift"))
        end = placed.join(up, "bin", "left").select("item", F.coalesce("sequence_id", "bin").alias("sequence_id"),
                                                    (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
    return whole.unionByName(end)


def pack_documents(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", length: int = 1024,
                   end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if asked, ids."""
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH):
        pieces = materialise(token_pieces(docs, tokenizer, doc_id=doc_id, text=text, length=length, end_id=end_id, with_ids=with_ids), "pieces")
    return pieces.join(pack(pieces, length), "item").drop("item")
