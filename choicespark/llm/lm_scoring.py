"""Language-model scoring with a log-frequency Bloom filter of quantised n-gram counts.

The model is an interpolated bigram model (Witten-Bell):

    p(w | v) = (c(v w) + t(v) p(w)) / (c(v) + t(v)),    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),

with v the word before (a start mark for the first), c counts and t the number of different words
seen after v.  Counts of bigrams and of followers are quantised to levels of a logarithmic scale,
and a level q is held as the q entries (n-gram, 1) .. (n-gram, q) of a Bloom filter: a reader probes
level after level and stops at the first miss.  A probe can be answered wrongly with a yes, never
with a no, so an n-gram that was seen is never lost.  Word counts are exact.

The first level decides whether an n-gram was seen at all.  A vocabulary of V words asks the filter
about V bigrams of each history, so its entries have ``FIRST_BITS`` bits and ``FIRST_PROBES`` probes (a
wrong yes in more than a million), the higher levels fewer.  Bigrams of unknown words are not asked for.  What
wrong answers are expected to add to a history's total is divided out:

    p(w | v) / (1 + f (V - t(v)) min(1, c(v)) / (c(v) + t(v))),    f: the measured share of wrong answers,

and c(v) stands for the sum of the quantised counts of v's bigrams, so the probabilities of all words
after a history add up to one but for single wrong answers.

Training counts every n-gram of every training text; nothing is pruned.  Tasks count their own part
first and deal sorted blocks of n-grams to shards, each of which adds them up and makes its own part
of the filter, so no task and no shard holds a hot n-gram more than once per block.  The parts are
broadcast when their measured size is at most ``max_broadcast`` bytes; a worker maps the broadcast's
file instead of holding a copy, and the broadcast is released when the scores are stored.  A task asks for a bigram once per
block of texts and for a history's followers once, and asks shard by shard.  Beyond that the filter
stays a table.  Texts are kept as blocks of word numbers (about two bytes a token), and a block's questions go as packed names, each distinct
word, history and bigram once, to the task that holds their shard; that answers by the same code with a byte or two a name, and
the answers meet their block again in the same order.  Shards are asked in ``ROUNDS`` rounds and blocks scored in as many, each of which
gives its shuffle files back before the next.  Scores are the same at every size.

Blocks name a history by 40 bits of its hash, and a bigram by its shard and 48 bits: an unseen bigram has the name of a seen one far more
rarely than it gets a wrong answer.

Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end mark.

Defined cases: null and empty texts are the end mark alone; an empty training set gives every token
the probability of an unseen one; a null id is carried; rows that repeat an id are scored one by
one (and counted one by one in training); an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark.llm.store import free_shuffles, materialise, release, setting, text_of
from choicespark.llm.words import CHUNK, give_back, mix, pair, word_blocks

START, END = 0x5441525453_5441, 0x444E455F_444E45
#: Base of the count levels; bits of filter and probes of a first level's entry, and of a higher level's.
BASE, FIRST_BITS, FIRST_PROBES, ENTRY_BITS, PROBES = 1.5, 30, 18, 16, 8
#: Rows and bytes that a task takes from the executor at once, and bytes of text that are scored at once.
BATCH, BATCH_BYTES = 1_000, 4 << 20
SCORE_CHUNK = 1 << 21
PIECE = 1 << 16  # names that the filter is asked for at once
#: Bytes of text that a shard stands for, tokens that a task counts at once, and the broadcast bound.
SHARD_BYTES, BLOCK, MAX_BROADCAST = 8 << 20, 1_000_000, 384 << 20
#: Rounds of questions and of scores when the filter is not broadcast, and rows of large binaries that a Parquet reader takes at once.
ROUNDS, READ_ROWS = 4, 16
SHORT = (1 << 48) - 1  # bits of a bigram's name within its shard
PAST = (1 << 40) - 1  # bits of a history's name
FOLLOWERS = 7  # salt of the key under which a word's number of followers is held


def level_of(count: np.ndarray) -> np.ndarray:
    """Level of a count: 1 for 1, and one more for each factor of ``BASE``."""
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(BASE) + 1e-9).astype(np.int64)


def _level_means() -> np.ndarray:
    """The mean of the whole numbers of each level (0 for level 0)."""
    edge = np.ceil(BASE ** np.arange(0, 110) - 1e-9)
    return np.concatenate(([0.0], (edge[:-1] + np.maximum(edge[1:] - 1, edge[:-1])) / 2))


def _below(h: np.ndarray, size) -> np.ndarray:
    """Numbers below ``size`` (less than 2^32) from the upper halves of hashes."""
    return (((h >> np.uint64(32)) * np.asarray(size, dtype=np.uint64)) >> np.uint64(32)).astype(np.int64)


def _entry(key: np.ndarray, level: int) -> np.ndarray:
    return mix(key + np.uint64(0x9E3779B97F4A7C15 * level & 0xFFFFFFFFFFFFFFFF))


def _stride(h: np.ndarray) -> np.ndarray:
    """How far apart the probes of an entry's hash are."""
    return mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)


def _probes(level: int) -> int:
    return FIRST_PROBES if level == 1 else PROBES


def make_filter(key: np.ndarray, level: np.ndarray) -> bytes:
    """Bits of a filter that holds the entries (key, 1) .. (key, level) of each key."""
    size = max(64, len(level) * FIRST_BITS + int((level - 1).sum()) * ENTRY_BITS)
    bits = np.zeros((size + 7) // 8 * 8, dtype=bool)
    q = 1
    while len(key):
        h = _entry(key, q)
        step = _stride(h)
        for _ in range(_probes(q)):
            bits[_below(h, len(bits))] = True
            h += step
        key, level = key[level > q], level[level > q]
        q += 1
    return np.packbits(bits, bitorder="little").tobytes()


def _blocks_of(texts: pa.Array, block: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: first, end, token bounds, each token and the token before it."""
    for i, j, at, h in word_blocks(texts, block):
        n = j - i
        bounds = at + np.arange(n + 1)
        token = np.empty(bounds[-1], dtype=np.uint64)
        ends = bounds[1:] - 1
        is_word = np.ones(len(token), dtype=bool)
        is_word[ends] = False
        token[is_word], token[ends] = h, END
        before = np.empty_like(token)
        before[1:] = token[:-1]
        before[bounds[:-1]] = START
        yield i, j, bounds, token, before


def _counts(shards: int):
    """Counted blocks of words and of bigrams of a task's texts, dealt to shards by hash."""
    def dealt(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        shard = _shard_of(key, shards)
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)).tolist():
            yield s, order[cut[s] : cut[s + 1]]

    def rows(token: np.ndarray, before: np.ndarray) -> Iterator[tuple]:
        word, n = np.unique(token, return_counts=True)
        for s, p in dealt(word):
            yield s, 0, word[p].tobytes(), b"", _small(n[p])
        key = pair(before, token)
        order = np.argsort(key, kind="stable")
        first = _firsts(key[order])
        n, one = np.diff(np.concatenate((first, [len(key)]))), order[first]
        del order, first
        # within a shard's block, each history stands once with its number of bigrams
        by = np.argsort(before[one], kind="stable")
        one, n = one[by], n[by]
        key, hist = key[one], before[one]
        for s, p in dealt(key):
            h, runs = np.unique(hist[p], return_counts=True)
            yield s, 1, _shorten(key[p]), np.int32(len(h)).tobytes() + _shorten(h, 5) + _small(runs), _small(n[p])

    def flush(token: np.ndarray, before: np.ndarray) -> Iterator[pa.RecordBatch]:
        for part in batched(rows(token, before), 32):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names=names)

    names, kinds = ["shard", "kind", "keys", "hist", "n"], [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, befores, held = [], [], 0
        for batch in batches:
            for _, _, _, token, before in _blocks_of(batch.column("text")):
                tokens.append(token)
                befores.append(before)
                held += len(token)
                if held >= BLOCK:
                    yield from flush(np.concatenate(tokens), np.concatenate(befores))
                    tokens, befores, held = [], [], 0
                    give_back()
        if held:
            yield from flush(np.concatenate(tokens), np.concatenate(befores))
        del tokens, befores
        give_back()
    return run


def _firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def _small(n: np.ndarray) -> bytes:
    """Counts as single bytes, and those above 254 after them."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n > 254].astype(np.int64).tobytes()


def _unsmall(raw: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(raw, dtype=np.uint8, count=size).astype(np.int64)
    n[n == 255] = np.frombuffer(raw[size:], dtype=np.int64)
    return n


def _halves(total: np.ndarray) -> bytes:
    """Sums of quantised counts, which are multiples of a half, as counts of halves."""
    return _small(np.rint(2 * total).astype(np.int64))


def _unhalves(raw: bytes, size: int) -> np.ndarray:
    return _unsmall(raw, size) / 2


def _shorten(key: np.ndarray, size: int = 6) -> bytes:
    """The lowest bytes of each key."""
    return np.ascontiguousarray(key).view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _lengthen(raw: bytes, size: int = 6) -> np.ndarray:
    out = np.zeros((len(raw) // size, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, size)
    return out.view(np.uint64).ravel()


def _histories(raw: bytes) -> np.ndarray:
    m = int(np.frombuffer(raw, np.int32, count=1)[0])
    return np.repeat(_lengthen(raw[4 : 4 + 5 * m], 5), _unsmall(raw[4 + 5 * m :], m))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard's blocks added up, shard after shard: words, the filter part of the bigrams, and each history's
    followers and sum of quantised counts."""
    means = _level_means()

    def out(s: int, blocks: list) -> Iterator[pa.RecordBatch]:
        words = [b for b in blocks if b[0] == 0]
        if words:
            key, at = np.unique(np.concatenate([np.frombuffer(b[1], np.uint64) for b in words]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([_unsmall(b[3], len(b[1]) // 8) for b in words])).astype(np.int64)
            yield row(s, "word", key.tobytes(), _small(n))
        grams = [b for b in blocks if b[0] == 1]
        if grams:
            key = np.concatenate([_lengthen(b[1]) for b in grams])
            order = np.argsort(key, kind="stable")
            key = key[order]
            first = _firsts(key)
            n = np.concatenate([_unsmall(b[3], len(b[1]) // 6) for b in grams])[order]
            level = level_of(np.add.reduceat(n, first))
            hist = np.concatenate([_histories(b[2]) for b in grams])[order[first]]
            del order, n
            bits = make_filter(key[first], level)
            filled = np.bitwise_count(np.frombuffer(bits, np.uint8)).sum() / (8 * len(bits))
            yield row(s, "bits", bits, b"", float(filled) ** FIRST_PROBES)
            hist, at, followers = np.unique(hist, return_inverse=True, return_counts=True)
            yield row(s, "follow", _shorten(hist, 5), _small(followers), 0.0, _halves(np.bincount(at, weights=means[level])))

    def row(s: int, kind: str, keys: bytes, n: bytes, wrong: float = 0.0, sums: bytes = b"") -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([kind]), pa.array([keys], pa.binary()), pa.array([n], pa.binary()),
                                           pa.array([sums], pa.binary()), pa.array([wrong])], names=["shard", "kind", "keys", "n", "sums", "wrong"])

    for s, blocks in _by_shard(batches, ["kind", "keys", "hist", "n"]):
        yield from out(s, blocks)
        del blocks
    give_back()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, n in zip(*[batch.column(c).to_pylist() for c in ("keys", "n")]):
            key = np.frombuffer(keys, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(_unsmall(n, len(key)))], names=["key", "n"])


def _unpack_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, sums in zip(*[batch.column(c).to_pylist() for c in ("keys", "sums")]):
            key = np.frombuffer(keys, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(_unhalves(sums, len(key)))], names=["key", "total"])


@dataclass
class BigramModel:
    """Stored tables and sizes: exact word counts, the filter's parts (shard, kind, keys: bits) and the histories' sums.

    ``wrong`` is the measured chance of a wrong first-level answer.
    """

    counts: DataFrame
    histories: DataFrame
    filter: DataFrame
    shards: int
    n_tokens: int
    n_words: int
    filter_bytes: int
    wrong: float

    def words(self) -> DataFrame:
        """(key, n) of every word."""
        return self.counts.filter("kind = 'word'").select("keys", "n").mapInArrow(_unpack, "key long, n long")

    def totals(self) -> DataFrame:
        """(key, total): of every history, the sum of its bigrams' quantised counts."""
        return self.histories.filter("kind = 'sums'").select("keys", F.col("n").alias("sums")).mapInArrow(_unpack_sums, "key long, total double")

    def bytes_to_broadcast(self) -> int:
        return self.filter_bytes + 20 * self.n_words  # a word is a key, a count and a total


def fit_bigrams(docs: DataFrame, train: Column | None = None, *, text: str = "text") -> BigramModel:
    """Count every token and bigram of the rows of ``docs`` where ``train`` holds (all when None)."""
    chosen = (docs.filter(train) if train is not None else docs).select(text_of(text).alias("text"))
    size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    blocks = chosen.mapInArrow(_counts(shards), "shard int, kind int, keys binary, hist binary, n binary")
    with _small_batches(docs.sparkSession):
        counts = materialise(blocks.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(
            _merge, "shard int, kind string, keys binary, n binary, sums binary, wrong double"), "lm-counts")
    free_shuffles(docs.sparkSession)  # the counted blocks are several times as large as what was made of them
    # a history's bigrams lie in many shards: its followers and sums are added up over them, dealt anew by history
    parts = counts.filter("kind = 'follow'").select("keys", "n", "sums").mapInArrow(_deal_followers(shards), "shard int, keys binary, n binary, sums binary")
    histories = materialise(parts.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(
        _add_followers, "shard int, kind string, keys binary, n binary"), "lm-histories")
    made = counts.filter("kind = 'bits'").select("shard", F.lit(0).alias("salt"), F.col("keys").alias("bits")).unionByName(
        histories.filter("kind = 'bits'").select("shard", F.lit(FOLLOWERS).alias("salt"), F.col("keys").alias("bits")))
    total = counts.filter("kind = 'word'").select("keys", "n").mapInArrow(_sums, "n long, words long").agg(F.sum("n"), F.sum("words")).first()
    wrong = counts.filter("kind = 'bits'").agg(F.sum("wrong")).first()[0] or 0.0  # shards without bigrams answer nothing
    filter_bytes = made.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    return BigramModel(counts, histories, made, shards, total[0] or 0, total[1] or 0, filter_bytes, wrong / shards)


@contextmanager
def _small_batches(spark) -> Iterator[None]:
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", BATCH), setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        yield


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = [_unsmall(x, len(k) // 8) for k, x in zip(batch.column("keys").to_pylist(), batch.column("n").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([int(x.sum()) for x in n]), pa.array([len(x) for x in n])], names=["n", "words"])


def _shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    return _below(mix(key), shards)


def _deal_followers(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n, sums in zip(*[batch.column(c).to_pylist() for c in ("keys", "n", "sums")]):
                key = _lengthen(keys, 5)
                n, total = _unsmall(n, len(key)), _unhalves(sums, len(key))
                shard = _shard_of(key, shards)
                order = np.argsort(shard, kind="stable")
                cut = np.searchsorted(shard[order], np.arange(shards + 1))
                which = np.flatnonzero(np.diff(cut)).tolist()
                parts = [order[cut[s] : cut[s + 1]] for s in which]
                yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), *[pa.array([f(p) for p in parts], pa.binary()) for f in (
                    lambda p: _shorten(key[p], 5), lambda p: _small(n[p]), lambda p: _halves(total[p]))]], names=["shard", "keys", "n", "sums"])
    return run


def _by_shard(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[tuple]]]:
    held, at = [], None
    for batch in batches:
        for s, *row in zip(*[batch.column(c).to_pylist() for c in ["shard", *columns]]):
            if s != at:
                if held:
                    yield at, held
                held, at = [], s
            held.append(row)
    if held:
        yield at, held


def _add_followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per shard: the filter part of the histories' numbers of followers, and the histories with their sums."""
    for s, rows in _by_shard(batches, ["keys", "n", "sums"]):
        key, at = np.unique(np.concatenate([_lengthen(k, 5) for k, _, _ in rows]), return_inverse=True)
        n = np.bincount(at, weights=np.concatenate([_unsmall(x, len(k) // 5) for k, x, _ in rows])).astype(np.int64)
        total = np.bincount(at, weights=np.concatenate([_unhalves(t, len(k) // 5) for k, _, t in rows]))
        bits = make_filter(_named(key, FOLLOWERS), level_of(n))
        yield pa.RecordBatch.from_arrays([pa.array([s, s], pa.int32()), pa.array(["bits", "sums"]), pa.array([bits, key.tobytes()], pa.binary()),
                                          pa.array([b"", _halves(total)], pa.binary())], names=["shard", "kind", "keys", "n"])


def _named(key: np.ndarray, salt: int) -> np.ndarray:
    """The name under which the filter holds a bigram (salt 0), or a word's number of followers."""
    return key & np.uint64(SHORT) if not salt else mix(key + np.uint64(salt))


class LogFrequencyFilter:
    """The filter's parts side by side; parts are (shard, bits)."""

    def __init__(self, shards: int, bits: np.ndarray, size: np.ndarray):
        self.shards, self.bits, self.size = shards, bits, size * 8
        self.first = np.cumsum(self.size) - self.size

    @staticmethod
    def join(shards: int, parts: dict[int, bytes]) -> LogFrequencyFilter:
        size = np.array([len(parts.get(s, b"")) for s in range(shards)], dtype=np.int64)
        return LogFrequencyFilter(shards, np.frombuffer(b"".join(parts.get(s, b"") for s in range(shards)), dtype=np.uint8), size)

    def level(self, key: np.ndarray, salt: int = 0) -> np.ndarray:
        """The level of each key: how many levels in a row the filter holds."""
        return self.probe(_shard_of(key, self.shards), _named(key, salt))

    def probe(self, shard: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The level of each name in its shard's part.

        Names are asked shard by shard and ``PIECE`` at once, so that probes that follow each other lie near each other in memory.
        """
        out = np.zeros(len(key), dtype=np.int64)
        todo, q = np.flatnonzero(self.size[shard]), 1
        todo = todo[np.argsort(shard[todo].astype(np.uint16 if self.shards <= 1 << 16 else np.int64), kind="stable")]
        key, first, size = key[todo], *(x[shard[todo]].astype(np.uint64) for x in (self.first, self.size))
        while len(todo):
            pieces = [slice(a, a + PIECE) for a in range(0, len(todo), PIECE)]
            yes = np.concatenate([self._holds(key[x], q, first[x], size[x]) for x in pieces])
            todo, key, first, size = (x[yes] for x in (todo, key, first, size))
            out[todo] = q
            q += 1
        return out

    def _holds(self, key: np.ndarray, q: int, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the filter holds each name at a level; most of those that it does not hold leave at the first probe."""
        h = _entry(key, q)
        yes = self._bit(h, first, size).astype(bool)
        h, first, size = h[yes], first[yes], size[yes]
        step, rest = _stride(h), np.ones(len(h), dtype=np.uint8)
        for _ in range(_probes(q) - 1):
            h += step
            rest &= self._bit(h, first, size)
        yes[yes] = rest
        return yes

    def _bit(self, h: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The bit at each hash's place, 0 or 1."""
        at = h >> np.uint64(32)  # as in _below, in place
        at *= size
        at >>= np.uint64(32)
        at += first
        within = at.astype(np.uint8) & 7
        at >>= np.uint64(3)
        return self.bits.take(at.view(np.int64)) >> within & 1


def _share(filt_wrong: float, n_words: int):
    """What wrong answers add to the total of a history with summed count c and t followers."""
    return lambda c, t: filt_wrong * np.maximum(n_words - t, 0) * np.minimum(1, c) / np.maximum(c + t, 1e-300)


def _score_block(token, before, bounds, known, count, total, asked, grams: LogFrequencyFilter, follow: LogFrequencyFilter, n_tokens: int, wrong: float, means: np.ndarray):
    """Per text of a block: tokens, known tokens, base score and score.

    ``asked`` keeps the level of each known word's (last: the start mark's) followers once it was asked for; it is -1 before.
    """
    word, where = np.unique(token, return_inverse=True)
    at = np.searchsorted(known, word)
    found = np.flatnonzero(at < len(known))
    found = found[known[at[found]] == word[found]]
    at = at[found]
    hists = np.append(word, np.array([START], dtype=np.uint64))
    c, c_hist, t_hist = np.zeros(len(word)), np.zeros(len(hists)), np.zeros(len(hists))
    c[found], c_hist[found], c_hist[-1] = count[at], total[at], total[-1]  # after the words' totals comes the start mark's
    p = (c + 0.1) / (n_tokens + 0.1 * (len(known) + 1))
    seen, at = np.append(found, len(word)), np.append(at, len(known))
    seen, at = seen[c_hist[seen] > 0], at[c_hist[seen] > 0]
    new = asked[at] < 0
    asked[at[new]] = follow.level(hists[seen[new]] & np.uint64(PAST), FOLLOWERS)
    t_hist[seen] = np.minimum(means[asked[at]], c_hist[seen])
    hist = np.empty_like(where)
    hist[1:] = where[:-1]
    hist[bounds[:-1]] = len(word)
    cv = c_hist[hist]
    cg = np.zeros(len(token))
    ask = np.flatnonzero((cv > 0) & (c[where] > 0))  # a bigram of an unknown word was not seen
    gram, at = np.unique(pair(before[ask], token[ask]), return_inverse=True)
    cg[ask] = means[grams.level(gram)][at]
    return _text_scores(bounds, where, c, p, cv, t_hist[hist], cg, wrong, len(known))


def _text_scores(bounds, where, c, p, cv, tv, cg, wrong: float, n_words: int):
    """Per text: tokens, known tokens, base score and score.

    ``c`` and ``p`` are counts and probabilities of a block's words, ``where`` each token's word; the others are of each
    token: summed count and followers of its history, and the count of its bigram.
    """
    pw, cg = p[where], np.minimum(cg, cv)
    smooth = np.where(cv > 0, (cg + tv * pw) / np.maximum(cv + tv, 1e-300) / (1 + _share(wrong, n_words)(cv, tv)), pw)
    first = bounds[:-1]
    return (np.diff(bounds), np.add.reduceat((c[where] > 0).astype(np.int64), first),
            np.add.reduceat(np.log10(p)[where], first), np.add.reduceat(np.log10(smooth), first))


SCORES = ["n_tokens", "n_known", "base_score", "score"]
#: The broadcast begins with this mark, by which a worker finds it in the broadcast's file.
_MARK = b"lm-filter-parts:"


def _packed_model(model: BigramModel) -> tuple[bytearray, tuple]:
    """All that scoring needs in one run of bytes, filled part by part, and where its arrays are."""
    n_words, shards = model.n_words, model.shards
    key, count, total = np.zeros(n_words, np.uint64), np.zeros(n_words, np.int64), np.zeros(n_words + 1)
    at = 0
    for r in model.counts.filter("kind = 'word'").select("keys", "n").toLocalIterator():
        k = np.frombuffer(bytes(r["keys"]), np.uint64)
        key[at : at + len(k)], count[at : at + len(k)] = k, _unsmall(bytes(r.n), len(k))
        at += len(k)
    order = np.argsort(key)
    key, count = key[order], count[order]
    del order
    name = key & np.uint64(PAST)
    order = np.argsort(name)
    name = name[order]
    for r in model.histories.filter("kind = 'sums'").select("keys", "n").toLocalIterator():
        k = np.frombuffer(bytes(r["keys"]), np.uint64)
        v = _unhalves(bytes(r.n), len(k))
        if n_words:
            i = np.minimum(np.searchsorted(name, k), n_words - 1)
            total[order[i[name[i] == k]]] = v[name[i] == k]
        total[n_words:] += v[k == np.uint64(START & PAST)].sum()
    del name, order
    if count.max(initial=0) < 1 << 31:
        count = count.astype(np.int32)
    tables = [key, count, total]
    size = {salt: np.zeros(shards, dtype=np.int64) for salt in (0, FOLLOWERS)}
    for r in model.filter.select("shard", "salt", F.octet_length("bits").alias("n")).collect():  # two short rows a shard
        size[r.salt][r.shard] = r.n
    heads = [*tables, size[0], size[FOLLOWERS]]
    start = len(_MARK) + sum(x.nbytes for x in heads)
    out = bytearray(start + sum(int(x.sum()) for x in size.values()))
    out[: len(_MARK)] = _MARK
    at = len(_MARK)
    for x in heads:
        out[at : at + x.nbytes] = x.tobytes()
        at += x.nbytes
    first = {0: start, FOLLOWERS: start + int(size[0].sum())}
    where = {salt: first[salt] + np.cumsum(n) - n for salt, n in size.items()}
    for r in model.filter.toLocalIterator():
        a = int(where[r.salt][r.shard])
        out[a : a + len(r.bits)] = r.bits
    return out, tuple((str(x.dtype), len(x)) for x in heads)


def _mapped(shared) -> np.ndarray:
    """The broadcast's bytes: its file, mapped, where the worker has one, else a copy."""
    path = getattr(shared, "_path", None)
    if path and os.path.isfile(path):
        with open(path, "rb") as f:
            at = f.read(256).find(_MARK)
        if at >= 0:
            return np.memmap(path, dtype=np.uint8, mode="r", offset=at).view(np.ndarray)
    return np.frombuffer(shared.value, dtype=np.uint8)


def _read_model(data: np.ndarray, heads: tuple, shards: int):
    """(words, counts, totals, filter of bigrams, filter of followers) of the packed bytes; only the small tables are copied."""
    at, tables = len(_MARK), []
    for kind, n in heads:
        size = np.dtype(kind).itemsize * n
        tables.append(np.frombuffer(bytes(data[at : at + size]), dtype=kind))
        at += size
    *words, grams, follow = tables
    cut = at + int(grams.sum())
    return (*words, LogFrequencyFilter(shards, data[at:cut], grams), LogFrequencyFilter(shards, data[cut : cut + int(follow.sum())], follow))


def _score_by_broadcast(docs: DataFrame, model: BigramModel) -> DataFrame:
    spark = docs.sparkSession
    free_shuffles(spark)  # the counts' blocks are on the executors' disks, where the broadcast goes
    packed, heads = _packed_model(model)
    shared = spark.sparkContext.broadcast(packed)
    del packed
    n_tokens, shards, wrong = model.n_tokens, model.shards, model.wrong

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        known, count, total, grams, follow = _read_model(_mapped(shared), heads, shards)
        means, asked = _level_means(), np.full(len(total), -1, dtype=np.int16)
        for batch in batches:
            for i, j, bounds, token, before in _blocks_of(batch.column("text"), SCORE_CHUNK):
                got = _score_block(token, before, bounds, known, count, total, asked, grams, follow, n_tokens, wrong, means)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *map(pa.array, got)], names=["doc_id", *SCORES])
        del known, count, total, asked, grams, follow
        give_back()

    with _small_batches(spark):
        scores = materialise(docs.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double"), "lm-scores")
    shared.destroy()
    return scores


def _kept(block: int):
    """Texts as blocks of at least ``block`` tokens: ids, tokens of each text, word hashes, and each token's word, the most frequent first."""
    def row(name: int, ids: list, sizes: list, tokens: list) -> pa.RecordBatch:
        word, where, n = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(word), dtype=np.uint32)
        place[order] = np.arange(len(word), dtype=np.uint32)
        planes = place[where].view(np.uint8).reshape(-1, 4).T  # the higher bytes are mostly 0
        ids = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([
            pa.array([name], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            *[pa.array([x], pa.binary()) for x in (np.concatenate(sizes).tobytes(), word[order].tobytes(), pa.compress(planes.tobytes(), "zstd", asbytes=True))],
        ], names=["block", "ids", "sizes", "words", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = TaskContext.get().partitionId() << 32, ([], [], [])
        for batch in batches:
            for i, j, bounds, token, _ in _blocks_of(batch.column("text")):
                for x, new in zip(held, (batch.column("doc_id").slice(i, j - i), np.diff(bounds), token)):
                    x.append(new)
                if sum(map(len, held[2])) >= block:
                    yield row(name, *held)
                    name, held = name + 1, ([], [], [])
                    give_back()
        if held[2]:
            yield row(name, *held)
        del held
        give_back()
    return run


#: What a shard's task gets, in this order: parts of the filter, the shard's words and histories; questions by them.
GRAM_BITS, FOLLOW_BITS, WORDS, SUMS, ASK_GRAM, ASK_WORD, ASK_HISTORY = range(7)
#: Bytes of a name in a question.
NAME = {ASK_GRAM: 6, ASK_WORD: 8, ASK_HISTORY: 5}


class _Block:
    """A kept block: its words and histories, each token's of both, and its distinct bigrams."""

    def __init__(self, sizes: bytes, words: bytes, at: bytes):
        size = np.frombuffer(sizes, np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(size)))
        n = int(self.bounds[-1])
        self.words = np.frombuffer(words, np.uint64)
        self.hists = np.append(self.words, np.array([START], dtype=np.uint64))
        planes = np.frombuffer(pa.decompress(at, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
        self.where = np.ascontiguousarray(planes.T).view(np.uint32).ravel().astype(np.int64)
        self.hist = np.empty_like(self.where)
        self.hist[1:] = self.where[:-1]
        self.hist[self.bounds[:-1]] = len(self.words)

    def code(self) -> np.ndarray:
        """A number of each token's bigram."""
        return self.hist * len(self.words) + self.where

    def codes(self) -> np.ndarray:
        """The numbers of the distinct bigrams, sorted."""
        code = np.sort(self.code())  # np.unique hashes, which takes forty times as long here
        return code[_firsts(code)]

    def keys(self, kind: int, code: np.ndarray | None = None) -> np.ndarray:
        """What is asked of a kind; bigrams by their distinct numbers."""
        if kind == ASK_WORD:
            return self.words
        if kind == ASK_HISTORY:
            return self.hists & np.uint64(PAST)
        return pair(self.hists[code // len(self.words)], self.words[code % len(self.words)])


def _dealt(key: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which keys are dealt, shard by shard, and their shards in it."""
    shard = _shard_of(key, shards)
    order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
    return order, shard[order]


def _asked(shards: int, low: int, high: int):
    """A block's questions to the shards from ``low`` to below ``high``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, *kept in zip(*[batch.column(c).to_pylist() for c in ("block", "sizes", "words", "at")]):
                block = _Block(*kept)
                for kind, size in NAME.items():
                    key = block.keys(kind, block.codes() if kind == ASK_GRAM else None)
                    order, shard = _dealt(key, shards)
                    cut = np.searchsorted(shard, np.arange(low, high + 1))
                    which = np.flatnonzero(np.diff(cut))
                    keys = [_shorten(key[order[cut[s] : cut[s + 1]]], size) for s in which.tolist()]
                    none, n = pa.nulls(len(which), pa.binary()), len(which)
                    yield pa.RecordBatch.from_arrays([pa.array(low + which, pa.int32()), pa.array([kind] * n, pa.int32()), pa.array([name] * n, pa.int64()),
                                                      pa.array(keys, pa.binary()), none], names=["shard", "kind", "block", "keys", "n"])
                del block, key, order, shard, keys
            give_back()
    return run


def _look_up(key: np.ndarray, among: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of each key that is among some sorted ones, else 0."""
    out = np.zeros(len(key), dtype=value.dtype)
    if len(among):
        at = np.minimum(np.searchsorted(among, key), len(among) - 1)
        yes = among[at] == key
        out[yes] = value[at[yes]]
    return out


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to each shard's questions, name for name: levels of bigrams, counts of words, sums and levels of histories."""
    none = np.zeros(0, np.uint64)

    def answers(kind: int, name: np.ndarray, part: dict) -> tuple:
        def level(bits: int, salt: int) -> np.ndarray:
            filt = LogFrequencyFilter.join(1, {0: part.get(bits, b"")})  # a shard without a part holds nothing
            return filt.probe(np.zeros(len(name), dtype=np.int64), _named(name, salt)).astype(np.uint8)
        if kind == ASK_GRAM:
            return level(GRAM_BITS, 0), None
        if kind == ASK_WORD:
            return _look_up(name, *part.get(WORDS, (none, none.astype(np.int64)))), None
        return _look_up(name, *part.get(SUMS, (none, none.astype(np.float64)))), level(FOLLOW_BITS, FOLLOWERS)

    def flush(shard: int, kind: int, part: dict, held: list) -> pa.RecordBatch:
        size = NAME[kind]
        value, level = answers(kind, _lengthen(b"".join(k for _, k in held), size), part)
        edge = np.cumsum([0] + [len(k) // size for _, k in held]).tolist()
        pack = {ASK_GRAM: np.ndarray.tobytes, ASK_WORD: _small, ASK_HISTORY: _halves}[kind]
        cols = [[pack(value[a:b]) for a, b in zip(edge, edge[1:])], [None if level is None else level[a:b].tobytes() for a, b in zip(edge, edge[1:])]]
        n = len(held)
        return pa.RecordBatch.from_arrays([pa.array([b for b, _ in held], pa.int64()), pa.array([kind] * n, pa.int32()), pa.array([shard] * n, pa.int32()),
                                           *[pa.array(c, pa.binary()) for c in cols]], names=["block", "kind", "shard", "value", "level"])

    at, part, asks, held, names = None, {}, None, [], 0
    for batch in batches:
        for shard, kind, block, keys, n in zip(*[batch.column(c).to_pylist() for c in ("shard", "kind", "block", "keys", "n")]):
            if held and ((shard, kind) != (at, asks) or names >= PIECE):
                yield flush(at, asks, part, held)
                held, names = [], 0
            if shard != at:
                at, part = shard, {}
            if kind == WORDS:
                key = np.frombuffer(keys, np.uint64)
                part[kind] = key, _unsmall(n, len(key))
            elif kind == SUMS:
                key = np.frombuffer(keys, np.uint64)
                part[kind] = key, _unhalves(n, len(key))
            elif kind in NAME:
                asks = kind
                held.append((block, keys))
                names += len(keys) // NAME[kind]
            else:
                part[kind] = keys
    if held:
        yield flush(at, asks, part, held)
    del part, held
    give_back()


def _scored(shards: int, n_tokens: int, n_words: int, wrong: float):
    """Scores of the texts of each block, whose answers come after it by kind and shard."""
    means = _level_means()

    def scores(ids: pa.Array, kept: tuple, answers: dict) -> pa.RecordBatch:
        block = _Block(*kept)
        code, gram = np.unique(block.code(), return_inverse=True)

        def back(kind: int, read, column: int = 0) -> np.ndarray:
            """The answers' values in the order of the keys that were asked."""
            order, shard = _dealt(block.keys(kind, code), shards)
            size = np.diff(np.append(_firsts(shard), len(shard))).tolist()
            out = np.empty(len(order))
            out[order] = np.concatenate([read(a[column], n) for a, n in zip(answers[kind], size, strict=True)])
            return out

        levels = lambda raw, n: np.frombuffer(raw, np.uint8, count=n)
        c = back(ASK_WORD, _unsmall)
        c_hist = back(ASK_HISTORY, _unhalves)
        c_hist[:-1][c == 0] = 0
        t_hist = np.where(c_hist > 0, np.minimum(means[back(ASK_HISTORY, levels, 1).astype(np.int64)], c_hist), 0)
        cg = means[back(ASK_GRAM, levels).astype(np.int64)][gram]
        del code, gram
        cv = c_hist[block.hist]
        cg[(cv == 0) | (c == 0)[block.where]] = 0  # a bigram of an unknown word was not seen
        p = (c + 0.1) / (n_tokens + 0.1 * (n_words + 1))
        got = _text_scores(block.bounds, block.where, c, p, cv, t_hist[block.hist], cg, wrong, n_words)
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, got)], names=["doc_id", *SCORES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("kind", "value", "level", "sizes", "words", "at")])
            for i, (kind, value, level, *kept) in enumerate(rows):
                if kind < 0:
                    if held:
                        yield scores(*held)
                        give_back()
                    held = batch.column("ids")[i].values, kept, {k: [] for k in NAME}
                else:
                    held[2][kind].append((value, level))
        if held:
            yield scores(*held)
        del held
        give_back()
    return run


def _score_by_deal(docs: DataFrame, model: BigramModel) -> DataFrame:
    spark, shards = docs.sparkSession, model.shards
    free_shuffles(spark)
    no = F.lit(None)
    part = lambda rows, kind, keys, n: rows.select("shard", F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("block"), F.col(keys).alias("keys"), n.alias("n"))
    parts = part(model.filter.filter("salt = 0"), GRAM_BITS, "bits", no.cast("binary"))
    parts = parts.unionByName(part(model.filter.filter(F.col("salt") == FOLLOWERS), FOLLOW_BITS, "bits", no.cast("binary")))
    parts = parts.unionByName(part(model.counts.filter("kind = 'word'"), WORDS, "keys", F.col("n")))
    parts = parts.unionByName(part(model.histories.filter("kind = 'sums'"), SUMS, "keys", F.col("n")))
    with _small_batches(spark):
        blocks = materialise(docs.mapInArrow(_kept(BLOCK), "block long, ids array<long>, sizes binary, words binary, at binary"), "lm-blocks")
    answers, scores = [], []
    with _small_batches(spark), setting(spark, "spark.sql.parquet.columnarReaderBatchSize", READ_ROWS):
        for i in range(ROUNDS):
            low, high = shards * i // ROUNDS, shards * (i + 1) // ROUNDS
            if low < high:
                asked = blocks.select("block", "sizes", "words", "at").mapInArrow(_asked(shards, low, high), "shard int, kind int, block long, keys binary, n binary")
                asked = asked.unionByName(parts.filter((F.col("shard") >= low) & (F.col("shard") < high)))
                answers.append(materialise(asked.repartition(high - low, "shard").sortWithinPartitions("shard", "kind").mapInArrow(
                    _answered, "block long, kind int, shard int, value binary, level binary"), "lm-answers"))
                free_shuffles(spark)
        kept = blocks.withColumns({"kind": F.lit(-1), "shard": F.lit(-1), "value": no.cast("binary"), "level": no.cast("binary")})
        every = kept
        for a in answers:
            every = every.unionByName(a, allowMissingColumns=True)
        n = max(1, blocks.count() // ROUNDS)
        for i in range(ROUNDS):
            some = every.filter(F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == i)
            scores.append(materialise(some.repartition(n, "block").sortWithinPartitions("block", "kind", "shard").mapInArrow(
                _scored(shards, model.n_tokens, model.n_words, model.wrong), "doc_id long, n_tokens long, n_known long, base_score double, score double"), "lm-scores"))
            free_shuffles(spark)
    release(blocks, *answers)
    out = scores[0]
    for x in scores[1:]:
        out = out.unionByName(x)
    return out


def score(docs: DataFrame, model: BigramModel, *, doc_id: str = "doc_id", text: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities of the whole text).

    The same filter answers at every size; ``max_broadcast`` only says how the questions reach it.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).alias("text"))
    found = (_score_by_broadcast if model.bytes_to_broadcast() <= max_broadcast else _score_by_deal)(rows, model)
    return found.withColumn("train_tokens", F.lit(model.n_tokens).cast("long"))
