import math
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from choicespark.llm import lm_scoring as M
from choicespark.llm import queries as Q
from choicespark.llm.store import crc_bucket
from helpers import words
from llm_fixtures import documents, edges, make_docs, rng, sf  # noqa: F401


def quantised(n):
    means = M._level_means()
    return float(means[int(M.level_of(np.array([n]))[0])]) if n else 0.0


def plain(rows, train):
    """Base score and score with the quantised counts in plain dictionaries."""
    c, gram, follow = Counter(), Counter(), defaultdict(set)
    for i, t in rows:
        if train(i):
            ws = words(t) + ["</s>"]
            for v, w in zip(["<s>", *ws], ws):
                c[w] += 1
                gram[v, w] += 1
                follow[v].add(w)
    n, v_size, total = sum(c.values()), len(c), Counter()
    for (v, _), k in gram.items():
        total[v] += quantised(k)
    out = []
    for i, t in rows:
        ws, base, score = words(t) + ["</s>"], 0.0, 0.0
        for v, w in zip(["<s>", *ws], ws):
            p = (c[w] + 0.1) / (n + 0.1 * (v_size + 1))
            cv = total[v]
            base += math.log10(p)
            t_v = min(quantised(len(follow[v])), cv)
            score += math.log10((quantised(gram[v, w]) + t_v * p) / (cv + t_v) if cv else p)
        out.append((str(i), len(ws), sum(c[w] > 0 for w in ws), n, round(base, 6), score))
    return sorted(out)


def shown(df):
    return sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), r.score) for r in df.collect())


def is_train(i):
    return zlib.crc32(str(i).encode()) % 10 != 0


def same(got, want, room):
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) <= room * w[1] for g, w in zip(got, want))


ROOM = 0.01  # log10 a token, in every text


@pytest.mark.parametrize("bound", [M.MAX_BROADCAST, 0])
def test_both_ways_match_brute_force(documents, bound):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    model = M.fit_bigrams(documents, crc_bucket("doc_id", 10) != 0)
    same(shown(M.score(documents, model, max_broadcast=bound)), plain(rows, is_train), ROOM)


def test_many_shards_and_blocks_change_nothing(documents, monkeypatch):
    part = crc_bucket("doc_id", 10) != 0
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    monkeypatch.setattr(M, "SHARD_BYTES", 20_000)
    monkeypatch.setattr(M, "BLOCK", 3000)
    model = M.fit_bigrams(documents, part)
    assert model.shards > 10
    held = shown(M.score(documents, model))
    same(held, plain(rows, is_train), ROOM)
    same(shown(M.score(documents, model, max_broadcast=0)), held, 1e-9)


def test_probabilities_after_a_history_add_up_to_one(spark):
    """Over the whole vocabulary, for a hundred histories of every band of counts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = M.fit_bigrams(docs, crc_bucket("doc_id", 10) != 0)
    packed, heads = M._packed_model(model)
    known, count, total, grams, follow = M._read_model(np.frombuffer(packed, np.uint8), heads, model.shards)
    means, rng = M._level_means(), np.random.default_rng(1)
    assert len(known) == model.n_words > 100_000 and model.wrong < 3e-6
    p = (count + 0.1) / (model.n_tokens + 0.1 * (model.n_words + 1))
    for low, high in ((1, 1), (2, 5), (6, 50), (51, 1000), (1001, 1 << 60)):
        band = np.flatnonzero((count >= low) & (count <= high))
        sums = []
        for v in rng.choice(band, min(100, len(band)), replace=False):
            cv = total[v]
            tv = min(means[follow.level(known[v : v + 1] & np.uint64(M.PAST), M.FOLLOWERS)[0]], cv)
            cg = means[grams.level(M.pair(np.full(len(known), known[v]), known))]
            sums.append(((cg + tv * p) / (cv + tv)).sum() / (1 + M._share(model.wrong, model.n_words)(cv, tv)))
        # after a word that was seen once, a single wrong answer adds a half: only their mean is one
        assert np.mean(sums) == pytest.approx(1, abs=0.15 if high == 1 else 0.05), (low, np.mean(sums))
        assert low == 1 or np.median(sums) == pytest.approx(1, abs=0.1)


def test_filter_never_forgets_and_rarely_errs(rng):
    key = np.array([rng.getrandbits(64) for _ in range(20_000)], dtype=np.uint64)
    level = np.array([1 + min(20, int(rng.expovariate(0.5))) for _ in key])
    filt = M.LogFrequencyFilter.join(1, {0: M.make_filter(M._named(key, 0), level)})
    got = filt.level(key)
    assert (got >= level).all() and (got > level).mean() < 0.005
    other = np.array([rng.getrandbits(64) for _ in range(20_000)], dtype=np.uint64)
    assert (filt.level(other) > 0).sum() <= 2


def test_held_out_texts_score_above_the_base(spark):
    rows = Q.QUERIES["op1_lm_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert all(r.score < 0 for r in rows)


def test_edges(edges, make_docs):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    model, none = M.fit_bigrams(edges), M.fit_bigrams(make_docs([]))
    assert (none.n_tokens, none.n_words) == (0, 0)
    for bound in (M.MAX_BROADCAST, 0):
        same(shown(M.score(edges, model, max_broadcast=bound)), plain(rows, lambda i: True), ROOM)
        same(shown(M.score(edges, none, max_broadcast=bound)), plain(rows, lambda i: False), 1e-9)
        assert M.score(make_docs([]), model, max_broadcast=bound).count() == 0


@pytest.mark.parametrize("shard_bytes", [M.SHARD_BYTES, 20_000])
def test_scores_are_the_same_on_both_sides_of_the_bound(documents, monkeypatch, shard_bytes):
    monkeypatch.setattr(M, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(M, "FIRST_PROBES", 2)  # many wrong answers, and the same ones
    model = M.fit_bigrams(documents, crc_bucket("doc_id", 10) != 0)
    held = shown(M.score(documents, model))
    same(shown(M.score(documents, model, max_broadcast=model.bytes_to_broadcast() - 1)), held, 1e-9)
    exact = plain([(r.doc_id, r.text) for r in documents.collect()], is_train)
    assert any(abs(a[5] - b[5]) > 1e-6 for a, b in zip(held, exact))  # the filter's answers, not exact counts


def test_workers_find_the_broadcast_in_its_file(tmp_path):
    import pickle

    class Shared:
        value = bytearray(M._MARK + b"abc")
        _path = str(tmp_path / "x")

    with open(Shared._path, "wb") as f:
        pickle.dump(Shared.value, f, 5)
    assert bytes(M._mapped(Shared))[: len(M._MARK) + 3] == M._MARK + b"abc"
    Shared._path = None
    assert bytes(M._mapped(Shared)) == M._MARK + b"abc"


def test_the_filter_is_asked_once_for_a_bigram_of_a_block_and_for_a_history_of_a_task(make_docs, monkeypatch):
    """And the scores of a text do not depend on what was asked before it."""
    texts = ["a b c d a b", "b c zz", "", "a b c d a b"] * 50
    model = M.fit_bigrams(make_docs(list(enumerate(texts))))
    packed, heads = M._packed_model(model)
    known, count, total, grams, follow = M._read_model(np.frombuffer(packed, np.uint8), heads, model.shards)
    names, plain_level = Counter(), M.LogFrequencyFilter.level

    def level(self, key, salt=0):
        names.update((salt, int(k)) for k in key)
        return plain_level(self, key, salt)

    monkeypatch.setattr(M.LogFrequencyFilter, "level", level)
    means, asked, got = M._level_means(), np.full(len(total), -1, dtype=np.int16), []
    blocks = list(M._blocks_of(pa.array(texts), 600))
    for _, _, bounds, token, before in blocks:
        got += zip(*M._score_block(token, before, bounds, known, count, total, asked, grams, follow, model.n_tokens, model.wrong, means))
    times = {salt: [n for (s, _), n in names.items() if s == salt] for salt in (0, M.FOLLOWERS)}
    assert len(blocks) > 2 and len(times[0]) == 10 and max(times[0]) <= len(blocks)
    assert len(times[M.FOLLOWERS]) == 6 and max(times[M.FOLLOWERS]) == 1  # of a, b, c, d, zz and the start mark
    want = plain(list(enumerate(texts)), lambda i: True)
    same(sorted((str(i), int(n), int(k), model.n_tokens, round(float(b), 6), float(x)) for i, (n, k, b, x) in enumerate(got)), want, ROOM)


@pytest.mark.parametrize("piece", [7, M.PIECE])
def test_levels_are_those_of_single_probes(rng, monkeypatch, piece):
    """Many parts, empty ones too, repeated names, few probes: wrong answers are the same as of a name asked alone."""
    monkeypatch.setattr(M, "FIRST_PROBES", 2)
    monkeypatch.setattr(M, "PIECE", piece)
    shards, word = 23, (1 << 64) - 1
    key = np.array([rng.getrandbits(64) for _ in range(1500)], dtype=np.uint64)
    shard = M._shard_of(key, shards)
    level = np.array([1 + min(30, int(rng.expovariate(0.3))) for _ in key])
    parts = {s: M.make_filter(M._named(key[shard == s], 0), level[shard == s]) for s in range(shards) if s != 5}
    filt = M.LogFrequencyFilter.join(shards, parts)
    ask = np.concatenate((key, key[:200], np.array([rng.getrandbits(64) for _ in range(1500)], dtype=np.uint64)))

    def alone(k, bits):
        q = 1
        while bits:
            h = int(M._entry(np.array([k], np.uint64), q)[0])
            step = int(M._stride(np.array([h], np.uint64))[0])
            for i in range(M._probes(q)):
                at = ((h + i * step & word) >> 32) * 8 * len(bits) >> 32
                if not bits[at >> 3] >> (at & 7) & 1:
                    return q - 1
            q += 1
        return 0

    want = [alone(int(n), parts.get(int(s))) for s, n in zip(M._shard_of(ask, shards), M._named(ask, 0))]
    assert filt.level(ask).tolist() == want
    assert sum(w > 0 for w in want[1700:]) > 10  # wrong answers
    assert len(filt.level(ask[:0])) == 0


def test_beyond_the_bound_tables_hold_a_few_bytes_a_token(spark, monkeypatch):
    """The tables that scoring by dealt questions writes, and that all but the scores are deleted after it."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, written, plain_materialise = M.fit_bigrams(docs, crc_bucket("doc_id", 10) != 0), {}, M.materialise

    def materialise(df, name):
        out = plain_materialise(df, name)
        folder = Path(out._scratch_path.removeprefix("file:"))
        written[folder] = sum(f.stat().st_size for f in folder.glob("*.parquet"))
        return out

    monkeypatch.setattr(M, "materialise", materialise)
    tokens = sum(r.n_tokens for r in M.score(docs, model, max_broadcast=0).select("n_tokens").collect())
    assert tokens > 100_000 and 0 < sum(written.values()) < 10 * tokens
    assert [f.name for f in written if f.exists() and not f.name.startswith("lm-scores")] == []


def test_kept_blocks_are_the_texts_they_were_made_of(rng, monkeypatch):
    class Context:
        get = staticmethod(lambda: Context)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(M, "TaskContext", Context)
    texts = [" ".join(f"w{int(rng.expovariate(0.01))}" for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "a"]
    ids = [None if i % 7 == 0 else i // 2 for i in range(len(texts))]
    rows = list(M._kept(500)(iter([pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])] * 2)))
    plain_blocks = list(M._blocks_of(pa.array(texts)))
    want = [np.concatenate(x) for x in zip(*[(token, before) for *_, token, before in plain_blocks])]
    blocks = [M._Block(*(r.column(c)[0].as_py() for c in ("sizes", "words", "at"))) for r in rows]
    assert [r.column("block")[0].as_py() for r in rows] == [(3 << 32) + i for i in range(len(rows))] and len(rows) == 2
    assert [i for r in rows for i in r.column("ids")[0].as_py()] == ids * 2
    for b in blocks:
        assert (b.words[b.where] == want[0]).all() and (b.hists[b.hist] == want[1]).all()
        assert (np.sort(b.keys(M.ASK_GRAM, b.codes())) == np.unique(M.pair(want[1], want[0]))).all()


def test_sums_of_quantised_counts_are_kept_exactly(rng):
    means = M._level_means()
    sums = np.array([sum(means[rng.randrange(60)] for _ in range(rng.randrange(5))) for _ in range(2000)] + [0.5, 127.0, 127.5, 128.0])
    assert (M._unhalves(M._halves(sums), len(sums)) == sums).all()
