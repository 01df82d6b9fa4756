import zlib
from collections import defaultdict

import numpy as np
import pytest

from choicespark.llm import packing as P
from choicespark.llm.queries import TOKENIZER
from choicespark.llm.tokenizing import encoder, public_path
from llm_fixtures import documents, edges, make_docs, rng, sf  # noqa: F401


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path(TOKENIZER))


def plain_pieces(tokenizer, text, length=1024):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
    cut = (len(ids) - 1) % length + 1
    return [(a, ids[a:b]) for a, b in zip([0, *range(cut, len(ids), length)], range(cut, len(ids) + 1, length))]


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a ", "a  b", "It's we'll \n\n x", "a\nb c\t d", "x <|endoftext|> y <| z", "é  b 　c d e f",
                                  "1 22 3.5%", "tab\tx y", "a\x1cb \x85c d", "a'b 's 'll", "\U0001f600 x\U0001f600y z"])
def test_units_give_the_tokenizers_ids(tokenizer, text):
    got = np.frombuffer(encoder(public_path(TOKENIZER))(text), dtype="<u4").tolist()
    assert got == tokenizer.encode(text, add_special_tokens=False).ids


def check(df, tokenizer):
    rows = P.pack_documents(df, public_path(TOKENIZER), with_ids=True).collect()
    want = sorted((str(r.doc_id), k, a, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
                  for r in df.collect() for k, (a, ids) in enumerate(plain_pieces(tokenizer, r.text)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 1024
    return rows, seqs


def test_documents(documents, tokenizer):
    rows, seqs = check(documents, tokenizer)
    assert len(seqs) <= -(-sum(r.length for r in rows) // 1024) * 1.02 + 1


def test_edges(edges, make_docs, tokenizer):
    check(edges, tokenizer)
    assert P.pack_documents(make_docs([]), public_path(TOKENIZER)).count() == 0


def pieces(spark, sizes, parts):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "item long, length long").repartition(parts)
    return P.materialise(rows, "test-pieces")


@pytest.mark.parametrize("items", [50, 100_000])
def test_rounds_over_many_partitions_stay_near_the_bound(spark, rng, items):
    sizes = [rng.randint(1, 1024) for _ in range(3000)]
    got = P.pack(pieces(spark, sizes, 24), items=items).collect()
    assert sorted(r.item for r in got) == list(range(3000))
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, sizes[r.item]))
    for parts in seqs.values():
        ends = np.cumsum([s for _, s in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert len(seqs) <= sum(sizes) / 1024 * (1.03 if items > 50 else 1.08)


def test_items_that_never_fit_together_end(spark):
    got = P.pack(pieces(spark, [600] * 500, 8), items=40).collect()
    assert len({r.sequence_id for r in got}) == 500


def test_best_fit_takes_the_tightest_bin():
    of, at, fill = P.best_fit(np.array([600, 500, 400, 420, 24]), 1024)
    assert of.tolist() == [0, 1, 1, 0, 1] or fill.tolist()[of[3]] >= 1020
    assert fill.sum() == 1944 and len(fill) == 2


@pytest.mark.parametrize("space", [" ", "\n", " "])
def test_very_long_white_space_is_encoded(spark, make_docs, space):
    from tokenizers import Tokenizer

    path = public_path(TOKENIZER)
    texts = ["ordinary row", "a" + space * 1_200_000 + "b", space * 99_999 + "x", space * 100_000]
    slow = Tokenizer.from_file(path)
    want = {i: len(slow.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
    got = defaultdict(int)
    for r in P.token_pieces(make_docs(list(enumerate(texts))), path).collect():
        got[r.doc_id] += r.length
    assert got == want


def test_a_cutting_task_holds_bounded_tokens(spark, monkeypatch):
    import pyarrow as pa

    class Docs:  # hands out the function that tasks run
        select = lambda self, *cols: self
        mapInArrow = lambda self, run, schema: run

    monkeypatch.setattr(P, "TaskContext", type("Ctx", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": lambda self: 0})())}))
    path, text = public_path(TOKENIZER), "some words in a row, " * 2_000
    n = len(encoder(path)(text)) // 4 + 1
    batch = pa.RecordBatch.from_arrays([pa.array(range(300), pa.int64()), pa.array([text] * 300)], names=["doc_id", "text"])
    got = list(P.token_pieces(Docs(), path, with_ids=True)(iter([batch])))
    assert sum(sum(b.column("length").to_pylist()) for b in got) == 300 * n > 2 * P.HELD
    assert max(sum(b.column("length").to_pylist()) for b in got) <= P.HELD + n


def test_the_second_tokenizer_is_built_for_texts_that_need_it(tokenizer, monkeypatch):
    import tokenizers

    from choicespark.llm import tokenizing

    built = []
    stub = type("Tokenizer", (), {"from_file": staticmethod(lambda path: built.append(path) or tokenizer)})
    monkeypatch.setattr(tokenizers, "Tokenizer", stub)
    path = public_path(TOKENIZER)
    encode = tokenizing._encoder(path)
    for text, times in (("ordinary row", 0), ("x <|endoftext|> y", 1), ("a" + " " * 100_000 + "b", 1)):
        assert np.frombuffer(encode(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(built) == times
