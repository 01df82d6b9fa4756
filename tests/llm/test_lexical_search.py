import math
import re
from collections import Counter

import pytest

from choicespark.llm import lexical_search as L
from helpers import lower
from llm_fixtures import EDGES, make_docs, rng  # noqa: F401

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lower(text))


def brute(docs, items, n=20):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    big, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        wanted, scored = Counter(terms(text)), []
        for i, b in bags:
            m = 75 + (25 * sum(b.values()) * big) // total
            s = sum(k * math.floor(1000 * math.log((2 * big + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 12 * m)) for t, k in wanted.items() if b[t])
            if s:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:n])]
    return sorted(out, key=str)


def found(spark, make_docs, docs, items, n=20, **kw):
    items = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, L.search(make_docs(docs), items, n, **kw).collect()), key=str)


def corpus(rng, n):
    words = ["the", "of", *(f"w{i}" for i in range(40)), "é", "Ünder", "x9", "日本"]
    return [(i, " ".join(rng.choice(words[: 2 + i % 45]) + rng.choice(["", ",", "\n", "_", "'"]) for _ in range(rng.randint(1, 60)))) for i in range(n)]


@pytest.mark.parametrize("kw", [{}, {"shard": 20, "bundle": 2}, {"shard": 7, "bundle": 1}])
def test_equal_to_brute_force(spark, make_docs, rng, kw):
    docs = corpus(rng, 150)
    docs += [(500 + i, docs[3][1]) for i in range(60)]  # many copies, so many ties
    items = [(k, docs[k * 11][1][:80]) for k in range(6)] + [(90, "THE the the W1"), (91, "nowhere"), (92, None), (93, ""), (None, "w2 of"), (90, "w3")]
    assert found(spark, make_docs, docs, items, **kw) == brute(docs, items)


def test_small_results_and_undefined_rows(spark, make_docs, rng):
    docs = [*EDGES, *corpus(rng, 30), (7, None), (None, "w1 w2")]
    items = [(1, "same text twice"), (2, "x"), (3, "é é one"), (4, "w1 the of")]
    for n in (1, 3, 20):
        assert found(spark, make_docs, docs, items, n, shard=10) == brute(docs, items, n)


def test_vocabulary_beyond_the_broadcast_bound(spark, make_docs, rng, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_BYTES", 0)
    docs, items = corpus(rng, 60), [(1, "w1 the w20"), (2, "of w3")]
    assert found(spark, make_docs, docs, items, shard=16) == brute(docs, items)


def test_empty_tables(spark, make_docs):
    assert found(spark, make_docs, [], [(1, "a")]) == [] == found(spark, make_docs, [(1, "a")], [])


def test_long_texts_are_counted_whole(monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 10)
    text = "Alpha beta,gamma " * 20 + "é" * 50 + " omega"
    n, counts = L.term_counts(text.encode())
    assert (n, {k.decode(): v for k, v in counts.items()}) == (len(terms(text)), dict(Counter(terms(text))))
