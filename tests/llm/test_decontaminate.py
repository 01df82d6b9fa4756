from collections import Counter

import pytest

from choicespark.llm import decontaminate as D
from llm_fixtures import documents, edges, make_docs, rng, sf  # noqa: F401


def words(text):
    return (text or "").lower().replace("\t", " ").replace("\n", " ").split(" ")


def plain(docs, items, width=5, least=0.8):
    """Best item-sized window of every document for every item, by looking at all of them."""
    out = {}
    for i, t in docs:
        w = [x for x in words(t) if x]
        for j, u in items:
            v = [x for x in words(u) if x]
            if not v or not w:
                continue
            k = min(width, len(v))
            item = Counter(tuple(v[a:a + k]) for a in range(len(v) - k + 1))
            for s in range(max(0, len(w) - len(v)) + 1):
                win = w[s:s + len(v)]
                got = Counter(tuple(win[a:a + k]) for a in range(len(win) - k + 1))
                both = sum((got & item).values())
                sim = both / sum((got | item).values())
                if sim >= least and sim > out.get((i, j), (0, 0))[0]:
                    out[i, j] = (sim, s)
    return out


def run(spark, make_docs, docs, items, **how):
    found = D.contaminated(make_docs(docs), spark.createDataFrame(items, "item_id long, text string"), **how).collect()
    return {(r.doc_id, r.item_id): (r.similarity, r.start) for r in found}


@pytest.fixture()
def corpus(rng):
    vocab = [f"w{i}" for i in range(60)]
    items = [(j, " ".join(rng.choices(vocab, k=rng.choice([15, 20, 33, 50])))) for j in range(8)]
    items += [(8, "one two three"), (9, items[0][1]), (10, "alpha"), (11, " ".join(["again and"] * 10))]
    docs = []
    for i in range(160):
        ws = rng.choices(vocab, k=rng.randint(0, 80))
        for _ in range(rng.randint(0, 2)):
            v = rng.choice(items)[1].split()
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(v))
                v[k:k + 1] = rng.choice([[], [v[k], "extra"], ["other"], [v[k].upper()]])
                v = v or ["w0"]
            cut = rng.choice([0, 0, 0, 2])
            at = rng.randint(0, len(ws))
            ws[at:at] = v[cut:]
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(ws)))
    docs += [(100, items[3][1]), (101, " ".join(items[3][1].split()[:-2])), (102, " ".join(items[3][1].split()[2:])), (103, None), (104, "")]
    return docs, items


def test_matches_brute_force_over_all_windows(spark, make_docs, corpus):
    docs, items = corpus
    want = plain(docs, items)
    got = run(spark, make_docs, docs, items)
    assert len(want) > 25 and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_blocks_find_every_pair_within_the_radius(spark, make_docs, corpus):
    """A small radius only leaves out pairs that are farther apart."""
    docs, items = corpus
    small, full = run(spark, make_docs, docs, items, radius=4), run(spark, make_docs, docs, items)
    assert set(small) <= set(full)
    assert all(k in small for k, (sim, _) in full.items() if sim == 1)


def test_joins_instead_of_broadcasts_give_the_same(spark, make_docs, corpus, monkeypatch):
    docs, items = corpus
    want = run(spark, make_docs, docs, items)
    monkeypatch.setattr(D, "small", lambda df: df)
    assert run(spark, make_docs, docs, items) == want


def test_real_tables_match_brute_force(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()])
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in D.contaminated(documents, items).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_clean_drops_contaminated_rows_only(spark, edges, make_docs):
    items = spark.createDataFrame([(1, "another text of the same id"), (1, None), (None, " "), (2, "")], "item_id long, text string")
    left = D.clean(edges, items)
    assert left.columns == edges.columns
    want = sorted((str(r.doc_id), str(r.text)) for r in edges.collect() if r.text != "another text of the same id")
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == want
    assert D.clean(make_docs([]), items).count() == 0
    assert D.clean(edges, items.limit(0)).count() == edges.count()


def test_no_python_in_the_plan(documents, spark, sf):
    found = D.contaminated(documents, spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert "Python" not in found._jdf.queryExecution().toString()


def test_periodic_documents_match_brute_force(spark, make_docs):
    turns = lambda a, b, n: " ".join((a, b)[k % 2] for k in range(n))
    items = [(j, turns(f"a{j}", f"b{j}", 13)) for j in range(12)]
    docs = [(j, turns(f"b{j}", f"a{j}", 13)) for j in range(12)] + [(100 + j, turns(f"b{j}", f"a{j}", 12)) for j in range(12)]
    want = plain(docs, items)
    got = run(spark, make_docs, docs, items)
    assert all((j, j) in want for j in range(12)) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
