from collections import Counter

import pytest

from choicespark.llm import queries as Q
from choicespark.llm import token_counts as C
from choicespark.llm.tokenizing import public_path
from helpers import words
from llm_fixtures import documents, edges, make_docs, sf  # noqa: F401

CHANGE = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}


def test_signed_changes_and_idempotent_commits(spark, tmp_path):
    rollup = C.TokenRollup(spark, str(tmp_path / "rollup"))
    assert totals(rollup) == {}
    one = spark.createDataFrame([("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None),
                                 ("insert", "b", "de", "v2", 3, None)], CHANGE)
    assert rollup.commit("one", one) and not rollup.commit("one", one)
    two = spark.createDataFrame([("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 14, 10), ("delete", "b", "de", "v2", 3, None)], CHANGE)
    assert rollup.commit("two/..", two)
    assert totals(C.TokenRollup(spark, rollup.path)) == {("a", "en", "v1"): (1, 14), (None, None, "v1"): (1, 0), ("b", "de", "v2"): (0, 0)}
    assert rollup.commit("none", one.limit(0)) and not rollup.commit("none", one)


def test_a_cut_off_commit_does_not_count_and_is_replaced(spark, tmp_path):
    import pathlib

    rollup = C.TokenRollup(spark, str(tmp_path / "rollup"))
    row = spark.createDataFrame([("insert", "a", "en", "v1", 10, None)], CHANGE)
    rollup.commit("one", row)
    for marker in pathlib.Path(rollup._folder("one")).glob("*_SUCCESS*"):
        marker.unlink()
    assert totals(rollup) == {}
    assert rollup.commit("one", row) and totals(rollup) == {("a", "en", "v1"): (1, 10)}


def test_unknown_changes_raise(spark, tmp_path):
    rollup = C.TokenRollup(spark, str(tmp_path / "rollup"))
    with pytest.raises(Exception, match="unknown op"):
        rollup.commit("x", spark.createDataFrame([("upsert", "a", "en", "v1", 10, None)], CHANGE))
    assert totals(rollup) == {}


def test_query_matches_counts_made_one_by_one(spark, sf, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_path(Q.TOKENIZER))
    low = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 0").collect()}
    docs, tokens = Counter(), Counter()
    for r in documents.collect():
        for version, n in (("words", len(words(r.text))), ("byte_bpe_50k", len(tokenizer.encode(r.text or "", add_special_tokens=False).ids))):
            docs[r.source, r.lang, version] += r.doc_id not in low
            tokens[r.source, r.lang, version] += n * (r.doc_id not in low)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in Q.QUERIES["op4_token_counts"](spark, sf).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}


def test_edges(edges, make_docs):
    counts = C.count_versions(edges, {"words": C.word_count("text"), "bpe": C.bpe_count("text", public_path(Q.TOKENIZER))})
    rows = counts.collect()
    assert len(rows) == 2 * edges.count() and all(r.n_tokens is not None for r in rows)
    assert sorted(r.n_tokens for r in rows if r.tokenizer == "words") == sorted(len(words(r.text)) for r in edges.collect())
    assert C.count_versions(make_docs([]), {"words": C.word_count("text")}).count() == 0


def test_query_counts_null_and_repeated_ids_row_by_row(spark, make_docs, tmp_path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_path(Q.TOKENIZER))
    rows = [(None, "no id here"), (None, "nor here, at all"), (None, None), (4, "one"), (4, "one"), (4, "another text of the same id"), (5, "low"), (5, "low too"), (6, "")]
    path = str(tmp_path)
    docs_table = make_docs(rows)
    docs_table.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, 0), (4, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    docs, tokens = Counter(), Counter()
    for r in docs_table.collect():
        for version, n in (("words", len(words(r.text))), ("byte_bpe_50k", len(tokenizer.encode(r.text or "", add_special_tokens=False).ids))):
            docs[r.source, r.lang, version] += r.doc_id != 5
            tokens[r.source, r.lang, version] += n * (r.doc_id != 5)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in Q.QUERIES["op4_token_counts"](spark, path).collect()}
    assert got == {k: (docs[k], tokens[k]) for k in docs}
