import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Rows (doc_id, text) as a documents table."""
    def make(rows):
        full = [(i, t, "en", f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture()
def rng():
    return random.Random(5)


#: Rows that every operator must take: nulls in any column, empty and blank texts, repeats, a long text.
EDGES = [(None, None), (None, "a lone text without an id here"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"),
         (5, "Same text, twice over and over again"), (6, "same text, twice over and over again"), (7, "x " * 60_000), (8, "é" * 70_000), (4, "another text of the same id")]


@pytest.fixture(scope="session")
def edges(make_docs):
    return make_docs(EDGES)
