import pytest
from pyspark.sql import functions as F

from choicespark.llm import line_dedup as L
from helpers import edit_distance
from llm_fixtures import edges, make_docs, rng  # noqa: F401


def plain(rows):
    lines = [((i is None, i or 0, k), x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if x.strip(" \t\r\n\x0b\x0c")]
    first = {}
    for at, x in sorted(lines):
        first.setdefault(x, at)
    near = {}
    texts = [x for x in first if len(x) >= 10]
    for x in texts:
        for y in texts:
            if first[y] < first[x] and abs(len(x) - len(y)) <= 1 and edit_distance(x, y) == 1:
                near[x] = min(near.get(x, first[y]), first[y])
    out = []
    for at, x in lines:
        keep = min(first[x], near.get(x, first[x]))
        if keep < at:
            out.append((at[1] if not at[0] else None, at[2], keep[1] if not keep[0] else None, keep[2], int(keep != first[x])))
    return sorted(map(str, out))


def got(df):
    return sorted(str(tuple(r)) for r in L.dropped_lines(df).collect())


@pytest.fixture()
def lines(rng):
    base = ["".join(rng.choice("abc é") for _ in range(rng.randint(6, 24))) for _ in range(25)]
    pool = list(base)
    for b in base:
        for _ in range(6):
            x = list(b)
            for _ in range(rng.randint(1, 2)):
                k = rng.randrange(len(x))
                x[k:k + 1] = rng.choice([[], [x[k], "d"], ["e"], [x[k], x[k]]])
            pool.append("".join(x))
    pool += [f"Page {k:05d} of the book" for k in range(30)] + ["", "  ", "\r"]
    return [(i, "\n".join(rng.choices(pool, k=rng.randint(0, 14)))) for i in range(40)]


def test_matches_brute_force(make_docs, lines):
    want = plain(lines)
    assert sum(x.endswith("1)") for x in want) > 20
    assert got(make_docs(lines)) == want


def test_joins_instead_of_broadcasts_give_the_same(make_docs, lines, monkeypatch):
    monkeypatch.setattr(L, "small", lambda df: df)
    assert got(make_docs(lines)) == plain(lines)


def test_edges_and_empty(edges, make_docs):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert got(edges) == plain(rows)
    assert L.dropped_lines(make_docs([])).count() == 0 and L.clean_lines(make_docs([])).count() == 0


def test_clean_lines_takes_out_what_is_dropped(make_docs):
    rows = [(1, "first line of text\nshort\n\nfirst line of text"), (2, "first line of texts\r\nshort\nnew line here"), (3, None), (None, "short\nwhat only this has")]
    left = {r.doc_id: r.text for r in L.clean_lines(make_docs(rows).withColumn("gone", F.lit(1))).collect()}
    assert left == {1: "first line of text\nshort\n", 2: "first line of texts\r\nnew line here", 3: None, None: "what only this has"}


def test_rows_that_share_an_id_lose_their_own_lines_only(make_docs):
    rows = [(1, "a line that is repeated"), (None, "a line that is repeated\nonly in the first"), (None, "only in the second\na line that is repeated"),
            (None, "equal at one number"), (None, "equal at one number\nand more"), (7, "a line that is repeated\nonly in seven"), (7, "unique in seven"), (7, "unique in seven")]
    left = sorted((str(r.doc_id), r.text) for r in L.clean_lines(make_docs(rows)).collect())
    kept = [t for i, t in left if "equal at one number" in t]
    assert len(kept) == 1  # one of the two rows keeps the line, told by their hashes
    first = kept[0] == "equal at one number"
    want = [("1", "a line that is repeated"), ("7", "only in seven"), ("7", "unique in seven"), ("7", "unique in seven"), ("None", "only in the first"),
            ("None", "only in the second")] + ([("None", "equal at one number"), ("None", "and more")] if first else [("None", ""), ("None", "equal at one number\nand more")])
    assert left == sorted(want)
    assert L.dropped_lines(make_docs(rows)).count() == 4


def test_query_names_what_its_sql_names(spark, make_docs, tmp_path):
    from choicespark.llm import queries as Q

    rows = [(None, "equal at one number"), (None, "equal at one number\nand more"), (None, "x\nequal at one number"), (3, "near at one numbers"), (3, "near at one number\ny"), (4, "near at one number")]
    make_docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(str(tuple(r)) for r in Q.QUERIES["op10_line_dedup"](spark, str(tmp_path)).collect()) == plain(rows)
