import hashlib
import re

import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents, make_docs, sf  # noqa: F401
from choicespark.llm import secret_scan as S
from choicespark.llm.queries import QUERIES, SPELLING
from choicespark.llm.tokenizing import public_path

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base(text):
    """(start, kind's place, end) of the base spans, on code points; re.IGNORECASE also takes U+017F and U+212A, hence the check."""
    text, out = text or "", []
    for m in ASSIGN.finditer(text):
        if len(m.group(2)) >= 6 and m.group().isascii():
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(out)


RANDOM = "qZ7xK9wLmT4vB2nR8pYs3dFg"
TEXTS = [
    'x password = "hunter22" y', "API_KEY:abcdef and apikey= 12345", "secret:token: abcdefgh", "token=token=zzzzzzz", "ſecret=abcdefg toKen=abcdefg",
    "é AKIA" + "A1" * 8 + " ü AKIA123", "ñ" * 50 + "0123456789abcdef01234567" + "…" + "deadbeef" * 5, "日本 token = '" + "f" * 40 + "' 語", f"key {RANDOM} end",
    "123e4567-e89b-12d3-a456-426614174000", "the_long_identifier_of_words_and_12", "4111111111111111-1111-1111", "data:;base64," + RANDOM * 3,
    "9233A8ECF7C5B09FE5949719B6B82BC439E9329B", None, "", " \n", "passwd  :  '" + RANDOM + "'", f"é{RANDOM}é{RANDOM}", "a" * 300_000 + " " + RANDOM, "AKIA" * 9, "x " * 100_000 + "secret=abcdef",
]


@pytest.fixture(scope="module")
def scanned(spark, make_docs):
    docs = make_docs([*enumerate(TEXTS), (None, TEXTS[0]), (3, TEXTS[3])]).withColumn("spans", F.lit(1))
    return [(r.doc_id, [tuple(s) for s in r.spans]) for r in S.scan(docs, public_path(SPELLING)).collect()]


def test_base_spans_equal_the_patterns_on_code_points(scanned):
    assert len(scanned) == len(TEXTS) + 2
    for i, spans in scanned:
        text = TEXTS[0 if i is None else i]
        got = [(a, S.KINDS.index(k), b) for k, a, b, _, _ in spans if k != "random"]
        assert got == base(text), (i, got)
        assert all(text[a:b] == v for _, a, b, v, _ in spans)
        assert [(a, S.KINDS.index(k)) for k, a, *_ in spans] == sorted((a, S.KINDS.index(k)) for k, a, *_ in spans)


def test_random_strings_are_exposed_and_known_forms_are_not(scanned):
    found = {i: [v for k, _, _, v, _ in spans if k == "random"] for i, spans in scanned if i is not None}
    assert found[8] == [RANDOM] and found[17] == [RANDOM] and found[18] == [RANDOM, RANDOM] and found[19] == [RANDOM]
    for i in (9, 10, 11, 12, 13, 14, 15, 16, 21):
        assert found[i] == [], TEXTS[i] and TEXTS[i][:60]
    tokens = S.speller(public_path(SPELLING))
    for i, spans in scanned:
        assert all(r == len(v) / tokens(v.encode()) < 2.0 for k, _, _, v, r in spans if k == "random")


def test_most_random_strings_are_found_and_few_words():
    import random
    import string

    rng, tokens, pattern = random.Random(1), S.speller(public_path(SPELLING)), re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
    keys = ["".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(20, 48))) for _ in range(500)]
    assert sum(bool(S.find_spans(k.encode(), tokens, pattern, 2.0)) for k in keys) >= 495
    words = ["Donaudampfschifffahrtsgesellschaft", "getElementsByClassNameAndAttribute", "internationalisation-of-services", "numpy-1_26_4-cp312-manylinux",
             "src/main/java/org/example/Application", "SomeVeryLongCamelCaseIdentifierName", "2024-01-01-release-notes-for-users"]
    assert [w for w in words if S.find_spans(w.encode(), tokens, pattern, 2.0)] == []


def test_known_values_and_redaction(spark, make_docs):
    docs = make_docs([(1, f"é token=abcdef99 {RANDOM}"), (2, RANDOM), (3, None), (4, "clean")])
    found = S.findings(S.scan(docs, public_path(SPELLING)))
    known = spark.createDataFrame([(RANDOM,), (None,), (RANDOM,)], "value string")
    assert [(r.doc_id, r.kind) for r in S.without_known(found, known).collect()] == [(1, "assign")]
    red = {r.doc_id: r.text for r in S.redact(docs, public_path(SPELLING)).collect()}
    assert red == {1: "é [assign] [random]", 2: "[random]", 3: None, 4: "clean"}


def test_query_derives_its_digest_from_the_spans(spark, sf, documents):
    rows = {r.doc_id: r for r in QUERIES["op11_secret_scans"](spark, sf).collect()}
    assert len(rows) == documents.count()
    for d in documents.collect():
        want, r = base(d.text), rows[d.doc_id]
        line = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in want) for i in range(3)]
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [s for s in line.split(",") if s]


def test_empty_table(spark, make_docs):
    assert S.scan(make_docs([(1, "x")]).limit(0), public_path(SPELLING)).count() == 0
