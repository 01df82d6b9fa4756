import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicespark.llm import language_id as G
from llm_fixtures import edges, make_docs  # noqa: F401

PAGE = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_documents_are_told_by_text_alone(spark, labelled):
    train, test = labelled.filter("doc_id % 4 <> 0"), labelled.filter("doc_id % 4 = 0 and n_chars >= 100")
    pages = test.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))
    rows = G.identify(pages, train).join(test.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("truth")), "page_id").collect()
    assert len(rows) == test.count()
    assert sum(r.lang == r.truth for r in rows) > 0.97 * len(rows)


def test_pages_follow_their_address_and_declaration(spark, labelled):
    sf = "/root/testdata/sf0.01"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = G.identify(pages, labelled).collect()
    assert len(rows) == pages.count() and all(0 < r.probability <= 1 + 1e-9 for r in rows)
    assert sum(r.lang == r.declared for r in rows) > 0.95 * len(rows)


def test_host_and_declaration_decide_where_text_does_not(spark, labelled):
    de = [r.text for r in labelled.filter("lang = 'de' and n_chars > 200").limit(40).collect()]
    en = [r.text for r in labelled.filter("lang = 'en' and n_chars > 200").limit(40).collect()]
    pages = [(i, "http://a.nord.example.de/x", f"<p>{t}</p>") for i, t in enumerate(de)]
    pages += [(100 + i, "https://u@www.south.example.org:80/y", f'<HTML class="x" lang="en-GB"><p>{t}') for i, t in enumerate(en)]
    pages += [(900, "http://a.nord.example.de/z", "<p></p>"), (901, "http://b.nord.example.de", None), (902, "http://new.host.zz", '<html lang="en">'),
              (903, None, None), (904, "no address", "<script>der die das</script>")]
    rows = {r.page_id: r for r in G.identify(spark.createDataFrame(pages, PAGE), labelled).collect()}
    assert len(rows) == len(pages)
    assert rows[900].lang == "de" and rows[901].lang == "de" and rows[902].lang == "en"
    assert rows[903].text_lang is None and rows[903].lang is not None and rows[904].text_lang is None
    assert (rows[100].declared, rows[100].host, rows[100].suffix) == ("en", "www.south.example.org", "org")


def test_edges(spark, labelled, edges):
    none = spark.createDataFrame([], PAGE)
    assert G.identify(none, labelled).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "", ""), (1, "http://x", "<p>a</p>"), (1, "http://x", "<p>a</p>")], PAGE).withColumn("lang", F.lit(1)).withColumn("host", F.lit(2))
    assert G.identify(odd, labelled).count() == 4
    rows = G.identify(odd, labelled.limit(0)).collect()
    assert len(rows) == 4 and all(r.lang is None for r in rows)
    assert G.identify(odd, edges).filter("lang = 'en'").count() == 4


def test_joins_of_hot_and_rare_hosts(spark, labelled):
    t = labelled.filter("lang = 'fr' and n_chars > 200").first().text
    pages = [(i, "http://hot.example.com/", f"<p>{t}</p>") for i in range(300)] + [(1000 + i, f"http://h{i}.example.net/", f"<p>{t}</p>") for i in range(300)]
    rows = G.identify(spark.createDataFrame(pages, PAGE), labelled).collect()
    assert len(rows) == 600 and {r.lang for r in rows} == {"fr"}


def test_pages_without_text_do_not_vote(spark, labelled):
    text = {k: [r.text for r in labelled.filter((F.col("lang") == k) & (F.col("n_chars") > 200)).limit(12).collect()] for k in ("de", "fr")}
    pages = [(i, "http://hot.example.com/a", f'<html lang="fr"><p>{t}</p>') for i, t in enumerate(text["fr"])]
    pages += [(100 + i, "http://hot.example.com/b", '<html lang="fr"><script>x</script>') for i in range(200)]
    pages += [(400 + i, f"http://h{i}.example.net/", f'<html lang="de"><p>{t}</p>') for i, t in enumerate(text["de"])]
    pages += [(500, "http://hot.example.com/c", "<p></p>"), (501, None, '<html lang="fr">'), (502, "http://new.example.com/", None)]
    rows = {r.page_id: r for r in G.identify(spark.createDataFrame(pages, PAGE), labelled).collect()}
    assert len(rows) == len(pages)
    assert {rows[i].lang for i in (*range(len(text["fr"])), *range(100, 300), 500, 501, 502)} == {"fr"}
    assert {rows[400 + i].lang for i in range(len(text["de"]))} == {"de"}
    assert all(rows[i].text_lang is None for i in (*range(100, 300), 500, 501, 502))


def fused(pages, langs, logp):
    """The posterior of every page by plain Python: {page_id: (lang, probability)}; pages are (id, url, html)."""
    seen = []
    for i, url, html in pages:
        html = html or ""
        text = re.sub(r"&[a-zA-Z0-9#]+;", " ", re.sub(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ", html))
        b = G._buckets(text.encode(), G.BITS)
        e = logp[:, b].sum(axis=1) if len(b) > 1 else np.zeros(len(langs))
        e = e - e.max()
        said = re.search(r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", html)
        at = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", url or "")
        host = at.group(1).lower() if at else None
        part = host.split(".") if host else []
        seen.append({"id": i, "e": e, "vote": int(e.argmax()) if e.max() > e.min() else None, "said": said.group(1).lower() if said else None, "host": host,
                     "domain": ".".join(part[-2:]) if part else None, "suffix": part[-1] if part else None})
    kinds = {k: len({p[k] for p in seen}) for k in ("said", "suffix")}
    out = {}
    for p in seen:
        rest = [q for q in seen if q is not p and q["vote"] is not None]  # without the page's own vote
        votes = lambda k, v, i: sum(q["vote"] == i for q in rest if k is None or q[k] == v)
        scores = []
        for i in range(len(langs)):
            prior = everywhere = (votes(None, None, i) + 1) / (len(rest) + len(langs))
            for k in ("domain", "host"):
                prior = (votes(k, p[k], i) + G.HOST_MASS * prior) / (sum(q[k] == p[k] for q in rest) + G.HOST_MASS)
            s = G.TEMPER * p["e"][i] + math.log(prior if p["host"] else everywhere)
            for k in ("said", "suffix"):
                if p[k] is not None:
                    s += math.log((votes(k, p[k], i) + G.VALUE_MASS) / (votes(None, None, i) + G.VALUE_MASS * kinds[k]))
            scores.append(s)
        top = max(scores)
        out[p["id"]] = (langs[scores.index(top)], 1 / sum(math.exp(s - top) for s in scores))
    return out


def test_posterior_equals_plain_python(spark, labelled):
    pages = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()][:120]
    pages += [(-1, None, None), (-2, "http://a.blog.example.de/", "<p></p>"), (-3, "http://b.blog.example.de/", '<html lang="xx"><p>der die das und</p>'),
              (-4, "no address", ""), (-5, "http://a.blog.example.de/", "<p>the of and to</p>")]
    want = fused(pages, *G.fit_language(labelled))
    got = {r.page_id: (r.lang, r.probability) for r in G.identify(spark.createDataFrame(pages, PAGE), labelled).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert {i: x[1] for i, x in got.items()} == pytest.approx({i: x[1] for i, x in want.items()}, rel=1e-9)


def test_too_many_languages_are_refused(spark):
    docs = spark.range(G.MAX_LANGUAGES + 5).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        G.fit_language(docs)
