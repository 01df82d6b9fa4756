"""Language identification of web pages by Bayesian evidence fusion.

log P(language | page) adds up, and normalises, the evidence of

* the text: naive Bayes over hashed byte trigrams of the visible text, tempered because neighbouring
  trigrams are not independent;
* the language that the markup declares, and
* the address suffix, each by P(value | language), smoothed, from grouped counts over all pages;
* the host: P(language | host) smoothed towards its domain, and the domain's towards all pages.
  Each level is one grouped count, without the page's own vote.

The counts take each page's language by its text alone as a vote; a page without text evidence has none.  The trigram model is fitted on a
bounded, hash-chosen sample of labelled documents (``per_language`` rows of each, a parameter); it
holds ``2 ** bits`` numbers per language.  Votes, counts and fusion cover every page.

Defined cases: null or blank pages have no text evidence, an absent or unknown declaration and an
address without a host have none of theirs, and what is left decides; documents without a language
or text are not fitted; ties go to the alphabetically first language; repeated rows are pages of
their own; other columns are not read; an empty table gives an empty result, and without labelled
documents the language is null; a language column with more than ``MAX_LANGUAGES`` values is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from choicespark.llm.store import join_counted, materialise
from choicespark.llm.words import mix

BITS, PER_LANGUAGE = 16, 2_000
#: Languages that one model may tell apart; the driver holds ``2 ** bits`` numbers of each.
MAX_LANGUAGES = 512
#: Weight of a trigram's log likelihood, pseudo-counts of a level of the host prior and of a declared value.
TEMPER, HOST_MASS, VALUE_MASS = 0.1, 5.0, 1.0


def _buckets(text: bytes, bits: int) -> np.ndarray:
    b = np.frombuffer(b" " + b" ".join(text.lower().split()) + b" ", dtype=np.uint8).astype(np.uint64)
    gram = b[:-2] | (b[1:-1] << np.uint64(8)) | (b[2:] << np.uint64(16))
    return (mix(gram) >> np.uint64(64 - bits)).astype(np.int64)


def fit_language(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", bits: int = BITS,
                 per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in alphabetical order and their log trigram probabilities (language, bucket)."""
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.lit(8)).alias("pick")).filter(
        "lang is not null and text is not null")
    n = {r.lang: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}  # one row per language
    if len(n) > MAX_LANGUAGES:
        raise ValueError(f"column {lang} has more than {MAX_LANGUAGES} values: these are no languages")
    langs = sorted(n)
    if not langs:
        return [], np.zeros((0, 1 << bits))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / n[k]))])
    sample = rows.filter((F.col("pick") / F.lit(2.0**64) + 0.5) <= share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(langs), 1 << bits), dtype=np.int64)
        for batch in batches:
            for k, t in zip(batch.column("lang").to_pylist(), batch.column("text")):
                total[langs.index(k)] += np.bincount(_buckets(t.as_py().encode(), bits), minlength=1 << bits)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["lang", "bucket", "n"])

    counts = np.full((len(langs), 1 << bits), 0.05)
    for r in sample.mapInArrow(count, "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.lang, r.bucket] += r.n
    return langs, np.log(counts / counts.sum(axis=1, keepdims=True))


def visible_text(html: str) -> Column:
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(text, "&[a-zA-Z0-9#]+;", " ")


def declared_language(html: str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.nullif(F.lower(found), F.lit(""))


def host_of(url: str) -> Column:
    found = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.lower(found), F.lit(""))


def _text_evidence(langs: list[str], model, bits: int):
    @F.arrow_udf("array<double>")
    def evidence(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        logp = model.value
        for texts in parts:
            out = []
            for t in texts:
                b = _buckets((t.as_py() or "").encode(), bits)
                e = logp[:, b].sum(axis=1) if len(b) > 1 else np.zeros(len(langs))
                out.append(e - e.max())
            yield pa.array(out, pa.list_(pa.float64()))
    return evidence


def identify(pages: DataFrame, docs: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", lang: str = "lang",
             text: str = "text", key: str = "doc_id", bits: int = BITS, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Per page: page_id, lang, probability, text_lang, declared, host, suffix."""
    langs, logp = fit_language(docs, text=text, lang=lang, key=key, bits=bits, per_language=per_language)
    host = host_of(url)
    rows = pages.select(F.col(page_id).alias("page_id"), visible_text(html).alias("t"), declared_language(html).alias("declared"), host.alias("host"))
    part = F.split(F.col("host"), r"\.")
    rows = rows.withColumn("suffix", F.element_at(part, -1)).withColumn(
        "domain", F.when(F.size(part) > 1, F.concat_ws(".", F.element_at(part, -2), F.element_at(part, -1))).otherwise(F.col("host")))
    if not langs:
        none = F.lit(None)
        return rows.select("page_id", none.cast("string").alias("lang"), none.cast("double").alias("probability"), none.cast("string").alias("text_lang"), "declared", "host", "suffix")
    model = pages.sparkSession.sparkContext.broadcast(logp)
    n, names = len(langs), F.array(*[F.lit(x) for x in langs])
    rows = rows.withColumn("e", _text_evidence(langs, model, bits)(F.col("t"))).drop("t")
    rows = rows.withColumn("vote", F.when(F.array_max("e") > F.array_min("e"), F.array_position("e", F.array_max("e")).cast("int") - 1))
    rows = materialise(rows, "page-evidence")

    votes = lambda prefix: [F.count_if(F.col("vote") == i).alias(f"{prefix}{i}") for i in range(n)]
    # n counts rows, v those that vote
    level = lambda by, prefix: materialise(rows.groupBy(*by).agg(F.count("*").alias(f"{prefix}n"), F.count("vote").alias(f"{prefix}v"), *votes(prefix)), "votes")
    everything = rows.agg(F.count("vote"), *votes("g")).first()
    total, overall = everything[0], [everything[i + 1] or 0 for i in range(n)]

    blank = lambda c: F.coalesce(c, F.lit("")).alias(f"{c}_key")
    domains, suffixes, said = level(["domain"], "d"), level(["suffix"], "s"), level(["declared"], "c")
    known = level(["host", "domain", "suffix"], "h").withColumns({f"{c}_key": F.coalesce(c, F.lit("")) for c in ("host", "domain", "suffix")}).drop("host", "domain", "suffix")
    # a domain or suffix with very many hosts has at least as many pages, which its level counts
    known = join_counted(known, domains.select(blank("domain"), "dn", "dv", *[f"d{i}" for i in range(n)]), ["domain_key"], "dn")
    known = join_counted(known, suffixes.select(blank("suffix"), "sn", *[f"s{i}" for i in range(n)]), ["suffix_key"], "sn")
    known = materialise(known.drop("domain_key", "suffix_key", "dn", "sn"), "host-levels")
    declared = materialise(said.select(blank("declared"), "cn", *[f"c{i}" for i in range(n)]), "declared")
    keyed = rows.withColumns({f"{c}_key": F.coalesce(c, F.lit("")) for c in ("host", "declared")})
    met = join_counted(join_counted(keyed, known, ["host_key"], "hn"), declared, ["declared_key"], "cn")

    scores = []
    kinds, suffix_kinds = max(1, said.count()), max(1, suffixes.count())
    voted = F.col("vote").isNotNull().cast("double")
    for i in range(n):
        own = F.coalesce(F.col("vote") == i, F.lit(False)).cast("double")
        everywhere = prior = (F.lit(float(overall[i])) - own + 1) / (F.lit(float(total)) - voted + n)
        for p in "dh":
            prior = (F.col(f"{p}{i}") - own + HOST_MASS * prior) / (F.col(f"{p}v") - voted + HOST_MASS)
        prior = F.when(F.col("host").isNull(), everywhere).otherwise(prior)
        given = lambda col, k: (F.col(col) - own + VALUE_MASS) / (F.lit(float(overall[i])) - own + VALUE_MASS * k)
        score = TEMPER * F.get("e", F.lit(i)) + F.log(prior)
        score += F.when(F.col("declared").isNotNull(), F.log(given(f"c{i}", kinds))).otherwise(0.0)
        scores.append(score + F.when(F.col("suffix").isNotNull(), F.log(given(f"s{i}", suffix_kinds))).otherwise(0.0))
    met = met.select("page_id", "e", "vote", "declared", "host", "suffix", F.array(*scores).alias("score"))
    top = F.array_max("score")
    best = F.array_position("score", top).cast("int")
    sure = 1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return met.select("page_id", F.element_at(names, best).alias("lang"), sure.alias("probability"),
                      F.when(F.col("vote").isNotNull(), F.element_at(names, F.col("vote") + 1)).alias("text_lang"), "declared", "host", "suffix")
