"""The operators' queries over the driver tables, each beside its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from choicespark.llm import (decontaminate, exact_dedup, hard_negatives, language_id, lexical_search, line_dedup, lm_scoring, packing,
                             secret_scan, sharding, simhash, token_counts, toxicity)
from choicespark.llm.store import crc_bucket, materialise, table
from choicespark.llm.tokenizing import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: File in the public tokenizers' folder whose ids the queries count and pack.
TOKENIZER = "byte_bpe_50k.json"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn
    return add


@query()
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = crc_bucket("doc_id", 10)
    found = lm_scoring.score(docs, lm_scoring.fit_bigrams(docs, part != 0))
    return found.select("doc_id", (part == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256,
                  length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", F.col("n_rows").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_path(TOKENIZER))


@query()
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and tokens by source, language and tokenizer version, without documents labelled low quality.

    Batches: every document with a provisional count (a quarter of its characters), the real counts as
    revisions, the withdrawal of the low-quality documents, and the revisions once more (no effect).
    """
    docs = table(spark, sf_dir, "documents")
    path = public_path(TOKENIZER)
    counts = materialise(token_counts.count_versions(
        docs, {"words": token_counts.word_count("text"), "byte_bpe_50k": token_counts.bpe_count("text", path)},
        guess=F.ceil(F.coalesce("n_chars", F.lit(0)) / 4)), "token-counts")
    rollup = token_counts.TokenRollup(spark)
    rollup.commit("load", token_counts.changes(counts.select(*token_counts.KEY, F.col("guess").alias("n_tokens")), "insert"))
    revised = token_counts.changes(counts, "revise", "guess")
    rollup.commit("count", revised)
    low = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id").distinct()
    rollup.commit("low-quality", token_counts.changes(counts.join(low, "doc_id", "left_semi"), "delete"))
    rollup.commit("count", revised)
    return rollup.totals()


@query()
def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"), width=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Bytes of text that a shard of the query holds at most.
SHARD_BYTES = 1 << 20


@query(f"""
WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes,
                  CAST('0x' || substr(md5(doc_id || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
     a AS (SELECT doc_id, n_bytes, d.h >> (60 - depth) AS node, depth FROM d, (SELECT unnest(range(0, 61)) AS depth)),
     t AS (SELECT depth, node, sum(n_bytes) AS shard_bytes, count(*) AS shard_rows FROM a GROUP BY depth, node),
     f AS (SELECT doc_id, n_bytes, depth, node, shard_bytes, shard_rows,
                  row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k
           FROM a JOIN t USING (depth, node) WHERE shard_bytes <= {SHARD_BYTES} OR shard_rows = 1)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(lpad(bin(node), 60, '0'), depth::INTEGER) END AS shard,
       depth::INTEGER AS depth, shard_bytes::BIGINT AS shard_bytes, shard_rows
FROM f WHERE k = 1
""")
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), SHARD_BYTES)
    return found.select("doc_id", "n_bytes", "shard", F.length("shard").alias("depth"), "shard_bytes", "shard_rows")


@query()
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start", "n_words")


@query()
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_bucket("doc_id", 5) != 0)


@query()
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_score(docs, toxicity_model(spark, docs, sf_dir), into="score")
    return scored.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Lines with their place and characters; lines of ten characters or more are near when one edit apart.
#: One edit leaves the first four or the last four characters alone.
_LINE_SQL = """
WITH l AS (SELECT doc_id, i - 1 AS line_no, z[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS z FROM documents) t,
                  LATERAL (SELECT unnest(generate_series(1, len(z))) AS i)),
     x AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
     u AS (SELECT line, min((doc_id, line_no)) AS f FROM x GROUP BY line),
     p AS (SELECT a.line, a.f AS f, b.f AS g, b.line AS other FROM u a JOIN u b
             ON left(a.line, 4) = left(b.line, 4) AND abs(length(a.line) - length(b.line)) <= 1
           UNION ALL SELECT a.line, a.f, b.f, b.line FROM u a JOIN u b
             ON right(a.line, 4) = right(b.line, 4) AND abs(length(a.line) - length(b.line)) <= 1),
     n AS (SELECT line, min(g) AS g FROM p WHERE g < f AND length(line) >= 10 AND length(other) >= 10
                  AND levenshtein(line, other) = 1 GROUP BY line),
     k AS (SELECT x.doc_id, x.line_no, u.f, n.g, CASE WHEN n.g IS NULL OR u.f < n.g THEN u.f ELSE n.g END AS keep
           FROM x JOIN u USING (line) LEFT JOIN n USING (line))
SELECT doc_id, line_no::INTEGER AS line_no, keep[1] AS keep_doc_id, keep[2]::INTEGER AS keep_line_no,
       CASE WHEN keep = f THEN 0 ELSE 1 END AS edits
FROM k WHERE keep < (doc_id, line_no)
"""


@query(_LINE_SQL)
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dropped_lines(table(spark, sf_dir, "documents"))
    return found.filter(~(F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("line_no") == F.col("keep_line_no"))))  # the SQL knows ids and numbers only


#: File in the public tokenizers' folder whose tokens expose random strings.
SPELLING = "byte_bpe_50k.tiktoken"


@query()
def op11_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), public_path(SPELLING))
    spans = F.col("spans")
    return found.select(
        "doc_id", *[secret_scan.count_of(spans, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.listed(spans, ("assign", "access", "hex")), 256).alias("base_sha256"),
        secret_scan.listed(spans).alias("spans"), secret_scan.count_of(spans, "random").alias("n_random"))


@query("""
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                  [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     s AS (SELECT a.vec_id AS anchor_id, a.label AS own, c.vec_id, c.label, list_dot_product(a.q, c.q)::BIGINT AS score
           FROM v a, v c WHERE a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
     p AS (SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS "rank", s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE s.label <> p.own AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
     i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
     d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
     g AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
     t AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
     f AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM t, g GROUP BY term, n_docs),
     c AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))) AS score
           FROM t JOIN d USING (doc_id) JOIN f USING (term), g),
     s AS (SELECT item_id, doc_id, sum(score)::BIGINT AS score FROM i JOIN c USING (term) GROUP BY ALL)
SELECT item_id, (row_number() OVER w20)::INTEGER AS "rank", doc_id, score FROM s WHERE score > 0
WINDOW w20 AS (PARTITION BY item_id ORDER BY score DESC, doc_id)
QUALIFY row_number() OVER w20 <= 20
""")
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
