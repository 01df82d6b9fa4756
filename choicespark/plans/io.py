"""Source and sink plans: survey scan, renames, ids, unions, file round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from choicespark.sources import files as IO
from choicespark.sources import survey as SV
from choicespark.plans.registry import query, table
from choicespark.questionnaire import QUESTION_CODES

# binding: customer columns play questionnaire answers; two names are absent on purpose
CUSTOMER_RENAME = {"c_acctbal": "Q52_raw", "c_nationkey": "Q57", "c_mktsegment": "Q53_text",
                   "c_phone": "Q99", "c_comment": "Q98"}
ITEMS = ["Q52_raw", "Q57", "Q53_text", "Q98", "Q99"]


@query("survey_scan", """
SELECT 'C_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0')
         AS persona_id, 'C' AS country, c_acctbal AS Q52_raw, c_nationkey AS Q57, c_mktsegment AS Q53_text
FROM customer""")
def q_survey_scan(spark, sf_dir):
    raw = SV.read_table(spark, f"{sf_dir}/customer.parquet")
    df = SV.normalise_dialect(raw, "C", CUSTOMER_RENAME, key_col="c_custkey")
    return df.select("persona_id", "country", "Q52_raw", "Q57", "Q53_text")


@query("rename_present", """
SELECT c_custkey, c_name, c_nationkey AS Q57, c_acctbal AS Q52_raw, c_mktsegment AS Q53_text FROM customer""")
def q_rename_present(spark, sf_dir):
    return SV.rename_present(table(spark, sf_dir, "customer"), CUSTOMER_RENAME)


@query("select_items", """
SELECT 'C_' || lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST(c_custkey AS VARCHAR))) AS INTEGER), '0')
         AS persona_id, 'C' AS country, c_acctbal AS Q52_raw, c_nationkey AS Q57, c_mktsegment AS Q53_text
FROM customer""")
def q_select_items(spark, sf_dir):
    df = SV.normalise_dialect(table(spark, sf_dir, "customer"), "C", CUSTOMER_RENAME, key_col="c_custkey")
    out, _missing = SV.select_items(df, ITEMS)
    return out


_QUESTION_SQL = " ".join(f"WHEN '{code}' THEN '{text}'" for text, code in QUESTION_CODES.items())


@query("question_text", f"""
SELECT p_partkey, 'Q' || CAST(p_partkey % 70 AS VARCHAR) AS code,
       CASE 'Q' || CAST(p_partkey % 70 AS VARCHAR) {_QUESTION_SQL} ELSE 'Q' || CAST(p_partkey % 70 AS VARCHAR) END AS question
FROM part""")
def q_question_text(spark, sf_dir):
    """The whole questionnaire, and codes it does not have."""
    n = table(spark, sf_dir, "part")
    code = F.concat(F.lit("Q"), (F.col("p_partkey") % 70).cast("string"))
    return n.select("p_partkey", code.alias("code"), SV.question_text(code, QUESTION_CODES).alias("question"))


def _unioned(spark, sf_dir):
    loaders = {
        "C": lambda: table(spark, sf_dir, "customer").select(
            SV.make_persona_id("C", F.col("c_custkey")).alias("persona_id"), F.lit("C").alias("source"),
            F.col("c_name").alias("name"), F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal"),
            F.col("c_mktsegment").alias("segment")),
        "S": lambda: table(spark, sf_dir, "supplier").select(
            SV.make_persona_id("S", F.col("s_suppkey")).alias("persona_id"), F.lit("S").alias("source"),
            F.col("s_name").alias("name"), F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal")),
        "X": lambda: spark.read.parquet(f"{sf_dir}/absent_source.parquet"),
    }
    return SV.union_sources(loaders)


_PAD = "lpad(CAST({k} AS VARCHAR), CAST(greatest(4, length(CAST({k} AS VARCHAR))) AS INTEGER), '0')"


@query("union_sources", f"""
SELECT 'C_' || {_PAD.format(k='c_custkey')} AS persona_id, 'C' AS source, c_name AS name, c_nationkey AS nationkey,
       c_acctbal AS acctbal, c_mktsegment AS segment FROM customer
UNION ALL
SELECT 'S_' || {_PAD.format(k='s_suppkey')}, 'S', s_name, s_nationkey, s_acctbal, NULL FROM supplier""")
def q_union_sources(spark, sf_dir):
    df, _skipped = _unioned(spark, sf_dir)
    return df


@query("make_persona_id", f"""
SELECT c_custkey AS key, 'C_' || {_PAD.format(k='c_custkey')} AS persona_id FROM customer
UNION ALL SELECT s_suppkey, 'S_' || {_PAD.format(k='s_suppkey')} FROM supplier""")
def q_make_persona_id(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"),
                                                SV.make_persona_id("C", F.col("c_custkey")).alias("persona_id"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"),
                                                SV.make_persona_id("S", F.col("s_suppkey")).alias("persona_id"))
    return c.unionByName(s)


@query("csv_roundtrip", "SELECT doc_id, text, lang, source, n_chars, '' AS blank FROM documents")
def q_csv_roundtrip(spark, sf_dir):
    """Whole texts with quotes, separators and line breaks, beside an empty string."""
    path = IO.scratch_path(spark, "csv")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars", F.lit("").alias("blank"))
    IO.write_csv(docs, path)
    return IO.read_csv(spark, path, "doc_id bigint, text string, lang string, source string, n_chars bigint, blank string", multi_line=True)


@query("json_roundtrip", "SELECT event_id, user_id, event_type, value, props FROM events")
def q_json_roundtrip(spark, sf_dir):
    path = IO.scratch_path(spark, "json")
    IO.write_jsonl(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "props"), path)
    return spark.read.schema("event_id bigint, user_id bigint, event_type string, value double, props string").json(path)


@query("jsonl_scan", "SELECT event_id, event_type FROM events WHERE event_type <> 'error'")
def q_jsonl_scan(spark, sf_dir):
    """Lines for ``error`` events are written malformed (plus blank lines); the scan keeps the rest."""
    ev = table(spark, sf_dir, "events")
    good = F.to_json(F.struct("event_id", "event_type"))
    line = (F.when(F.col("event_type") == "error", F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"),
                                                            F.lit(', "event_type": ')))
            .otherwise(good))
    text = ev.select(F.explode(F.array(line, F.lit(""))).alias("value"))
    path = IO.scratch_path(spark, "jsonl")
    text.write.mode("overwrite").text(path)
    rows, _bad = IO.read_jsonl(spark, path, "event_id bigint, event_type string")
    return rows


@query("jsonl_first_lines", """
SELECT event_id, event_type FROM (SELECT *, 2 * (row_number() OVER (ORDER BY event_id) - 1) AS line_no FROM events)
WHERE line_no < (SELECT count(*) FROM events) AND event_type <> 'error'""")
def q_jsonl_first_lines(spark, sf_dir):
    """The first half of the lines of files in event order; malformed and blank lines count towards it."""
    ev = table(spark, sf_dir, "events")
    bad = F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(', "event_type": '))
    line = F.when(F.col("event_type") == "error", bad).otherwise(F.to_json(F.struct("event_id", "event_type")))
    path = IO.scratch_path(spark, "jsonl")
    (ev.select("event_id", line.alias("line")).orderBy("event_id").select(F.explode(F.array("line", F.lit(""))))
     .write.mode("overwrite").text(path))
    rows, _bad = IO.read_jsonl(spark, path, "event_id bigint, event_type string", max_samples=ev.count())
    return rows


@query("platform_scan", f"""
SELECT 'U_' || {_PAD.format(k='i')} AS persona_id, 'U' AS country, 'R' || o_orderkey AS answer, true AS id_stable
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders)""")
def q_platform_scan(spark, sf_dir):
    """A platform export of orders (a header-echo row first, no key column): ids are row numbers over all its files."""
    path = IO.scratch_path(spark, "platform")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.lit("2024-01-01").alias("StartDate"), F.concat(F.lit("R"), "o_orderkey").alias("answer"))
    echo = spark.range(1).select(F.lit(-1).cast("long").alias("o_orderkey"), F.lit(SV.ECHO_MARKER).alias("StartDate"), F.lit("What").alias("answer"))
    IO.write_csv(echo.unionByName(rows).orderBy("o_orderkey").drop("o_orderkey"), path)
    df = SV.normalise_dialect(SV.read_table(spark, path, "csv", "StartDate string, answer string"), "U", {}, key_col="row")
    return df.select("persona_id", "country", "answer", "id_stable")


@query("history_scan", """
SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS step, event_id / 1000 AS epoch,
       CASE WHEN event_type <> 'signup' THEN value END AS loss, CASE WHEN event_type = 'signup' THEN value END AS eval_loss,
       CASE WHEN event_type = 'click' THEN value / 10 END AS learning_rate, value * 2 AS grad_norm
FROM events""")
def q_history_scan(spark, sf_dir):
    """Per-run history documents written in chunks of ≤100 entries (absent keys left out), then inlined back."""
    v, kind = F.col("value"), F.col("event_type")
    entry = F.struct(F.col("event_id").alias("step"), (F.col("event_id") / 1000).alias("epoch"),
                     F.when(kind != "signup", v).alias("loss"), F.when(kind == "signup", v).alias("eval_loss"),
                     F.when(kind == "click", v / 10).alias("learning_rate"), (v * 2).alias("grad_norm"))
    entries = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"),
                                                    F.expr("event_id div 100").alias("chunk"), entry.alias("e"))
    docs = entries.groupBy("run_id", "chunk").agg(F.collect_list("e").alias("log_history")).drop("chunk")
    path = IO.scratch_path(spark, "history")
    docs.write.mode("overwrite").json(path)
    h = IO.read_training_history(spark, path, multi_line=False)
    return h.select("run_id", "step", "epoch", "loss", "eval_loss", "learning_rate", "grad_norm")
