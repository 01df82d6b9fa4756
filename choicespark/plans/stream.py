"""Online preference update plans: the batch twin and the streaming run over ``events``."""

from __future__ import annotations

from choicespark.functions.nulls import scaled
from choicespark.plans.registry import query, table
from choicespark.streaming.ordered_update import Update, ordered_update_batch, ordered_update_stream
from choicespark.streaming.preference_update import preference_update_batch, preference_update_stream

PREF_SQL = """
WITH w AS (SELECT user_id, value,
                  coalesce(1.0 / (1.0 + TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0), 1.0) AS w
           FROM events)
SELECT user_id, count(*) AS n, CAST(round(sum(w * value) / sum(w) * 1e6) AS BIGINT) AS posterior_mean_ppm
FROM w GROUP BY user_id"""


def _out(df):
    return df.select("user_id", "n", scaled("posterior_mean").alias("posterior_mean_ppm"))


@query("pref_update_batch", PREF_SQL)
def q_pref_update_batch(spark, sf_dir):
    return _out(preference_update_batch(table(spark, sf_dir, "events")))


@query("pref_update_stream", PREF_SQL)
def q_pref_update_stream(spark, sf_dir):
    return _out(preference_update_stream(spark, f"{sf_dir}/events*.parquet"))


#: Knowledge fades by a tenth with each event.
UPDATE = Update(mean=0.0, precision=1.0, forget=0.9)

ORDERED_SQL = """
WITH w AS (SELECT user_id, value AS x,
                  coalesce(1.0 / (1.0 + TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0), 1.0) AS w,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS k
           FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL),
s AS (SELECT user_id, count(*) AS n, sum(pow(0.9, k) * w) AS tw, sum(pow(0.9, k) * w * x) AS twx FROM w GROUP BY user_id)
SELECT user_id, n, CAST(round(twx / (pow(0.9, n) + tw) * 1e6) AS BIGINT) AS posterior_mean_ppm,
       CAST(round((pow(0.9, n) + tw) * 1e6) AS BIGINT) AS precision_ppm FROM s"""


def _ordered(df):
    return df.select("user_id", "n", scaled("posterior_mean").alias("posterior_mean_ppm"), scaled("precision").alias("precision_ppm"))


@query("ordered_update_batch", ORDERED_SQL)
def q_ordered_update_batch(spark, sf_dir):
    return _ordered(ordered_update_batch(table(spark, sf_dir, "events"), UPDATE))


@query("ordered_update_stream", ORDERED_SQL)
def q_ordered_update_stream(spark, sf_dir):
    return _ordered(ordered_update_stream(spark, f"{sf_dir}/events*.parquet", UPDATE))
