"""Streaming queries T1–T4 over ``events`` and ``conversations`` as file
streams, drained with ``availableNow`` and read back from their sinks (T2: and the state)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..streaming import jobs
from .bindings import read_table
from .catalog import register


def _log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    e = jobs.file_stream(spark, sf_dir, "events.parquet", schema)
    return e.select(
        F.col("event_id").alias("query_id"), F.col("user_id").alias("subject_id"),
        F.floor(F.col("value") * 1000).cast("int").alias("response_time_ms"),
        F.get_json_object("props", "$.k").cast("int").alias("citation_count"),
        (F.col("event_type") != "error").alias("success"), F.col("ts").alias("created_at"))


@register("stream_query_analytics", """
WITH q AS (SELECT user_id AS subject_id, ts AS created_at, CASE WHEN event_id % 9 <> 0 THEN CAST(floor(value * 1000) AS INTEGER) END AS ms,
             CAST(json_extract(props, '$.k') AS INTEGER) AS cites, event_type <> 'error' AS success FROM events)
SELECT date_trunc('day', created_at) AS query_date, count(*) AS total_queries,
  round(sum(ms) / count(ms), 6) AS avg_response_time, round(sum(cites) / count(cites), 6) AS avg_citations,
  count(*) FILTER (WHERE success) AS successful_queries, count(*) FILTER (WHERE NOT success) AS failed_queries
FROM q GROUP BY 1""")
def q_stream_query_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the log; the approximate patient count is tested apart."""
    log = _log_stream(spark, sf_dir).withColumn(
        "response_time_ms", F.when(F.col("query_id") % 9 != 0, F.col("response_time_ms")))
    base = scratch_path(spark, "stream_query_analytics")
    days = jobs.stream_query_analytics(spark, log, f"{base}/days", f"{base}/checkpoint")
    return (days.drop("approx_unique_patients").withColumn("avg_response_time", F.round("avg_response_time", 6))
            .withColumn("avg_citations", F.round("avg_citations", 6)))


_SESSIONS_ORACLE = """
WITH q AS (SELECT user_id AS subject_id, ts AS created_at, CAST(floor(value * 1000) AS INTEGER) AS ms FROM events),
g AS (SELECT *, CASE WHEN lag(created_at) OVER w IS NULL
                       OR epoch_us(created_at) - epoch_us(lag(created_at) OVER w) > 1800000000
                      THEN 1 ELSE 0 END AS new_s
      FROM q WINDOW w AS (PARTITION BY subject_id ORDER BY created_at)),
s AS (SELECT *, sum(new_s) OVER (PARTITION BY subject_id ORDER BY created_at
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM g),
agg AS (SELECT subject_id, min(created_at) AS start_time, max(created_at) + INTERVAL 30 MINUTE AS session_end,
          max(created_at) AS last_activity, count(*) AS query_count, sum(ms) AS total_response_time_ms
        FROM s GROUP BY subject_id, sid)
SELECT * FROM agg"""


@register("stream_sessions", _SESSIONS_ORACLE)
def q_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session: the closed ones from the sink, the open ones from the state store."""
    base = scratch_path(spark, "stream_sessions")
    closed = jobs.run_available_now(spark, jobs.stream_sessions(_log_stream(spark, sf_dir)), f"{base}/out", f"{base}/checkpoint")
    return closed.unionByName(jobs.open_sessions(spark, f"{base}/checkpoint"))


@register("stream_first_wins", """
SELECT * EXCLUDE (rn) FROM (
  SELECT event_id AS query_id, user_id AS subject_id, CAST(floor(value * 1000) AS INTEGER) AS response_time_ms,
    CAST(json_extract(props, '$.k') AS INTEGER) AS citation_count, event_type <> 'error' AS success, ts AS created_at,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) e
WHERE rn = 1""")
def q_stream_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first question of every subject by time, whichever micro-batch holds it."""
    base = scratch_path(spark, "stream_first_wins")
    return jobs.stream_first_wins(spark, _log_stream(spark, sf_dir), ["subject_id"], ["created_at", "query_id"],
                                  f"{base}/target", f"{base}/checkpoint")


_PREV_ORACLE = """
WITH ex AS (SELECT conv_id, q_idx, min(turn) FILTER (WHERE role = 'user') AS turn,
    arg_min(text, turn) FILTER (WHERE role = 'user') AS question,
    arg_min(text, turn) FILTER (WHERE role = 'assistant') AS answer
  FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q_idx
        FROM conversations WHERE role IN ('user', 'assistant')) t
  WHERE q_idx > 0 GROUP BY conv_id, q_idx)
SELECT conv_id, q_idx, turn, question,
  last_value(CASE WHEN answer IS NOT NULL THEN question END IGNORE NULLS) OVER w AS prev_question,
  last_value(CASE WHEN answer IS NOT NULL THEN answer END IGNORE NULLS) OVER w AS prev_answer
FROM ex WINDOW w AS (PARTITION BY conv_id ORDER BY q_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@register("stream_previous_turn", _PREV_ORACLE)
def q_stream_previous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "conversations").schema
    turns = jobs.file_stream(spark, sf_dir, "conversations.parquet", schema)
    base = scratch_path(spark, "stream_previous_turn")
    return jobs.run_available_now(spark, jobs.stream_previous_turn(turns), f"{base}/out", f"{base}/checkpoint")
