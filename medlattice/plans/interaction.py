"""Question/request operators bound to the driver's tables.

Questions come from ``benchmark`` and the user turns of ``conversations``;
requests, model responses and failures are derived from ``events``. The
invented prose holds no English routing phrases, no dates and no URIs, so
those are added deterministically from row ids (never by filtering rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import questions as Q
from ..session import scratch_path
from .bindings import ClinicalTables, with_ctes
from .catalog import register

# Sample questions whose routes the reference's rules determine.
SAMPLE_QUESTIONS = (
    "What is Protected Health Information under HIPAA?",
    "Explain the difference between HIPAA Privacy Rule and Security Rule",
    "What are the normal ranges for a Complete Blood Count?",
    "What is the ICD-10 coding system?",
    "What are HIPAA breach notification requirements?",
    "What are my diagnoses?",
    "What is the mechanism of aspirin?",
    "treatment for asthma",
    "types of insulin",
)


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _questions(t: ClinicalTables) -> DataFrame:
    """Every benchmark item and every user turn, prefixed with a sample question."""
    b = t.raw("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("question_id"),
                                  F.col("item_id").alias("n"), "text")
    c = (t.raw("conversations").filter(F.col("role") == "user")
         .select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
                 .alias("question_id"), (F.col("conv_id") * 7 + F.col("turn")).alias("n"), "text"))
    prefixes = F.array(*[F.lit(p) for p in SAMPLE_QUESTIONS])
    both = b.unionByName(c)
    pick = F.element_at(prefixes, (F.col("n") % len(SAMPLE_QUESTIONS) + 1).cast("int"))
    # Every fourth question is the sample alone, so pure sample routes are covered too.
    q = F.when(F.col("n") % 4 == 0, pick).otherwise(F.concat(pick, F.lit(" "), F.col("text")))
    return both.select("question_id", q.alias("question"))


_QUESTIONS_SQL = f"""SELECT question_id,
  CASE WHEN n % 4 = 0 THEN [{", ".join(_sql_str(p) for p in SAMPLE_QUESTIONS)}][n % {len(SAMPLE_QUESTIONS)} + 1]
       ELSE [{", ".join(_sql_str(p) for p in SAMPLE_QUESTIONS)}][n % {len(SAMPLE_QUESTIONS)} + 1] || ' ' || text END
  AS question
FROM (SELECT 'b' || CAST(item_id AS VARCHAR) AS question_id, item_id AS n, text FROM benchmark
      UNION ALL
      SELECT 'c' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), conv_id * 7 + turn, text
      FROM conversations WHERE role = 'user') u"""


def _contains_any_sql(expr: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({expr}, {_sql_str(p)})" for p in phrases) + ")"


_ROUTE_SQL = f"""CASE WHEN {_contains_any_sql('lower(question)', Q.PATIENT_INDICATORS)} THEN 'direct'
  WHEN {_contains_any_sql('lower(question)', Q.GENERAL_INDICATORS)}
       AND NOT {_contains_any_sql('lower(question)', Q.PATIENT_CONTEXT_WORDS)} THEN 'kb'
  ELSE 'direct' END"""


@register("route_question", with_ctes(f"SELECT question_id, {_ROUTE_SQL} AS route FROM qs",
                                      extra=(("qs", _QUESTIONS_SQL),)))
def q_route_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.route_question(_questions(ClinicalTables(spark, sf_dir))).select("question_id", "route")


# --- R4 ---------------------------------------------------------------------------

def _requests(t: ClinicalTables) -> DataFrame:
    e = t.raw("events")
    et, uid, eid = F.col("event_type"), F.col("user_id").cast("string"), F.col("event_id").cast("string")
    inner = F.concat(F.lit('{"subject_id": '), (F.col("user_id") * 11).cast("string"),
                     F.lit(', "question": "What are my labs '), eid, F.lit('?"}'))
    odd = F.col("event_id") % 11
    event = (F.when(odd == 0, F.lit('{"subject_id": "0", "question": "false"}'))     # non-empty strings are there
             .when(odd == 1, F.concat(F.lit('{"body": {"subject_id": "'), uid, F.lit('", "question": "[]"}}')))
             .when(odd == 2, F.lit('{"body": null}')).when(odd == 3, F.lit('{"body": [1, 2]}'))
             .when(odd == 4, F.concat(F.lit('{"body": {"subject_id": '), uid, F.lit(', "question": {}}}')))
             .when(et == "click", F.concat(F.lit('{"body": {"subject_id": '), uid,
                                             F.lit(', "question": "What is sepsis '), eid, F.lit('?"}}')))
             .when(et == "view", F.to_json(F.struct(inner.alias("body"))))
             .when(et == "purchase", F.concat(F.lit('{"subject_id": '), uid, F.lit(', "question": ""}')))
             .when(et == "signup", F.lit('{"subject_id": 0, "question": "hello"}'))
             .otherwise(F.lit('{"body": "{not json"}')))
    return e.select(F.col("event_id").alias("request_id"), event.alias("event"))


_REQUESTS_SQL = """SELECT event_id AS request_id,
  CASE WHEN event_id % 11 = 0 THEN '{"subject_id": "0", "question": "false"}'
       WHEN event_id % 11 = 1 THEN '{"body": {"subject_id": "' || CAST(user_id AS VARCHAR) || '", "question": "[]"}}'
       WHEN event_id % 11 = 2 THEN '{"body": null}' WHEN event_id % 11 = 3 THEN '{"body": [1, 2]}'
       WHEN event_id % 11 = 4 THEN '{"body": {"subject_id": ' || CAST(user_id AS VARCHAR) || ', "question": {}}}'
       WHEN event_type = 'click' THEN '{"body": {"subject_id": ' || CAST(user_id AS VARCHAR)
         || ', "question": "What is sepsis ' || CAST(event_id AS VARCHAR) || '?"}}'
       WHEN event_type = 'view' THEN CAST(json_object('body', '{"subject_id": ' || CAST(user_id * 11 AS VARCHAR)
         || ', "question": "What are my labs ' || CAST(event_id AS VARCHAR) || '?"}') AS VARCHAR)
       WHEN event_type = 'purchase' THEN '{"subject_id": ' || CAST(user_id AS VARCHAR) || ', "question": ""}'
       WHEN event_type = 'signup' THEN '{"subject_id": 0, "question": "hello"}'
       ELSE '{"body": "{not json"}' END AS event
FROM events"""


def _empty_json(kind: str, value: str) -> str:
    """Python's ``not x`` by JSON type, in DuckDB."""
    return (f"({kind} IS NULL OR {kind} = 'NULL' OR ({kind} = 'VARCHAR' AND {value} = '') OR ({kind} = 'BOOLEAN' AND {value} = 'false')"
            f" OR ({kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND CAST({value} AS DOUBLE) = 0)"
            f" OR ({kind} = 'ARRAY' AND {value} = '[]') OR ({kind} = 'OBJECT' AND {value} = '{{}}'))")


@register("validate_requests", with_ctes(f"""
SELECT request_id, subject_id, question,
  CASE step WHEN 1 THEN 400 WHEN 2 THEN 500 WHEN 3 THEN 400 WHEN 4 THEN 400 WHEN 5 THEN 404 ELSE 200 END AS status_code,
  CASE step WHEN 1 THEN 'Invalid JSON in request body' WHEN 2 THEN 'Internal server error'
       WHEN 3 THEN 'Missing required field: subject_id' WHEN 4 THEN 'Missing required field: question'
       WHEN 5 THEN 'Subject ID ' || sid || ' not found in database' END AS error
FROM (SELECT *, CASE WHEN NOT valid THEN 1 WHEN json_type(body) <> 'OBJECT' THEN 2
          WHEN {_empty_json('sid_type', 'sid')} THEN 3 WHEN {_empty_json('q_type', 'question')} THEN 4
          WHEN subject_id IS NULL OR subject_id NOT IN (SELECT subject_id FROM patients) THEN 5 ELSE 0 END AS step
      FROM (SELECT *, TRY_CAST(trunc(TRY_CAST(sid AS DOUBLE)) AS BIGINT) AS subject_id
            FROM (SELECT *, json_extract_string(body, '$.subject_id') AS sid, json_extract_string(body, '$.question') AS question,
                    json_type(body, '$.subject_id') AS sid_type, json_type(body, '$.question') AS q_type
                  FROM (SELECT request_id, json_valid(txt) AS valid, CASE WHEN json_valid(txt) THEN CAST(txt AS JSON) END AS body
                        FROM (SELECT request_id, CASE json_type(event, '$.body') WHEN 'VARCHAR' THEN json_extract_string(event, '$.body')
                                WHEN 'NULL' THEN 'null' ELSE coalesce(CAST(json_extract(event, '$.body') AS VARCHAR), event) END AS txt
                              FROM reqs) a) b) c) d) e""",
    "patients", extra=(("reqs", _REQUESTS_SQL),)))
def q_validate_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    out = Q.validate_requests(_requests(t), t.patients)
    return out.select("request_id", "subject_id", "question", "status_code", "error")


# --- R5 ---------------------------------------------------------------------------

_KIND_SQL = """CASE WHEN NOT success THEN CASE WHEN response_time_ms < 3000 THEN 'ClientError'
    WHEN response_time_ms < 6000 THEN 'DatabaseError' WHEN response_time_ms < 9000 THEN 'Timeout'
    WHEN response_time_ms < 12000 THEN 'ConnectionError' ELSE 'ValueError' END END"""


def _with_kind(t: ClinicalTables) -> DataFrame:
    q = t.kb_queries
    ms = F.col("response_time_ms")
    kind = F.when(~F.col("success"), F.when(ms < 3000, "ClientError").when(ms < 6000, "DatabaseError")
                  .when(ms < 9000, "Timeout").when(ms < 12000, "ConnectionError").otherwise("ValueError"))
    return q.select("query_id", kind.alias("error_kind"))


def _classes_sql() -> str:
    status = " ".join(f"WHEN {_sql_str(k)} THEN {c}" for k, c, _ in Q.ERROR_CLASSES)
    msg = " ".join(f"WHEN {_sql_str(k)} THEN {_sql_str(m)}" for k, _, m in Q.ERROR_CLASSES)
    return f"""SELECT query_id, error_kind,
  CASE WHEN error_kind IS NULL THEN 200 ELSE CASE error_kind {status} ELSE 500 END END AS status_code,
  CASE WHEN error_kind IS NULL THEN NULL ELSE CASE error_kind {msg} ELSE 'Unexpected error' END END AS message
FROM (SELECT query_id, {_KIND_SQL} AS error_kind FROM kb_queries) k"""


@register("classify_errors", with_ctes(_classes_sql(), "kb_queries"))
def q_classify_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.classify_errors(_with_kind(ClinicalTables(spark, sf_dir)))


# --- R6 ---------------------------------------------------------------------------

def _bodies(t: ClinicalTables) -> DataFrame:
    e = t.raw("events")
    et, eid = F.col("event_type"), F.col("event_id").cast("string")
    body = (F.when(F.col("event_id") % 13 == 0, F.concat(F.lit('{"content": "['), eid, F.lit(', 2]"}')))   # text, no list
            .when(et == "click", F.concat(F.lit('{"content": [{"text": "answer '), eid, F.lit('"}], "id": 1}')))
            .when(et == "view", F.concat(F.lit('{"content": "plain '), eid, F.lit('"}')))
            .when(et == "purchase", F.concat(F.lit('{"choices": [{"message": {"content": "choice '), eid,
                                                F.lit('"}}]}')))
            .when(et == "signup", F.concat(F.lit('{"completion": "done '), eid, F.lit('"}')))
            .otherwise(F.concat(F.lit('{"other": '), eid, F.lit("}"))))
    return e.select(F.col("event_id").alias("response_id"), body.alias("body"))


@register("parse_model_response", """
SELECT response_id, CASE WHEN json_exists(body, '$.content') THEN
         CASE WHEN json_type(body, '$.content') = 'ARRAY'
              THEN coalesce(json_extract_string(body, '$.content[0].text'), json_extract_string(body, '$.content[0]'))
              ELSE json_extract_string(body, '$.content') END
       WHEN json_exists(body, '$.choices') THEN json_extract_string(body, '$.choices[0].message.content')
       WHEN json_exists(body, '$.completion') THEN json_extract_string(body, '$.completion')
       ELSE body END AS answer
FROM (SELECT event_id AS response_id,
        CASE WHEN event_id % 13 = 0 THEN '{"content": "[' || i || ', 2]"}'
             WHEN event_type = 'click' THEN '{"content": [{"text": "answer ' || i || '"}], "id": 1}'
             WHEN event_type = 'view' THEN '{"content": "plain ' || i || '"}'
             WHEN event_type = 'purchase' THEN '{"choices": [{"message": {"content": "choice ' || i || '"}}]}'
             WHEN event_type = 'signup' THEN '{"completion": "done ' || i || '"}'
             ELSE '{"other": ' || i || '}' END AS body
      FROM (SELECT event_id, event_type, CAST(event_id AS VARCHAR) AS i FROM events) e) b""")
def q_parse_model_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.parse_model_response(_bodies(ClinicalTables(spark, sf_dir))).select("response_id", "answer")


# --- R9 ---------------------------------------------------------------------------

@register("latency_compare", with_ctes("""
SELECT date_trunc('day', created_at) AS day, count(*) AS n,
  round(avg(response_time_ms), 6) AS avg_server_ms, round(avg(client_time_ms), 6) AS avg_client_ms,
  round(quantile_cont(client_time_ms - response_time_ms, 0.5), 6) AS p50_overhead_ms,
  round(quantile_cont(client_time_ms - response_time_ms, 0.95), 6) AS p95_overhead_ms
FROM (SELECT *, response_time_ms + CAST((query_id % 37) * 3 AS INTEGER) AS client_time_ms FROM kb_queries) q
GROUP BY 1""", "kb_queries"))
def q_latency_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = ClinicalTables(spark, sf_dir).kb_queries.withColumn(
        "client_time_ms", F.col("response_time_ms") + ((F.col("query_id") % 37) * 3).cast("int"))
    return Q.latency_compare(q, [S.day_start("created_at").alias("day")])


# --- W2 / R3 / F10 ----------------------------------------------------------------

_EXCHANGES_SQL = """SELECT conv_id, q_idx, min(turn) FILTER (WHERE role = 'user') AS turn,
    arg_min(text, turn) FILTER (WHERE role = 'user') AS question,
    arg_min(text, turn) FILTER (WHERE role = 'assistant') AS answer
  FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)
                    OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q_idx
        FROM conversations WHERE role IN ('user', 'assistant')) t
  WHERE q_idx > 0 GROUP BY conv_id, q_idx"""

_PREV_SQL = """SELECT *,
  last_value(CASE WHEN answer IS NOT NULL THEN question END IGNORE NULLS) OVER w AS prev_question,
  last_value(CASE WHEN answer IS NOT NULL THEN answer END IGNORE NULLS) OVER w AS prev_answer
FROM ex WINDOW w AS (PARTITION BY conv_id ORDER BY q_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def exchanges(t: ClinicalTables) -> DataFrame:
    return Q.exchanges(t.raw("conversations"))


@register("previous_turn", with_ctes("SELECT conv_id, q_idx, turn, question, answer, prev_question, prev_answer "
                                     "FROM prev", extra=(("ex", _EXCHANGES_SQL), ("prev", _PREV_SQL))))
def q_previous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Q.previous_turn(exchanges(ClinicalTables(spark, sf_dir)))
    return p.select("conv_id", "q_idx", "turn", "question", "answer", "prev_question", "prev_answer")


@register("append_turn", with_ctes("SELECT conv_id, q_idx, question, answer FROM ex WHERE answer IS NOT NULL",
                                   extra=(("ex", _EXCHANGES_SQL),)))
def q_append_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered exchanges appended to the memory table (rerun-safe)."""
    from ..sources.sinks import append_new, content_key
    turns = Q.append_turns(exchanges(ClinicalTables(spark, sf_dir))).select("conv_id", "q_idx", "question", "answer")
    keyed = turns.withColumn("turn_key", content_key("conv_id", "q_idx"))
    path = scratch_path(spark, "turns")
    for _ in range(2):
        out = append_new(spark, keyed, path, "turn_key")
    return out.select("conv_id", "q_idx", "question", "answer")


def _dated_text(t: ClinicalTables) -> DataFrame:
    c = t.raw("conversations")
    d1 = F.date_format(F.date_add(F.lit("2150-01-01").cast("date"), (F.col("conv_id") * 3 + F.col("turn")).cast("int")),
                       "yyyy-MM-dd")
    d2 = F.date_format(F.date_add(F.lit("2150-01-01").cast("date"), (F.col("conv_id") * 5).cast("int")), "yyyy-MM-dd")
    txt = F.concat(F.col("text"), F.lit(" Seen on "), d1, F.lit(", again "), d1, F.lit(" and on "), d2, F.lit("."))
    return c.select("conv_id", "turn", txt.alias("text"))


@register("extract_dates", """
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(regexp_extract_all(txt, '\\d{4}-\\d{2}-\\d{2}'))), ', ')
  AS dates
FROM (SELECT conv_id, turn, text || ' Seen on ' || strftime(DATE '2150-01-01' + CAST(conv_id * 3 + turn AS INTEGER), '%Y-%m-%d')
      || ', again ' || strftime(DATE '2150-01-01' + CAST(conv_id * 3 + turn AS INTEGER), '%Y-%m-%d')
      || ' and on ' || strftime(DATE '2150-01-01' + CAST(conv_id * 5 AS INTEGER), '%Y-%m-%d') || '.' AS txt
      FROM conversations) c""")
def q_extract_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.mentioned_dates(_dated_text(ClinicalTables(spark, sf_dir)), "text").select("conv_id", "turn", "dates")


# --- F11 ------------------------------------------------------------------------------

@register("source_name", """
SELECT doc_id, uri, CASE WHEN uri IS NULL OR uri = '' THEN 'Unknown' ELSE regexp_extract(uri, '[^/]*$') END
  AS source_name
FROM (SELECT doc_id, CASE lang WHEN 'en' THEN 's3://kb/' || source || '/doc-' || CAST(doc_id AS VARCHAR) || '.md'
  WHEN 'de' THEN '' WHEN 'fr' THEN NULL ELSE 's3://kb/' || source || '/' END AS uri FROM documents) d""")
def q_source_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ClinicalTables(spark, sf_dir).raw("documents")
    lang = F.col("lang")
    uri = (F.when(lang == "en", F.concat(F.lit("s3://kb/"), F.col("source"), F.lit("/doc-"),
                                         F.col("doc_id").cast("string"), F.lit(".md")))
           .when(lang == "de", F.lit("")).when(lang == "fr", F.lit(None).cast("string"))
           .otherwise(F.concat(F.lit("s3://kb/"), F.col("source"), F.lit("/"))))
    return d.select("doc_id", uri.alias("uri")).withColumn("source_name", S.source_name("uri"))
