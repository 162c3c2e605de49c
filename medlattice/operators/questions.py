"""Question and request operators R1–R9, W2, W7.

All are built-in expressions over a questions/requests DataFrame (no UDF):
routing is a chain of ``contains``, request validation and response parsing
are JSON path lookups, the previous turn is a window over the conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .scan import exact_quantiles, last_before, running_count

# The reference's routing phrases, in its order (substring match
# on the lower-cased question; 'my ' and 'i ' keep their trailing space).
PATIENT_INDICATORS = (
    "my ", "i was", "was i", "did i", "when did i", "have i",
    "am i", "do i have", "what did i", "where was i",
    "this", "that", "said", "those", "these",
    "at these", "during this", "for this", "for those",
    "prescribed to me", "diagnosed with", "admitted for",
    "most recent", "last time", "latest",
)
GENERAL_INDICATORS = (
    "what does ", "what is ", "what are ", "how does ", "why does ",
    "explain ", "define ", "what causes ",
    "side effects of", "symptoms of", "treatment for",
    "difference between", "types of",
    "used for", "work", "mechanism",
)
PATIENT_CONTEXT_WORDS = ("my", "i ", "me", "this", "that", "these", "those")


def _any_contains(text: Column, phrases, whole_word: bool = False) -> Column:
    if whole_word:
        pats = [r"(^|\W)" + p.strip().replace(" ", r"\s+") + (r"(\W|$)" if not p.endswith(" ") else r"\s")
                for p in phrases]
        return reduce(lambda a, b: a | b, [text.rlike(p) for p in pats])
    return reduce(lambda a, b: a | b, [text.contains(p) for p in phrases])


def route_question(questions: DataFrame, question: str = "question", whole_word: bool = False) -> DataFrame:
    """R1: 'direct' (patient data) or 'kb' (knowledge base).

    Exact parity by default: 'me' matches inside 'treatment' and 'mechanism',
    so those general questions route to 'direct' as in the reference.
    ``whole_word=True`` matches the context words as words instead.
    """
    q = F.lower(F.col(question))
    patient = _any_contains(q, PATIENT_INDICATORS)
    general = _any_contains(q, GENERAL_INDICATORS)
    context = _any_contains(q, PATIENT_CONTEXT_WORDS, whole_word=whole_word)
    route = F.when(patient, "direct").when(general & ~context, "kb").otherwise("direct")
    return questions.withColumn("route", route)


# --- R4: request validation -------------------------------------------------------

def _json_type(v: Column) -> Column:
    """STRING, BOOLEAN, VOID (JSON null), OBJECT, ARRAY or a number's type; NULL if absent."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def _falsy(v: Column) -> Column:
    """Python's ``not x`` for a JSON value that may be absent."""
    kind, text = _json_type(v), F.to_json(v)
    number = ~kind.isin("STRING", "BOOLEAN", "VOID", "OBJECT", "ARRAY") & (text.try_cast("double") == 0)
    return F.coalesce(v.isNull() | (kind == "VOID") | text.isin('""', "false", "[]", "{}") | number, F.lit(True))


def _plain(v: Column) -> Column:
    """A JSON string's own text, any other value as JSON."""
    return F.when(_json_type(v) == "STRING", F.variant_get(v, "$", "string")).otherwise(F.to_json(v))


def validate_requests(requests: DataFrame, patients: DataFrame, event: str = "event") -> DataFrame:
    """The handler's front half for a batch of raw request events.

    ``body`` may be a JSON string, an object, or absent (direct invocation: the event
    itself). Unparseable text -> 400; a body that is no object (null, a list, a number)
    -> 500, as its fields cannot be asked for; an empty subject or question in Python's
    sense (so not the strings "0" or "false") -> 400; unknown subject -> 404; else 200.
    """
    ev = F.try_parse_json(F.col(event))
    given = F.try_variant_get(F.col("_ev"), "$.body", "variant")
    body = (F.when(F.col("_given").isNull(), F.col("_ev"))
            .when(_json_type(F.col("_given")) == "STRING", F.try_parse_json(F.variant_get("_given", "$", "string")))
            .otherwise(F.col("_given")))
    sid, question = (F.try_variant_get(F.col("_body"), f"$.{name}", "variant") for name in ("subject_id", "question"))
    parsed = (requests.withColumn("_ev", ev).withColumn("_given", given).withColumn("_body", body)
              .withColumn("_object", F.coalesce(_json_type(F.col("_body")) == "OBJECT", F.lit(False)))
              .withColumn("_sid", F.when(F.col("_object"), sid)).withColumn("_q", F.when(F.col("_object"), question))
              .withColumn("_sid_txt", _plain(F.col("_sid"))).withColumn("question", _plain(F.col("_q")))
              .withColumn("subject_id", F.col("_sid_txt").try_cast("double").try_cast("long")))
    known = patients.select("subject_id").distinct().withColumn("_known", F.lit(True))
    j = parsed.join(known, "subject_id", "left")
    cases = ((F.col("_body").isNull(), 400, F.lit("Invalid JSON in request body")),
             (~F.col("_object"), 500, F.lit("Internal server error")),
             (_falsy(F.col("_sid")), 400, F.lit("Missing required field: subject_id")),
             (_falsy(F.col("_q")), 400, F.lit("Missing required field: question")),
             (F.col("_known").isNull(), 404, F.concat(F.lit("Subject ID "), F.col("_sid_txt"), F.lit(" not found in database"))))
    status, error = F.lit(200), F.lit(None).cast("string")
    for failed, code, message in reversed(cases):
        status, error = F.when(failed, code).otherwise(status), F.when(failed, message).otherwise(error)
    return j.withColumn("status_code", status).withColumn("error", error) \
        .drop("_ev", "_given", "_body", "_object", "_sid", "_q", "_sid_txt", "_known")


# --- R5: error classification -------------------------------------------------------

# Failure kind -> (HTTP status, message prefix), server then client side.
ERROR_CLASSES = (
    ("JSONDecodeError", 400, "Invalid JSON in request body"),
    ("MissingField", 400, "Missing required field"),
    ("SubjectNotFound", 404, "Subject ID not found in database"),
    ("DatabaseError", 503, "Database error"),
    ("ClientError", 502, "AWS Bedrock error"),
    ("Exception", 500, "Internal server error"),
    ("Timeout", 408, "Request timed out after 120 seconds"),
    ("ConnectionError", 503, "Could not connect to API endpoint"),
)


def classify_errors(log: DataFrame, kind: str = "error_kind") -> DataFrame:
    """Status code and message for each failure kind (unknown kinds -> 500)."""
    status = F.lit(500)
    message = F.lit("Unexpected error")
    for k, code, msg in reversed(ERROR_CLASSES):
        status = F.when(F.col(kind) == k, F.lit(code)).otherwise(status)
        message = F.when(F.col(kind) == k, F.lit(msg)).otherwise(message)
    return log.withColumn("status_code", F.when(F.col(kind).isNull(), F.lit(200)).otherwise(status)) \
        .withColumn("message", F.when(F.col(kind).isNull(), F.lit(None).cast("string")).otherwise(message))


# --- R6: model response parsing -------------------------------------------------------

def parse_model_response(responses: DataFrame, body: str = "body") -> DataFrame:
    """Answer from the first *present* key: ``content`` (list -> first
    element's ``text``, else the scalar), ``choices[0].message.content``,
    ``completion``; otherwise the whole body as text. Presence is tested on
    the key list, so a ``null`` content still wins (as in the reference)."""
    b = F.col(body)
    keys = F.coalesce(F.json_object_keys(b), F.array().cast("array<string>"))
    content = F.get_json_object(b, "$.content")
    is_list = F.coalesce(_json_type(F.try_variant_get(F.try_parse_json(b), "$.content", "variant")) == "ARRAY", F.lit(False))
    first = F.coalesce(F.get_json_object(b, "$.content[0].text"), F.get_json_object(b, "$.content[0]"))
    answer = (F.when(F.array_contains(keys, "content"), F.when(is_list, first).otherwise(content))
              .when(F.array_contains(keys, "choices"), F.get_json_object(b, "$.choices[0].message.content"))
              .when(F.array_contains(keys, "completion"), F.get_json_object(b, "$.completion"))
              .otherwise(b))
    return responses.withColumn("answer", answer)


# --- R9: latency ----------------------------------------------------------------------

def latency_compare(log: DataFrame, keys: list[Column], server: str = "response_time_ms",
                    client: str = "client_time_ms") -> DataFrame:
    """Client round trip vs server time: per-group mean overhead and
    exact median / p95 of the overhead (linear interpolation)."""
    names = [f"_key{i}" for i in range(len(keys))]
    rows = log.select("*", *[k.alias(n) for k, n in zip(keys, names)], (F.col(client) - F.col(server)).alias("_over"))
    means = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(server), 6).alias("avg_server_ms"),
                                     F.round(F.avg(client), 6).alias("avg_client_ms"))
    spread = exact_quantiles(rows, names, "_over", {"p50_overhead_ms": 0.5, "p95_overhead_ms": 0.95}, 16.0)
    spread = spread.select(*[F.col(n).alias(f"{n}_") for n in names], *[F.round(c, 6).alias(c) for c in ("p50_overhead_ms", "p95_overhead_ms")])
    same = reduce(lambda a, b: a & b, [means[n].eqNullSafe(spread[f"{n}_"]) for n in names])
    titles = log.select(*keys).columns
    return means.join(spread, same, "left").select(*[F.col(n).alias(t) for n, t in zip(names, titles)], "n", "avg_server_ms",
                                                   "avg_client_ms", "p50_overhead_ms", "p95_overhead_ms")


# --- W2 / R3: conversation turns ----------------------------------------------------------

def exchanges(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
              text: str = "text") -> DataFrame:
    """Pair each user turn with the first assistant turn before the next user
    turn: one row per question with ``answer`` (NULL when unanswered)."""
    t = turns.filter(F.col(role).isin("user", "assistant"))
    # running count of user turns per conversation, in two levels (scan.py)
    t = running_count(t, conv, turn, F.col(role) == "user", "q_idx")
    t = t.filter(F.col("q_idx") > 0)
    return t.groupBy(conv, "q_idx").agg(
        F.min(F.when(F.col(role) == "user", F.col(turn))).alias("turn"),
        F.min_by(F.when(F.col(role) == "user", F.col(text)),
                 F.when(F.col(role) == "user", F.col(turn))).alias("question"),
        F.min_by(F.col(text), F.when(F.col(role) == "assistant", F.col(turn))).alias("answer"),
    )


def previous_turn(ex: DataFrame, conv: str = "conv_id", order: str = "q_idx") -> DataFrame:
    """The last *successful* earlier exchange of the same conversation
    (memory only grows after a success, R3): previous question and answer."""
    ok = F.when(F.col("answer").isNotNull(), F.struct(F.col("question").alias("q"), F.col("answer").alias("a")))
    out = last_before(ex, conv, order, ok, "_prev")       # two-level carry-forward (scan.py)
    return out.withColumn("prev_question", F.col("_prev.q")).withColumn("prev_answer", F.col("_prev.a")) \
        .drop("_prev")


def append_turns(ex: DataFrame) -> DataFrame:
    """Only answered exchanges enter the conversation memory."""
    return ex.filter(F.col("answer").isNotNull())


# --- W7 -----------------------------------------------------------------------------------

def distinct_sources(responses: DataFrame, query_id: str = "query_id", citations: str = "citations") -> DataFrame:
    """Source names per question, first seen, with the 1-based citation
    group where each first appears (the CLI's 'KNOWLEDGE SOURCES' list)."""
    c = responses.select(query_id, F.posexplode(citations).alias("pos", "_c"))
    r = c.select(query_id, "pos", F.explode(F.col("_c.retrievedReferences")).alias("_r"))
    uri = F.col("_r.location.s3Location.uri")
    return (r.filter(uri.isNotNull() & (uri != ""))
            .groupBy(query_id, F.substring_index(uri, "/", -1).alias("source_name"))
            .agg((F.min("pos") + 1).alias("first_group")))


def mentioned_dates(df: DataFrame, text: str) -> DataFrame:
    """F10 + F17: distinct yyyy-mm-dd mentions, sorted, joined with ', '."""
    return df.withColumn("dates", F.array_join(S.extract_dates(text), ", "))
