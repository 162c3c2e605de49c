"""Query-log analytics: sessions (K9), run and session summaries (A7, A8),
citation flattening and counts (R7, R8, K8), cascade delete (K10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

DEFAULT_SESSION_GAP_MINUTES = 30  # our choice; the reference never closes a session


def sessionize(df: DataFrame, key: str = "subject_id", ts: str = "created_at",
               gap_minutes: int = DEFAULT_SESSION_GAP_MINUTES, session_col: str = "session_id",
               bucket_minutes: int = 60) -> DataFrame:
    """Gaps-and-islands: a new session starts when the gap to the previous event
    of the same key exceeds ``gap_minutes``. Adds ``session_start`` and a
    deterministic ``session_id`` (key + start time).

    Skew-safe in two levels, so one key holding a third of all events is not
    sorted in one task:

    1. events are windowed per (key, time bucket) and get a *local* session
       start inside their bucket;
    2. a per-bucket summary (one row per key and non-empty bucket, so tiny
       even for a hot key) decides whether a bucket's first local session
       continues the previous bucket's last session, and carries the true
       start forward across any chain of such buckets.

    The result does not depend on ``bucket_minutes``; it only sets how finely
    a hot key is split.
    """
    gap_us = gap_minutes * 60 * 1_000_000
    us = S.epoch_us(ts)
    b = df.withColumn("_us", us).withColumn("_bucket", F.floor(F.col("_us") / F.lit(bucket_minutes * 60 * 1_000_000)))
    w = Window.partitionBy(key, "_bucket").orderBy("_us")
    prev = F.lag("_us").over(w)
    b = b.withColumn("_start", F.when(prev.isNull() | (F.col("_us") - prev > gap_us), F.col("_us")))
    b = b.withColumn("_local", F.max("_start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summ = b.groupBy(key, "_bucket").agg(F.min("_us").alias("_first"), F.max("_us").alias("_last"),
                                         F.max("_local").alias("_last_local"))
    wb = Window.partitionBy(key).orderBy("_bucket")
    prev_last = F.lag("_last").over(wb)
    prev_last_local = F.lag("_last_local").over(wb)
    prev_first = F.lag("_first").over(wb)
    continues = prev_last.isNotNull() & (F.col("_first") - prev_last <= gap_us)
    cand = (F.when(~continues, F.col("_first"))
            .when(prev_last_local != prev_first, prev_last_local))      # previous bucket had a break
    summ = summ.withColumn("_cand", cand).withColumn(
        "_eff_first", F.last("_cand", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, 0)))
    out = b.join(summ.select(key, "_bucket", "_first", "_eff_first"), [key, "_bucket"])
    start_us = F.when(F.col("_local") == F.col("_first"), F.col("_eff_first")).otherwise(F.col("_local"))
    out = out.withColumn("session_start", S.ntz_from_epoch_us(start_us)) \
        .drop("_us", "_bucket", "_start", "_local", "_first", "_eff_first")
    return out.withColumn(session_col, F.concat(
        F.col(key).cast("string"), F.lit("@"), F.date_format("session_start", "yyyyMMdd'T'HHmmss.SSSSSS")))


def session_rollup(kb_queries: DataFrame, gap_minutes: int = DEFAULT_SESSION_GAP_MINUTES) -> DataFrame:
    """K9: fill ``user_sessions`` — start, last activity, query count, total ms.

    Rows with a real session id keep it; missing ids or the ``direct-query``
    placeholder are sessionized by inactivity gap per subject.
    """
    q = kb_queries
    if "session_id" in q.columns:
        has_id = F.col("session_id").isNotNull() & (F.col("session_id") != "direct-query")
        with_id = q.filter(has_id)
        no_id = sessionize(q.filter(~has_id | F.col("session_id").isNull()).drop("session_id"),
                           gap_minutes=gap_minutes).drop("session_start")
        q = with_id.unionByName(no_id.select(*with_id.columns))
    else:
        q = sessionize(q, gap_minutes=gap_minutes).drop("session_start")
    return q.groupBy("session_id").agg(
        F.min("subject_id").alias("user_identifier"),
        F.min("created_at").alias("start_time"),
        F.max("created_at").alias("last_activity"),
        F.count(F.lit(1)).alias("query_count"),
        F.sum("response_time_ms").alias("total_response_time_ms"),
    )


def run_summary(results: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Total, ok, failed, mean ms over successes (/max(ok,1)), citations over successes."""
    ok = F.col("success") == F.lit(True)
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(ok).alias("successful"),
        (F.count(F.lit(1)) - F.count_if(ok)).alias("failed"),
        F.round(F.coalesce(F.sum(F.when(ok, F.col("response_time_ms"))), F.lit(0))
                / F.greatest(F.count_if(ok), F.lit(1)), 6).alias("avg_time_ms"),
        F.coalesce(F.sum(F.when(ok, F.col("citation_count"))), F.lit(0)).cast("bigint")
        .alias("total_citations"),
    )


def session_summary(turns: DataFrame, session: str = "session_id", ts: str = "created_at",
                    question: str = "query_text", ms: str = "response_time_ms",
                    status: str = "status_code", last_n: int = 10, cut: int = 120) -> DataFrame:
    """Questions, total and average ms (int-truncated), duration in seconds,
    and the last ``last_n`` questions as numbered lines (oldest first).

    The recent list is built from at most ``last_n`` rows per session (a
    window limit), so no session is ever collected whole.
    """
    agg = turns.groupBy(session).agg(
        F.count(F.lit(1)).alias("questions"),
        F.coalesce(F.sum(ms), F.lit(0)).cast("bigint").alias("total_ms"),
        F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    agg = agg.select(
        session, "questions", "total_ms",
        F.when(F.col("questions") > 0, (F.col("total_ms") / F.col("questions")).cast("bigint"))
        .otherwise(F.lit(0).cast("bigint")).alias("avg_ms"),
        ((S.epoch_us("_last") - S.epoch_us("_first"))
         / 1_000_000).cast("bigint").alias("duration_s"))
    w = Window.partitionBy(session).orderBy(F.col(ts).desc(), F.col(question).asc())
    recent = (turns.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= last_n)
              .withColumn("_line", F.concat(
                  F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" | "),
                  S.py_str(F.substring(F.col(question), 1, cut)), F.lit(" ... | "),
                  S.py_str(ms), F.lit(" ms | HTTP "), S.py_str(status))))
    lines = recent.groupBy(session).agg(
        F.array_sort(F.collect_list(F.struct(F.col("_rn").alias("k"), F.col("_line").alias("v")))).alias("_a"))
    # _rn counts from the newest; print oldest first, numbered from 1.
    lines = lines.select(session, F.array_join(F.transform(
        F.reverse(F.col("_a")),
        lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["v"])), "\n")
        .alias("recent_questions"))
    return agg.join(lines, session, "left")


# --- citations ----------------------------------------------------------------

def flatten_citations(responses: DataFrame, query_id: str = "query_id",
                      citations: str = "citations", excerpt_cut: int = 1000, carry: tuple[str, ...] = ()) -> DataFrame:
    """citations[] -> retrievedReferences[] -> one row per reference.

    ``source_document`` is the URI's last segment ('Unknown' when missing),
    the excerpt is cut to 1000 code points (empty -> NULL), metadata holds
    the URI and the location type ('S3' by default). ``carry``: further response
    columns to keep.
    """
    c = responses.select(query_id, *carry, F.posexplode(citations).alias("citation_pos", "_c"))
    r = c.select(query_id, *carry, "citation_pos",
                 F.posexplode(F.col("_c.retrievedReferences")).alias("reference_pos", "_r"))
    uri = F.coalesce(F.col("_r.location.s3Location.uri"), F.lit(""))
    excerpt = F.col("_r.content.text")
    return r.select(
        query_id, *carry, "citation_pos", "reference_pos",
        S.source_name(uri).alias("source_document"),
        F.when(F.coalesce(excerpt, F.lit("")) == "", F.lit(None)).otherwise(F.substring(excerpt, 1, excerpt_cut))
        .alias("excerpt_text"),
        F.to_json(F.struct(uri.alias("s3_uri"),
                           F.coalesce(F.col("_r.location.type"), F.lit("S3")).alias("reference_type")))
        .alias("metadata"),
    )


def citation_previews(responses: DataFrame, query_id: str = "query_id", citations: str = "citations",
                      cut: int = 200) -> DataFrame:
    """The batch client's view of each reference: the file name of its source ('Unknown
    source' without a location; an empty URI stays empty), an excerpt of ``cut`` code
    points with '...' where the text is longer, and the short client's excerpt, which
    always ends with '...'."""
    r = (responses.select(query_id, F.posexplode(citations).alias("citation_pos", "_c"))
         .select(query_id, "citation_pos", F.posexplode("_c.retrievedReferences").alias("reference_pos", "_r")))
    uri = F.coalesce(F.col("_r.location.s3Location.uri"), F.lit("Unknown source"))
    text = F.coalesce(F.col("_r.content.text"), F.lit(""))
    return r.select(query_id, "citation_pos", "reference_pos", S.source_name(uri, missing="").alias("source"),
                    S.ellipsize(text, cut).alias("excerpt"), S.ellipsize(text, cut, always=True).alias("short_excerpt"))


def citation_counts(responses: DataFrame, citations: str = "citations") -> DataFrame:
    """Both counts the reference keeps — citation groups (logger) and
    flattened references (batch client)."""
    groups = F.coalesce(F.size(citations), F.lit(0))
    refs = F.aggregate(F.coalesce(F.col(citations), F.array()), F.lit(0),
                       lambda acc, c: acc + F.coalesce(F.size(c["retrievedReferences"]), F.lit(0)))
    return responses.withColumn("citation_groups", F.greatest(groups, F.lit(0))) \
        .withColumn("reference_count", refs)


def source_citation_counts(sources: DataFrame, citations: DataFrame) -> DataFrame:
    """K8: fill ``knowledge_sources.citation_count`` from the citation rows."""
    counts = citations.groupBy(F.col("source_document").alias("document_name")).agg(
        F.count(F.lit(1)).alias("_n"))
    return (sources.join(counts, "document_name", "left")
            .withColumn("citation_count", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n"))


def cascade_delete(queries: DataFrame, citations: DataFrame, deleted_ids: DataFrame,
                   key: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """Remove deleted queries and, by ``ON DELETE CASCADE``, their citations."""
    ids = deleted_ids.select(key).distinct()
    return queries.join(ids, key, "left_anti"), citations.join(ids, key, "left_anti")
