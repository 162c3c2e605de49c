"""Sinks S15–S17: the query log, the citation log and JSON result records.

The reference inserts one row per question inside a transaction. Here a sink
appends a whole DataFrame, keyed by a content hash so a rerun (e.g. after a
lost executor retried the job) never duplicates rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# The columns written per question.
QUERY_LOG_COLUMNS = ["subject_id", "query_text", "response_text", "session_id", "response_time_ms",
                     "citation_count", "success", "error_message", "model_arn", "created_at"]


def content_key(*cols: str | Column) -> Column:
    """Stable key from content (replaces the SERIAL surrogate)."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\\N"))
             for c in cols]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None if there is none; any other failure is raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs inside removes its shuffle files when it is done: nothing reads them again."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def append_new(spark: SparkSession, df: DataFrame, path: str, key: str, ts: str | None = None) -> DataFrame:
    """Append one row per ``key`` that is not yet in the table at ``path``; return the
    table. With ``ts`` the table has one folder per day of that time, and only the days
    of the new rows are read for the comparison (equal keys have equal times).

    Keys are compared first, without the other columns: a batch without repeats goes to the
    table as it is, one that is stored already is not written, and whole rows are joined only
    with the keys that are repeated or stored. Each step's shuffle files go when it is done,
    and the table is written with zstd."""
    with _shuffles_removed(spark):
        return _append_new(spark, df, path, key, ts)


def _append_new(spark: SparkSession, df: DataFrame, path: str, key: str, ts: str | None) -> DataFrame:
    new = df if ts is None else df.withColumn("_day", F.coalesce(F.date_format(ts, "yyyyMMdd"), F.lit("none")))
    met = new.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_stored", F.lit(False))
    old = _existing(spark, path)
    if old is not None:
        if ts is not None:
            old = old.withColumn("_day", F.col("_day").cast("string")).join(new.select("_day").distinct(), "_day", "left_semi")
        stored = old.select(F.col(key).alias("_key")).distinct().withColumn("_found", F.lit(True))
        met = met.join(stored, "_key", "left").withColumn("_stored", F.col("_found").isNotNull()).drop("_found")
    seen = met.agg((F.max("_rows") > 1).alias("repeated"), F.bool_or("_stored").alias("some"), F.bool_and("_stored").alias("all")).first()
    if not seen["all"]:
        if seen["repeated"] or seen["some"]:
            held = met.where("_rows > 1 OR _stored")
            aside = scratch_path(spark, "held-keys")           # written, so that its size decides the joins with whole rows
            held.write.parquet(aside)
            held = spark.read.schema(held.schema).parquet(aside)
            once = new.join(held, new[key].eqNullSafe(held["_key"]), "left_anti")
            twice = new.join(held.where("NOT _stored"), new[key].eqNullSafe(held["_key"]), "left_semi").dropDuplicates([key])
            new = once.unionByName(twice)
        if ts is None:
            new.write.mode("append").option("compression", "zstd").parquet(path)
        else:
            # a rebalance, unlike a repartition, splits a day that holds most rows over several tasks
            new.hint("rebalance", "_day").write.mode("append").option("compression", "zstd").partitionBy("_day").parquet(path)
    out = spark.read.parquet(path)
    return out if ts is None else out.drop("_day")


def query_log_sink(spark: SparkSession, log: DataFrame, path: str) -> DataFrame:
    """One row per question; ``query_key`` = hash(session, subject, time, text)."""
    keyed = log.withColumn("query_key", content_key(
        "session_id", "subject_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "query_text"))
    return append_new(spark, keyed, path, "query_key", "created_at")


def citation_sink(spark: SparkSession, citations: DataFrame, path: str) -> DataFrame:
    """One row per retrieved reference (callers pass successful queries only)."""
    keyed = citations.withColumn("citation_key", content_key("query_id", "citation_pos", "reference_pos"))
    return append_new(spark, keyed, path, "citation_key",
                      "created_at" if "created_at" in citations.columns else None)


def json_sink(results: DataFrame, path: str, ts: str = "created_at") -> None:
    """Result records as JSON, one folder per day (``query_<yyyymmdd>``
    in the reference's naming); rewriting a day replaces only that day."""
    (results.withColumn("day", F.date_format(ts, "yyyyMMdd")).hint("rebalance", "day")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
     .partitionBy("day").json(path))
