"""Sessionization: the skew-safe two-level form equals the single-window form
for any bucket width; chains across many buckets stay one session."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from medlattice.operators import querylog
from tests.conftest import SMALL_SF


def _sessions(df, bucket):
    out = querylog.sessionize(df, bucket_minutes=bucket)
    return sorted((r["subject_id"], str(r["created_at"]), r["session_id"]) for r in out.collect())


def test_bucket_width_does_not_change_sessions(spark):
    e = spark.read.parquet(f"{SMALL_SF}/events.parquet").select(
        F.col("user_id").alias("subject_id"), F.col("ts").alias("created_at"))
    # gap of 10 hours so sessions span many one-minute buckets
    fine = querylog.sessionize(e, gap_minutes=600, bucket_minutes=1)
    whole = querylog.sessionize(e, gap_minutes=600, bucket_minutes=10 ** 7)
    a = sorted((r["subject_id"], str(r["created_at"]), r["session_id"]) for r in fine.collect())
    b = sorted((r["subject_id"], str(r["created_at"]), r["session_id"]) for r in whole.collect())
    assert a == b
    assert len({x[2] for x in a}) < len(a)           # some sessions really do hold several events


def test_chain_across_buckets_is_one_session(spark):
    t0 = dt.datetime(2150, 1, 1, 0, 5)
    rows = [(1, t0 + dt.timedelta(minutes=29 * i)) for i in range(40)]         # one 19-hour session
    rows += [(1, t0 + dt.timedelta(days=2)), (1, t0 + dt.timedelta(days=2, minutes=31))]  # two more
    df = spark.createDataFrame(rows, "subject_id long, created_at timestamp_ntz")
    got = _sessions(df, 60)
    assert len({s for _, _, s in got}) == 3
    assert got == _sessions(df, 10 ** 7)


def test_two_level_scans_equal_plain_windows(spark):
    from pyspark.sql import Window
    from medlattice.operators import scan
    rows = [(k, i, (i * 7 + k) % 3 == 0, None if i % 4 else f"v{i}") for k in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k long, o long, f boolean, v string")
    w = Window.partitionBy("k").orderBy("o")
    want_cnt = {(r["k"], r["o"]): r["c"] for r in df.withColumn(
        "c", F.sum(F.col("f").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).collect()}
    got_cnt = {(r["k"], r["o"]): r["c"] for r in scan.running_count(df, "k", "o", F.col("f"), "c", width=1).collect()}
    assert got_cnt == want_cnt
    want_last = {(r["k"], r["o"]): r["p"] for r in df.withColumn(
        "p", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).collect()}
    got_last = {(r["k"], r["o"]): r["p"] for r in scan.last_before(df, "k", "o", F.col("v"), "p", width=3).collect()}
    assert got_last == want_last


def test_full_ranking_by_time_buckets(spark):
    from pyspark.sql import Window
    from medlattice.operators import scan
    base = dt.datetime(2150, 1, 1)
    rows = [(1, None if i % 9 == 0 else base + dt.timedelta(days=i * 3 % 40), i) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, x long")
    w = Window.partitionBy("k").orderBy(F.col("t").desc_nulls_first(), F.col("x").asc())
    want = {r["x"]: r["rn"] for r in df.withColumn("rn", F.row_number().over(w)).collect()}
    got = {r["x"]: r["rn"] for r in scan.rank_all_by_time(df, "k", "t", [F.col("x").asc()], width_days=2).collect()}
    assert got == want


def test_stream_sessions_across_batches_with_late_data(spark, tmp_path):
    """Three micro-batches: a session extended by a later batch, sessions
    emitted only once the watermark passes their end, the still-open session
    withheld. Spark guarantees only that data newer than the watermark is never
    dropped; an event older than it may still be aggregated, but it can never
    change a session already emitted."""
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq

    from medlattice.streaming import jobs
    t = lambda h, m: dt.datetime(2150, 1, 1, h, m)
    batches = [
        [(1, t(10, 0), 100), (1, t(10, 10), 200), (2, t(10, 0), 50)],
        [(1, t(10, 20), 300), (2, t(13, 0), 70)],      # extends subject 1; watermark -> 12:00
        [(1, t(9, 0), 999)],                           # late: older than the watermark
    ]
    src = tmp_path / "src"
    src.mkdir()
    for i, rows in enumerate(batches):
        cols = list(zip(*rows))
        pq.write_table(pa.table({"subject_id": pa.array(cols[0], pa.int64()),
                                 "created_at": pa.array(cols[1], pa.timestamp("us")),
                                 "response_time_ms": pa.array(cols[2], pa.int32())}), src / f"part-{i}.parquet")
        time.sleep(1.1)
    schema = "subject_id long, created_at timestamp_ntz, response_time_ms int"
    from pyspark.sql.types import _parse_datatype_string
    stream = jobs.file_stream(spark, str(src), "*.parquet", _parse_datatype_string(schema), max_files_per_trigger=1)
    out = jobs.run_available_now(spark, jobs.stream_sessions(stream, gap="30 minutes", watermark="1 hour"),
                                 str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = sorted((r["subject_id"], r["start_time"], r["session_end"], r["query_count"], r["total_response_time_ms"])
                 for r in out.collect())
    on_time = [(1, t(10, 0), t(10, 50), 3, 600), (2, t(10, 0), t(10, 30), 1, 50)]
    late = (1, t(9, 0), t(9, 30), 1, 999)
    assert got in (on_time, sorted(on_time + [late]))


def test_append_new_compares_keys_before_rows(spark, tmp_path, monkeypatch):
    """Rows that are new and not repeated are not de-duplicated whole, a batch that is stored
    already writes nothing; repeats, null keys and partly stored batches give one row a key."""
    from pyspark.sql import functions as F
    from medlattice.sources.sinks import append_new

    def keyed(first, last):
        return spark.range(first, last).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit("x").alias("payload"))

    path, rows = str(tmp_path / "t"), keyed(0, 400)
    with monkeypatch.context() as m:
        m.setattr(type(rows), "dropDuplicates", lambda *_: pytest.fail("whole rows are shuffled"))
        append_new(spark, rows, path, "key")
        files = sorted(p.name for p in (tmp_path / "t").glob("*.parquet"))
        assert append_new(spark, rows, path, "key").count() == 400
    assert sorted(p.name for p in (tmp_path / "t").glob("*.parquet")) == files
    odd = spark.createDataFrame([(None, "n"), (None, "n"), ("k9999", "a"), ("k9999", "a")], "key string, payload string")
    out = append_new(spark, rows.unionByName(rows).unionByName(keyed(400, 410)).unionByName(odd), path, "key")
    assert out.count() == out.select("key").distinct().count() == 412
