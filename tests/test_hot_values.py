"""Aggregates where one value holds most rows, and dictionaries with repeated codes."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlattice.operators import records, scan


@pytest.mark.parametrize("width", [0.5, 10.0, 1000.0])
def test_quantiles_over_value_counts(spark, width):
    rng = random.Random(1)
    rows = [(g, 5.0 if rng.random() < 0.6 else round(rng.uniform(-20, 40), 1)) for g in ("a", "b", None) for _ in range(301)] + [("c", 2.0), ("d", None)]
    got = scan.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"low": 0.1, "mid": 0.5, "high": 0.93}, width)
    found = {r.g: (r.low, r.mid, r.high) for r in got.collect()}
    assert set(found) == {"a", "b", "c", None}
    for g, three in found.items():
        values = [v for h, v in rows if h == g and v is not None]
        assert three == pytest.approx(np.quantile(values, [0.1, 0.5, 0.93]))


def test_dense_rank_of_ids(spark):
    ids = [3, 3, 900, -5, 4096, 4097, 10 ** 12]
    got = scan.dense_rank_all(spark.createDataFrame([(i,) for i in [*ids, None]], "i long"), "i", "n", width=64)
    order = sorted(set(ids))
    assert sorted((r.i, r.n) for r in got.collect()) == sorted((i, order.index(i)) for i in ids)


def test_repeated_dictionary_codes_count_as_in_a_join(spark):
    """Titles meet the counted codes; the counts are those of joining first."""
    rng = random.Random(2)
    dx = [(s, h, rng.randrange(1, 3), rng.choice("AB"), 9) for s in (1, 2) for h in range(20)]
    titles = [("A", 9, "one"), ("A", 9, "one"), ("A", 9, "other"), ("B", 10, "of another version")]
    d = spark.createDataFrame(dx, "subject_id long, hadm_id long, seq_num int, icd_code string, icd_version int")
    t = spark.createDataFrame(titles, "icd_code string, icd_version int, long_title string")
    a = d.select("hadm_id").distinct().withColumn("admittime", F.lit(None).cast("timestamp_ntz"))
    want = Counter((s, c, title, seq) for s, _, seq, c, v in dx
                   for title in ([x for k, w, x in titles if (k, w) == (c, v)] or [None]))
    got = {(r.subject_id, r.icd_code, r.long_title, r.seq_num): r.occurrence_count for r in records.diagnosis_counts(d, t, a, k=50).collect()}
    assert got == dict(want)
    p = d.withColumn("chartdate", F.lit(None).cast("timestamp_ntz"))
    want = Counter((s, c, title) for (s, c, title, _), n in want.items() for _ in range(n))
    got = {(r.subject_id, r.icd_code, r.long_title): r.occurrence_count for r in records.procedure_history(p, t, k=50).collect()}
    assert got == dict(want)


def test_rows_without_a_time_are_ranked_in_runs_of_their_ids(spark):
    """A third of all rows lack a time and share one key."""
    import datetime as dt
    from pyspark.sql import Window
    base = dt.datetime(2150, 1, 1)
    rows = [(1 if i % 3 == 0 else i % 7, None if i % 3 == 0 else base + dt.timedelta(hours=i * 5 % 400), i * 37 % 30011) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k long, t timestamp_ntz, x long")
    sub = df.where("t IS NULL").select(scan._untimed(df, "t", "x").alias("s")).groupBy("s").count()
    assert sub.agg(F.max("count")).first()[0] <= 4096 and sub.count() == 8
    w = Window.partitionBy("k").orderBy(F.col("t").desc_nulls_first(), F.col("x"))
    got = scan.rank_all_by_time(df, "k", "t", [F.col("x").asc_nulls_last()], first_tie="x")
    assert got.join(df.select("k", "x", F.row_number().over(w).alias("want")), ["k", "x"]).where("rn = want").count() == 30_000
    up = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_last(), "x")
    want = df.select("k", "x", F.lead("x").over(up).alias("want"))
    got = scan.next_in_key(df, "k", "t", "x", ["x"]).join(want, ["k", "x"])
    assert got.where(F.col("next_x").eqNullSafe(F.col("want"))).count() == 30_000
