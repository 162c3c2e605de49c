"""Segmented scans per key that do not put a hot key into one task.

A running count, a carried-forward value or a full ranking over one key is
computed in two levels: rows are windowed per (key, bucket) of the ordering
column, and a per-bucket summary — one row per key and non-empty bucket, so
small even for a key holding a third of all rows — supplies what the earlier
buckets contribute (an offset, or the last value seen). Results are exact and
independent of the bucket width.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import epoch_us


def running_count(df: DataFrame, key: str, order: str, flag: Column, out: str, width: int = 1024) -> DataFrame:
    """``out`` = number of rows with ``flag`` true at or before this row
    (by integer ``order``) within ``key``."""
    b = df.withColumn("_bkt", F.floor(F.col(order) / F.lit(width))).withColumn("_f", flag.cast("int"))
    w = Window.partitionBy(key, "_bkt").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_local", F.sum("_f").over(w))
    summ = b.groupBy(key, "_bkt").agg(F.sum("_f").alias("_n"))
    wb = Window.partitionBy(key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_off", F.coalesce(F.sum("_n").over(wb), F.lit(0)))
    out_df = b.join(summ.select(key, "_bkt", "_off"), [key, "_bkt"])
    return out_df.withColumn(out, (F.col("_local") + F.col("_off")).cast("long")).drop("_bkt", "_f", "_local", "_off")


def last_before(df: DataFrame, key: str, order: str, value: Column, out: str, width: int = 1024) -> DataFrame:
    """``out`` = the last non-null ``value`` strictly before this row (by
    integer ``order``) within ``key``."""
    b = df.withColumn("_bkt", F.floor(F.col(order) / F.lit(width))).withColumn("_v", value)
    w = Window.partitionBy(key, "_bkt").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_local", F.last("_v", ignorenulls=True).over(w))
    summ = b.groupBy(key, "_bkt").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_last"))
    wb = Window.partitionBy(key).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_carry", F.last("_last", ignorenulls=True).over(wb))
    out_df = b.join(summ.select(key, "_bkt", "_carry"), [key, "_bkt"])
    return out_df.withColumn(out, F.coalesce("_local", "_carry")).drop("_bkt", "_v", "_local", "_carry")


def _untimed(df: DataFrame, time_col: str, tie_col: str | None, width: int = 4096) -> Column:
    """Bucket among the rows without a time: runs of ``width`` of a numeric ``tie_col`` that
    orders them ascending, NULLs last; 0 for rows with a time, or without such a column."""
    if tie_col is None or not isinstance(df.schema[tie_col].dataType, T.NumericType):
        return F.lit(0).cast("long")
    return F.when(F.col(time_col).isNotNull(), F.lit(0).cast("long")).otherwise(
        F.coalesce(F.floor(F.col(tie_col) / F.lit(width)).cast("long"), F.lit(2 ** 62)))


def rank_all_by_time(df: DataFrame, key: str, time_col: str, ties: Sequence[Column], out: str = "rn",
                     width_days: int = 30, first_tie: str | None = None) -> DataFrame:
    """Full ranking per key by ``time_col`` DESC NULLS FIRST, then ``ties``:
    local row numbers per (key, bucket) plus the number of rows in the buckets that come
    first: those without a time, cut by ``first_tie`` (the numeric column that ``ties``
    begin with, ascending, NULLs last), then later times."""
    width = width_days * 86_400 * 1_000_000
    t = epoch_us(time_col)
    # NULL times rank first under DESC: give them the largest bucket
    b = df.withColumn("_bkt", F.coalesce(F.floor(t / F.lit(width)), F.lit(2 ** 62))).withColumn("_sub", _untimed(df, time_col, first_tie))
    part = [key, "_bkt", "_sub"]
    w = Window.partitionBy(*part).orderBy(F.col(time_col).desc_nulls_first(), *ties)
    b = b.withColumn("_local", F.row_number().over(w))
    summ = b.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(key).orderBy(F.col("_bkt").desc(), "_sub").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_off", F.coalesce(F.sum("_n").over(wb), F.lit(0)))
    out_df = b.join(summ.select(*part, "_off"), part)
    return out_df.withColumn(out, (F.col("_local") + F.col("_off")).cast("int")).drop("_bkt", "_sub", "_local", "_off")


def next_in_key(df: DataFrame, key: str, time_col: str, tie_col: str, carry: Sequence[str],
                prefix: str = "next_", width_days: int = 1) -> DataFrame:
    """For each row, the ``carry`` columns of the next row within ``key`` under
    (``time_col`` ASC NULLS LAST, ``tie_col`` ASC), as ``prefix + name``:
    ``lead`` per (key, bucket), and for the last row of a bucket the first
    row of the key's next non-empty bucket, taken from a per-bucket summary. Rows without
    a time are cut into buckets by a numeric ``tie_col``.
    ``tie_col`` must be non-null (a row key), so both levels agree on the order."""
    width = width_days * 86_400 * 1_000_000
    b = df.withColumn("_bkt", F.coalesce(F.floor(epoch_us(time_col) / F.lit(width)), F.lit(2 ** 62)))
    b = b.withColumn("_sub", _untimed(df, time_col, tie_col))
    part = [key, "_bkt", "_sub"]
    payload = F.struct(*[F.col(c).alias(c) for c in carry])
    w = Window.partitionBy(*part).orderBy(F.col(time_col).asc_nulls_last(), F.col(tie_col).asc_nulls_last())
    b = b.withColumn("_p", payload).withColumn("_local", F.lead("_p").over(w))
    # the bucket's first row: least (time, tie), times in one bucket are all set or all NULL
    summ = b.groupBy(*part).agg(F.min_by("_p", F.struct(time_col, tie_col)).alias("_first"))
    wb = Window.partitionBy(key).orderBy("_bkt", "_sub")
    summ = summ.withColumn("_carry", F.lead("_first").over(wb))
    out_df = b.join(summ.select(*part, "_carry"), part)
    nxt = F.coalesce("_local", "_carry")
    return out_df.select(*df.columns, *[nxt[c].alias(prefix + c) for c in carry])


def percent_rank_all(df: DataFrame, value: str, out: str, width: float = 1 / 1024) -> DataFrame:
    """``percent_rank() OVER (ORDER BY value)`` over the whole frame, without
    moving every row into one task: rows collapse to a histogram of distinct
    values (partial aggregation), each distinct value learns how many rows are
    smaller from a window per value bucket plus an offset from a summary with
    one row per non-empty bucket (bounded by the value range / ``width``, not by
    the row count), and the rank is joined back on the value. NULL values get
    NULL."""
    hist = (df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
            .withColumn("_bkt", F.floor(F.col(value) / F.lit(width))))
    w = Window.partitionBy("_bkt").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumn("_local", F.coalesce(F.sum("_c").over(w), F.lit(0)))
    summ = hist.groupBy("_bkt").agg(F.sum("_c").alias("_n"))
    wb = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    summ = (summ.withColumn("_off", F.coalesce(F.sum("_n").over(wb), F.lit(0)))
            .withColumn("_total", F.sum("_n").over(Window.partitionBy())))
    ranks = hist.join(summ.select("_bkt", "_off", "_total"), "_bkt").select(
        value, F.when(F.col("_total") > 1, (F.col("_local") + F.col("_off")) / (F.col("_total") - 1))
        .otherwise(F.lit(0.0)).alias(out))
    return df.join(ranks, value, "left")


def dense_rank_all(df: DataFrame, value: str, out: str, width: int = 4096) -> DataFrame:
    """``out`` = 0, 1, 2 … along the distinct integer values of ``value`` (NULLs left out):
    a row number per value bucket plus offsets from a summary with one row per non-empty
    bucket, so that no task sorts all values."""
    values = df.select(value).dropna().distinct().withColumn("_bkt", F.floor(F.col(value) / F.lit(width)))
    values = values.withColumn("_local", F.row_number().over(Window.partitionBy("_bkt").orderBy(value)) - 1)
    summ = values.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("_off", F.coalesce(F.sum("_n").over(below), F.lit(0))).select("_bkt", "_off")
    ranked = values.join(summ, "_bkt").select(value, (F.col("_local") + F.col("_off")).cast("long").alias(out))
    return df.join(ranked, value)


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float], width: float) -> DataFrame:
    """One row per group of ``keys`` with its rows' exact quantiles (linear interpolation,
    NULL values left out). Rows collapse to counts per (group, value) first, so a value that
    a third of all rows hold is one row; the counts are summed per (group, value bucket)
    and offset by the smaller buckets, so no buffer holds a group's distinct values."""
    b = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    b = b.withColumn("_bkt", F.floor(F.col("_v") / F.lit(width)))
    below = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    summ = (b.groupBy(*keys, "_bkt").agg(F.sum("_c").alias("_n"))
            .withColumn("_off", F.coalesce(F.sum("_n").over(below), F.lit(0)))
            .withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys))))
    right = summ.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bkt").alias("_b"), "_off", "_all")
    same = reduce(lambda x, y: x & y, [b[k].eqNullSafe(right[f"_k{i}"]) for i, k in enumerate(keys)], b["_bkt"] == right["_b"])
    smaller = Window.partitionBy(*keys, "_bkt").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    # a value takes the places _i to _i + _c - 1 of its group
    at = b.join(right, same).withColumn("_i", F.coalesce(F.sum("_c").over(smaller), F.lit(0)) + F.col("_off"))
    out = []
    for name, p in quantiles.items():
        place = F.lit(p) * (F.col("_all") - 1)
        low = F.floor(place)

        def holds(rank):
            return (F.col("_i") <= rank) & (rank < F.col("_i") + F.col("_c"))
        part = (F.when(holds(low), F.col("_v") * (1 - (place - low))).otherwise(F.lit(0.0))
                + F.when(holds(low + 1), F.col("_v") * (place - low)).otherwise(F.lit(0.0)))
        out.append(F.sum(part).alias(name))
    return at.groupBy(*keys).agg(*out)
