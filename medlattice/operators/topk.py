"""Top-k per key: the batch form of ``WHERE key = %s ORDER BY … LIMIT k``.

``row_number() <= k`` over a window partitioned by the key is planned by
Catalyst as ``WindowGroupLimit`` (partial, before the shuffle) + ``Window``,
so a hot key contributes at most k rows per input partition to the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def desc(c: str) -> Column:
    """PostgreSQL ``DESC``: NULLs first."""
    return F.col(c).desc_nulls_first()


def asc(c: str) -> Column:
    """PostgreSQL ``ASC``: NULLs last."""
    return F.col(c).asc_nulls_last()


def tie_break(df: DataFrame, exclude: Sequence[str]) -> list[Column]:
    """Total order over the remaining orderable columns, so LIMIT is reproducible."""
    out = []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if f.dataType.typeName() in ("array", "map", "struct", "variant", "binary"):
            continue
        out.append(F.col(f.name).asc_nulls_last())
    return out


def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  k: int | None, rank_col: str = "rn",
                  order_names: Sequence[str] = ()) -> DataFrame:
    """Keep the first k rows per key under ``order`` (then all other columns).

    ``k=None`` keeps every row and only numbers them (full ranking).
    """
    ties = tie_break(df, list(keys) + list(order_names))
    w = Window.partitionBy(*keys).orderBy(*order, *ties)
    ranked = df.withColumn(rank_col, F.row_number().over(w))
    if k is None:
        return ranked
    return ranked.filter(F.col(rank_col) <= k)
