"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregates and two joins over the links that remain; nothing
is gathered on the driver but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlattice.llm.common import materialize


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"),
                    F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(links: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour (or itself)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links``: two columns of node ids (longs), any direction, repeats allowed.
    Returns (node, root): the smallest node id of its component, for every node
    that has a link to another node. Rounds needed grow with the logarithm of the
    longest chain, so no bound on them is set."""
    a, b = links.columns
    live = links.where(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    live = materialize(live, "links")
    state = _state(live)
    while state[0]:
        live = materialize(_small_star(_large_star(live)), "links")
        after = _state(live)
        if after == state:
            break
        state = after
    root = live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.unionByName(live.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
