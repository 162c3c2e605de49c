"""Exact top-k inner products through a pivot-distance index.

With M the largest norm, a vector x becomes x' = (x, sqrt(M^2 - |x|^2)) and a query q
becomes q' = (q, 0); then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest inner
products are the nearest neighbours and the triangle inequality holds.

Index: every vector is keyed by its nearest pivot and its distance to it. Sorted by
distance, a pivot's cell is cut into rings of about ``block_rows`` vectors; a ring of
equal distances may be larger and is then dealt into parts by a hash of the id.

Search: a query first meets the ring of its nearest pivot that its own distance falls
into, which gives a lower limit for its k-th best score and so a radius. Then the
annuli of every other pivot are expanded as far as the radius reaches: a ring is visited
only if max(ring_min - d, d - ring_max, (d - d_nearest) / 2) is within it. In a visited
block the rows outside the annulus are left out before the products are made. Queries
meet blocks in chunks of bounded size; pairs of a query and a ring are the only thing
that is joined.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from medlattice.llm.common import materialize

K = 5
PIVOTS = 48
PIVOT_SAMPLE = 4096
BINS = 512
BLOCK_ROWS = 4096
CHUNK_QUERIES = 1024
SLACK = 1e-6


def integer_vectors(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, vec): floor(scale * x) of each component as doubles, in bytes. Rows with a
    null id or vector, or a null or non-finite component, are left out."""
    def run(batches):
        for batch in batches:
            ids, out = [], []
            for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if vec_id is None or not values.is_valid or values.values.null_count:
                    continue
                x = values.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    ids.append(vec_id)
                    out.append((np.floor(scale * x) + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "vec"])
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")) \
        .mapInArrow(run, "vec_id long, vec binary")


def _stack(column, dimension: int) -> np.ndarray:
    """Byte vectors as a matrix; shorter vectors are filled with zeros."""
    out = np.zeros((len(column), dimension))
    for row, raw in zip(out, column):
        x = np.frombuffer(raw, np.float64)
        row[:len(x)] = x
    return out


def _lift(x: np.ndarray, m2: float) -> np.ndarray:
    return np.hstack((x, np.sqrt(np.maximum(0.0, m2 - (x * x).sum(1)))[:, None]))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """Cluster centres of the sample (Lloyd's rounds from spread starting points)."""
    count = min(count, len(np.unique(sample, axis=0)))
    picked = [0]
    nearest = _distances(sample, sample[:1])[:, 0]
    rng = np.random.default_rng(5)
    while len(picked) < count:
        weight = nearest ** 2
        picked.append(int(rng.choice(len(sample), p=weight / weight.sum())) if weight.sum() > 0 else len(picked))
        nearest = np.minimum(nearest, _distances(sample, sample[picked[-1:]])[:, 0])
    centres = sample[picked]
    for _ in range(rounds):
        own = _distances(sample, centres).argmin(1)
        centres = np.stack([sample[own == c].mean(0) if (own == c).any() else centres[c] for c in range(len(centres))])
    return centres


class Index:
    """Materialized vectors with cell, ring and part; the rings' bounds; the pivots."""

    def __init__(self, vectors: DataFrame, pivots: int = PIVOTS, sample_rows: int = PIVOT_SAMPLE, bins: int = BINS,
                 block_rows: int = BLOCK_ROWS):
        plain = materialize(vectors, "vectors")
        measure = plain.mapInArrow(_norms, "n long, dimension long, m2 double").agg(
            F.sum("n").alias("n"), F.max("dimension").alias("dimension"), F.max("m2").alias("m2")).first()
        self.rows, self.dimension, self.m2 = measure["n"] or 0, measure["dimension"] or 0, measure["m2"] or 0.0
        if not self.rows:
            return
        sample = plain.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toArrow()     # at most sample_rows
        self.pivots = choose_pivots(_lift(_stack(sample.column("vec").to_pylist(), self.dimension), self.m2), pivots)
        keyed = materialize(plain.mapInArrow(self._assign(), "vec_id long, vec binary, cell int, dist double"), "keyed")
        width = (keyed.agg(F.max("dist")).first()[0] or 0.0) / bins + 1e-9
        slot = F.floor(F.col("dist") / F.lit(width)).cast("int")
        # at most pivots * (bins + 1) rows reach the driver
        found = keyed.groupBy("cell", slot.alias("slot")).agg(F.count("*").alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()
        self.rings, ring_of = [], []
        for r in sorted(found, key=lambda r: (r["cell"], r["slot"])):
            last = self.rings[-1] if self.rings else None
            if last is None or last["cell"] != r["cell"] or last["n"] + r["n"] > block_rows:
                last = {"ring": len(self.rings), "cell": r["cell"], "n": 0, "low": r["low"], "high": r["high"]}
                self.rings.append(last)
            last["n"] += r["n"]
            last["high"] = r["high"]
            ring_of.append((r["cell"], r["slot"], last["ring"]))
        parts = {x["ring"]: -(-x["n"] // block_rows) for x in self.rings}
        spark = vectors.sparkSession
        places = spark.createDataFrame([(c, s, g, parts[g]) for c, s, g in ring_of], "cell int, slot int, ring int, parts int")
        self.ring_parts = spark.createDataFrame(list(parts.items()), "ring int, parts int")
        self.blocks = (keyed.withColumn("slot", slot).join(F.broadcast(places), ["cell", "slot"])
                       .select("vec_id", "vec", "dist", "ring", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")))

    def _assign(self):
        pivots, m2, dimension = self.pivots, self.m2, self.dimension

        def run(batches):
            for batch in batches:
                d = _distances(_lift(_stack(batch.column("vec").to_pylist(), dimension), m2), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), pa.array(cell.astype(np.int32)),
                                                  pa.array(d[np.arange(len(d)), cell])], names=["vec_id", "vec", "cell", "dist"])
        return run

    def visits(self, queries: DataFrame, k: int, home: bool) -> DataFrame:
        """(query_id, vec, d, limit, ring): the rings that each query must meet. home: only
        the ring that it falls into. Otherwise queries has ``limit``, the least score that
        still counts (null: none yet), and the home ring is left out."""
        pivots, m2, dimension = self.pivots, self.m2, self.dimension
        cell = np.array([x["cell"] for x in self.rings])
        low, high = (np.array([x[name] for x in self.rings]) for name in ("low", "high"))

        def run(batches):
            for batch in batches:
                x = _stack(batch.column("vec").to_pylist(), dimension)
                d = _distances(np.hstack((x, np.zeros((len(x), 1)))), pivots)
                own = d.argmin(1)
                to = d[:, cell]
                gap = np.maximum(np.maximum(low - to, to - high), 0.0)
                homes = np.where(cell[None] == own[:, None], gap, np.inf).argmin(1)
                if home:
                    ring, limit = homes[:, None] == np.arange(len(cell)), np.full(len(x), -np.inf)
                else:
                    limit = np.array([-np.inf if v is None else v for v in batch.column("limit").to_pylist()])
                    bound = np.maximum(gap, (to - d[np.arange(len(d)), own][:, None]) / 2)
                    reach = np.sqrt(np.maximum(0.0, (x * x).sum(1) + m2 - 2 * limit))
                    ring = (bound <= (reach * (1 + SLACK) + SLACK)[:, None]) & (homes[:, None] != np.arange(len(cell)))
                q, r = np.nonzero(ring)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(q)), batch.column("vec").take(pa.array(q)),
                                                  pa.array(to[q, r]), pa.array(limit[q]), pa.array(r.astype(np.int32))],
                                                 names=["query_id", "vec", "d", "limit", "ring"])
        return queries.mapInArrow(run, "query_id long, vec binary, d double, limit double, ring int")

    def meet(self, visits: DataFrame, k: int, chunk: int) -> DataFrame:
        """(query_id, vec_id, score): for each visit and part the k best at or above the limit."""
        dimension, m2 = self.dimension, self.m2
        met = visits.groupBy("ring").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("int").alias("chunks"))
        asked = (visits.join(met, "ring").join(F.broadcast(self.ring_parts), "ring")
                 .withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.col("chunks")).cast("int"))
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .select("ring", "part", "chunk", "query_id", "vec", "d", "limit"))
        given = (self.blocks.join(met, "ring").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
                 .select("ring", "part", "chunk", "vec_id", "vec", "dist"))

        def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("dist", kind="stable")
            dist = rows["dist"].to_numpy()
            out_q, out_v, out_s = [], [], []
            q = _stack(queries["vec"], dimension)
            reach = np.sqrt(np.maximum(0.0, (q * q).sum(1) + m2 - 2 * queries["limit"].to_numpy())) * (1 + SLACK) + SLACK
            d = queries["d"].to_numpy()
            lo, hi = np.searchsorted(dist, d - reach, "left"), np.searchsorted(dist, d + reach, "right")
            vec_ids, vectors = rows["vec_id"].to_numpy(np.int64), _stack(rows["vec"], dimension)
            for at in range(0, len(q), 128):
                a, b = int(lo[at:at + 128].min()), int(hi[at:at + 128].max())
                if a >= b:
                    continue
                order = a + np.argsort(vec_ids[a:b], kind="stable")          # ties go to the smaller id
                scores = q[at:at + 128] @ vectors[order].T
                for i, row in enumerate(scores):
                    query_id = int(queries["query_id"].iloc[at + i])
                    row[vec_ids[order] == query_id] = -np.inf
                    least = max(float(queries["limit"].iloc[at + i]), float(np.partition(row, -k)[-k]) if len(row) > k else -np.inf)
                    good = np.flatnonzero((row >= least) & (row > -np.inf))
                    best = good[np.argsort(-row[good], kind="stable")[:k]]
                    out_q += [query_id] * len(best)
                    out_v += vec_ids[order[best]].tolist()
                    out_s += row[best].astype(np.int64).tolist()
            return pd.DataFrame({"query_id": pd.Series(out_q, dtype="int64"), "vec_id": pd.Series(out_v, dtype="int64"),
                                 "score": pd.Series(out_s, dtype="int64")})
        key = ["ring", "part", "chunk"]
        return given.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score long")


def _norms(batches):
    n, dimension, m2 = 0, 0, 0.0
    for batch in batches:
        for raw in batch.column("vec").to_pylist():
            x = np.frombuffer(raw, np.float64)
            n, dimension, m2 = n + 1, max(dimension, len(x)), max(m2, float(x @ x))
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([dimension]), pa.array([m2])], names=["n", "dimension", "m2"])


def top_k(vectors: DataFrame, is_query, k: int = K, chunk: int = CHUNK_QUERIES, **index_options) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query with
    the rows of other ids, best first, ties to the smaller vec_id; fewer rows if there are
    fewer. ``vectors``: vec_id, vec (see integer_vectors); is_query: condition on vec_id.

    A query id that occurs in several rows is asked once (with the smallest vector by
    bytes). Repeated candidate rows count as often as they occur. Vectors of fewer
    components count as filled with zeros. No rows give an empty result."""
    index = Index(vectors, **index_options)
    if not index.rows:
        return vectors.sparkSession.createDataFrame([], T.StructType([
            T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()),
            T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())]))
    queries = materialize(index.blocks.where(is_query).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")), "queries")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = materialize(index.meet(index.visits(queries, k, True), k, chunk), "near")
    limits = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("limit"))
    rest = index.visits(queries.join(limits, "query_id", "left"), k, False)
    both = near.unionByName(index.meet(rest, k, chunk))
    return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
