"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes two feature families: hashed byte trigrams over a folded alphabet
(log counts, weighted by inverse document frequency over the whole corpus) and a
profile of the text's form (shares of character classes, word length, repeated words
and lines), in soft bins. A truncated SVD of labelled reference documents gives the
latent space. The references' vectors are broadcast; every document is compared with
all of them by exact blocked cosine products, and its nearest neighbours vote with
weights that grow with their similarity.

References: at most ``per_class`` labelled documents of each class, chosen by a hash
of the id. That bounds the model: 2 * per_class vectors of ``rank`` floats and a
projection of DIMENSION x rank floats. Everything else covers all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlattice.llm.common import byte_texts, crc_mod, text_slices

TRIGRAM_DIMENSION = 4096
BINS = 12
PROFILE = 10
DIMENSION = TRIGRAM_DIMENSION + PROFILE * BINS
PER_CLASS = 1500
RANK = 48
NEIGHBOURS = 15
SHARPNESS = 8
PROFILE_WEIGHT = 1.0
_MIX = np.uint32(2654435761)
_PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Folded alphabet: letters keep their identity and case is a class of its own for
    capitals (one symbol per 4 letters); digits, blanks and each punctuation mark apart."""
    out = np.zeros(256, np.uint32)
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 70 + (b >> 4)
        elif "a" <= c <= "z":
            out[b] = 1 + b - 97
        elif "A" <= c <= "Z":
            out[b] = 27 + (b - 65) // 4
        elif c.isdigit():
            out[b] = 35
        elif c == "\n":
            out[b] = 36
        elif b <= 32 or b == 127:
            out[b] = 37
        else:
            out[b] = 38 + b % 32
    return out


_CLASS = _classes()
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15                 # odd, so that it has an inverse modulo 2 ** 64
_SALT = np.random.default_rng(7).integers(1, 1 << 62, size=256, dtype=np.int64).view(np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, 1 << 17), _powers(pow(_BASE, -1, 1 << 64), 1 << 17)


def _word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each word, from running sums."""
    n = len(raw)
    up, down = (_UP, _DOWN) if n <= len(_UP) else (_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_SALT[raw] * up[:n], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def _profile(raw: np.ndarray, text: bytes) -> np.ndarray:
    """PROFILE numbers in 0..1 that describe the form of a text."""
    n = len(raw)
    bytes_seen = np.bincount(raw, minlength=256)
    uppers, digits = int(bytes_seen[65:91].sum()), int(bytes_seen[48:58].sum())
    letters = uppers + int(bytes_seen[97:123].sum() + bytes_seen[128:].sum())
    some = max(1, n - int(bytes_seen[_IS_BLANK].sum()))
    marks = max(0, some - letters - digits)
    padded = np.ones(n + 2, bool)
    padded[1:-1] = _IS_BLANK[raw]
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    starts, ends = edge[::2], edge[1::2]
    repeated = distinct = distinct_pairs = single = length = 0.0
    if len(starts):
        hashes = _word_hashes(raw, starts, ends)
        pairs = hashes[1:] * np.uint64(_BASE) + hashes[:-1]
        repeated = float((hashes[1:] == hashes[:-1]).mean()) if len(pairs) else 0.0
        distinct = len(np.unique(hashes)) / len(hashes)
        distinct_pairs = len(np.unique(pairs)) / len(pairs) if len(pairs) else 1.0
        single = float((ends - starts == 1).mean())
        length = min(1.0, float((ends - starts).mean()) / 16)
    lines = [x for x in text.split(b"\n") if x]
    same_lines = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return np.array([uppers / max(1, letters), marks / some, digits / some, repeated, distinct, distinct_pairs,
                     single, length, same_lines, min(1.0, np.log1p(n) / 14)])


def trigram_counts(raw: np.ndarray) -> np.ndarray:
    """Counts of hashed trigrams of folded bytes, whole text."""
    counts = np.zeros(TRIGRAM_DIMENSION, np.int64)
    for at in range(0, max(0, len(raw) - 2), _PIECE):
        c = _CLASS[raw[at:at + _PIECE + 2]]
        code = (c[:-2] * np.uint32(128) + c[1:-1]) * np.uint32(128) + c[2:]
        counts += np.bincount(code * _MIX >> np.uint32(20), minlength=TRIGRAM_DIMENSION)
    return counts


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, values) of the raw features: trigram counts, then binned profile."""
    raw = np.frombuffer(text or b"", np.uint8)
    counts = trigram_counts(raw)
    spot = np.sqrt(np.clip(_profile(raw, text or b""), 0, 1)) * (BINS - 1)
    low = np.minimum(spot.astype(np.int64), BINS - 2)
    part = spot - low
    base = TRIGRAM_DIMENSION + np.arange(PROFILE) * BINS + low
    at = np.flatnonzero(counts)
    return np.concatenate((at, base, base + 1)), np.concatenate((counts[at], 1 - part, part))


def weighted(places: np.ndarray, values: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Feature values after weighting: each family has unit length (profile times its weight)."""
    n = len(places) - 2 * PROFILE                              # the profile stands last
    out = np.concatenate((np.log1p(values[:n]) * idf[places[:n]], values[n:]))
    out[:n] /= max(1e-12, float(np.linalg.norm(out[:n])))
    out[n:] *= PROFILE_WEIGHT / max(1e-12, float(np.linalg.norm(out[n:])))
    return out


# ------------------------------------------------------------------------ fit
def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each hashed trigram, and all documents: over every row."""
    def count(batches):
        df, n = np.zeros(TRIGRAM_DIMENSION + 1, np.int64), 0
        for part in text_slices(batches):
            for text in byte_texts(part.column("text")):
                df[:TRIGRAM_DIMENSION] += trigram_counts(np.frombuffer(text or b"", np.uint8)) > 0
                n += 1
        df[TRIGRAM_DIMENSION] = n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(df))), pa.array(df)], names=["place", "n"])
    rows = (docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "place long, n long")
            .groupBy("place").agg(F.sum("n").alias("n")).collect())    # TRIGRAM_DIMENSION + 1 rows
    out = np.zeros(TRIGRAM_DIMENSION + 1, np.int64)
    for r in rows:
        out[r["place"]] = r["n"]
    return out[:-1], int(out[-1])


def references(docs: DataFrame, labelled: DataFrame, per_class: int) -> tuple[list, np.ndarray]:
    """Raw features and labels of the reference documents. ``labelled``: doc_id, label."""
    chosen = [labelled.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    wanted = chosen[0].unionByName(chosen[1])                  # at most 2 * per_class ids

    def extract(batches):
        for part in text_slices(batches):
            both = [features(t) for t in byte_texts(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"),
                                              pa.array([p.astype(np.int32) for p, _ in both], pa.list_(pa.int32())),
                                              pa.array([v.astype(np.float32) for _, v in both], pa.list_(pa.float32()))],
                                             names=["doc_id", "label", "places", "values"])
    table = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "label")
             .mapInArrow(extract, "doc_id long, label int, places array<int>, values array<float>").toArrow())
    rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("label").to_pylist(),
                      table.column("places").to_pylist(), table.column("values").to_pylist()))
    seen, out = set(), []
    for doc_id, label, places, values in rows:                 # a repeated id counts once
        if doc_id not in seen:
            seen.add(doc_id)
            out.append((label, np.array(places, np.int64), np.array(values, np.float64)))
    return [(p, v) for _, p, v in out], np.array([x for x, _, _ in out], np.float32)


def latent_space(raw: list, idf: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(projection DIMENSION x rank, unit reference vectors) by randomised truncated SVD."""
    matrix = np.zeros((len(raw), DIMENSION), np.float32)
    for row, (places, values) in zip(matrix, raw):
        np.add.at(row, places, weighted(places, values, idf).astype(np.float32))
    rank = max(1, min(rank, *matrix.shape))
    probe = np.random.default_rng(11).standard_normal((DIMENSION, min(rank + 16, DIMENSION))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(matrix @ probe)
        probe = matrix.T @ basis
    _, _, right = np.linalg.svd(basis.T @ matrix, full_matrices=False)
    projection = np.ascontiguousarray(right[:rank].T)
    vectors = matrix @ projection
    return projection, vectors / np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))


def fit(docs: DataFrame, labelled: DataFrame, per_class: int = PER_CLASS, rank: int = RANK) -> dict:
    """Model from ``docs`` (doc_id, text) and ``labelled`` (doc_id, label 0/1, one row
    per id). No labelled document: the model votes 0.5 for every text."""
    df, n = document_frequency(docs)
    raw, labels = references(docs, labelled, per_class)
    idf = np.log((1 + n) / (1 + df)) + 0.1
    if not raw:
        return {"idf": idf, "projection": np.zeros((DIMENSION, 1), np.float32), "vectors": np.zeros((0, 1), np.float32), "labels": labels}
    projection, vectors = latent_space(raw, idf, rank)
    return {"idf": idf, "projection": projection, "vectors": vectors, "labels": labels}


# ---------------------------------------------------------------------- score
def vote(model: dict, texts: list[bytes | None], neighbours: int = NEIGHBOURS, block: int = 128) -> np.ndarray:
    """Score of each text: the neighbours' labels weighted by similarity ** SHARPNESS."""
    out = np.full(len(texts), 0.5)
    k = min(neighbours, len(model["labels"]))
    for lo in range(0, len(texts) if k else 0, block):
        latent = np.stack([weighted(p, v, model["idf"]).astype(np.float32) @ model["projection"][p]
                           for p, v in map(features, texts[lo:lo + block])])
        latent /= np.maximum(1e-12, np.linalg.norm(latent, axis=1, keepdims=True))
        cosine = latent @ model["vectors"].T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, 1), 1e-6, None) ** SHARPNESS
        out[lo:lo + block] = (weight * model["labels"][near]).sum(1) / weight.sum(1)
    return np.clip(out, 0.0, 1.0)


def score(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``docs`` with a new last column (0 to 1), replacing one of that name; every row and
    other column stays. Null text counts as empty."""
    docs = docs.drop(column)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in text_slices(batches):
            scores = vote(shared.value, byte_texts(part.column("text").cast(pa.string())))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores)], names=[*part.schema.names, column])
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())]))


def training_labels(labels: DataFrame, column: str = "quality") -> DataFrame:
    """One row (doc_id, label) per labelled id whose crc32 modulo 3 is not 1. Rows with
    a null id or label do not count; an id labelled both ways takes the majority, 1 on a tie."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.when(F.avg(F.col(column).cast("double")) >= 0.5, 1).otherwise(0).alias("label"))
