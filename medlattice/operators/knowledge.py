"""Knowledge-base data side (K1–K7): passages, de-duplication, text repair,
lexical (BM25) and dense (cosine) retrieval, citation rows.

The reference delegates all of this to a hosted retrieve-and-generate
service; these are the Spark jobs a user would run to build and query the
same corpus. Scoring is exact; only ``retrieve_dense_approx`` approximates.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .topk import top_k_per_key

WS = r"[ \t\n\x0B\f\r]+"           # whitespace, spelled out so Java and RE2 agree
NON_LETTER = r"[^\p{L}]+"           # token separator for retrieval


# --- K1 ------------------------------------------------------------------------------

def split_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   max_words: int = 200) -> DataFrame:
    """Documents -> passages at blank lines and before markdown headings;
    passages longer than ``max_words`` are cut into consecutive word windows.
    Returns (doc_id, passage_no, text, word_count); passage_no counts from 1. Passages
    are cut and numbered inside their document's row, without a shuffle.
    """
    blocks = F.split(F.regexp_replace(F.col(text), r"\n#", "\n\n#"), r"\n[ \t\x0B\f\r]*\n")
    words = F.transform(blocks, lambda block: F.filter(F.split(block, WS), lambda w: w != ""))
    # an empty block has no chunk: the sequence would run backward
    chunks = F.transform(F.filter(words, lambda w: F.size(w) > 0), lambda w: F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(w) / max_words).cast("int") - 1), lambda i: F.slice(w, i * max_words + 1, max_words)))
    out = docs.select(doc_id, F.posexplode(F.flatten(chunks)).alias("_at", "_words"))
    return out.select(doc_id, (F.col("_at") + 1).alias("passage_no"), F.array_join("_words", " ").alias("text"), F.size("_words").alias("word_count"))


# --- K2 ------------------------------------------------------------------------------

def normalize_for_dedupe(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), WS, " "))


def dedupe_passages(passages: DataFrame, keys: tuple[str, str] = ("doc_id", "passage_no"),
                    text: str = "text") -> DataFrame:
    """Drop repeated passages (after lower-casing and collapsing whitespace);
    the first copy by (doc_id, passage_no) wins. Only the hash and the keys are
    aggregated (with a map-side partial, so a passage repeated in a third of all
    documents is reduced before the shuffle); the winners' texts are joined by key."""
    hashed = passages.withColumn("content_hash", F.sha2(normalize_for_dedupe(text), 256))
    best = hashed.groupBy("content_hash").agg(F.min(F.struct(*keys)).alias("_m"), F.count(F.lit(1)).alias("copies"))
    winners = best.select(*[F.col(f"_m.{k}").alias(k) for k in keys], "copies", "content_hash")
    return passages.join(winners, list(keys)).select(*passages.columns, "copies", "content_hash")


def shingle_set(text: str | Column, size: int = 5) -> Column:
    """Sorted distinct hashes of the runs of ``size`` words of a normalised text; fewer words
    are one run, none (or null) the empty set."""
    words = F.filter(F.split(normalize_for_dedupe(text), " "), lambda w: w != "")
    # a lambda over the one array of words: written into the inner one, it would be split for every run
    runs = F.transform(F.array(words), lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (size - 1), F.lit(1))),
                                                             lambda i: F.xxhash64(F.array_join(F.slice(w, i, size), " "))))
    return F.when(normalize_for_dedupe(text) != "", F.array_sort(F.array_distinct(runs[0]))).otherwise(F.array().cast("array<long>"))


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` through a table in the shared scratch folder: made once, however often it is read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


COUNTERS = 1 << 17


def common_order(sets: DataFrame, items: str = "items") -> bytes:
    """How common the items of ``sets`` are: they are counted over all sets in COUNTERS counters,
    by their value, and each counter's place among the others by its count, rarest first, is given
    in two bytes. Items that share a counter share its place, so with their value as a tie this is
    one order of all items, rare ones first as far as the counters tell them apart."""
    at = F.pmod(F.col("item"), F.lit(COUNTERS)).cast("int")
    counted = sets.select(F.explode(items).alias("item")).groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    n = np.zeros(COUNTERS, np.int64)
    for part in counted.collect():                                         # at most COUNTERS rows
        n[part["at"]] = part["n"]
    return (np.searchsorted(np.sort(n), n) * 65536 // COUNTERS).astype(">u2").tobytes()


def prefix(items: str | Column, order: bytes, similarity: float) -> Column:
    """The first m - ceil(similarity * m) + 1 of m items, rare ones first by ``common_order``."""
    items = F.col(items) if isinstance(items, str) else items
    place = F.lit(order)
    placed = F.transform(items, lambda x: F.struct(F.substring(place, (F.pmod(x, F.lit(COUNTERS)) * 2 + 1).cast("int"), F.lit(2)).alias("n"), x.alias("item")))
    m = F.size(items)
    return F.transform(F.slice(F.array_sort(placed), F.lit(1), (m - F.ceil(m * similarity - 1e-9) + 1).cast("int")), lambda x: x["item"])


def similar_sets(sets: DataFrame, prefixes: DataFrame, similarity: float = 0.8) -> DataFrame:
    """All pairs (a, b, similarity) of the sets (id, items) with a Jaccard similarity of at
    least ``similarity``, each once; an id that stands in several rows has the same items in
    all. Exact, by prefixes: with the items of every set in one order, rare ones first, two
    such sets share an item of their first m - ceil(similarity * m) + 1 (``prefixes``: id, m,
    head). A pair meets on (item, length class), is dropped where the
    lengths or the items after the first common one cannot reach the similarity, and is
    verified on the whole sets. A common item stands in a prefix only where a set has hardly
    any other; what then meets on it is split by length, and by AQE into pieces of both sides.
    The places and lengths of an index row are packed, and only prefixes are shuffled by item.
    """
    tiny = 1e-9
    step = F.floor(F.log("m") / -math.log(similarity) + tiny)
    # length and place in one number; rows that meet under a clash of the key are told apart by the whole sets
    index = prefixes.where("m > 0").select("id", step.alias("step"), F.posexplode("head").alias("at", "item"), "m").select(
        "id", "step", "item", (F.shiftleft(F.col("m").cast("long"), 32) + F.col("at")).alias("m_at"))
    key = F.xxhash64("item", "step").alias("key")
    short = index.withColumn("step", F.explode(F.array("step", F.col("step") + 1))).select(F.col("id").alias("a"), F.col("m_at").alias("ma_at"), key)
    long = index.select(F.col("id").alias("b"), F.col("m_at").alias("mb_at"), key)

    def parts(c: str) -> tuple[Column, Column]:
        return F.shiftright(c, 32), F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    (ma, at_a), (mb, at_b) = parts("ma_at"), parts("mb_at")
    bar = (ma + mb) * similarity - tiny                                     # both >= bar <=> common * (1 + similarity) >= bar
    rest = 1 + F.least(ma - 1 - at_a, mb - 1 - at_b)
    met = (short.join(long, "key").where((ma < mb) | ((ma == mb) & (F.col("a") < F.col("b"))))
           .where((ma >= mb * similarity - tiny) & (rest * (1 + similarity) >= bar))
           .select("a", "b").distinct())
    once = sets.groupBy("id").agg(F.first("items").alias("items"))
    whole = (met.join(once.select(F.col("id").alias("a"), F.col("items").alias("_a")), "a")
             .join(once.select(F.col("id").alias("b"), F.col("items").alias("_b")), "b")
             .select("a", "b", F.size("_a").alias("ma"), F.size("_b").alias("mb"), F.size(F.array_intersect("_a", "_b")).alias("common")))
    bar = (F.col("ma") + F.col("mb")) * similarity - tiny
    return (whole.where(F.col("common") * (1 + similarity) >= bar)
            .select("a", "b", (F.col("common") / (F.col("ma") + F.col("mb") - F.col("common"))).alias("similarity")))


def near_copies(passages: DataFrame, keys: tuple[str, str] = ("doc_id", "passage_no"), text: str = "text",
                size: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row per passage. Passages with the same set of word shingles are a class, named by
    its first passage (first_<key>) and counted (copies). ``links`` counts the other classes
    with a Jaccard similarity of at least ``similarity``, ``best`` is the largest of these
    similarities (null without links), and ``kept`` marks the first passage of each class
    that no earlier class is linked with. Passages without words are one class without links.
    Pairs are made between classes only, never between copies."""
    hashed = passages.select(*keys, shingle_set(text, size).alias("items"))
    hashed = hashed.withColumn("id", F.unhex(F.md5(F.array_join(F.col("items").cast("array<string>"), ","))))
    hashed = _written(hashed, "shingles")
    told = hashed.select(*keys, "id", F.size("items").alias("m"), prefix("items", common_order(hashed), similarity).alias("head"))
    classes = _written(told.groupBy("id").agg(F.min(F.struct(*keys)).alias("first"), F.count(F.lit(1)).alias("copies"),
                                              F.first("m").alias("m"), F.first("head").alias("head")), "classes")
    pairs = similar_sets(hashed.select("id", "items"), classes.select("id", "m", "head"), similarity)
    pairs = (pairs.join(classes.select(F.col("id").alias("a"), F.col("first").alias("_a")), "a")
             .join(classes.select(F.col("id").alias("b"), F.col("first").alias("_b")), "b"))
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), (F.col("_b") < F.col("_a")).alias("later"), "similarity"),
        F.struct(F.col("b").alias("id"), (F.col("_a") < F.col("_b")).alias("later"), "similarity"))).alias("e")).select("e.*")
    linked = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"), F.max("similarity").alias("best"), F.max("later").alias("later"))
    told = classes.drop("m", "head").join(linked, "id", "left")
    return hashed.drop("items").join(told, "id").select(
        *keys, *[F.col(f"first.{k}").alias(f"first_{k}") for k in keys], "copies", F.coalesce("links", F.lit(0)).alias("links"),
        F.round("best", 6).alias("best"),
        (F.struct(*keys).eqNullSafe(F.col("first")) & ~F.coalesce("later", F.lit(False))).alias("kept"))


# --- K3 ------------------------------------------------------------------------------

def _damaged_bytes() -> list[str]:
    """What each byte from 0x80 on looks like when read as Windows-1252; the five bytes
    that it leaves undefined are the C1 controls of the same number."""
    return [bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in range(0x80, 0x100)]


_SEEN = _damaged_bytes()
_LEADS = "".join(_SEEN[0x42:0x75])                 # 0xC2 to 0xF4 begin a character of two to four bytes
_TRAILS = "".join(_SEEN[:0x40])                    # 0x80 to 0xBF go on
_TWO, _THREE, _FOUR = "".join(_SEEN[0x42:0x60]), "".join(_SEEN[0x60:0x70]), "".join(_SEEN[0x70:0x75])


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


#: damaged characters: a lead byte with the one to three bytes that belong to it
DAMAGED = f"{_class(_TWO)}{_class(_TRAILS)}|{_class(_THREE)}{_class(_TRAILS)}{{2}}|{_class(_FOUR)}{_class(_TRAILS)}{{3}}"


def damage_text(c: str | Column) -> Column:
    """Text whose UTF-8 bytes were read as Windows-1252: the damage that K3 undoes."""
    c = F.col(c) if isinstance(c, str) else c
    return _latin_to_seen(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"))


# ISO-8859-1 reads a byte as the character of its number; Windows-1252 differs in 0x80-0x9F only
_NUMBERS, _LOOKS = "".join(map(chr, range(0x80, 0xA0))), "".join(_SEEN[:0x20])


def _latin_to_seen(c: Column) -> Column:
    return F.translate(c, _NUMBERS, _LOOKS)


def repair_text(c: str | Column) -> Column:
    """K3: undo UTF-8-read-as-Windows-1252 mojibake (``Â°C`` -> ``°C``) in one pass.

    The text is split at the damaged characters, each being a lead byte's letter with as
    many followers as it announces; each of them alone is turned back to bytes and decoded.
    What is repaired is never looked at again, so a repaired character cannot join the
    next one to another damaged one. A sequence that is no character (an overlong form or
    a surrogate) stays as it is. Text without a lead stays untouched."""
    c = F.col(c) if isinstance(c, str) else c

    def undo(bad: Column) -> Column:
        raw = F.encode(F.translate(bad, _LOOKS, _NUMBERS), "ISO-8859-1")
        return F.coalesce(F.try_validate_utf8(raw.cast("string")), bad)
    damaged = F.regexp_extract_all(c, F.lit(f"({DAMAGED})"), 1)
    # each side is computed once; behind the last text there is no damaged character
    pieces = F.zip_with(F.split(c, DAMAGED, -1), damaged, lambda text, bad: F.concat(text, F.coalesce(undo(bad), F.lit(""))))
    return F.when(c.rlike(_class(_LEADS)), F.array_join(pieces, "")).otherwise(c)


# --- K4 ------------------------------------------------------------------------------

def tokens(c: str | Column) -> Column:
    """Lower-cased letter runs (``array_remove`` stays in generated code,
    unlike a lambda filter)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_remove(F.split(F.lower(c), NON_LETTER), "")


def term_counts(docs: DataFrame, vocab: DataFrame | None, *kept: str) -> DataFrame:
    """(term, doc_id, dl, ``kept``, tf): how often the terms of ``vocab`` stand in ``docs``
    (doc_id, text, ``kept``); only these are exploded and counted. dl: all tokens."""
    d = docs.select("doc_id", *kept, tokens("text").alias("toks")).withColumn("dl", F.size("toks"))
    # explode_outer: a plain explode makes Catalyst infer size(toks) > 0 and push
    # that (a second tokenization) into the scan.
    t = d.select("doc_id", *kept, "dl", F.explode_outer("toks").alias("term"))
    if vocab is not None:
        t = t.join(vocab, "term", "left_semi")
    else:
        t = t.filter(F.col("term").isNotNull())
    return t.groupBy(*kept, "term", "doc_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def idf(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, idf) of ``term_counts``: an aggregate with partials, so a term found in every
    document is no hot partition."""
    df_t = tf.groupBy("term").agg(F.sum(F.when(F.col("tf") > 0, 1).otherwise(0)).alias("df"))
    return df_t.select("term", F.log(F.lit(1.0) + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25_weight(avgdl: float, k1: float = 1.2, b: float = 0.75) -> Column:
    """BM25 contribution ``idf * tf(k1+1) / (tf + k1(1-b+b*dl/avgdl))`` of a row with idf, tf and dl."""
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("dl") / F.lit(avgdl if avgdl > 0 else 1.0))
    return F.col("idf") * F.col("tf") * F.lit(k1 + 1.0) / (F.col("tf") + norm)


DOCS_A_BLOCK = 1024


def retrieve_lexical(questions: DataFrame, docs: DataFrame, k: int = 3, qid: str = "question_id",
                     qtext: str = "question", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """K4: top-k documents per question by BM25 over distinct query terms.
    Scores are rounded to 6 places before ranking (sum order is not fixed);
    ties go to the smaller doc id. ``relevance_score`` scales each
    question's scores to [0, 1] by its best score.

    Documents are shuffled once, into blocks of about DOCS_A_BLOCK. Their terms are counted,
    meet the questions' terms (broadcast while Spark takes them for small, else shuffled by
    term), are added up and cut to the k best of each question inside the block, so neither
    postings nor scores are shuffled, and what a task holds does not grow with the documents."""
    q = questions.select(F.col(qid).alias("qid"), F.explode(F.array_distinct(tokens(qtext))).alias("term"))
    vocab = q.select("term").distinct()
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    stats = d.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(tokens("text"))).alias("avgdl")).first()
    blocks = max(1, math.ceil(stats["n"] / DOCS_A_BLOCK))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks))).repartition(blocks, "block")
    tf = term_counts(d, vocab, "block")
    asked = _written(q.join(idf(tf, int(stats["n"])), "term"), "asked-terms")    # its size, not that of the documents, decides the join
    met = tf.join(asked, "term")
    scores = (met.groupBy("block", "qid", "doc_id").agg(F.round(F.sum(bm25_weight(float(stats["avgdl"] or 0.0))), 6).alias("score"))
              .drop("block"))
    top = top_k_per_key(scores, ["qid"], [F.col("score").desc(), F.col("doc_id").asc()], k, rank_col="rank",
                        order_names=["score", "doc_id"])
    best = F.max("score").over(Window.partitionBy("qid"))
    return top.select(F.col("qid").alias(qid), "rank", F.col("doc_id").alias(doc_id), "score",
                      F.round(F.when(best > 0, F.col("score") / best).otherwise(F.lit(0.0)), 6)
                      .alias("relevance_score"))


# --- K5 ------------------------------------------------------------------------------

BLOCK_ROWS = 4096
TILE_QUERIES = 1024
ROWS_OUT = 16384
#: vectors and queries that one task of the cell index holds at most
SHARD_ROWS = 1 << 16
ASKED_ROWS = 1 << 17
GROUP = 32
_HITS = "qid long, vid long, cosine double"
_HIT_TYPES = pa.schema([("qid", pa.int64()), ("vid", pa.int64()), ("cosine", pa.float64())])


def _unit(vectors) -> np.ndarray:
    """Vectors as unit rows (a zero vector becomes NaN: its cosine is undefined)."""
    m = vectors if isinstance(vectors, np.ndarray) and vectors.ndim == 2 else np.stack([np.asarray(v, np.float64) for v in vectors])
    with np.errstate(divide="ignore", invalid="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _best(qids: np.ndarray, q: np.ndarray, vids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one block for every query, ties to the smaller id; products are
    made for TILE_QUERIES queries at a time."""
    order = np.argsort(vids, kind="stable")
    vids, v = vids[order], v[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    undefined, groups = np.isnan(q).any() or np.isnan(v).any(), len(v) // GROUP
    for lo in range(0, len(q), TILE_QUERIES):
        sims = q[lo:lo + TILE_QUERIES] @ v.T
        ranked = np.nan_to_num(sims, nan=-np.inf) if undefined else sims
        # the k-th best of some groups' best is at most the k-th best of all; rounding moves either by half a millionth
        least = np.full((len(ranked), 1), -np.inf)
        if groups >= k:
            tops = ranked[:, :groups * GROUP].reshape(len(ranked), groups, GROUP).max(axis=2)
            least = np.partition(tops, -k, axis=1)[:, -k, None] - 2e-6
        # all that may be among a query's k best, in the order of their ids, then the best first
        i, j = np.nonzero(ranked >= least)
        cosine = np.round(sims[i, j], 6)
        best = np.lexsort((j, -np.nan_to_num(cosine, nan=-np.inf), i))
        i, j, cosine = i[best], j[best], cosine[best]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((qids[lo + i[kept]], vids[j[kept]], cosine[kept]))
    return pd.DataFrame({name: np.concatenate([o[j] for o in out]) for j, name in enumerate(("qid", "vid", "cosine"))})


PAIRS_A_TASK = 8


def _in_blocks(df: DataFrame, key: str, name: str, rows: int) -> tuple[DataFrame, int]:
    """(name: block number, rows: its (id, vec)) with about ``rows`` vectors a block."""
    blocks = max(1, math.ceil(df.count() / rows))
    b = df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    return b.groupBy(name).agg(F.collect_list(F.struct(F.col(key).alias("id"), "vec")).alias(f"{name}_rows")), blocks


def retrieve_dense(spark: SparkSession, queries: DataFrame, corpus: DataFrame, k: int = 5,
                   qid: str = "qid", qvec: str = "vec", vid: str = "vid", vvec: str = "vec",
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """K5: exact top-k corpus vectors per query vector by cosine similarity.

    Both sides are packed into blocks of about ``block_rows`` vectors, and every query block
    meets every corpus block once. The blocks of the larger side are dealt into parts and
    shuffled once; each part gets a copy of the other side's blocks, and a task goes through
    the pairs of some parts, about PAIRS_A_TASK, one pair at a time, and keeps the k best per
    query. A window picks the global k. Nothing passes through the driver but the two row
    counts.
    """
    q = queries.select(F.col(qid).alias("qid"), F.col(qvec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    c = corpus.select(F.col(vid).alias("vid"), F.col(vvec).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
    qb, n = _in_blocks(q, "qid", "qb", block_rows)
    cb, m = _in_blocks(c, "vid", "cb", block_rows)
    stay, moved, at = (cb, qb, "cb") if m >= n else (qb, cb, "qb")
    parts = min(max(n, m), math.ceil(n * m / PAIRS_A_TASK))
    stay = stay.withColumn("part", F.pmod(at, F.lit(parts))).repartition(parts, "part")
    pairs = stay.join(moved.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), "part")

    def block(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        vecs = rows.field("vec")
        if len(set(np.diff(vecs.offsets.to_numpy()).tolist())) > 1:
            raise ValueError("vectors of different lengths")
        ids = rows.field("id")
        ids = np.array(ids.to_pylist()) if ids.null_count else ids.to_numpy()
        return ids, _unit(vecs.flatten().to_numpy(zero_copy_only=False).reshape(len(vecs), -1))

    def fn(batches):
        for part in batches:
            for qrows, crows in zip(part.column("qb_rows"), part.column("cb_rows")):
                yield pa.RecordBatch.from_pandas(_best(*block(qrows.values), *block(crows.values), k), _HIT_TYPES, preserve_index=False)
    local = pairs.select("qb_rows", "cb_rows").mapInArrow(fn, _HITS)
    top = top_k_per_key(local, ["qid"], [F.col("cosine").desc_nulls_last(), F.col("vid").asc()], k,
                        rank_col="rank", order_names=["cosine", "vid"])
    return top.select(F.col("qid").alias(qid), "rank", F.col("vid").alias(vid), "cosine")


# --- K6 ------------------------------------------------------------------------------

def _probed(q: np.ndarray, centres: np.ndarray, held: np.ndarray, margin: float, k: int) -> np.ndarray:
    """(queries, cells): which cells each of the unit vectors ``q`` probes: those within
    ``margin`` of its closest one, and the closest ones until k vectors are in them."""
    near = np.nan_to_num(q @ centres.T, nan=-1.0)
    order = np.argsort(-near, axis=1, kind="stable")
    close = np.take_along_axis(near, order, 1) >= near.max(axis=1, keepdims=True) - margin
    before = np.cumsum(held[order], axis=1) - held[order]
    out = np.zeros(near.shape, bool)
    np.put_along_axis(out, order, (close | (before < k)) & (held[order] > 0), 1)
    return out


def _grid(vectors: int, queries: int, cores: int) -> tuple[int, int]:
    """Vectors of a shard and queries of a chunk: as many as a task may hold, fewer while that
    leaves cores idle. Each vector is sent once for each chunk and each query once for each
    shard, so the larger both are, the less is shuffled."""
    side = math.ceil(math.sqrt(2 * cores))
    return tuple(min(most, max(BLOCK_ROWS, math.ceil(n / side))) for n, most in ((vectors, SHARD_ROWS), (queries, ASKED_ROWS)))


class CellIndex:
    """Corpus vectors by nearest k-means centroid (about sqrt(n) cells, fitted by Spark).
    A query probes every cell whose centroid is within ``margin`` (in cosine) of its closest
    one: few where the vectors have structure, most where they have none. The margin is
    not set but measured: the exact neighbours of ``sample`` corpus vectors (a fixed bound,
    the least by a hash of the id) tell in which cells neighbours lie, and the margin is
    the least that reaches them in a share of ``recall``. Cells larger than a block are
    dealt into parts by a hash of the id."""

    def __init__(self, corpus: DataFrame, recall: float = 0.95, sample: int = 256, seed: int = 7,
                 block_rows: int = BLOCK_ROWS):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.recall, self.sample, self.margins = recall, sample, {}
        c = corpus.select("vid", F.col("vec").cast("array<double>").alias("vec"))
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        unit = c.where(norm > 0).select("vid", F.transform("vec", lambda x: x / norm).alias("vec"))
        n = unit.count()
        features = unit.select(array_to_vector("vec").alias("features"))
        model = KMeans(k=max(2, round(math.sqrt(max(n, 1)))), seed=seed, maxIter=10).fit(features)
        self.centres = _unit(model.clusterCenters())                       # about sqrt(n) vectors
        self.cells = unit.mapInPandas(self._nearest(), "vid long, vec array<double>, cell int")
        self.sizes = self.cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).withColumn(
            "parts", F.ceil(F.col("n") / F.lit(block_rows)).cast("int"))
        self.held = np.zeros(len(self.centres), np.int64)
        for r in self.sizes.collect():                                     # about sqrt(n) rows
            self.held[r["cell"]] = r["n"]

    def margin(self, k: int) -> float:
        """The least margin that reaches a share of ``recall`` of the k nearest neighbours
        (other than themselves) of the sampled vectors."""
        if k not in self.margins:
            asked = self.cells.orderBy(F.xxhash64("vid"), "vid").limit(self.sample)
            near = retrieve_dense(self.cells.sparkSession, asked.select(F.col("vid").alias("qid"), "vec"), self.cells.select("vid", "vec"), k + 1)
            found = near.where("qid <> vid").join(self.cells.select("vid", "cell"), "vid").select("qid", "cell").collect()   # sample * k rows
            rows = asked.select("vid", "vec").collect() if found else []                                                     # sample rows
            to_centres = dict(zip([r["vid"] for r in rows], _unit([r["vec"] for r in rows]) @ self.centres.T)) if rows else {}
            gaps = sorted(float(to_centres[r["qid"]].max() - to_centres[r["qid"]][r["cell"]]) for r in found)
            self.margins[k] = gaps[math.ceil(self.recall * len(gaps)) - 1] + 1e-9 if gaps else 2.0
        return self.margins[k]

    def _nearest(self):
        centres = self.centres

        def fn(batches):
            for pdf in batches:
                if len(pdf):
                    yield pdf.assign(cell=(_unit(pdf["vec"]) @ centres.T).argmax(axis=1).astype("int32"))
        return fn

    def _sent(self, queries: DataFrame, k: int, groups: np.ndarray, name: str) -> DataFrame:
        """(qid, vec, ``name``): each query with the numbers in ``groups`` (one a cell) of the
        cells that it probes, each once. Rows leave in batches of at most ROWS_OUT vectors."""
        centres, held, margin = self.centres, self.held, self.margin(k)

        def fn(batches):
            of = np.zeros((len(groups), int(groups.max()) + 1), np.int32)
            of[np.arange(len(groups)), groups] = 1
            for pdf in batches:
                for at in range(0, len(pdf), TILE_QUERIES):
                    tile = pdf.iloc[at:at + TILE_QUERIES]
                    i, j = np.nonzero(_probed(_unit(tile["vec"]), centres, held, margin, k) @ of)
                    for lo in range(0, len(i), ROWS_OUT):
                        to = i[lo:lo + ROWS_OUT]
                        yield pd.DataFrame({"qid": tile["qid"].to_numpy()[to], "vec": tile["vec"].to_numpy()[to], name: j[lo:lo + ROWS_OUT].astype("int32")})
        # single precision stays as it is: half the bytes, the same numbers
        kind = queries.schema["vec"].dataType.simpleString()
        kind = kind if kind == "array<float>" else "array<double>"
        return queries.select("qid", F.col("vec").cast(kind).alias("vec")).where("vec IS NOT NULL") \
            .mapInPandas(fn, f"qid long, vec {kind}, {name} int")

    def probes(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, vec, cell): the cells that each query probes."""
        return self._sent(queries, k, np.arange(len(self.centres)), "cell")

    def search(self, queries: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
        """The k best of every query in each shard. Cells are laid together to shards of about
        ``block_rows`` vectors (if not given, as many as a task may hold: see _grid), so a query is
        sent once to a shard, not to each of its cells; there it meets the vectors of those cells
        only that it probes, some queries at a time."""
        asked_rows = block_rows
        if block_rows is None:
            block_rows, asked_rows = _grid(int(self.held.sum()), queries.count(), self.cells.sparkSession.sparkContext.defaultParallelism)
        shards = ((np.cumsum(self.held) - self.held) // block_rows).astype(np.int32)
        sizes = np.bincount(shards, self.held)
        shape = self.cells.sparkSession.createDataFrame([(i, max(1, math.ceil(n / block_rows))) for i, n in enumerate(sizes.tolist())], "shard int, parts int")
        numbers = F.array(*[F.lit(i) for i in shards.tolist()])
        asked = self._sent(queries, k, shards, "shard")
        shape = shape.join(asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(asked_rows)).cast("int").alias("chunks")), "shard")
        key = ["shard", "part", "chunk"]
        left = (self.cells.withColumn("shard", numbers[F.col("cell")]).join(shape, "shard")
                .withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
                .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(*key, "cell", "vid", "vec"))
        right = (asked.join(shape, "shard").withColumn("chunk", F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int"))
                 .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*key, "qid", "vec"))
        centres, held, margin = self.centres, self.held, self.margin(k)

        def fn(rows: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"qid": [], "vid": [], "cosine": []}).astype({"qid": "int64", "vid": "int64"})]
            if len(rows) and len(qs):
                v, vids, cells = _unit(rows["vec"]), rows["vid"].to_numpy(), list(rows.groupby("cell").indices.items())
                for at in range(0, len(qs), TILE_QUERIES):
                    tile = qs.iloc[at:at + TILE_QUERIES]
                    q, qids, found = _unit(tile["vec"]), tile["qid"].to_numpy(), []
                    wanted = _probed(q, centres, held, margin, k)
                    for cell, mine in cells:
                        ask = np.flatnonzero(wanted[:, cell])
                        if len(ask):
                            found.append(_best(qids[ask], q[ask], vids[mine], v[mine], k))
                    if found:
                        hits = pd.concat(found)
                        out.append(hits.sort_values(["qid", "cosine", "vid"], ascending=[True, False, True], na_position="last").groupby("qid").head(k))
            return pd.concat(out[1:] or out)
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(fn, _HITS)


def retrieve_dense_approx(queries: DataFrame, corpus: DataFrame, k: int = 5, qid: str = "qid", qvec: str = "vec",
                          vid: str = "vid", vvec: str = "vec", **index_options) -> DataFrame:
    """K6: approximate twin of K5 through ``CellIndex``: the best k of the vectors in the
    probed cells (no distance cut), so recall is below 1 by design: about ``recall``, the
    share that the index's margin was measured for."""
    q = queries.select(F.col(qid).alias("qid"), F.col(qvec).alias("vec"))
    c = corpus.select(F.col(vid).alias("vid"), F.col(vvec).alias("vec"))
    hits = CellIndex(c, **index_options).search(q, k)
    top = top_k_per_key(hits, ["qid"], [F.col("cosine").desc_nulls_last(), F.col("vid").asc()], k, rank_col="rank",
                        order_names=["cosine", "vid"])
    return top.select(F.col("qid").alias(qid), "rank", F.col("vid").alias(vid), "cosine")


# --- K7 ------------------------------------------------------------------------------

def citations_for_answers(hits: DataFrame, docs: DataFrame, qid: str = "question_id", doc_id: str = "doc_id",
                          text: str = "text", name: Column | None = None) -> DataFrame:
    """K7: ranked hits -> citation rows in the log's shape (R7) with the
    [0, 1] ``relevance_score`` the reference's table declares but never fills."""
    name = name if name is not None else F.concat(F.lit("doc-"), F.col(doc_id).cast("string"), F.lit(".md"))
    d = docs.select(doc_id, name.alias("source_document"),
                    F.when(F.coalesce(F.col(text), F.lit("")) == "", F.lit(None))
                    .otherwise(F.substring(text, 1, 1000)).alias("excerpt_text"))
    return hits.join(d, doc_id).select(
        F.col(qid).alias("query_id"), (F.col("rank") - 1).alias("citation_pos"), F.lit(0).alias("reference_pos"),
        "source_document", "excerpt_text", "relevance_score")
