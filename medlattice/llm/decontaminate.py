"""Benchmark decontamination with DataFrame functions only.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z in lower
case. A benchmark item gives every window of ``window`` consecutive words; an item of
fewer words is one window. A document word is hit if it lies in an occurrence of a
window.

Every window is keyed by the hash of one anchor inside it: the ``anchor_words``-gram
of smallest hash (shorter windows: all their words). Documents hash the grams at all
their positions and keep those whose hash is in the set of anchor hashes, which is
part of the plan; only these positions are exploded, joined with the broadcast windows
and verified word by word. The windows are shipped only if they number at most
``max_windows`` and hold at most ``max_bytes`` of words. Beyond that every position
is exploded and joined by shuffling; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 13
ANCHOR_WORDS = 4
MAX_WINDOWS = 100_000
MAX_BYTES = 64 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Normalised words; null has none."""
    parts = F.split(F.translate(text, _UPPER, _LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def _gram(words_name: str, position: str, length: int) -> str:
    return "xxhash64(" + ", ".join([str(length), *[f"{words_name}[{position} + {i}]" for i in range(length)]]) + ")"


def _positions(size: str, length: int) -> str:
    """SQL for the starts of all grams of the length."""
    return f"if({size} >= {length}, sequence(0, {size} - {length}), cast(array() as array<int>))"


def item_windows(benchmark: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """One row per distinct window: w (its words), anchor (hash), gram (the anchor's
    length), at (the anchor's place in the window), items (ids that hold the window)."""
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("all"))
             .withColumn("n", F.size("all")).where("n > 0"))
    starts = F.explode(F.expr(f"sequence(0, greatest(n - {window}, 0))"))
    distinct = (items.select("item_id", "all", starts.alias("s"))
                .select("item_id", F.slice("all", F.col("s") + 1, F.lit(window)).alias("w"))
                .groupBy("w").agg(F.collect_set("item_id").alias("items"))
                .withColumn("len", F.size("w")).withColumn("gram", F.least("len", F.lit(anchor_words))))
    grams = F.lit(None)
    for length in range(1, anchor_words + 1):
        each = F.expr(f"array_min(transform({_positions('len', length)}, i -> struct({_gram('w', 'i', length)} as h, i as i)))")
        grams = F.when(F.col("gram") == length, each).otherwise(grams)
    return distinct.withColumn("best", grams).select(
        "w", "len", "items", "gram", F.col("best.h").alias("anchor"), F.col("best.i").alias("at"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, anchor_words: int = ANCHOR_WORDS,
         max_windows: int = MAX_WINDOWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, text_key (sha-256 of the
    text), n_words, spans (array of (start, len) of the occurrences, in words), items
    (sorted ids, as strings, of the items with an occurring window), n_hit.

    Null or empty text: no words, no hits. A null item_id is no item, but its windows
    hit. Repeated rows, null ids and further columns are fine; an empty benchmark hits
    nothing.
    """
    windows = item_windows(benchmark, window, anchor_words)
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.array_join("w", " "))), F.lit(0)).alias("b"),
                       F.coalesce(F.sum(F.size("items")), F.lit(0)).alias("i"), F.collect_set("gram").alias("grams")).first()
    small = size["n"] <= max_windows and size["i"] <= max_windows and size["b"] <= max_bytes
    kept = []
    for length in sorted(size["grams"]):
        at = _positions("n_words", length)
        if small:
            hashes = [r[0] for r in windows.where(F.col("gram") == length).select("anchor").distinct().collect()]
            at = f"filter({at}, i -> {_gram('words', 'i', length)} in ({', '.join(f'{h}L' if h > -2**63 else 'bigint(-9223372036854775808)' for h in hashes)}))"
        kept.append(f"transform({at}, i -> struct({length} as gram, i as i))")
    none = "cast(array() as array<struct<gram:int,i:int>>)"
    rows = (docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
            .withColumn("row", F.monotonically_increasing_id())
            .select("row", "doc_id", F.sha2(F.col("text"), 256).alias("text_key"), words(F.col("text")).alias("words"))
            .withColumn("n_words", F.size("words"))
            .withColumn("found", F.expr(f"concat({', '.join([*kept, none])})"))
            .select("row", "doc_id", "text_key", "n_words", "words", F.explode_outer("found").alias("f")))
    key = F.lit(None).cast("long")
    for length in sorted(size["grams"]):
        key = F.when(F.col("f.gram") == length, F.expr(_gram("words", "f.i", length))).otherwise(key)
    # the words around the anchor are all that a window needs
    low = F.greatest(F.col("f.i") - (window - 1), F.lit(0))
    around = rows.select("row", "doc_id", "text_key", "n_words", key.alias("anchor"), F.col("f.i").alias("i"), low.alias("low"),
                         F.when(F.col("f").isNotNull(), F.slice("words", low + 1, F.lit(2 * window))).alias("near"))
    start = F.col("i") - F.col("at")
    there = F.when(start >= F.col("low"), F.slice("near", start - F.col("low") + 1, F.col("len")) == F.col("w")).otherwise(False)
    joined = around.join(F.broadcast(windows.drop("gram")) if small else windows.drop("gram"), "anchor", "left")
    hits = joined.select("row", "doc_id", "text_key", "n_words", F.when(there, F.struct(start.alias("start"), F.col("len"))).alias("span"),
                         F.when(there, F.col("items")).alias("items"))
    grouped = hits.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr("size(array_distinct(flatten(transform(spans, s -> sequence(s.start, s.start + s.len - 1)))))")
    return grouped.select("doc_id", "text_key", "n_words", "spans", "items", covered.alias("n_hit"))


def contaminated() -> Column:
    """A document is contaminated when hit words are at least a twentieth of its words."""
    return (F.col("n_hit") > 0) & (F.lit(20) * F.col("n_hit") >= F.col("n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents, other documents unchanged."""
    bad = scan(docs, benchmark, **options).where(contaminated()).select(
        F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & F.sha2(docs["text"].cast("string"), 256).eqNullSafe(bad["bad_key"])
    return docs.join(bad, same, "left_anti").select(docs.columns)


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(list_slice(w, s, s + least(len(w), 13) - 1), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM b WHERE len(w) > 0)),
grams AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT doc_id, s, n, item_id FROM grams JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
