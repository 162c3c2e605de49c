"""Language identification by interpolated Kneser-Ney character models.

Texts become symbols of 16 bits: every letter is its own code point in lower case (only
letters beyond the basic plane share the 6,400 private-use numbers), and one border symbol
stands for each run of non-letters. Counts of the symbol 4-grams of every language come
from all training documents, added up by Spark; lower orders use continuation counts. A
model holds, for every order, one sorted array of n-gram keys (perfect hashes of 64 bits:
the symbols as digits) and the log probabilities of all languages beside it. A text gets
the language of lowest cross-entropy per symbol.

Size of the broadcast model: it holds every 4-gram that a training row holds, so it does not
depend on how large the input is which of them count. It grows with the distinct 4-grams, not
with the rows. ``max_bytes``, if a caller sets it, bounds it instead: 4-grams below a least
count are then left out, the smallest power of two with which all languages' arrays fit.

Rejection is calibrated on the scored training documents: a language's threshold is the
cross-entropy that ``accept`` of its own documents stay below.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlattice.llm.common import materialize, text_slices

ORDER = 4
BITS = 16
ALPHABET = 1 << BITS
UNKNOWN = "und"
ACCEPT = 0.995
_BORDER, _SKIP = 0, ALPHABET - 1
_PRIVATE = 0xE000, 0xF900 - 0xE000            # numbers that are no letters, for letters beyond 16 bits
_PIECE = 1 << 20


def _symbol_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint16)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = cp if cp < ALPHABET else _PRIVATE[0] + cp % _PRIVATE[1]
        elif cp >= 0x300 and unicodedata.category(c)[0] == "M":
            out[cp] = _SKIP
    return out


def _head(keys: np.ndarray) -> np.ndarray:
    """All symbols but the last."""
    return keys >> np.uint64(BITS)


def _tail(keys: np.ndarray, symbols_kept: int) -> np.ndarray:
    """The last symbols."""
    return keys & np.uint64((1 << BITS * symbols_kept) - 1)


_SYMBOLS: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """Symbols of a text in lower case, closed by borders; runs of borders are one.
    A text without letters gives an empty array."""
    if not _SYMBOLS:
        _SYMBOLS.append(_symbol_table())
    if not any(c.isalpha() for c in text):
        return np.empty(0, np.uint16)
    cps = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    raw = _SYMBOLS[0][cps]
    raw = np.concatenate(([_BORDER], raw[raw != _SKIP], [_BORDER]))
    return raw[np.concatenate(([True], (raw[1:] != _BORDER) | (raw[:-1] != _BORDER)))].astype(np.uint16)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of the ORDER-grams of a text. The first symbols are seen
    after borders only, so every symbol but the first border is predicted once."""
    s = symbols(text) if text else np.empty(0, np.uint16)
    if not len(s):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    s = np.concatenate((np.zeros(ORDER - 2, np.uint16), s))
    keys, counts = [], []
    for at in range(0, len(s) - ORDER + 1, _PIECE):
        part = s[at:at + _PIECE + ORDER - 1]
        code = part[:len(part) - ORDER + 1].astype(np.uint64)
        for i in range(1, ORDER):
            code = code << np.uint64(BITS) | part[i:len(part) - ORDER + 1 + i]
        k, c = np.unique(code, return_counts=True)
        keys.append(k)
        counts.append(c)
    return (keys[0], counts[0]) if len(keys) == 1 else add_up(np.concatenate(keys), np.concatenate(counts))


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(keys, return_inverse=True)
    return keys, np.bincount(place, counts, len(keys)).astype(np.int64)


# ------------------------------------------------------------------------ fit
def language_counts(training: DataFrame, buffer_grams: int = 1 << 20) -> DataFrame:
    """(lang, key, n): counts over all of ``training`` (text, lang), added up in each
    task before they are shuffled."""
    def count(batches):
        held: dict[str, list] = {}
        size = 0

        def flush():
            for lang, parts in held.items():
                keys, counts = add_up(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)],
                                                 names=["lang", "key", "n"])
        for part in text_slices(batches):
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist()):
                keys, counts = gram_counts(text)
                held.setdefault(lang, []).append((keys, counts))
                size += len(keys)
            if size > buffer_grams:
                yield from flush()
                held, size = {}, 0
        yield from flush()
    return (training.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
            .mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def kneser_ney(keys: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """Per order from 1 to ORDER: (keys, discounted probability, context keys, weight of
    the lower order) of one language. The highest order has raw counts, the others count
    the distinct symbols before them."""
    orders = [(keys, counts)]
    for order in range(ORDER, 1, -1):
        tails = _tail(orders[0][0], order - 1)
        orders.insert(0, add_up(tails, np.ones(len(tails), np.int64)))
    out = []
    for k, c in orders:
        d = _discount(c)
        contexts, place = np.unique(_head(k), return_inverse=True)
        total = np.bincount(place, c, len(contexts))
        kinds = np.bincount(place, minlength=len(contexts))
        out.append((k, np.maximum(c - d, 0) / total[place], contexts, d * kinds / total))
    return out


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(sorted_keys, keys), max(0, len(sorted_keys) - 1))
    return place, (sorted_keys[place] == keys) if len(sorted_keys) else np.zeros(len(keys), bool)


def _interpolated(model: list[tuple], order: int, keys: np.ndarray) -> np.ndarray:
    """Probability of the last symbol of each n-gram under one language."""
    if order == 0:
        return np.full(len(keys), 1.0 / ALPHABET)
    k, p, contexts, weight = model[order - 1]
    place, found = _find(k, keys)
    seen = np.where(found, p[place], 0.0)
    place, found = _find(contexts, _head(keys))
    return seen + np.where(found, weight[place], 1.0) * _interpolated(model, order - 1, _tail(keys, order - 1))


def build_model(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> dict:
    """Sorted hash arrays of all languages. ``grams[n]``: (keys, log p, columns by
    language) of the n-grams that some language holds; ``backoff[n]``: (contexts, log
    weight) used where an n-gram is in no language."""
    langs = sorted(counts)
    models = [kneser_ney(*counts[lang]) for lang in langs]
    grams, backoff = {}, {}
    for order in range(1, ORDER + 1):
        keys = np.unique(np.concatenate([m[order - 1][0] for m in models])) if models else np.empty(0, np.uint64)
        grams[order] = keys, np.log(np.stack([_interpolated(m, order, keys) for m in models], 1)).astype(np.float32) if models else None
        contexts = np.unique(np.concatenate([m[order - 1][2] for m in models])) if models else np.empty(0, np.uint64)
        weight = np.zeros((len(contexts), len(models)), np.float32)
        for column, m in enumerate(models):
            place, found = _find(m[order - 1][2], contexts)
            weight[found, column] = np.log(np.maximum(m[order - 1][3][place[found]], 1e-12))
        backoff[order] = contexts, weight
    return {"langs": langs, "grams": grams, "backoff": backoff}


def least_count(table: DataFrame, max_bytes: int) -> int:
    """The smallest power of two such that the model of the 4-grams counted at least that
    often in some language takes at most ``max_bytes``: each order has no more keys or
    contexts than there are 4-grams, each with a key and a number per language."""
    langs = table.select("lang").distinct().count()
    row = 2 * ORDER * (8 + 4 * langs)
    sizes = (table.groupBy("key").agg(F.max("n").alias("n")).groupBy(F.floor(F.log2("n") + 1e-9).cast("int").alias("power"))
             .agg(F.count(F.lit(1)).alias("grams")).collect())                              # at most 63 rows
    kept = {r["power"]: r["grams"] for r in sizes}
    power = 0
    while sum(n for p, n in kept.items() if p >= power) * row > max_bytes and power < 63:
        power += 1
    return 1 << power


def fit(training: DataFrame, max_bytes: int | None = None) -> dict:
    """Model from ``training`` (text, lang); rows with a null text or lang do not count.
    All 4-grams reach the driver, or with ``max_bytes`` those that its least count leaves."""
    table = materialize(language_counts(training.where("text IS NOT NULL AND lang IS NOT NULL")), "gram-counts")
    least = 1 if max_bytes is None else least_count(table, max_bytes)
    kept = table if least == 1 else table.join(table.groupBy("key").agg(F.max("n").alias("most")).where(F.col("most") >= least), "key", "left_semi")
    arrow = kept.select("lang", "key", "n").toArrow()
    lang = arrow.column("lang").combine_chunks().dictionary_encode()
    code, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
    key, n = arrow.column("key").to_numpy().view(np.uint64), arrow.column("n").to_numpy()
    order = np.lexsort((key, code))
    code, key, n = code[order], key[order], n[order]
    ends = np.searchsorted(code, np.arange(len(names)), side="right")
    return build_model({name: (key[a:b], n[a:b]) for name, a, b in zip(names, [0, *ends.tolist()], ends.tolist())})


# ---------------------------------------------------------------------- score
def _log_p(model: dict, order: int, keys: np.ndarray) -> np.ndarray:
    """log p of each n-gram, one column per language."""
    if order == 0:
        return np.full((len(keys), len(model["langs"])), -np.log(ALPHABET), np.float32)
    own, logs = model["grams"][order]
    place, found = _find(own, keys)
    out = logs[place]
    miss = np.flatnonzero(~found)
    if len(miss):
        contexts, weight = model["backoff"][order]
        at, known = _find(contexts, _head(keys[miss]))
        out[miss] = np.where(known[:, None], weight[at], 0) + _log_p(model, order - 1, _tail(keys[miss], order - 1))
    return out


def cross_entropy(model: dict, text: str | None) -> tuple[np.ndarray, int] | None:
    """(nats per symbol for each language, symbols), or None without a letter."""
    keys, counts = gram_counts(text)
    if not len(keys) or not model["langs"]:
        return None
    n = int(counts.sum())
    return -(counts @ _log_p(model, ORDER, keys).astype(np.float64)) / n, n


def entropies(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` (doc_id, text, lang, ...) as doc_id, label (its lang), train (kept from
    the input), best (language), entropy, posterior, symbols; best is null without a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in text_slices(batches):
            best, entropy, posterior, size = [], [], [], []
            for text in part.column("text").to_pylist():
                scored = cross_entropy(shared.value, text)
                if scored is None:
                    best.append(None), entropy.append(None), posterior.append(0.0), size.append(0)
                    continue
                each, n = scored
                b = int(np.argmin(each))
                best.append(shared.value["langs"][b])
                entropy.append(float(each[b]))
                posterior.append(float(1 / np.exp(np.clip(-n * (each - each[b]), -700, 0)).sum()))
                size.append(n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("train"), pa.array(best, pa.string()),
                                              pa.array(entropy, pa.float64()), pa.array(posterior, pa.float64()), pa.array(size, pa.int64())],
                                             names=["doc_id", "label", "train", "best", "entropy", "posterior", "symbols"])
    return docs.mapInArrow(run, "doc_id long, label string, train boolean, best string, entropy double, posterior double, symbols long")


def identify(docs: DataFrame, train, accept: float = ACCEPT, max_bytes: int | None = None) -> DataFrame:
    """Language of every row of ``docs`` (doc_id, text, lang). ``train``: condition for
    the rows that may be learned from; of these, rows with a lang are.

    Returns doc_id, lang_pred (``und`` for a null text, one without a letter, or where
    nothing was learned), score (0 to 1: the posterior; where rejected, times threshold /
    entropy), entropy (nats per symbol), rejected (above its language's threshold). Every
    row gives one row, repeats and null ids included; ties go to the language first in
    order; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("label"), F.coalesce(train, F.lit(False)).alias("train"))
    model = fit(rows.where("train").select("text", F.col("label").alias("lang")), max_bytes)
    scored = materialize(entropies(rows, model), "entropies")
    thresholds = (scored.where("train AND best = label").groupBy("best")
                  .agg(F.percentile_approx("entropy", accept, 10000).alias("threshold")))     # one row per language
    rejected = F.col("entropy") > F.col("threshold")
    joined = scored.join(F.broadcast(thresholds), "best", "left")
    return joined.select(
        "doc_id", F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"),
        F.when(F.col("best").isNull(), 0.0).when(rejected, F.col("posterior") * F.col("threshold") / F.col("entropy"))
        .otherwise(F.col("posterior")).alias("score"), "entropy", F.coalesce(rejected, F.col("best").isNull()).alias("rejected"))
