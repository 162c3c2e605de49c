"""Packing token pieces into windows by multiway Karmarkar-Karp differencing.

Every document is tokenized and closed with an end id. It is cut at multiples of
``piece`` tokens; pieces that fill a window stand alone, the others are dealt at random
into groups of about ``group_rows``. In a group each piece starts as a partition into k
windows, all but one empty. The two partitions with the widest imbalance are merged,
the fullest window of one with the emptiest of the other, until one partition is left:
k windows of nearly equal length. k starts at the least count that could hold the
group, and rises while some window exceeds the capacity.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from medlattice.llm.common import materialize, text_slices

CAPACITY = 2048
PIECE = 512
GROUP_ROWS = 600
END_ID = 1
CACHE_WORDS = 200_000


# ------------------------------------------------------------------- tokenizer
class WordCachingTokenizer:
    """Ids of a lower-casing, white-space-dropping byte-level BPE tokenizer with word ends.

    No token of it crosses white space, so texts are cut there, each new word is encoded
    once and remembered. That short way is taken for Latin-1 texts without control
    characters and special-token brackets, where normalising is plain lower-casing;
    other texts go through the tokenizer as they are. New words are merged by tiktoken
    from the same vocabulary, the word end being a byte of its own (tests compare both)."""

    _PARTS = regex.compile(r"('s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+)")
    _ODD = bytes([*range(9), 11, 12, *range(14, 32), *range(127, 161)])
    _END = "\x01"

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        vocabulary = self.full.get_vocab()
        printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        others = sorted(set(range(256)) - set(printable))
        byte_of = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        special = {t.content for t in self.full.get_added_tokens_decoder().values()}
        ranks = {}
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            if token not in special:
                self.ends[i] = token.endswith("</w>")
                ranks[bytes(byte_of[c] for c in token.removesuffix("</w>")) + self._END.encode() * bool(self.ends[i])] = i
        self.lean = tiktoken.Encoding("words", pat_str=r"[^\x01 ]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}                      # ids as little-endian 32-bit numbers

    def _plain(self, text: str) -> bool:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return "<|" not in text and len(raw.translate(None, self._ODD)) == len(raw)

    def _learn(self, words: list[str]) -> None:
        """Encode new words in one run; the word-end tokens tell where each part ends."""
        marked = self._PARTS.sub(r"\1" + self._END, " ".join(words)) + " "
        raw = np.frombuffer(marked.encode("latin-1"), np.uint8)
        upto = np.cumsum(raw == 1)[raw == 32]                  # parts up to the end of each word
        ids = np.array(self.lean.encode_ordinary(marked), "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != upto[-1] or len(upto) != len(words):
            raise ValueError("the tokenizer does not close every word part")
        at, flat = 0, ids.tobytes()
        for word, end in zip(words, (4 * ends[upto - 1]).tolist()):
            self.known[word] = flat[at:end]
            at = end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, without special tokens; null gives none."""
        words = [t.lower().split() if t is not None and self._plain(t) else None for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = [w for w in set(chain.from_iterable(w for w in words if w)) if w not in self.known]
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), "<u4") if w is not None else
                np.array(self.full.encode(t, add_special_tokens=False).ids if t else [], "<u4")
                for t, w in zip(texts, words)]


_TOKENIZERS: dict[str, WordCachingTokenizer] = {}


def tokenizer(path: str) -> WordCachingTokenizer:
    """One tokenizer per Python worker and file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordCachingTokenizer(path)
    return _TOKENIZERS[path]


def cuts(n: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole windows, then pieces of
    ``piece`` tokens and the rest."""
    out, at = [], 0
    while n - at >= capacity:
        out.append((at, capacity))
        at += capacity
    while at < n:
        out.append((at, min(piece, n - at)))
        at += out[-1][1]
    return out


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    def run(batches):
        for part in text_slices(batches):
            rows: list[tuple] = []
            encoded = tokenizer(tokenizer_path).encode(part.column("text").to_pylist())
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                rows += [(doc_id, a, n, zlib.crc32(ids[a:a + n].tobytes()), len(ids)) for a, n in cuts(len(ids), capacity, piece)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


# ----------------------------------------------------------------- differencing
def differencing(lengths: np.ndarray, k: int) -> tuple[np.ndarray, int]:
    """Karmarkar-Karp into k windows: (window of each piece, longest window)."""
    n = len(lengths)
    left, right = [-1] * n, [-1] * n                    # nodes: pieces, then unions
    heap = []
    for i in range(n):
        sums, nodes = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], nodes[0] = lengths[i], i
        heap.append((-int(lengths[i]) if k > 1 else 0, i, sums, nodes))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, a, a_nodes = heapq.heappop(heap)          # both with the fullest window first
        _, _, b, b_nodes = heapq.heappop(heap)
        sums, b_nodes = a + b[::-1], b_nodes[::-1]
        nodes = np.where(a_nodes < 0, b_nodes, a_nodes)
        both = np.flatnonzero((a_nodes >= 0) & (b_nodes >= 0))
        if len(both):
            nodes[both] = np.arange(len(left), len(left) + len(both))
            left += a_nodes[both].tolist()
            right += b_nodes[both].tolist()
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), turn, sums, nodes))
        turn += 1
    _, _, sums, nodes = heap[0]
    window = np.zeros(n, np.int64)
    for w, node in enumerate(nodes.tolist()):
        stack = [node] if node >= 0 else []
        while stack:
            node = stack.pop()
            if node < n:
                window[node] = w
            else:
                stack += [left[node], right[node]]
    return window, int(sums[0])


def pack(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each piece. The count of windows rises until none exceeds the capacity;
    with one window a piece every piece fits, so the search ends."""
    k = max(1, -(-int(lengths.sum()) // capacity))
    while True:
        window, longest = differencing(lengths, k)
        if longest <= capacity:
            return window
        k += max(1, k // 256)


def _pack_group(capacity: int):
    def run(key, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("piece_no", kind="stable").reset_index(drop=True)
        window = pack(rows["length"].to_numpy(np.int64), capacity)
        _, number = np.unique(window, return_inverse=True)
        rows["sequence_id"] = 2 * ((int(key[0]) << 20) + number)
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows.drop(columns=["piece_no", "grp"])
    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, piece: int = PIECE,
                   group_rows: int = GROUP_ROWS, end_id: int = END_ID) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset. Windows hold at most ``capacity`` ids; offsets are
    gapless from 0. Null and empty texts are the end id alone; repeated rows and null ids
    are packed like others; no row gives no piece. Other columns are ignored."""
    cut = materialize(pieces(docs, tokenizer_path, capacity, piece, end_id)
                      .withColumn("piece_no", F.monotonically_increasing_id()), "pieces")
    rest = cut.where(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_rows))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = (rest.withColumn("grp", F.pmod(F.xxhash64("piece_no"), F.lit(groups))).groupBy("grp")
              .applyInPandas(_pack_group(capacity), schema))
    whole = cut.where(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("piece_no") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(whole)
