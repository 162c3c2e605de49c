"""Common ground of the two repeated-passage operators (words and bytes).

A window is WINDOW consecutive units (words or bytes) of one document. To find the
windows that several documents share without shuffling every window, each window names
an anchor: of the ``gram``-unit grams in it, the leftmost with the smallest hash. Equal
windows name equal anchors, at the same place in the window, so only documents that
share an anchor can share a window (winnowing; about 2 / (WINDOW - gram + 2) of all
positions are anchors). With a ``split`` the windows of an anchor fall into two sides,
those that hold at least ``split`` units before the anchor and those that do not; the key
of a side also covers the units before or after the anchor that all its windows hold, so
that a short gram still gives a telling key. A place is 2 * anchor + side.

1. ``shared_anchors``: anchors are packed into compressed blobs by hash bucket, combined
   in each task first, and the places of anchors that occur in two texts come back.
2. An operator's own ``locate`` finds the occurrences in whole texts and cuts the windows
   of each document into blocks, one per occurrence. Equal blocks of a task are combined.
3. An operator's own ``decide`` tells for the windows of every distinct block the
   smallest document id that holds them.
4. ``removed_spans`` brings that back to the occurrences.

Documents are ordered by doc_id. Rows with a null doc_id come after all others, ordered
by a hash of their text. Rows of the same doc_id never remove anything from each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlattice.llm.common import byte_texts, discard, materialize, text_slices

WINDOW = 50
FLUSH_ANCHORS = 1 << 20
BUCKET_ANCHORS = 400_000
_MASK = 0xFFFFFFFFFFFFFFFF
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_CACHED = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = {b: (_powers(b, _CACHED + 1), _powers(pow(b, -1, 1 << 64), _CACHED + 1)) for b in _BASES}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Polynomial hashes of any ranges of a sequence of 64-bit units."""

    def __init__(self, units: np.ndarray, base: int = _BASES[0]):
        n = len(units)
        if n <= _CACHED:
            up, self.down = _POWERS[base]
        else:
            up, self.down = _powers(base, n + 1), _powers(pow(base, -1, 1 << 64), n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(units * up[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every run of ``width`` values."""
    reach = 1
    while 2 * reach <= width:
        values, reach = pick(values[:-reach], values[reach:]), 2 * reach
    rest = width - reach
    return pick(values[:len(values) - rest], values[rest:]) if rest else values


def anchor_of_windows(grams: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions of all anchors ascending, position of each window's anchor)."""
    least = _sliding(grams, per_window, np.minimum)            # one value per window
    pad = np.zeros(per_window - 1, np.uint64)
    candidate = _sliding(np.concatenate((pad, least, pad)), per_window, np.maximum) == grams
    some = np.flatnonzero(candidate)
    at = (np.cumsum(candidate) - candidate)[:len(least)]       # first candidate in the window
    while True:
        wrong = np.flatnonzero(grams[some[at]] != least)
        if not len(wrong):
            break
        at[wrong] += 1
    own = some[at]                                             # never moves back
    return own[_changes(own)], own


# ---------------------------------------------------------------- 1. anchors
def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ord, tk): ord orders the documents, (ord, tk) names a row's content."""
    text = F.col("text").cast("string")
    late = F.shiftrightunsigned(F.xxhash64(text), 2) + F.lit(1 << 62)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       F.coalesce(F.col("doc_id").cast("long"), late).alias("ord"), F.xxhash64(text).alias("tk"))


def _planes(x: np.ndarray) -> bytes:
    """Bytes of an array, sorted by place value, so that they compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _from_planes(raw: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(a) for a in arrays], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(_planes, arrays)))


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes = np.frombuffer(raw[:4 * len(kinds)], np.uint32).tolist()
    out, at = [], 4 * len(kinds)
    for kind, n in zip(kinds, sizes):
        end = at + n * np.dtype(kind).itemsize
        out.append(_from_planes(raw[at:end], kind, n))
        at = end
    return out


def _changes(x: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal values."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)


_NO_DOCUMENT = np.uint32(0xFFFFFFFF)


def shared_anchors(docs: DataFrame, anchors_of, buckets: int) -> DataFrame:
    """(tk, places array<int>): per distinct text the places of its anchors whose key another
    text has too. ``anchors_of(text) -> (places, keys)``. ``docs``: (tk, ck, text), two hashes
    of the text."""
    def scan(batches):
        held: list[tuple] = []
        seen: set[tuple] = set()
        size = turn = 0

        def flush():
            ids = np.array([o for o, _, _ in held], np.int64)
            doc = np.repeat(np.arange(len(held)), [len(p) for _, p, _ in held])
            place = np.concatenate([p for _, p, _ in held]).astype(np.uint32)
            h = np.concatenate([g for _, _, g in held])
            order = np.argsort(h, kind="stable")
            doc, place, h = doc[order], place[order], h[order]
            start = _changes(h)
            many = np.minimum.reduceat(ids[doc], start) != np.maximum.reduceat(ids[doc], start)
            local = np.repeat(many, np.diff(np.append(start, len(h))))
            # keys of several documents here: known to be shared, one entry stands for all
            by_doc = np.argsort(doc[local], kind="stable")
            d, p = doc[local][by_doc], place[local][by_doc]
            edge = _changes(d)
            for a, b in zip(edge.tolist(), np.append(edge[1:], len(d)).tolist()):
                yield (turn + a) % buckets, int(ids[d[a]]), p[a:b].astype(np.int32), None
            entry = ~local
            entry[start[many]] = True
            h, doc, place = h[entry], np.where(local[entry], _NO_DOCUMENT, doc[entry]).astype(np.uint32), place[entry]
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            edge = _changes(bucket)
            for a, b in zip(edge.tolist(), np.append(edge[1:], len(h)).tolist()):
                some = np.unique(doc[a:b])
                some = some[some != _NO_DOCUMENT]
                index = np.where(doc[a:b] == _NO_DOCUMENT, _NO_DOCUMENT, np.searchsorted(some, doc[a:b]).astype(np.uint32))
                yield int(bucket[a]), None, None, _pack(h[a:b], index, place[a:b], ids[some])

        def rows():
            found = list(flush()) if held else []
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.int32()), pa.array([r[1] for r in found], pa.int64()),
                                               pa.array([r[2] for r in found], pa.list_(pa.int32())), pa.array([r[3] for r in found], pa.binary())],
                                              names=["bucket", "tk", "places", "blob"])
        for part in text_slices(batches):
            for key, text in zip(zip(part.column("tk").to_pylist(), part.column("ck").to_pylist()), byte_texts(part.column("text"))):
                if key in seen:
                    continue
                seen.add(key)
                places, keys = anchors_of(text or b"")
                if len(places):
                    held.append((key[0], places, keys))
                    size += len(places)
            if size >= FLUSH_ANCHORS:
                yield rows()
                held, size, turn = [], 0, turn + 1
        yield rows()

    def meet(rows: pa.Table) -> pa.Table:
        known = rows.filter(pc.is_valid(rows.column("tk")))
        lists = known.column("places").combine_chunks()
        out = [(np.repeat(known.column("tk").to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)), lists.flatten().to_numpy())]
        parts = [_unpack(b, np.uint64, np.uint32, np.uint32, np.int64) for b in rows.column("blob").to_pylist() if b is not None]
        if parts:
            h = np.concatenate([x[0] for x in parts])
            lone = np.concatenate([x[1] != _NO_DOCUMENT for x in parts])
            ids = np.concatenate([x[3][np.minimum(x[1], max(0, len(x[3]) - 1))] if len(x[3]) else np.full(len(x[1]), -1) for x in parts])
            place = np.concatenate([x[2] for x in parts])
            order = np.argsort(h, kind="stable")
            h, lone, ids, place = h[order], lone[order], ids[order], place[order]
            start = _changes(h)
            several = (np.minimum.reduceat(ids, start) != np.maximum.reduceat(ids, start)) | ~np.logical_and.reduceat(lone, start)
            keep = np.repeat(several, np.diff(np.append(start, len(h)))) & lone
            out.append((ids[keep], place[keep].astype(np.int32)))
        tk, place = (np.concatenate([x[i] for x in out]) for i in (0, 1))
        return pa.table([pa.array(tk, pa.int64()), pa.array(place, pa.int32())], names=["tk", "place"])

    packed = docs.select("tk", "ck", "text").mapInArrow(scan, "bucket int, tk long, places array<int>, blob binary")
    return (packed.groupBy("bucket").applyInArrow(lambda rows: meet(rows), "tk long, place int")
            .groupBy("tk").agg(F.collect_set("place").alias("places")))


# ------------------------------------------------------------------ 2. blocks
def blocks(own: np.ndarray, split: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, windows) of the runs of windows that share an anchor and
    side, from the anchor of every window. Every place makes one run."""
    side = (own - np.arange(len(own)) >= split).astype(np.int64) if split is not None else 0
    code = 2 * own + side
    start = _changes(code)
    return code[start], start, np.diff(np.append(start, len(code)))


OCCURRENCES = "h long, a long, ord long, tk long, first int, windows int, lo long, hi long, payload binary"
_NAMES = ["h", "a", "ord", "tk", "first", "windows", "lo", "hi", "payload"]


class BlockBuffer:
    """Occurrences of blocks, and one entry per distinct block with its payload and the
    smallest and largest document that holds it."""

    def __init__(self, limit: int = 120_000):
        self.limit, self.rows, self.size, self.distinct = limit, [], 0, {}

    def add(self, o: int, tk: int, h: np.ndarray, a: np.ndarray, first: np.ndarray, windows: np.ndarray, payload) -> None:
        """payload(i): bytes of block i."""
        self.rows.append((o, tk, h.view(np.int64), a.view(np.int64), first.astype(np.int32), windows.astype(np.int32)))
        self.size += len(h)
        for i, key in enumerate(zip(self.rows[-1][2].tolist(), self.rows[-1][3].tolist())):
            known = self.distinct.get(key)
            if known is None:
                self.distinct[key] = [o, o, payload(i)]
            elif o < known[0]:
                known[0] = o
            elif o > known[1]:
                known[1] = o

    def full(self) -> bool:
        return self.size >= self.limit

    def drain(self) -> pa.RecordBatch:
        n, m = self.size, len(self.distinct)
        join = lambda i: np.concatenate([r[i] for r in self.rows]) if self.rows else np.empty(0, np.int64)
        repeat = lambda i: np.repeat([r[i] for r in self.rows], [len(r[2]) for r in self.rows]) if self.rows else np.empty(0, np.int64)
        keys = list(self.distinct)
        values = list(self.distinct.values())
        none = pa.nulls(m, pa.int64())
        columns = [pa.concat_arrays([pa.array(join(2), pa.int64()), pa.array([k[0] for k in keys], pa.int64())]),
                   pa.concat_arrays([pa.array(join(3), pa.int64()), pa.array([k[1] for k in keys], pa.int64())]),
                   pa.concat_arrays([pa.array(repeat(0), pa.int64()), none]), pa.concat_arrays([pa.array(repeat(1), pa.int64()), none]),
                   pa.concat_arrays([pa.array(join(4), pa.int32()), pa.nulls(m, pa.int32())]),
                   pa.concat_arrays([pa.array(join(5), pa.int32()), pa.nulls(m, pa.int32())]),
                   *(pa.concat_arrays([pa.nulls(n, t), pa.array([v[i] for v in values], t)]) for i, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.binary())))]
        self.rows, self.size, self.distinct = [], 0, {}
        return pa.RecordBatch.from_arrays(columns, names=_NAMES)


def verdicts(h: np.ndarray, a: np.ndarray, first: np.ndarray, hi: np.ndarray, size: np.ndarray, least: np.ndarray) -> pa.Table:
    """Runs (h, a, i0, i1, wlo) of windows with the same smallest document, of blocks with
    ``size`` windows each, counted from ``first``; only where ``hi`` lies above it."""
    block = np.repeat(np.arange(len(size)), size)
    window = np.arange(len(block)) - np.repeat(np.cumsum(size) - size, size) + first[block]
    start = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (least[1:] != least[:-1])))) if len(block) else np.empty(0, np.int64)
    end = np.append(start[1:], len(block)) - 1 if len(start) else start
    keep = least[start] < hi[block[start]]
    start, end = start[keep], end[keep]
    return pa.table([pa.array(h[block[start]], pa.int64()), pa.array(a[block[start]], pa.int64()), pa.array(window[start], pa.int32()),
                     pa.array(window[end], pa.int32()), pa.array(least[start], pa.int64())], names=["h", "a", "i0", "i1", "wlo"])


VERDICTS = "h long, a long, i0 int, i1 int, wlo long"


def distinct_blocks(entries: pa.Table, *keys: str) -> tuple:
    """Entries with the same h, a (and further keys) as one: (key columns, lo, hi, payloads)."""
    columns = [entries.column(k).to_numpy().astype(np.int64) for k in ("h", "a", *keys)]
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    lo = np.minimum.reduceat(entries.column("lo").to_numpy()[order], start)
    hi = np.maximum.reduceat(entries.column("hi").to_numpy()[order], start)
    return [c[start] for c in columns], lo, hi, entries.column("payload").take(pa.array(order[start]))


HOT_BLOCKS = 5_000
SALTS = 64
WINDOWS = "h long, a long, i int, own long, lo long, hi long"


def hot_verdicts(blocks: DataFrame, windows_of, hot: int) -> DataFrame:
    """Verdicts on the blocks (h, a, lo, hi, payload) of keys with very many of them, window
    by window: Spark takes the smallest document of every (key, window hash), combined in
    each task first, and joins it back, so that no task holds the blocks of a key. Windows
    that over ``hot`` blocks hold are joined in SALTS parts. ``windows_of(payload)``: hashes
    of the block's windows."""
    def scan(batches):
        for part in batches:
            own = [windows_of(x) for x in part.column("payload").to_pylist()]
            each = np.array([len(x) for x in own], np.int64)
            row = np.repeat(np.arange(len(own)), each)
            i = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
            h, a, lo, hi = (part.column(c).to_numpy()[row] for c in ("h", "a", "lo", "hi"))
            flat = np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(a, pa.int64()), pa.array(i, pa.int32()),
                                              pa.array(flat, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())],
                                             names=["h", "a", "i", "own", "lo", "hi"])
    whole = blocks.groupBy("h", "a", "payload").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    windows = materialize(whole.mapInArrow(scan, WINDOWS), "windows")
    least = windows.groupBy("h", "own").agg(F.min("lo").alias("wlo"), F.max("hi").alias("top"), F.count("*").alias("n"))
    least = materialize(least.where("wlo < top").select("h", "own", "wlo", "n"), "least")
    many = least.where(F.col("n") > hot).select("h", "own", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.col("wlo").alias("far"))
    dealt = windows.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")).join(many, ["h", "own", "salt"], "left")
    few = dealt.where("far IS NULL").join(least.where(F.col("n") <= hot), ["h", "own"])
    columns = ["h", "a", F.col("i").alias("i0"), F.col("i").alias("i1")]
    hit = dealt.where("far < hi").select(*columns, F.col("far").alias("wlo")).unionByName(few.where("wlo < hi").select(*columns, "wlo"))
    verdicts = materialize(hit, "hot-verdicts")
    for done in (windows, least):
        discard(done)
    return verdicts


def removed_spans(occurrences: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(ord, tk, spans): per document the unit ranges [start, end) to remove. ``verdicts``:
    (h, a, i0, i1, wlo): windows i0 to i1 of the block occur in document wlo."""
    rows = occurrences.where("ord IS NOT NULL").select("h", "a", "ord", "tk", "first")
    hit = rows.join(verdicts, ["h", "a"]).where("ord > wlo")
    span = F.struct((F.col("first") + F.col("i0")).alias("start"), (F.col("first") + F.col("i1") + WINDOW).alias("end"))
    return hit.select("ord", "tk", span.alias("span")).groupBy("ord", "tk").agg(F.array_sort(F.collect_set("span")).alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Sorted (start, end) joined where they overlap or touch."""
    out: list[list[int]] = []
    for start, end in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def bucket_count(size: int, anchors_per_byte: float) -> int:
    """Buckets for the anchors of ``size`` bytes of text."""
    return max(1, int(size * anchors_per_byte / BUCKET_ANCHORS) + 1)
