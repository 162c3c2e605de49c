"""SimHash near-duplicates by bit-sliced distance counting.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word
shingles. Two fingerprints link at ``radius`` or fewer differing bits.

Candidates: the fingerprint is cut into ``blocks`` bit blocks. Two fingerprints
within the radius differ in at most ``radius`` blocks, so they agree on at least
``blocks - radius`` of them; each choice of that many blocks gives one key. The
search is exact. Fingerprints that share a key are compared in cells of bounded
size: a key with more than ``cell_rows`` fingerprints is cut into chunks and each
pair of chunks is a cell of its own.

In a cell the fingerprints stand as 64 vertical bit planes, 64 of them to a
machine word. One fingerprint is compared with a word of 64 others at a time:
the differing bits of each plane go through carry-save adders into vertical
counters, and a word is abandoned as soon as all its lanes exceed the radius.
A cell returns a spanning star for each of its groups, never its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlattice.llm.common import LOWER, byte_texts, free_name, materialize, text_slices
from medlattice.llm.components import components

SHINGLE_WORDS = 4
RADIUS = 4
BLOCKS = 6
CELL_ROWS = 2048
SEED = 42
_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---------------------------------------------------------------- fingerprints
def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """Fingerprint of a UTF-8 text as an unsigned integer. Words are runs of bytes
    other than ASCII white space, A-Z in lower case; shingles count with their
    repeats. Fewer words than a shingle: the whole sequence. No word or null: 0."""
    tokens = text.translate(LOWER).split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in tokens), np.int64, len(tokens))) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > words:
        starts, ends = starts[:len(starts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    for at in range(0, n, 16384):
        part = np.fromiter((digest(joined[a:b], SEED) for a, b in
                            zip(starts[at:at + 16384].tolist(), ends[at:at + 16384].tolist())), np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS, row: str | None = None) -> DataFrame:
    """(doc_id, fp): one row per input row; fp holds the 64 bits as a signed long. With
    ``row``, the name of a column of longs that numbers the rows, also (row, tk): that
    number and a hash of the text."""
    number = [] if row is None else [F.col(row).alias("row"), F.xxhash64(F.col("text").cast("string")).alias("tk")]
    more = [] if row is None else ["row", "tk"]

    def scan(batches):
        for part in text_slices(batches):
            fps = np.array([fingerprint(t, words) for t in byte_texts(part.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(fps.view(np.int64)),
                                              *(part.column(c) for c in more)], names=["doc_id", "fp", *more])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), *number) \
        .mapInArrow(scan, ", ".join(f"{c} long" for c in ["doc_id", "fp", *more]))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ------------------------------------------------------------------- candidates
def block_keys(fp: Column, radius: int, blocks: int) -> Column:
    """Array of longs, one key per choice of ``blocks - radius`` blocks: the bits of
    those blocks, hashed together with the number of the choice."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(number), *[parts[i] for i in chosen])
                     for number, chosen in enumerate(combinations(range(blocks), blocks - radius))])


# ------------------------------------------------------------- bit-sliced cells
def _exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose vertical counter is larger than the radius."""
    more, same = np.zeros_like(over), np.full_like(over, _ALL)
    for place in range(len(counters) - 1, -1, -1):
        if radius >> place & 1:
            same &= counters[place]
        else:
            more |= same & counters[place]
            same &= ~counters[place]
    return over | more


def near_lanes(fps: np.ndarray, planes: np.ndarray, query: np.ndarray, word: np.ndarray,
               valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compare fingerprint query[i] with the 64 lanes of word[i], for all i at once.
    valid[i]: the lanes that count. Returns (i, mask) for words with a near lane."""
    places = max(2, radius.bit_length())
    at = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range(places)]
    over = np.zeros(len(query), np.uint64)
    for plane in range(0, 64, 2):
        bits = fps[query]
        first, second = (planes[p, word] ^ (np.uint64(0) - (bits >> np.uint64(p) & _ONE)) for p in (plane, plane + 1))
        # carry-save adder: ones + first + second = ones' + 2 * carry
        mixed = counters[0] ^ first
        carry = (counters[0] & first) | (mixed & second)
        counters[0] = mixed ^ second
        for place in range(1, places):
            counters[place], carry = counters[place] ^ carry, counters[place] & carry
        over |= carry
        if plane % 8 == 6:
            valid = valid & ~_exceeds(counters, over, radius)
            live = valid != 0
            if not live.all():   # abandon words all of whose lanes exceed the radius
                at, query, word, valid, over = at[live], query[live], word[live], valid[live], over[live]
                counters = [c[live] for c in counters]
            if not len(at):
                break
    return at, valid


def _stars(rows: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spanning stars (centre, member) of the graph whose node i has neighbour mask m."""
    near, links = dict(rows), []
    left = sum(1 << i for i in near)
    while left:
        centre = (left & -left).bit_length() - 1
        left ^= 1 << centre
        front = 1 << centre
        while front:
            node = (front & -front).bit_length() - 1
            front ^= 1 << node
            new = near.get(node, 0) & left
            left ^= new
            front |= new
            while new:
                member = (new & -new).bit_length() - 1
                new &= new - 1
                links.append((centre, member))
    return links


def link_cells(fps: np.ndarray, starts: np.ndarray, radius: int, slab: int = 1 << 17) -> list[tuple[int, int]]:
    """Links (as positions in fps) that span the near groups of each cell. Cell c
    holds fps[starts[c]:starts[c + 1]]."""
    sizes = np.diff(starts)
    words = (sizes + 63) // 64
    first_word = np.concatenate(([0], np.cumsum(words)))
    cell = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(fps)) - starts[cell]
    lane_word, lane = first_word[cell] + place // 64, (place % 64).astype(np.uint64)
    planes = np.zeros((64, int(first_word[-1])), np.uint64)
    for p in range(64):
        np.bitwise_or.at(planes[p], lane_word, (fps >> np.uint64(p) & _ONE) << lane)
    filled = np.zeros(planes.shape[1], np.uint64)
    np.bitwise_or.at(filled, lane_word, _ONE << lane)
    compared = words[cell]
    upto = np.concatenate(([0], np.cumsum(compared)))
    found: dict[int, dict[int, int]] = {}
    lo = 0
    while lo < len(fps):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + slab, "right")) - 1)
        query = np.repeat(np.arange(lo, hi), compared[lo:hi])
        step = np.arange(len(query)) - np.repeat(upto[lo:hi] - upto[lo], compared[lo:hi])
        word = first_word[cell[query]] + step
        valid = filled[word]
        own = word == lane_word[query]
        valid[own] &= ~(_ONE << lane[query[own]])
        at, masks = near_lanes(fps, planes, query, word, valid, radius)
        for q, w, m in zip(query[at].tolist(), step[at].tolist(), masks.tolist()):
            rows = found.setdefault(int(cell[q]), {})
            node = q - int(starts[cell[q]])
            rows[node] = rows.get(node, 0) | m << (64 * w)
        lo = hi
    return [(int(starts[c]) + a, int(starts[c]) + b) for c, rows in found.items() for a, b in _stars(list(rows.items()))]


def _scan_cells(radius: int, buffer_rows: int = 1 << 16):
    """Partition function: rows (cell, fp) sorted by cell to links (a, b)."""
    def scan(batches):
        held_cell, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def flush(cells, fps):
            starts = np.concatenate((np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]]), [len(cells)]))
            links = link_cells(fps, starts, radius)
            ends = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)[ends[:, 0]]), pa.array(fps.view(np.int64)[ends[:, 1]])],
                                              names=["a", "b"])
        for batch in batches:
            held_cell = np.concatenate((held_cell, batch.column("cell").to_numpy(zero_copy_only=False)))
            held_fp = np.concatenate((held_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            if len(held_cell) >= buffer_rows:
                cut = int(np.searchsorted(held_cell, held_cell[-1]))   # cells come in ascending order
                if cut:
                    yield flush(held_cell[:cut], held_fp[:cut])
                    held_cell, held_fp = held_cell[cut:], held_fp[cut:]
        if len(held_cell):
            yield flush(held_cell, held_fp)
    return scan


def near_links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that span the groups of fingerprints within the radius.
    ``distinct`` has one column fp without repeats."""
    keyed = materialize(distinct.select("fp", F.explode(block_keys(F.col("fp"), radius, blocks)).alias("key")), "keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / F.lit(cell_rows)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    cells = (keyed.join(sizes, "key").select("key", "fp", chunks.alias("chunks"))
             .select("key", "fp", "chunks", own.alias("own"))
             .select("key", "fp", "own", F.explode(F.when(F.col("chunks") == 1, F.array(F.lit(0)))
                                                   .otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))).alias("other"))
             .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp"))
    return (cells.repartition("cell").sortWithinPartitions("cell", "fp")
            .mapInArrow(_scan_cells(radius), "a long, b long").distinct())


def simhash_groups(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, blocks: int = BLOCKS,
                   cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, fp, component_id, component_size) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id in the row's component; component_size
    counts its rows. Null and empty texts have fingerprint 0 and link like others.
    A repeated row gives a repeated result row; a null doc_id never becomes a
    component_id unless its component has no other id. Other columns are ignored.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    named = _named(rows, radius, blocks, cell_rows).select("fp", "component_id", "component_size")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "component_size")


def _named(rows: DataFrame, radius: int, blocks: int, cell_rows: int) -> DataFrame:
    """(fp, root, component_id, component_size) for every fingerprint of ``rows``
    (doc_id, fp); root is the component's own fingerprint."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    roots = components(near_links(distinct.select("fp"), radius, blocks, cell_rows))
    classes = (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
               .select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    whole = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    return classes.join(whole, "root").select("fp", "root", "component_id", "component_size")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = RADIUS, blocks: int = BLOCKS,
             cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row of each group of near copies: the one with the smallest doc_id; a null id
    comes after all others, and of equal ids the smaller hash of the text goes first. Null
    and empty texts are near copies of each other; of repeated rows one stays; an empty
    table stays empty; very long texts count whole. All columns stay as they are."""
    number = free_name(docs, "_keep_row")
    numbered = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = materialize(fingerprints(numbered, words, number), "fingerprints")
    named = _named(rows, radius, blocks, cell_rows).select("fp", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "tk", "row")).alias("first")
    chosen = rows.join(named, "fp").groupBy("root").agg(first).select(F.col("first.row").alias(number))
    return numbered.join(chosen, number, "left_semi").select(docs.columns)
