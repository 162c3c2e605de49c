"""Repeated passages of words, located by Aho-Corasick automata.

1. Recurring passages are confirmed: of the GRAM-word phrases that the windows of WINDOW
   words name (winnowing, see repeats), those that two documents hold are kept, by an
   aggregate on the phrase's hash that each task combines first.
2. The phrases are dealt into shards of about SHARD_PHRASES. Every word is written as one
   of 32 symbols, so that a document is a short string and a phrase a 60-bit number. The
   shard of a phrase follows from the least of its runs of LEAD symbols (by a fixed order),
   and so does that of every GRAM words of a document: neighbours mostly share it. So a
   document is cut into stretches that overlap by GRAM - 1 words, one for each change of
   shard, and each streams through the pyahocorasick automaton of its shard. Every place
   meets all phrases that could start there, and some 3.4 symbols a word are streamed for
   any number of shards. A group is one shard and about RANGE_WORDS words of stretches.
3. The hits alone tell where phrases stand. A hit at which a window has its anchor opens a
   block of windows; for the windows of each distinct block the smallest document that
   holds them is found by the hash of the whole window, and a word goes if a window over
   it starts in a smaller document. Two words with the same symbol give hits too many,
   which find no equal window and remove nothing.

The blocks of a phrase with over ``hot_blocks`` of them are decided by window, apart
(repeats.hot_verdicts).
"""

from __future__ import annotations

import math
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlattice.llm import repeats
from medlattice.llm.common import byte_texts, discard, materialize, text_slices

GRAM = 12
PER_WINDOW = repeats.WINDOW - GRAM + 1
SYMBOL_BITS = 5                            # GRAM symbols fit a long
FLUSH_ANCHORS = 1 << 20
SHARD_PHRASES = 200_000                    # some 200 MB of automaton
RANGE_WORDS = 8_000_000
LEAD = 4
LEADS = GRAM - LEAD + 1
#: symbols streamed for a word: a run of equal shards has (LEADS + 1) / 2 places, GRAM - 1 symbols and a border more
REACH = 1 + 2 * GRAM / (LEADS + 1)
FLUSH_WORDS = 1 << 20
BYTES_A_WORD = 6
BLOCKS_AT_ONCE = 50_000
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
_RANK = np.random.default_rng(23).permutation(1 << LEAD * SYMBOL_BITS).astype(np.uint32)
_BORDER = np.uint8(48 + (1 << SYMBOL_BITS))   # no symbol: no phrase goes across
_SALT = np.random.default_rng(17).integers(1, 1 << 62, size=256, dtype=np.int64).view(np.uint64)


def word_units(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word; words are runs of bytes other than ASCII white space."""
    raw = np.frombuffer(text, np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    blank = np.ones(len(raw) + 2, bool)
    blank[1:-1] = _IS_BLANK[raw]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    return repeats.RangeHash(_SALT[raw]).of(edge[::2], edge[1::2])


def symbols_of(units: np.ndarray) -> np.ndarray:
    """The symbol of each word, a printable ASCII byte."""
    return (units >> np.uint64(64 - SYMBOL_BITS)).astype(np.uint8) + np.uint8(48)


def phrase_codes(symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The phrase at each place as a number, its first word in the highest bits."""
    code = np.zeros(len(places), np.int64)
    for i in range(GRAM):
        code = code << SYMBOL_BITS | (symbols[places + i] - np.uint8(48))
    return code


# --------------------------------------------------------- 1. recurring phrases
SCANNED = "h long, code long, lo long, hi long, ord long, tk long, symbols binary"


def _scan(batches):
    """Partition function: rows (ord, tk, text) to the distinct anchor phrases of a flush with
    their smallest and largest document (h, code, lo, hi) and the symbols of each text of a
    whole window (ord, tk, symbols), one for equal rows of the task."""
    schema = pa.schema([(n, pa.binary() if n == "symbols" else pa.int64()) for n in ("h", "code", "lo", "hi", "ord", "tk", "symbols")])

    def batch(values: dict) -> pa.RecordBatch:
        size = len(next(iter(values.values())))
        return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(size, f.type)
                                           for f in schema], schema=schema)

    def flush(held):
        h, code = (np.concatenate([x[j] for x in held]) for j in (1, 2))
        o = np.repeat(np.array([x[0] for x in held], np.int64), [len(x[1]) for x in held])
        order = np.argsort(h, kind="stable")
        start = repeats._changes(h[order])
        return batch({"h": h[order][start].view(np.int64), "code": code[order][start],
                      "lo": np.minimum.reduceat(o[order], start), "hi": np.maximum.reduceat(o[order], start)})

    held, size, seen = [], 0, set()
    for part in text_slices(batches):
        texts = {"ord": [], "tk": [], "symbols": []}
        for o, tk, text in zip(part.column("ord").to_pylist(), part.column("tk").to_pylist(), byte_texts(part.column("text"))):
            units = word_units(text or b"")
            if len(units) < repeats.WINDOW or (o, tk) in seen:
                continue
            seen.add((o, tk))
            grams = repeats.RangeHash(units).grams(GRAM)
            anchors, _ = repeats.anchor_of_windows(grams, PER_WINDOW)
            symbols = symbols_of(units)
            held.append((o, grams[anchors], phrase_codes(symbols, anchors)))
            size += len(anchors)
            for name, value in zip(texts, (o, tk, symbols.tobytes())):
                texts[name].append(value)
        if texts["ord"]:
            yield batch(texts)
        if size >= FLUSH_ANCHORS:
            yield flush(held)
            held, size = [], 0
    if held:
        yield flush(held)


# ----------------------------------------------------------------- 2. automata
def automaton(codes: np.ndarray) -> ahocorasick.Automaton:
    """The automaton of some phrases, given as numbers."""
    codes = np.unique(codes)
    shifts = SYMBOL_BITS * np.arange(GRAM - 1, -1, -1)
    text = ((codes[:, None] >> shifts & (1 << SYMBOL_BITS) - 1).astype(np.uint8) + np.uint8(48)).tobytes().decode("ascii")
    machine = ahocorasick.Automaton()
    for at in range(0, len(text), GRAM):
        machine.add_word(text[at:at + GRAM], 0)
    machine.make_automaton()
    return machine


def hits(machine: ahocorasick.Automaton, symbols: str) -> list[int]:
    """Every place at which a phrase of the automaton starts."""
    return [end - GRAM + 1 for end, _ in machine.iter(symbols)]


def shard_table(shards: int) -> np.ndarray:
    """The shard of the phrases whose least run of LEAD symbols has a rank, by rank."""
    return (repeats.mixed(np.arange(len(_RANK), dtype=np.uint64)) % np.uint64(shards)).astype(np.int32)


def least_of_codes(codes: np.ndarray) -> np.ndarray:
    """The rank of the least run of LEAD symbols of each phrase."""
    shifts = SYMBOL_BITS * np.arange(LEADS)
    return _RANK[codes[:, None] >> shifts & len(_RANK) - 1].min(axis=1)


def stretches(symbols: np.ndarray, ends: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, ...]:
    """(shard, text, first place in the text, places) of the stretches of some texts, given
    one behind the other (``ends``: where each ends; each has GRAM words or more)."""
    own = (symbols - np.uint8(48)).astype(np.uint32)
    runs = np.zeros(len(own) - LEAD + 1, np.uint32)
    for i in range(LEAD):
        runs = runs << np.uint32(SYMBOL_BITS) | own[i:len(own) - LEAD + 1 + i]
    shard = table[repeats._sliding(_RANK[runs], LEADS, np.minimum)]
    begins = np.concatenate(([0], ends[:-1]))
    size = ends - begins - GRAM + 1                            # places of each text
    text = np.repeat(np.arange(len(ends)), size)
    place = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    shard = shard[place + begins[text]]
    start = np.flatnonzero(np.concatenate(([True], (shard[1:] != shard[:-1]) | (text[1:] != text[:-1]))))
    return shard[start], text[start], place[start], np.diff(np.append(start, len(shard)))


def _dealt(shards: int, ranges: int, flush_words: int):
    """Partition function: texts (ord, tk, symbols) to blobs (range, shard, blob) of their
    stretches, one a shard for about ``flush_words`` words."""
    def run(batches):
        table, turn = shard_table(shards), TaskContext.get().partitionId()
        held, size = [], 0

        def rows():
            flat = np.concatenate([np.frombuffer(x, np.uint8) for _, _, x in held])
            ends = np.cumsum([len(x) for _, _, x in held])
            shard, text, first, places = stretches(flat, ends, table)
            order = np.argsort(shard, kind="stable")
            shard, text, first, places = (x[order] for x in (shard, text, first, places))
            begin = np.concatenate(([0], ends[:-1]))[text] + first
            ids, tks = (np.array([x[i] for x in held], np.int64) for i in (0, 1))
            edge = repeats._changes(shard)
            out = []
            for a, b in zip(edge.tolist(), np.append(edge[1:], len(shard)).tolist()):
                length = places[a:b] + GRAM                   # the words of all places, and a border
                stop = np.cumsum(length)
                taken = np.arange(stop[-1]) + np.repeat(begin[a:b] - (stop - length), length)
                taken[stop - 1] = 0
                letters = flat[taken]
                letters[stop - 1] = _BORDER
                some, index = np.unique(text[a:b], return_inverse=True)
                out.append(repeats._pack(ids[some], tks[some], index.astype(np.uint32), first[a:b].astype(np.uint32), letters))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(edge), turn % ranges), pa.int32()), pa.array(shard[edge], pa.int32()),
                                               pa.array(out, pa.binary())], names=["range", "shard", "blob"])
        for batch in batches:
            for o, tk, symbols in zip(*(batch.column(c).to_pylist() for c in ("ord", "tk", "symbols"))):
                held.append((o, tk, symbols))
                size += len(symbols)
                if size >= flush_words:
                    yield rows()
                    held, size, turn = [], 0, turn + 1
        if held:
            yield rows()
    return run


def _stream(find):
    """Group function: blobs of stretches of a range and the phrases of a shard to the places
    (ord, tk, places) of the documents that hold some."""
    def run(blobs: pa.Table, shard: pa.Table) -> pa.Table:
        out = {"ord": [], "tk": [], "places": []}
        lists = [np.asarray(x.values) for x in shard.column("codes")]
        if lists and blobs.num_rows:
            machine = automaton(np.concatenate(lists))
            for blob in blobs.column("blob").to_pylist():
                ids, tks, text, first, letters = repeats._unpack(blob, np.int64, np.int64, np.uint32, np.uint32, np.uint8)
                found = np.array(find(machine, letters.tobytes().decode("ascii")), np.int64)
                if not len(found):
                    continue
                begin = np.concatenate(([0], np.flatnonzero(letters == _BORDER)[:-1] + 1))
                piece = np.searchsorted(begin, found, side="right") - 1
                text, place = text[piece], (found - begin[piece] + first[piece]).astype(np.int32)
                order = np.argsort(text, kind="stable")
                text, place = text[order], place[order]
                edge = repeats._changes(text)
                out["ord"] += ids[text[edge]].tolist()
                out["tk"] += tks[text[edge]].tolist()
                out["places"] += np.split(place, edge[1:])
        return pa.table([pa.array(out["ord"], pa.int64()), pa.array(out["tk"], pa.int64()), pa.array(out["places"], pa.list_(pa.int32()))],
                        names=list(out))
    return run


def occurrences(texts: DataFrame, phrases: DataFrame, shards: int, ranges: int, find=hits, flush_words: int = FLUSH_WORDS) -> DataFrame:
    """(ord, tk, places): where the phrases (h, code) stand in the texts (ord, tk, symbols)."""
    def shard_of(batches):
        table = shard_table(shards)
        for batch in batches:
            code = batch.column("code")
            yield pa.RecordBatch.from_arrays([pa.array(table[least_of_codes(code.to_numpy())], pa.int32()), code], names=["shard", "code"])
    dealt = (phrases.select("code").mapInArrow(shard_of, "shard int, code long").groupBy("shard").agg(F.collect_set("code").alias("codes"))
             .select("shard", "codes", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))).alias("range")))
    streams = texts.select("ord", "tk", "symbols").mapInArrow(_dealt(shards, ranges, flush_words), "range int, shard int, blob binary")
    found = (streams.groupBy("range", "shard").cogroup(dealt.groupBy("range", "shard"))
             .applyInArrow(_stream(find), "ord long, tk long, places array<int>"))
    return found.groupBy("ord", "tk").agg(F.flatten(F.collect_list("places")).alias("places"))


# ------------------------------------------------------------------- 3. blocks
def _locate(batches):
    buffer = repeats.BlockBuffer()
    for part in text_slices(batches):
        keys = zip(part.column("ord").to_pylist(), part.column("tk").to_pylist())
        for (o, tk), text, located in zip(keys, byte_texts(part.column("text")), part.column("places")):
            units = word_units(text or b"")
            first_hash, second_hash = repeats.RangeHash(units), repeats.RangeHash(units, repeats._BASES[1])
            grams = first_hash.grams(GRAM)
            _, own = repeats.anchor_of_windows(grams, PER_WINDOW)
            place, first, windows = repeats.blocks(own)
            hit = np.zeros(len(units), bool)
            hit[located.values.to_numpy()] = True
            keep = hit[place // 2]
            anchor, first, windows = place[keep] // 2, first[keep], windows[keep]
            whole = second_hash.of(first, first + windows + repeats.WINDOW - 1) ^ (anchor - first).astype(np.uint64)
            each = second_hash.grams(repeats.WINDOW)
            buffer.add(o, tk, grams[anchor], whole, first, windows,
                       lambda i, each=each, first=first, windows=windows: each[first[i]:first[i] + windows[i]].tobytes())
        if buffer.full():
            yield buffer.drain()
    yield buffer.drain()


def _decide(entries: pa.Table) -> pa.Table:
    """Entries (h, a, lo, hi, payload) of some anchors: windows are equal if their anchor
    and their own hash are. Returns the runs of windows that remove something."""
    (h, a), lo, hi, payloads = repeats.distinct_blocks(entries)
    size = pc.binary_length(payloads).to_numpy().astype(np.int64) // 8
    each = np.frombuffer(b"".join(payloads.to_pylist()), np.uint64)
    anchor, document = np.repeat(h, size), np.repeat(lo, size)
    order = np.lexsort((each, anchor))
    start = np.flatnonzero(np.concatenate(([True], (anchor[order][1:] != anchor[order][:-1]) | (each[order][1:] != each[order][:-1]))))
    least = np.empty(len(anchor), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(document[order], start), np.diff(np.append(start, len(anchor))))
    return repeats.verdicts(h, a, np.zeros(len(h), np.int64), hi, size, least)


def _apply(batches):
    for part in text_slices(batches):
        rows = []
        for text, spans in zip(byte_texts(part.column("text")), part.column("spans").to_pylist()):
            words = text.split() if text else []
            gone = repeats.merged([(s["start"], s["end"]) for s in spans or []])
            kept, at = [], 0
            for start, end in gone:
                kept += words[at:start]
                at = end
            kept = b" ".join(kept + words[at:])
            rows.append((len(words), sum(b - a for a, b in gone), [{"start": a, "end": b} for a, b in gone], kept.decode("utf-8")))
        n_words, n_removed, spans, kept = zip(*rows) if rows else ((), (), (), ())
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                          pa.array(spans, kind), pa.array(kept, pa.string())],
                                         names=["doc_id", "n_words", "n_removed", "spans", "kept"])


def _windows_of(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, np.uint64)


def remove_repeats(docs: DataFrame, hot_blocks: int = repeats.HOT_BLOCKS, shard_phrases: int = SHARD_PHRASES,
                   range_words: int = RANGE_WORDS, find=hits) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): n_words, n_removed, spans (word ranges
    removed) and kept (the remaining words, joined by one space). ``find(automaton,
    symbols)`` gives the places of the phrases; nothing else does.

    Null, empty and blank texts have no words. The order of documents, null and repeated
    ids are treated as repeats says. An empty table gives an empty table. A text of any
    length is one row and streams whole. Other columns are ignored."""
    rows = repeats.keyed(docs)
    scanned = materialize(rows.select("ord", "tk", "text").mapInArrow(_scan, SCANNED), "scanned")
    phrases = materialize(scanned.where("h IS NOT NULL").groupBy("h", "code").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                          .where("lo < hi").select("h", "code"), "phrases")
    shards = max(1, -(-phrases.count() // shard_phrases))
    words = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, math.ceil(words / BYTES_A_WORD * min(shards, REACH) / (shards * range_words)))
    shared = materialize(occurrences(scanned.where("symbols IS NOT NULL"), phrases, shards, ranges, find, min(FLUSH_WORDS, range_words)), "hits")
    holding = rows.select("ord", "tk", "text").join(shared, ["ord", "tk"])
    located = materialize(holding.mapInArrow(_locate, repeats.OCCURRENCES), "blocks")
    entries = located.where("payload IS NOT NULL").select("h", "a", "lo", "hi", "payload")
    groups = max(1, -(-entries.count() // BLOCKS_AT_ONCE))
    hot = materialize(entries.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > hot_blocks).select("h"), "hot")
    verdicts = []
    if not hot.isEmpty():
        verdicts.append(repeats.hot_verdicts(entries.join(hot, "h", "left_semi"), _windows_of, hot_blocks))
        entries = entries.join(hot, "h", "left_anti")
    decided = (entries.withColumn("grp", F.pmod(F.xxhash64("h"), F.lit(groups))).groupBy("grp")
               .applyInArrow(lambda rows: _decide(rows), repeats.VERDICTS))
    verdicts.append(materialize(decided, "verdicts"))
    spans = materialize(repeats.removed_spans(located, reduce(DataFrame.unionByName, verdicts)), "spans")
    for done in (scanned, phrases, shared, located, hot, *verdicts):
        discard(done)
    return rows.join(spans, ["ord", "tk"], "left").select("doc_id", "text", "spans") \
        .mapInArrow(_apply, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string")


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d WHERE len(w) >= 50)),
low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN low USING (g) WHERE m < doc_id),
pos AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
