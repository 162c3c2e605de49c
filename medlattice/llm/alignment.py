"""Alignment of two tokenizers' ids over the bytes they share.

A (byte-level BPE, with a space before the text) and B (a SentencePiece model) cut the
same bytes into tokens. The byte offsets where a token of each ends cut the text into
groups; the two tokens that end together are a link, and an id pair's count is the number
of its links in the whole corpus.

Method: identity-map fast path. An array maps each A id to the B id of the same bytes. A
group of one A and one B token that this array maps to each other is counted in a vector
as long as A's vocabulary, one vector a task; only the other, irregular links enter the
shuffle of id pairs, summed per slice of documents first. So a pair that stands in a third
of all rows comes as one row a slice.

A text is cut where a space follows a character that is no white space. Neither tokenizer
has a token across such a place, so the groups of a text are the groups of its parts
joined by place, and each distinct part is encoded and aligned once per slice or remembered
(at most ``TABLE_PARTS`` parts). Slices hold at most ``SLICE_ROWS`` documents or about
``SLICE_CHARS`` bytes of text.

Stages: documents -> slices, written (the texts are read and encoded once) as small rows: a
document each, ``PAIRS_A_ROW`` id pairs each, and the packed links of the slice; id pairs of
all slices summed; the sums sent back to the slices that asked, where they are sorted by
slice and meet its documents one slice at a time. So no task holds more than one slice, however
many it has. Only vectors as long as a vocabulary pass through the driver.

Defined results. A text that is null, empty, or holds U+2581 (its B bytes differ) has no
tokens: zeros and empty groups. Repeated rows count and return each; a null id stays null;
an empty table gives an empty one; ties for the highest count are all best. Very long texts
are one row of a slice of their own. Only the id and text columns are read, so columns of
other names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlattice.llm.common import materialize
from medlattice.llm.pieces import MARK, slices
from medlattice.llm.repeats import _pack, _unpack

SLICE_ROWS = 4096
SLICE_CHARS = 4_000_000
CHUNK_CHARS = 125_000               # of a slice, cut into parts at once
PAIRS_A_ROW = 256
TABLE_PARTS = 200_000
#: A's word pattern (a fixed value of the byte-level vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S)(?= )")


def byte_letters() -> dict[str, int]:
    """Letter of the byte-level alphabet -> byte: printable Latin-1 stands for itself, the
    other bytes for the letters from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


class Pair:
    """Both tokenizers, the bytes of their ids, and the map from A ids to B ids."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["id"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if i not in special}
        self.a = tiktoken.Encoding("A", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        n = self.b.get_piece_size()
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else
                   self.b.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.n_a, self.n_b = max(ranks.values()) + 1, n
        self.a_len, self.b_len = np.zeros(self.n_a, np.int64), np.array([len(b) for b in b_bytes])
        self.same = np.full(self.n_a, -1, np.int64)
        # byte pieces first, so that an ordinary piece of the same bytes takes their place
        order = sorted((i for i in range(n) if not (self.b.is_control(i) or self.b.is_unknown(i))), key=self.b.is_byte, reverse=True)
        b_of = {b_bytes[i]: i for i in order}
        for raw, i in ranks.items():
            self.a_len[i] = len(raw)
            self.same[i] = b_of.get(raw, -1)


_PAIRS: dict[tuple[str, str], Pair] = {}


def pair(a_path: str, b_path: str) -> Pair:
    """One pair per Python worker and two files."""
    if (a_path, b_path) not in _PAIRS:
        _PAIRS[a_path, b_path] = Pair(a_path, b_path)
    return _PAIRS[a_path, b_path]


def parts_of(text: str) -> list[str]:
    """Parts of space + text, cut where a space follows a character that is no white space."""
    return _CUT.split(" " + text)


class Ragged:
    """Lists of numbers in one flat array."""

    def __init__(self):
        self.flat, self.start = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def extend(self, flat: np.ndarray, counts: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, flat])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(counts)])

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the given lists, and for each the place in ``rows``."""
        n = self.start[rows + 1] - self.start[rows]
        owner = np.repeat(np.arange(len(rows)), n)
        first = np.cumsum(n) - n
        return self.flat[self.start[rows][owner] + np.arange(len(owner)) - first[owner]], owner


class PartTable:
    """Distinct part -> its groups and links."""

    def __init__(self, tokenizers: Pair):
        self.t = tokenizers
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.groups: list[str] = []
        self.tokens_a, self.tokens_b, self.n_groups = Ragged(), Ragged(), Ragged()
        self.exact, self.pairs = Ragged(), Ragged()

    def _encode_a(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts and the number of each. Parts that end in white space (the
        last of a text) are encoded alone, the others as one text."""
        solid = [i for i, p in enumerate(parts) if not p[-1].isspace()]
        ids = np.array(self.t.a.encode_ordinary("".join(parts[i] for i in solid)), np.int64)
        ends = np.searchsorted(np.cumsum(self.t.a_len[ids]), np.cumsum([len(parts[i].encode()) for i in solid])) + 1 if solid else []
        lists: list = [None] * len(parts)
        at = 0
        for i, end in zip(solid, np.asarray(ends).tolist()):
            lists[i], at = ids[at:end], end
        for i, p in enumerate(parts):
            if lists[i] is None:
                lists[i] = np.array(self.t.a.encode_ordinary(p), np.int64)
        return np.concatenate(lists), np.array([len(x) for x in lists])

    def learn(self, parts: set[str]) -> None:
        new = [p for p in parts if p not in self.row]
        if len(self.row) + len(new) > TABLE_PARTS:
            self.clear()
            new = list(parts)
        if not new:
            return
        t = self.t
        a, count_a = self._encode_a(new)
        # the library puts a marker before a text, so a part's first space is left to it;
        # a part that is one space is a marker alone, for which the library gives nothing
        lone = [t.b.piece_to_id(MARK)]
        lists = [ids if p != " " else lone for p, ids in zip(new, t.b.encode([p[1:] for p in new], num_threads=1))]
        count_b = np.array([len(x) for x in lists])
        b = np.fromiter(chain.from_iterable(lists), np.int64, int(count_b.sum()))
        end_a, end_b = np.cumsum(t.a_len[a]), np.cumsum(t.b_len[b])
        if end_a[-1] != end_b[-1]:
            raise ValueError("the tokenizers do not spell the same bytes")
        # group borders: ends of both; the links stand there
        at_a = np.flatnonzero(np.isin(end_a, end_b, assume_unique=True))
        at_b = np.flatnonzero(np.isin(end_b, end_a, assume_unique=True))
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        part = np.searchsorted(np.cumsum(count_a), at_a, side="right")
        exact = (size_a == 1) & (size_b == 1) & (t.same[a[at_a]] == b[at_b])
        n = len(new)
        per_part = np.bincount(part, minlength=n)
        self.tokens_a.extend(count_a, np.ones(n, np.int64))
        self.tokens_b.extend(count_b, np.ones(n, np.int64))
        self.n_groups.extend(per_part, np.ones(n, np.int64))
        self.exact.extend(a[at_a][exact], np.bincount(part[exact], minlength=n))
        self.pairs.extend((a[at_a] * t.n_b + b[at_b])[~exact], np.bincount(part[~exact], minlength=n))
        text_a, text_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        groups = [",".join(text_a[i - m + 1:i + 1]) + "|" + ",".join(text_b[j - k + 1:j + 1])
                  for i, m, j, k in zip(at_a.tolist(), size_a.tolist(), at_b.tolist(), size_b.tolist())]
        stop = np.cumsum(per_part).tolist()
        for p, lo, hi in zip(new, [0] + stop, stop):
            self.row[p] = len(self.groups)
            self.groups.append(";".join(groups[lo:hi]))


_SLICE = ("slice long, doc int, doc_id long, n_a long, n_b long, n_groups long, groups string, links binary, "
          "exact_a array<int>, exact_n array<long>, at int, pair array<long>, pair_total array<long>")


def _counted(owner: np.ndarray, value: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) and how often each occurs."""
    both, n = np.unique(owner * max(width, 1) + value, return_counts=True)
    return both // max(width, 1), both % max(width, 1), n


def _slice_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
             "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split(" ") for x in _SLICE.split(", "))])


def _rows(schema: pa.Schema, n: int, **values) -> pa.RecordBatch:
    """``n`` rows of some columns, the others null."""
    return pa.RecordBatch.from_arrays([pa.array(values[f.name], f.type) if f.name in values else pa.nulls(n, f.type) for f in schema], schema=schema)


def aligned_slices(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Small rows of slices of documents, of three kinds: a document (``doc``, its place in the
    slice) with its groups (``a1,a2|b1;a3|b2``); at most PAIRS_A_ROW of the slice's distinct
    irregular pairs (A id * size of B's vocabulary + B id) with their counts, from place ``at``
    on; and ``links``, the exact links by document and A id and the others by document and
    place, packed. ``pair`` is empty where there are none. A row without ``slice`` per task
    holds the vector of its exact links: A ids in ``exact_a``, counts in ``exact_n``."""
    def run(batches):
        t, schema = pair(a_path, b_path), _slice_schema()
        table, total, seq = PartTable(t), np.zeros(t.n_a, np.int64), 0
        first = TaskContext.get().partitionId() << 32
        for whole in slices(batches, "text", SLICE_ROWS, SLICE_CHARS):
            number, before, links = first + seq, 0, []
            for part in slices([whole], "text", SLICE_ROWS, CHUNK_CHARS):
                parts = [parts_of(x) if x and MARK not in x else [] for x in part.column("text").to_pylist()]
                table.learn(set(chain.from_iterable(parts)))
                rows = [[table.row[p] for p in ps] for ps in parts]
                n, at = len(rows), np.fromiter(chain.from_iterable(rows), np.int64)
                doc = np.repeat(np.arange(n), [len(r) for r in rows])

                def sums(column):
                    return np.bincount(doc, column.flat[at], n).astype(np.int64) if len(at) else np.zeros(n, np.int64)
                yield _rows(schema, n, slice=np.full(n, number), doc=np.arange(before, before + n), doc_id=part.column("doc_id"),
                            n_a=sums(table.tokens_a), n_b=sums(table.tokens_b), n_groups=sums(table.n_groups),
                            groups=[";".join([table.groups[i] for i in r]) for r in rows], pair=[[]] * n)
                exact, owner = table.exact.take(at)
                total += np.bincount(exact, minlength=t.n_a)
                e_doc, e_a, e_n = _counted(doc[owner], exact, t.n_a)
                pairs, owner = table.pairs.take(at)
                distinct, place = np.unique(pairs, return_inverse=True)
                p_doc, p_at, p_n = _counted(doc[owner], place, len(distinct))
                links.append((e_doc + before, e_a, e_n, p_doc + before, distinct[p_at], p_n))
                before += n
            e_doc, e_a, e_n, p_doc, pairs, p_n = (np.concatenate(x).astype(np.int64) for x in zip(*links))
            distinct, p_at = np.unique(pairs, return_inverse=True)
            n = np.bincount(p_at, p_n, len(distinct)).astype(np.int64)
            edge = np.arange(0, len(distinct), PAIRS_A_ROW)
            yield _rows(schema, len(edge), slice=np.full(len(edge), number), at=edge, pair=[distinct[i:i + PAIRS_A_ROW] for i in edge],
                        pair_total=[n[i:i + PAIRS_A_ROW] for i in edge])
            yield _rows(schema, 1, slice=[number], links=[_pack(e_doc, e_a, e_n, p_doc, p_at.astype(np.int64), p_n, distinct)], pair=[[]])
            seq += 1
        used = np.flatnonzero(total)
        if len(used):
            yield _rows(schema, 1, exact_a=[used], exact_n=[total[used]])
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, _SLICE)


def link_counts(slices_: DataFrame, tokenizers: Pair) -> tuple[np.ndarray, DataFrame]:
    """The corpus-wide counts: of exact links by A id (a vector), of the others (pair, n).
    The two never hold the same id pair: tokens of the same bytes that end together start
    together too, so they are always a group of their own."""
    vector = np.zeros(tokenizers.n_a, np.int64)
    tasks = slices_.where("slice IS NULL").select(F.explode(F.arrays_zip("exact_a", "exact_n")).alias("x"))
    for r in tasks.groupBy("x.exact_a").agg(F.sum("x.exact_n").alias("n")).collect():     # at most A's vocabulary
        vector[r["exact_a"]] = r["n"]
    asked = slices_.where("slice IS NOT NULL").select(F.explode(F.arrays_zip("pair", "pair_total")).alias("x"))
    return vector, asked.groupBy(F.col("x.pair").alias("pair")).agg(F.sum("x.pair_total").alias("n"))


def align(docs: DataFrame, a_path: str, b_path: str, doc_id: str = "doc_id", text: str = "text",
          keep: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and ``groups``.
    ``keep`` is applied to the groups before anything is written, so that a caller who needs
    a digest only does not store the texts of all groups."""
    written = materialize(aligned_slices(docs, a_path, b_path, doc_id, text)
                          .withColumn("groups", F.when(F.col("doc").isNotNull(), keep(F.col("groups")))), "alignment")
    tokenizers = pair(a_path, b_path)
    vector, sums = link_counts(written, tokenizers)
    sums = materialize(sums, "pair-counts")
    best = np.zeros(tokenizers.n_b, np.int64)
    for r in sums.groupBy((F.col("pair") % tokenizers.n_b).alias("b")).agg(F.max("n").alias("n")).collect():  # at most B's vocabulary
        best[r["b"]] = r["n"]
    mapped = tokenizers.same >= 0
    np.maximum.at(best, tokenizers.same[mapped], vector[mapped])

    live = written.where("slice IS NOT NULL")
    asked = live.select("slice", "at", F.posexplode("pair").alias("from", "pair")).select("slice", (F.col("at") + F.col("from")).alias("at"), "pair")
    answers = asked.join(sums, "pair").select(F.col("slice").alias("asker"), "at", "n")
    held = live.where("doc IS NOT NULL OR links IS NOT NULL").select("slice", "doc", "doc_id", "n_a", "n_b", "n_groups", "groups", "links")
    kind = written.schema["groups"].dataType
    same, n_b = tokenizers.same, tokenizers.n_b
    best_exact = (vector > 0) & (vector == best[same]) & mapped

    def settle(rows: pa.Table, found: pa.Table) -> pa.Table:
        """The documents of one slice, from its rows and the counts that it asked for."""
        packed = next(x for x in rows.column("links").to_pylist() if x is not None)
        e_doc, e_a, e_n, p_doc, p_at, p_n, pairs = _unpack(packed, *[np.int64] * 7)
        known = np.zeros(len(pairs), np.int64)
        known[found.column("at").to_numpy()] = found.column("n").to_numpy()
        rows = rows.filter(pc.is_valid(rows.column("doc"))).sort_by("doc")
        links = np.zeros(rows.num_rows, np.int64)
        n_best, total = links.copy(), links.copy()
        count = known[p_at]
        for d, count, top, t in ((e_doc, vector[e_a], best_exact[e_a], e_n), (p_doc, count, count == best[pairs[p_at] % n_b], p_n)):
            np.add.at(links, d, t)
            np.add.at(total, d, t * count)
            np.add.at(n_best, d, t * top)
        return pa.table([rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")] + [pa.array(x) for x in (links, n_best, total)]
                        + [rows.column("groups")], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long"
    return held.groupBy("slice").cogroup(answers.groupBy("asker")).applyInArrow(settle, f"{out}, groups {kind.simpleString()}")
