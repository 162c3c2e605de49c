"""SentencePiece encoding and decoding through a table of distinct chunks.

A SentencePiece model writes a space as the marker U+2581. Where no piece of the model
has a marker behind another character, no merge can cross the place before a run of
markers: a text is cut there, each distinct marked word (``chunk``) is segmented once, and
the ids of a text are its chunks' ids joined by position. That is exact, since merges are
chosen by score and place among neighbours inside a chunk only.

The table of distinct chunks belongs to one Python worker: it is built slice by slice (at
most ``SLICE_ROWS`` texts or ``SLICE_CHARS`` characters), so a chunk is segmented once for
each slice or remembered from an earlier one, and is emptied beyond ``TABLE_CHUNKS``
entries or ``TABLE_CHARS`` characters. No row leaves its task: there is no shuffle, a hot
source or a group of copies is split like any other rows, and a lost executor costs only
its own tasks.

Defined results. Null text: the ids of an empty text (the end id alone, if asked for),
decoded to the empty string. U+2581 in a text is a marker like a space, as in the library.
Repeated rows each give a row, an empty table gives an empty one, very long texts are cut
into segments at chunk borders. Other columns stay as they are, but for ``ids`` and
``decoded``, which the operators write (name them otherwise by ``out``).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
SLICE_ROWS = 256
SLICE_CHARS = 4_000_000
SEGMENT_CHARS = 1_000_000
TABLE_CHUNKS = 400_000
TABLE_CHARS = 20_000_000
#: a run of spaces with the word behind it
CHUNK = regex.compile(r" +[^ ]*")


def segments(text: str, border: regex.Pattern, size: int = SEGMENT_CHARS) -> Iterator[str]:
    """Cut a long text where ``border`` matches, about every ``size`` characters; the match
    itself is left out. A text without such a place stays whole."""
    at = 0
    while len(text) - at > size:
        cut = border.search(text, at + size)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:]


def slices(batches, column: str, rows: int = SLICE_ROWS, chars: int = SLICE_CHARS):
    """Cut Arrow batches into slices of at most ``rows`` rows and about ``chars`` bytes of text."""
    for batch in batches:
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        at = 0
        while at < batch.num_rows:
            upto = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:at + rows]), chars, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


class ChunkTable:
    """Distinct chunk -> its ids, for one model in one worker."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "  a  b \tﬁ½\n "
        #: chunks may stand alone: no marker inside a piece, spaces kept, nothing rewritten
        self.separable = (not any(regex.search(f"[^{MARK}]{MARK}", p) for p in pieces)
                          and self.model.normalize(probe) == MARK + probe.replace(" ", MARK))
        self.known: dict[str, bytes] = {}                      # ids as 32-bit numbers
        self.chars = 0

    def learn(self, words: set[str]) -> None:
        """Segment words (chunks without their first marker, which the library puts before
        any text itself) that are not in the table."""
        new = list(words - self.known.keys())
        if len(self.known) + len(new) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self.known, self.chars = {}, 0
            new = list(words)
        self.known.update(zip(new, map(packed, self.model.encode(new, num_threads=1) if new else [])))
        if "" in self.known:            # the library gives nothing for an empty text, but a marker alone is a chunk
            self.known[""] = packed([self.model.piece_to_id(MARK)])
        self.chars += sum(map(len, new))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null and empty texts have none."""
        if not self.separable:
            return [packed(self.model.encode(t or "", num_threads=1)) for t in texts]
        words = [[w for part in segments(t, _BORDER) for w in marked_words(part)] if t else [] for t in texts]
        self.learn(set(chain.from_iterable(words)))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


def packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


def marked_words(text: str) -> list[str]:
    """The chunks of a text, each without its first marker. The first chunk is what
    stands before the first border, its first marker being the one the library adds."""
    text = text.replace(MARK, " ")
    if "  " not in text and not text.startswith(" "):
        return text.split(" ")
    return [c[1:].replace(" ", MARK) for c in CHUNK.findall(" " + text)]


#: between another character and a marker: a segment ends here, and the marker is left to the library
_BORDER = regex.compile(rf"(?<=[^ {MARK}])[ {MARK}]")
_TABLES: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    """One table per Python worker and model."""
    if path not in _TABLES:
        _TABLES[path] = ChunkTable(path)
    return _TABLES[path]


def _with(docs: DataFrame, out: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in docs.schema.fields if f.name != out] + [T.StructField(out, kind)])


def _append(part: pa.RecordBatch, out: str, values: pa.Array) -> pa.RecordBatch:
    names = [n for n in part.schema.names if n != out]
    return pa.RecordBatch.from_arrays([part.column(n) for n in names] + [values], names=names + [out])


def encode(docs: DataFrame, path: str, text: str = "text", end: bool = True, out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text (array of int) in ``out``, followed by the end id
    if ``end`` is set: what the library gives without sampling."""
    def run(batches):
        for part in slices(batches, text):
            table = chunk_table(path)
            tail = packed([table.model.eos_id()]) if end else b""
            ids = [i + tail for i in table.encode(part.column(text).to_pylist())]
            ends = np.cumsum([0] + [len(i) // 4 for i in ids])
            yield _append(part, out, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32))))
    return docs.withColumn(text, F.col(text).cast("string")).mapInArrow(run, _with(docs, out, T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text that the library's decode gives for each list of ids in
    ``out``; null ids give a null text."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                model = chunk_table(path).model
                texts = [None if i is None else model.decode(i) for i in part.column(ids).to_pylist()]
                yield _append(part, out, pa.array(texts, pa.large_string() if sum(map(len, filter(None, texts))) > 1 << 28 else pa.string()))
    return encoded.mapInArrow(run, _with(encoded, out, T.StringType()))
