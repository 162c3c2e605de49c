"""Secret scans through a trigram inverted index.

From each rule's regex a Boolean query over trigrams is derived that every match must
satisfy. Texts are indexed in blocks: the postings of the trigrams that some query
names, as sorted document numbers. A rule's postings are united and intersected as its
query says, and only the documents left are searched with the regex. A rule without
mandatory trigrams scans every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlattice.llm.common import LOWER, byte_texts, text_slices


@dataclass(frozen=True)
class Rule:
    """least: shortest length of group ``group`` for a match to count."""
    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Further shapes, listed after the base kinds. Fixed formats of published credentials.
MORE_RULES = (
    Rule("privatekey", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES
MASK = "[REDACTED]"


# ------------------------------------------------------------ trigram queries
# A query is True (no constraint), a trigram, ("and", {...}) or ("or", {...}).
def _join(kind: str, parts) -> object:
    parts = frozenset(parts)
    if kind == "and":
        parts -= {True}
    elif True in parts:
        return True
    return True if not parts else next(iter(parts)) if len(parts) == 1 else (kind, parts)


def _of_strings(strings: set[str]) -> object:
    """Some of these strings occurs."""
    return _join("or", [_join("and", [s[i:i + 3] for i in range(len(s) - 2)]) for s in strings])


def _strings(node, limit: int = 32) -> set[str] | None:
    """The finite set of strings that a node matches (ASCII, lower case), if small."""
    what, arg = node
    if what is op.LITERAL:
        return {chr(arg).lower()} if arg < 128 else None
    if what is op.IN and all(k is op.LITERAL and v < 128 for k, v in arg) and len(arg) <= 8:
        return {chr(v).lower() for _, v in arg}
    if what is op.SUBPATTERN:
        return _sequence_strings(arg[3], limit)
    if what is op.BRANCH:
        each = [_sequence_strings(x, limit) for x in arg[1]]
        return None if None in each or sum(map(len, each)) > limit else set().union(*each)
    if what is op.MAX_REPEAT and arg[1] <= 4:
        one = _sequence_strings(arg[2], limit)
        out, power = set(), {""}
        for times in range(arg[1] + 1 if one is not None else 0):
            if times >= arg[0]:
                out |= power
            power = {a + b for a in power for b in one}
            if len(power) > limit:
                return None
        return out if one is not None else None
    return None


def _sequence_strings(nodes, limit: int) -> set[str] | None:
    out = {""}
    for node in nodes:
        each = _strings(node, limit)
        if each is None or len(out) * len(each) > limit:
            return None
        out = {a + b for a in out for b in each}
    return out


def _query(nodes) -> object:
    """Query of a sequence: runs of finite strings are joined end to end and give
    trigrams across node borders; other nodes give what holds within them."""
    clauses, run = [], {""}
    for node in nodes:
        each = _strings(node)
        if each is not None and len(run) * len(each) <= 64:
            run = {a + b for a in run for b in each}
            continue
        clauses.append(_of_strings(run))
        run = each if each is not None else {""}
        what, arg = node
        if each is None:
            if what is op.SUBPATTERN:
                clauses.append(_query(arg[3]))
            elif what is op.BRANCH:
                clauses.append(_join("or", [_query(x) for x in arg[1]]))
            elif what is op.MAX_REPEAT and arg[0] >= 1:
                clauses.append(_query(arg[2]))
    return _join("and", [*clauses, _of_strings(run)])


def trigram_query(pattern: str) -> object:
    """Boolean trigram query (ASCII letters folded) that holds wherever the regex matches."""
    return _query(parser.parse(pattern))


def _trigrams(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


# ---------------------------------------------------------------- block index
def _code(trigram: str) -> int:
    a, b, c = trigram.encode("ascii")
    return a << 16 | b << 8 | c


class BlockIndex:
    """Postings of the wanted trigrams in one block of texts (case-folded bytes)."""

    def __init__(self, texts: list[bytes], wanted: np.ndarray):
        joined = np.frombuffer(b"\0\0".join(texts).translate(LOWER), np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
        self.size = len(texts)
        if len(joined) < 3 or not len(wanted):
            self.codes, self.docs = np.empty(0, np.int32), np.empty(0, np.int64)
            return
        leads = np.zeros(256, bool)
        leads[wanted >> 16] = True
        at = np.flatnonzero(leads[joined[:-2]])
        codes = joined[at].astype(np.int32) << 16 | joined[at + 1].astype(np.int32) << 8 | joined[at + 2]
        place = np.searchsorted(wanted, codes)
        hit = wanted[np.minimum(place, len(wanted) - 1)] == codes
        pairs = np.unique(codes[hit].astype(np.int64) * len(texts) + np.searchsorted(ends, at[hit], "right"))
        self.codes, self.docs = pairs // len(texts), pairs % len(texts)

    def postings(self, trigram: str) -> np.ndarray:
        lo, hi = np.searchsorted(self.codes, [_code(trigram), _code(trigram) + 1])
        return self.docs[lo:hi]

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            return self.postings(query)
        kind, parts = query
        found = sorted(map(self.candidates, parts), key=len)
        out = found[0]
        for more in found[1:]:
            out = np.intersect1d(out, more, assume_unique=True) if kind == "and" else np.union1d(out, more)
        return out


def compile_rules(rules=RULES) -> list[tuple]:
    """(rule, regex, query) of each rule."""
    return [(r, re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)), trigram_query(r.pattern)) for r in rules]


def _wanted(compiled) -> np.ndarray:
    return np.array(sorted(_code(t) for t in set().union(*(_trigrams(q) for _, _, q in compiled))), np.int32)


def _matches(rule: Rule, regex: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span() for m in regex.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def _scan_regex(rule: Rule, regex: re.Pattern, query) -> re.Pattern:
    """For a full scan of one repeated class, ask for the least length at once: maximal
    runs below it are no matches, so the matches are the same and short runs cost little."""
    if query is True and rule.group == 0 and rule.pattern.startswith("[") and rule.pattern.index("]") == len(rule.pattern) - 2 \
            and rule.pattern.endswith("+"):
        return re.compile(f"{rule.pattern[:-1]}{{{max(1, rule.least)},}}", regex.flags & ~re.UNICODE)
    return regex


def find_all(texts: list[bytes], compiled, wanted: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Per text: (start, rule number, end) in code points, by start and rule."""
    index, out, decoded = BlockIndex(texts, wanted), [[] for _ in texts], {}
    for number, (rule, regex, query) in enumerate(compiled):
        fast = _scan_regex(rule, regex, query)
        for d in index.candidates(query).tolist():
            if d not in decoded:
                decoded[d] = texts[d].decode("utf-8")
            out[d] += [(a, number, b) for a, b in _matches(rule, fast, decoded[d])]
    return [sorted(x) for x in out]


SPANS = "array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` (doc_id, text) with ``spans``: per row, the matches of all rules as
    (kind, start, end) in code points, end exclusive, by start and then by the rules'
    order. Null and empty texts have none. One result row per input row, repeats and
    null ids included; other columns are ignored."""
    compiled = compile_rules(rules)
    wanted = _wanted(compiled)
    kinds = [r.kind for r in rules]

    def run(batches):
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for part in text_slices(batches):
            found = find_all([t or b"" for t in byte_texts(part.column("text"))], compiled, wanted)
            spans = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, item)], names=["doc_id", "spans"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, f"doc_id long, spans {SPANS}")


def span_text(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """Text with each maximal run of overlapping or touching spans replaced by MASK."""
    out, at, n = [], 0, len(spans)
    i = 0
    while i < n:
        start, end = spans[i]
        while i + 1 < n and spans[i + 1][0] <= end:
            i += 1
            end = max(end, spans[i][1])
        out += [text[at:start], MASK]
        at = end
        i += 1
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with secrets in ``text`` masked and ``n_chars``, if there, recounted
    where the text changed. Rows, order of columns and other values stay."""
    compiled = compile_rules(rules)
    wanted = _wanted(compiled)

    def run(batches):
        for part in text_slices(batches):
            texts = byte_texts(part.column("text"))
            found = find_all([t or b"" for t in texts], compiled, wanted)
            new = [t if not x else mask(t.decode("utf-8"), [(a, b) for a, _, b in x]).encode("utf-8") for t, x in zip(texts, found)]
            columns = dict(zip(part.schema.names, part.columns))
            columns["text"] = pa.array(new, pa.binary()).cast(part.schema.field("text").type)
            if "n_chars" in columns:
                counts = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(t.decode("utf-8")) if x else n for t, x, n in zip(new, found, counts)],
                                              part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    return docs.mapInArrow(run, docs.schema)

