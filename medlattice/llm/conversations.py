"""Repair of conversation structure by least edits, with a Viterbi run in parallel chunks.

A conversation's turns are to read ``(s?(ua)+)?`` by the first letters of their roles
(system, user, assistant). Edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert
an empty user or assistant turn anywhere 2. Blank and repeated turns must be deleted, a
truncated turn that is not deleted costs 1. The audit is the cheapest edits' initials, the
least one by ASCII where several are cheapest.

Method: rank-convergence parallel Viterbi. Turns are sorted by (conversation, turn) over
range partitions and cut into chunks (``CHUNK_ROWS`` turns or ``CHUNK_BYTES``), so a
conversation that holds a third of all rows is spread over many tasks. Costs run backward:
the vector at a turn is the cost, by state, of finishing from there. A chunk in the middle
starts from a speculative vector (the end's). Fix-up passes then rerun the chunks whose
successor's vector came out different, turn by turn from the end, until old and new vector
differ only by a constant; from there on all earlier costs differ by that constant too.
The passes end when no chunk's vector changes direction. The stitched backward costs drive
the tracing: each chunk maps its four possible first states to its last one, the maps are
chained per conversation (one small row a chunk), and each chunk traces its own edits.

Bounds: a task holds one chunk; a conversation's chunk summaries meet in one task (one row
per ``CHUNK_ROWS`` turns); repeated turns of different chunks are found by an aggregate.
A conversation that is one chunk needs no pass beyond the first. The passes repeat as long
as vectors change, in the worst case once a chunk; forced deletions change no vector.

Defined results. Rows of one turn number stand by role, then text (the first 16 and 64
characters, beyond them by hash); null turns first; a null role or text is one space; a
null conversation id is a conversation of its own; repeated rows are repeated turns; a role
that is empty or begins otherwise can only be rewritten or deleted; an empty table gives an
empty one. Only four columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlattice.llm.common import materialize

CHUNK_ROWS = 16_384
CHUNK_BYTES = 16 * 1024 * 1024
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: states: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
#: the state that an inserted or rewritten turn leads to, and its role
NEXT = (USER, USER, ASSISTANT, USER)
NAME = {USER: "user", ASSISTANT: "assistant"}
KEEP = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None), "": (None,) * 4}
#: a code per turn: 2 * kind of role + truncated, or FORCED
KINDS = ("s", "u", "a", "")
FORCED = 2 * len(KINDS)
#: cost of closing a conversation in each state, and the inserts that do it
CLOSING = (0, 2 * INSERT, INSERT, 0)
CLOSE = ("", "II", "I", "")
SPACES = " \t\n\x0b\f\r"
LEGAL = {"su", "ua", "au"}

_STEPS: dict[tuple, tuple] = {}


# --------------------------------------------------------------------------- one turn
def step(code: int, after: tuple) -> tuple[tuple, tuple]:
    """The cost vector before a turn from the one after it (least entry taken off), and for
    each state the least letters up to and with this turn's own edit, and the next state."""
    known = _STEPS.get((code, after))
    if known is None:
        known = _STEPS[code, after] = _step(code, after)
    return known


def _step(code: int, after: tuple) -> tuple[tuple, tuple]:
    if code == FORCED:
        return after, tuple(("D", s) for s in range(4))
    keep, extra = KEEP[KINDS[code // 2]], CUT_OFF * (code % 2)

    def kept(s):
        return float("inf") if keep[s] is None else after[keep[s]] + extra
    costs = [min(DELETE + after[s], kept(s), REROLE + extra + after[NEXT[s]]) for s in range(4)]
    for _ in range(4):
        costs = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]

    def move(s):
        letters = ""
        while True:
            if DELETE + after[s] == costs[s]:
                return letters + "D", s
            if INSERT + costs[NEXT[s]] == costs[s]:
                letters, s = letters + "I", NEXT[s]
            elif kept(s) == costs[s]:
                return letters + "K", keep[s]
            else:
                return letters + "R", NEXT[s]
    least = min(costs)
    return tuple(int(c - least) for c in costs), tuple(map(move, range(4)))


def backward(codes: bytes, after: tuple) -> tuple:
    """The vector before the first turn."""
    for code in reversed(codes):
        after = step(code, after)[0]
    return after


def fix_up(codes: bytes, old: tuple, new: tuple, old_start: tuple) -> tuple[tuple, int]:
    """The vector before the first turn for a new vector behind the last, and the turns that
    were run again. Both vectors are run until they differ by a constant only (vectors are
    kept without their least entry, so they are then equal)."""
    for n, code in enumerate(reversed(codes)):
        if old == new:
            return old_start, n
        old, new = step(code, old)[0], step(code, new)[0]
    return new, len(codes)


def trace(codes: bytes, after: tuple, state: int) -> tuple[list[str], int]:
    """The letters of each turn from a first state, and the last state."""
    moves = []
    for code in reversed(codes):
        after, move = step(code, after)
        moves.append(move)
    letters = []
    for move in reversed(moves):
        edit, state = move[state]
        letters.append(edit)
    return letters, state


def faults(roles: list[str], texts: list[str], late=()) -> tuple[bytes, dict[str, int]]:
    """A code per turn and the counts of first faults; ``late`` are places of turns seen in
    an earlier chunk."""
    codes, seen, late = bytearray(), set(), set(late)
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for i, (role, text) in enumerate(zip(roles, texts)):
        core = text.strip(SPACES)
        if not core:
            count["blank"] += 1
            codes.append(FORCED)
        elif i in late or (role, text) in seen:
            count["duplicate"] += 1
            codes.append(FORCED)
        else:
            seen.add((role, text))
            cut_off = core[-1] not in ".!?"
            count["truncated"] += cut_off
            kind = role[:1] if role[:1] in KINDS else ""
            codes.append(2 * KINDS.index(kind) + cut_off)
    return bytes(codes), count


def edited(roles: list[str], texts: list[str], letters: list[str], state: int) -> list[tuple[str, str]]:
    """The (role, text) turns that the letters leave, from a first state."""
    out = []
    for role, text, edits in zip(roles, texts, letters):
        for e in edits:
            if e == "K":
                out.append((role, text))
                state = KEEP[role[:1]][state]
            elif e != "D":
                state = NEXT[state]
                out.append((NAME[state], text if e == "R" else ""))
    return out


# ---------------------------------------------------------------------------- damage
def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by a rule on crc32 of ``conv_id:turn`` modulo 20: 0 drops the turn, 1
    empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it a user's. A dropped
    turn stays as a row that is not ``present``, so that no conversation is lost."""
    space = F.lit(" ")
    turn_id = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), space).alias("role"),
                             F.coalesce(F.col("text").cast("string"), space).alias("text"), (F.crc32(turn_id.cast("binary")) % 20).alias("case"))
    case = F.col("case")
    copies = F.explode(F.when(case == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    text = F.when(case <= 1, "").when(case == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", F.when(case == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                    (case != 0).alias("present"), copies).drop("copy")


# ---------------------------------------------------------------------------- chunks
def _chunk_schema(conv: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), T.StructField("chunk", T.LongType()), T.StructField("whole", T.BooleanType()),
                         T.StructField("turns", T.ArrayType(T.LongType())), T.StructField("roles", T.ArrayType(T.StringType())),
                         T.StructField("texts", T.ArrayType(T.StringType())), T.StructField("present", T.ArrayType(T.BooleanType()))])


def _starts(conv: pa.Array) -> np.ndarray:
    """Where a new conversation begins (null ids are one)."""
    a, b = conv.slice(1), conv.slice(0, len(conv) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return np.append(0, np.flatnonzero(~np.asarray(same)) + 1)


def chunks(turns: DataFrame, rows: int = CHUNK_ROWS, size: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk of a conversation, its turns as arrays in order. ``chunk`` rises
    along a conversation; ``whole`` is set where the conversation surely has no other chunk."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.left("role", F.lit(16)), F.left("text", F.lit(64)), F.xxhash64("role", "text"), F.col("salt")]
    # the salt lets a range border fall between equal rows
    ranged = turns.select("conv_id", "turn", "role", "text", "present", F.monotonically_increasing_id().alias("salt")) \
        .repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]):
        task, made = TaskContext.get().partitionId() << 32, 0
        rest, fresh, begun = None, False, False       # open rows; are they not the partition's first; have some been written

        def out(table, spans):
            nonlocal made
            ends = pa.array([spans[0][0]] + [hi for _, hi, _ in spans], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in ("turn", "role", "text", "present")]
            ids = pa.array(range(task + made, task + made + len(spans)), pa.int64())
            made += len(spans)
            conv = table.column("conv_id").take(pa.array([lo for lo, _, _ in spans])).combine_chunks()
            return pa.RecordBatch.from_arrays([conv, ids, pa.array([w for *_, w in spans]), *lists],
                                              names=["conv_id", "chunk", "whole", "turns", "roles", "texts", "present"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [*rest, batch])
            starts = np.append(_starts(table.column("conv_id").combine_chunks()), table.num_rows).tolist()
            bytes_upto = np.cumsum(pc.binary_length(table.column("text")).to_numpy())
            spans = []
            for lo, hi in zip(starts, starts[1:]):
                last, at = hi == table.num_rows, lo
                while at < hi:
                    fit = int(np.searchsorted(bytes_upto, (bytes_upto[at - 1] if at else 0) + size, side="right"))
                    cut = min(hi, at + rows, max(fit, at + 1))
                    if last and cut == hi:
                        break                                      # stays open
                    spans.append((at, cut, fresh and not begun and at == lo and cut == hi))
                    begun, at = cut < hi or last, cut
                if not last:
                    fresh, begun = True, False
            rest = table.slice(at).to_batches()
            if spans:
                yield out(table, spans)
        if rest is not None:
            table = pa.Table.from_batches(rest)
            yield out(table, [(0, table.num_rows, False)])
    return ranged.drop("salt").mapInArrow(run, _chunk_schema(turns.schema["conv_id"].dataType))


def _there(row: dict) -> tuple[list, list[str], list[str], list[int]]:
    """Turn numbers, roles, texts and places of the turns that are present."""
    at = [i for i, p in enumerate(row["present"]) if p]
    return [row["turns"][i] for i in at], [row["roles"][i] for i in at], [row["texts"][i] for i in at], at


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _emit(rows: Iterator[dict], schema: T.StructType, at_once: int = 256):
    """Arrow batches of dictionaries."""
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow, held = to_arrow_schema(schema), []
    for row in rows:
        held.append(row)
        if len(held) == at_once:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


# --------------------------------------------------------------------- stitched chunks
def _schema(conv: T.DataType, text: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(text).fields])


def _coded(parts: DataFrame) -> DataFrame:
    """Codes of the chunks of conversations that have several, with what their neighbours
    need: the first letter and number of the last turn that is there."""
    key = F.sha2(F.concat(F.char_length("t.role").cast("string"), F.lit(":"), F.col("t.role"), F.col("t.text")), 256)
    zipped = F.arrays_zip(F.col("roles").alias("role"), F.col("texts").alias("text"), F.col("present").alias("present"))
    each = parts.select("conv_id", "chunk", F.posexplode(zipped).alias("place", "t")).where("t.present").select("conv_id", "chunk", "place", key.alias("key"))
    first = each.groupBy("conv_id", "key").agg(F.min("chunk").alias("first"), F.max("chunk").alias("last")).where("first < last")
    late = each.alias("e").join(first.alias("f"), F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("e.key") == F.col("f.key"))
                                & (F.col("e.chunk") > F.col("f.first"))).groupBy("chunk").agg(F.collect_list("place").alias("late"))
    schema = _schema(parts.schema["conv_id"].dataType, "chunk long, late array<int>, codes binary, initial string, turn long")

    def run(batches):
        def rows():
            for row in _rows(batches):
                turns, roles, texts, at = _there(row)
                late_there = set(row["late"] or ())
                codes, _ = faults(roles, texts, [i for i, place in enumerate(at) if place in late_there])
                known = [t for t in turns if t is not None]
                yield {"conv_id": row["conv_id"], "chunk": row["chunk"], "late": sorted(late_there), "codes": codes,
                       "initial": roles[-1][:1] if roles else None, "turn": known[-1] if known else None}
        yield from _emit(rows(), schema)
    return parts.join(late, "chunk", "left").select("conv_id", "chunk", "roles", "texts", "turns", "present", "late").mapInArrow(run, schema)


def stitched_costs(coded: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, chunk, after): the exact vector behind each chunk, and the fix-up passes
    that were run."""
    end = F.array(*[F.lit(c).cast("long") for c in CLOSING])
    schema = _schema(coded.schema["conv_id"].dataType, "chunk long, after array<bigint>, start array<bigint>")

    def speculate(batches):
        yield from _emit(({"conv_id": r["conv_id"], "chunk": r["chunk"], "after": CLOSING, "start": backward(r["codes"], CLOSING)}
                          for r in _rows(batches)), schema)

    def rerun(batches):
        yield from _emit(({"conv_id": r["conv_id"], "chunk": r["chunk"], "after": r["wanted"],
                           "start": fix_up(r["codes"], tuple(r["after"]), tuple(r["wanted"]), tuple(r["start"]))[0]} for r in _rows(batches)), schema)
    state, passes = materialize(coded.select("conv_id", "chunk", "codes").mapInArrow(speculate, schema), "speculative"), 0
    along = Window.partitionBy("conv_id").orderBy("chunk")
    while True:
        wanted = state.withColumn("wanted", F.coalesce(F.lead("start").over(along), end))
        if wanted.where("wanted <> after").isEmpty():
            return state.select("chunk", "after"), passes
        run = wanted.join(coded.select("chunk", "codes"), "chunk").select("conv_id", "chunk", "codes", "after", "start", "wanted")
        state, passes = materialize(run.mapInArrow(rerun, schema), "fix-up"), passes + 1


def _chained(coded: DataFrame, after: DataFrame) -> DataFrame:
    """Per chunk: its first state, the letter and number before it, and is it the last."""
    schema = _schema(coded.schema["conv_id"].dataType, "chunk long, late array<int>, after array<bigint>, ends array<int>, initial string, turn long")

    def ends(batches):
        yield from _emit(({"conv_id": r["conv_id"], "chunk": r["chunk"], "late": r["late"], "after": r["after"], "initial": r["initial"], "turn": r["turn"],
                           "ends": [trace(r["codes"], tuple(r["after"]), s)[1] for s in range(4)]} for r in _rows(batches)), schema)
    mapped = coded.join(after, "chunk").select("conv_id", "chunk", "late", "codes", "after", "initial", "turn").mapInArrow(ends, schema)

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        state, initial, turn, out = START, None, None, []
        for r in rows.itertuples():
            out.append((r.chunk, list(r.late), list(r.after), state, initial, turn, False))
            state = int(r.ends[state])
            initial = r.initial if r.initial is not None else initial
            turn = int(r.turn) if r.turn is not None and not pd.isna(r.turn) else turn
        out[-1] = (*out[-1][:-1], True)
        frame = pd.DataFrame(out, columns=["chunk", "late", "after", "state", "initial", "turn", "last"])
        return frame.astype({"turn": "Int64"})
    return mapped.groupBy("conv_id").applyInPandas(chain, "chunk long, late array<int>, after array<bigint>, state int, initial string, turn long, last boolean")


# ----------------------------------------------------------------------------- repair
SOLVED = ("chunk long, min_turn long, max_turn long, distinct_turns long, blank long, duplicate long, truncated long, "
          "illegal long, cost long, audit string, turns array<struct<role:string,text:string>>")


def _solve(parts: DataFrame) -> DataFrame:
    schema = _schema(parts.schema["conv_id"].dataType, SOLVED)

    def run(batches):
        def rows():
            for row in _rows(batches):
                turns, roles, texts, at = _there(row)
                late = set(row["late"] or ())
                codes, count = faults(roles, texts, [i for i, place in enumerate(at) if place in late])
                state = row["state"] or START
                after = tuple(row["after"]) if row["after"] is not None else CLOSING
                letters, final = trace(codes, after, state)
                left = edited(roles, texts, letters, state)
                close = CLOSE[final] if row["last"] is not False else ""
                for _ in close:
                    final = NEXT[final]
                    left.append((NAME[final], ""))
                audit = "".join(letters) + close
                known = [t for t in turns if t is not None]
                firsts = ([row["initial"]] if row["initial"] is not None else []) + [r[:1] for r in roles]
                cost = (DELETE * audit.count("D") + INSERT * audit.count("I") + REROLE * audit.count("R")
                        + CUT_OFF * sum(c < FORCED and c % 2 and not e.endswith("D") for c, e in zip(codes, letters)))
                yield {"conv_id": row["conv_id"], "chunk": row["chunk"], "min_turn": min(known, default=None), "max_turn": max(known, default=None),
                       "distinct_turns": len(set(known) - {row["turn"]}), **count, "illegal": sum(a + b not in LEGAL for a, b in zip(firsts, firsts[1:])),
                       "cost": cost, "audit": audit, "turns": [{"role": r, "text": t} for r, t in left]}
        yield from _emit(rows(), schema)
    return parts.select("conv_id", "chunk", F.col("turns"), "roles", "texts", "present", "late", "after", "state", "initial", "turn", "last").mapInArrow(run, schema)


def repair(turns: DataFrame, rows: int = CHUNK_ROWS, size: int = CHUNK_BYTES) -> DataFrame:
    """``turns``: conv_id, turn, role, text, present (false: no turn, only keeps the id).
    One row per chunk of a conversation (``single``: its only one), in order of ``chunk``:
    counts of faults, edits (``audit``), ``cost`` and the repaired ``turns``."""
    parts = materialize(chunks(turns, rows, size), "chunks")
    loose = parts.where("NOT whole")
    several = loose.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("conv_id").alias("id"))
    nothing = {"late": "array<int>", "after": "array<bigint>", "state": "int", "initial": "string", "turn": "long", "last": "boolean"}

    def plain(df):
        return df.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in nothing.items()])
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    only = plain(parts.where("whole").unionByName(loose.join(several, same, "left_anti")))
    out = _solve(only).withColumn("single", F.lit(True))
    split = materialize(loose.join(several, same, "left_semi"), "split-chunks")
    if split.isEmpty():
        return out
    coded = materialize(_coded(split), "coded")
    after, _ = stitched_costs(coded)
    joined = split.join(_chained(coded, after), "chunk")
    return out.unionByName(_solve(joined).withColumn("single", F.lit(False)))


def joined_text(turns: str = "turns"):
    """``role:text`` of an array of turns, newline-joined."""
    return F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def summaries(repaired: DataFrame) -> DataFrame:
    """One row per conversation. The chunks of one conversation pass through one task in
    order, one at a time, because the digest of its whole text is sequential; only its
    audit, a letter a turn, is kept."""
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("distinct_turns"), F.lit(0))
    single = repaired.where("single").select("conv_id", gaps.alias("gaps"), *counts, "audit", F.sha2(joined_text(), 256).alias("repaired_sha256"))
    schema = _schema(repaired.schema["conv_id"].dataType, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                     "audit string, repaired_sha256 string")

    def fold(batches):
        def rows():
            now = None
            for r in _rows(batches):
                if now is None or r["conv_id"] != now["conv_id"]:
                    if now is not None:
                        yield closed(now)
                    now = {"conv_id": r["conv_id"], "low": [], "high": [], "distinct": 0, "digest": hashlib.sha256(), "audit": [], "text": False} | dict.fromkeys(counts, 0)
                for c in counts:
                    now[c] += r[c]
                now["distinct"] += r["distinct_turns"]
                now["low"], now["high"] = [min(now["low"] + [r["min_turn"]])] if r["min_turn"] is not None else now["low"], \
                    [max(now["high"] + [r["max_turn"]])] if r["max_turn"] is not None else now["high"]
                now["audit"].append(r["audit"])
                if r["turns"]:
                    now["digest"].update(("\n" * now["text"] + "\n".join(t["role"] + ":" + t["text"] for t in r["turns"])).encode())
                    now["text"] = True
            if now is not None:
                yield closed(now)

        def closed(now):
            return {"conv_id": now["conv_id"], "gaps": now["high"][0] - now["low"][0] + 1 - now["distinct"] if now["low"] else 0,
                    **{c: now[c] for c in counts}, "audit": "".join(now["audit"]), "repaired_sha256": now["digest"].hexdigest()}
        yield from _emit(rows(), schema)
    several = repaired.where("NOT single").drop("single").repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(fold, schema)
    return single.unionByName(several)
