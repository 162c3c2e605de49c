"""Repair of conversations against a plain shortest-path search over all edit sequences."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from medlattice.llm import conversations as C

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                       T.StructField("text", T.StringType()), T.StructField("chunk", T.StringType()), T.StructField("audit", T.StringType())])
BLANK = " \t\n\x0b\f\r"


def cheapest(rows):
    """Least (cost, audit) over all edits of (role, text, fault) rows, and the repaired
    turns: a uniform-cost search that orders equal costs by the letters so far."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, left = heapq.heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in ("", "a"):
            return cost, audit, left
        done.add((i, state))

        def go(letter, price, step, role=None, text=""):
            initial = role[:1] if role is not None else None
            if role is not None and (state, initial) not in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                return
            heapq.heappush(heap, (cost + price, audit + letter, i + step, state if role is None else initial, left if role is None else (*left, (role, text))))
        for role in ("user", "assistant"):
            go("I", 2, 0, role)
        if i < len(rows):
            role, text, fault = rows[i]
            go("D", 3, 1)
            if fault not in ("blank", "duplicate"):
                go("K", fault == "truncated", 1, role, text)
                for new in ("user", "assistant"):
                    go("R", 2 + (fault == "truncated"), 1, new, text)


def brute_force(table):
    by_conv = defaultdict(list)
    for conv, turn, role, text in table:
        kept = by_conv[conv]
        role, text = " " if role is None else role, " " if text is None else text
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        if case:
            kept += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    out = {}
    for conv, rows in by_conv.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2].encode()))
        seen, marked, count = set(), [], defaultdict(int)
        for _, role, text in rows:
            core = text.strip(BLANK)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""
            seen.add((role, text))
            count[fault] += 1
            marked.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, left = cheapest(marked)
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in left))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest()
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"],
                     count["truncated"], illegal, cost, audit, digest)
    return out


def results(df):
    rows = df.collect()
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def table_of(seed, conversations=60, longest=12, hot=0):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why?", " ", "", "\t", "go on!", "hm ", "done.  ", "x", None, "é"] + [f"text {i}." for i in range(40)]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ursula"]
    rows = []
    for c in [*range(conversations), None]:
        for t in range(rng.randint(0, longest)):
            turn = None if rng.random() < 0.05 else t + 3 * (rng.random() < 0.1)
            role = ["user", "assistant"][t % 2] if rng.random() < 0.7 else rng.choice(roles)
            rows.append((c, turn, role, rng.choice(texts)))
    rows += [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(texts + [f"hot {t}."] * 30)) for t in range(hot)]
    return rows + rows[:5]                                         # repeated rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


def run(spark, data, **limits):
    return results(C.summaries(C.repair(C.damaged(frame(spark, data)), **limits)))


@pytest.mark.parametrize("seed", range(3))
def test_whole_conversations(spark, seed):
    rows = table_of(seed)
    assert run(spark, rows) == brute_force(rows)


@pytest.mark.parametrize("limits", [{"rows": 1}, {"rows": 3}, {"rows": 50}, {"size": 20}])
def test_chunks_give_the_same(spark, limits):
    """A conversation with most of all rows, in chunks of any size."""
    rows = table_of(11, conversations=15, hot=160)
    assert run(spark, rows, **limits) == brute_force(rows)


def test_everything_repeated(spark):
    """A hot conversation of one repeated row: all but one turn must go, in many chunks."""
    rows = [(1, 5, "user", "Same.")] * 150 + [(1, 9, "assistant", "Same.")] * 150 + [(2, None, None, None)]
    assert run(spark, rows, rows=20) == brute_force(rows)


def test_empty_table_and_dropped_conversation(spark):
    assert run(spark, []) == {}
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("seed", range(40))
def test_speculation_and_fix_up(seed):
    """Chunks from speculative vectors, run again until only constants differ, give the
    vectors of one long pass; the passes end early."""
    rng = random.Random(seed)
    codes = bytes(rng.choice([rng.randrange(8), 2, 4, C.FORCED]) for _ in range(200))
    exact, vectors = C.CLOSING, {200: C.CLOSING}
    for i in reversed(range(200)):
        exact = vectors[i] = C.step(codes[i], exact)[0]
    cuts = sorted(rng.sample(range(1, 200), 9))
    spans = list(zip([0, *cuts], [*cuts, 200]))
    after = [C.CLOSING] * len(spans)
    start = [C.backward(codes[a:b], C.CLOSING) for a, b in spans]
    passes = 0
    while True:
        wanted = [*start[1:], C.CLOSING]
        if wanted == after:
            break
        fixed = [C.fix_up(codes[a:b], o, n, s) for (a, b), o, n, s in zip(spans, after, wanted, start)]
        after, start, passes = wanted, [f[0] for f in fixed], passes + 1
    assert after == [vectors[b] for _, b in spans] and start == [vectors[a] for a, _ in spans]
    assert passes <= len(spans)
    # a rerun stops at the first turn where the vectors agree
    assert C.fix_up(codes, C.CLOSING, C.CLOSING, vectors[0]) == (vectors[0], 0)


def test_repaired_turns_are_returned(spark):
    rows = [(1, 0, "user", "Hello there."), (1, 1, "user", "Are you there?"), (1, 2, "assistant", "Yes.")]
    present = frame(spark, rows).selectExpr("conv_id", "turn", "role", "text", "true AS present")
    got = C.repair(present).first()
    assert got.audit == "KIKK" and got.cost == 2
    assert [(t.role, t.text) for t in got.turns] == [("user", "Hello there."), ("assistant", ""), ("user", "Are you there?"), ("assistant", "Yes.")]
