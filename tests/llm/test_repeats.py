import hashlib
import random

import numpy as np
import pytest

from medlattice.llm import byte_repeats, passages, repeats
from tests.llm.conftest import words_text


def brute(rows, unit):
    """Per row: (units, removed, runs, what is kept), windows of 50 units, by doc_id."""
    split = (lambda t: tuple((t or "").encode().split())) if unit == "word" else (lambda t: (t or "").encode())
    least = {}
    texts = [split(t) for _, t in rows]
    for (i, _), t in zip(rows, texts):
        for s in range(len(t) - 49):
            least[t[s:s + 50]] = min(i, least.get(t[s:s + 50], i))
    out = []
    for (i, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for s in range(len(t) - 49):
            if least[t[s:s + 50]] < i:
                gone[s:s + 50] = [True] * 50
        kept = [x for x, g in zip(t, gone) if not g]
        runs = sum(g and not (at and gone[at - 1]) for at, g in enumerate(gone))
        out.append((i, len(t), sum(gone), runs, b" ".join(kept) if unit == "word" else bytes(kept)))
    return sorted(out)


def planted(seed, n):
    rng = random.Random(seed)
    passages_ = [words_text(rng, k) for k in (49, 50, 51, 70, 130)]
    line = "a common line that very many of the texts hold " * 6
    rows = [(5, "same " * 300), (6, "same " * 200), (7, "")]
    for i in range(n):
        parts = [words_text(rng, rng.randint(0, 60)) for _ in range(rng.randint(1, 4))]
        parts += rng.sample(passages_, rng.randint(0, 2)) + ([line] if rng.random() < 0.4 else [])
        rng.shuffle(parts)
        rows.append((10 + i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(1000 + i, rows[10][1]) for i in range(8)]       # exact copies
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_words_match_brute_force(frame, seed):
    rows = planted(seed, 40)
    got = sorted((r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept.encode()) for r in passages.remove_repeats(frame(rows)).collect())
    assert got == brute(rows, "word")
    assert any(r[2] for r in got)


@pytest.mark.parametrize("hot_blocks", [5000, 2])
def test_bytes_match_brute_force(frame, hot_blocks):
    rows = [(i, t + "é" * (i % 3)) for i, t in planted(4, 25)]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
                 for r in byte_repeats.remove_repeats(frame(rows), hot_blocks).collect())
    assert got == brute(rows, "byte")
    assert any(r[2] for r in got)


def test_a_line_between_different_neighbours_meets_in_no_group_of_blocks(frame, monkeypatch):
    rng = random.Random(6)
    line = "this very line stands in each of the texts of this table, word by word"
    rows = [(i, f"{rng.getrandbits(300):x} {line} {rng.getrandbits(300):x}") for i in range(60)]
    decide = byte_repeats._decide

    def guarded(table):
        (h, *_), _ = byte_repeats._entries(table.column("blob").to_pylist())
        assert np.unique(h, return_counts=True)[1].max() <= 10, "a group holds the windows of all documents"
        return decide(table)
    monkeypatch.setattr(byte_repeats, "_decide", guarded)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept))
                 for r in byte_repeats.remove_repeats(frame(rows).coalesce(1), 5).collect())
    assert got == brute(rows, "byte")
    assert sum(r[2] > 0 for r in got) == 59


@pytest.mark.parametrize("seed", range(2))
def test_words_of_hot_phrases_match_brute_force(frame, seed):
    rows = planted(seed, 40)
    got = sorted((r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept.encode()) for r in passages.remove_repeats(frame(rows), 2).collect())
    assert got == brute(rows, "word")


def test_a_phrase_between_different_neighbours_meets_in_no_group_of_blocks(frame, monkeypatch):
    rng = random.Random(7)
    rows = []
    for i in range(60):                                        # two copies of 49 words of one passage that only pairs of texts extend
        own = [" ".join(f"{rng.getrandbits(40):x}" for _ in range(40)) for _ in range(2)]
        rows.append((i, f"{own[0]} e{i // 2} {' '.join(f'p{k}' for k in range(49))} {own[1]}"))
    decide = passages._decide

    def guarded(table):
        h = table.column("h").to_numpy()
        assert not len(h) or np.unique(h, return_counts=True)[1].max() <= 10, "a group holds the blocks of all documents"
        return decide(table)
    monkeypatch.setattr(passages, "_decide", guarded)
    got = sorted((r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept.encode()) for r in passages.remove_repeats(frame(rows), 5).collect())
    assert got == brute(rows, "word")
    assert [r[2] for r in got] == [0, 50] * 30


def test_odd_rows(frame, odd_rows):
    """Every row comes back; the smallest id keeps a shared text, null ids come last, rows
    of one id do not remove each other."""
    longest = len(odd_rows[7][1].split())
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in passages.remove_repeats(frame(odd_rows)).collect()), key=repr)
    assert len(got) == len(odd_rows)
    assert (7, longest, 0) in got and (8, longest + 1, longest) in got and (None, longest, longest) in got
    byte_rows = {(r.doc_id, r.n_bytes): r.n_removed for r in byte_repeats.remove_repeats(frame(odd_rows)).collect()}
    size = len(odd_rows[7][1].encode())
    assert byte_rows[(8, size + 5)] == size and byte_rows[(None, size)] == size and byte_rows[(11, 5000)] == 0


def test_empty_table(frame):
    assert passages.remove_repeats(frame([])).count() == 0
    assert byte_repeats.remove_repeats(frame([])).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_every_window_has_its_leftmost_smallest_anchor(seed):
    rng = np.random.default_rng(seed)
    grams = rng.integers(0, 4 if seed % 2 else 1 << 60, size=int(rng.integers(7, 80))).astype(np.uint64)
    places, own = repeats.anchor_of_windows(grams, 7)
    assert own.tolist() == [s + int(np.argmin(grams[s:s + 7])) for s in range(len(grams) - 6)]
    assert places.tolist() == sorted(set(own.tolist()))


def test_pack_round_trip():
    arrays = [np.arange(5, dtype=np.uint64), np.empty(0, np.uint32), np.array([7, 1 << 31], np.uint32), np.array([-3], np.int64)]
    back = repeats._unpack(repeats._pack(*arrays), np.uint64, np.uint32, np.uint32, np.int64)
    assert all(np.array_equal(a, b) for a, b in zip(arrays, back))


def test_automata_find_every_place():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 3, size=80).astype(np.uint8) + np.uint8(48) for _ in range(4)]
    codes = np.concatenate([passages.phrase_codes(t, np.array(p)) for t, p in zip(texts, ([0, 5], [60], [68], [1]))])
    phrases = {t[p:p + passages.GRAM].tobytes() for t, ps in zip(texts, ([0, 5], [60], [68], [1])) for p in ps}
    machine = passages.automaton(codes)
    for t in texts:
        assert passages.hits(machine, t.tobytes().decode()) == [p for p in range(81 - passages.GRAM)
                                                                if t[p:p + passages.GRAM].tobytes() in phrases]


@pytest.mark.parametrize("shard_phrases,range_words", [(20, 500), (1000, 10), (3, 100_000)])
def test_every_document_meets_every_shard(frame, shard_phrases, range_words):
    rows = planted(9, 30)
    out = passages.remove_repeats(frame(rows), shard_phrases=shard_phrases, range_words=range_words)
    assert sorted((r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept.encode()) for r in out.collect()) == brute(rows, "word")


def test_streams_do_not_grow_with_the_shards(frame, tmp_path):
    """With many shards some 3.4 symbols a word go through the automata, not one a word and shard."""
    rows, streamed = planted(9, 60), tmp_path / "streamed"
    words = sum(r[1] for r in brute(rows, "word"))
    streamed.touch()

    def find(machine, symbols):
        with open(streamed, "a") as f:
            f.write(f"{len(symbols)}\n")
        return passages.hits(machine, symbols)
    out = passages.remove_repeats(frame(rows), shard_phrases=3, range_words=1000, find=find)
    assert sorted((r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept.encode()) for r in out.collect()) == brute(rows, "word")
    assert words < sum(map(int, streamed.read_text().split())) < 5 * words


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_stretches_hold_every_place_once(shards):
    """Each place of each text lies in one stretch, of the shard of the phrase there."""
    rng = np.random.default_rng(shards)
    texts = [rng.integers(48, 80, size=n).astype(np.uint8) for n in (12, 13, 300, 50, 700)]
    table = passages.shard_table(shards)
    shard, text, first, places = passages.stretches(np.concatenate(texts), np.cumsum([len(t) for t in texts]), table)
    got = sorted((t, f + i, s) for s, t, f, n in zip(shard.tolist(), text.tolist(), first.tolist(), places.tolist()) for i in range(n))
    whole = [(i, np.arange(len(t) - passages.GRAM + 1), t) for i, t in enumerate(texts)]
    assert got == [(i, p, s) for i, at, t in whole for p, s in zip(at.tolist(), table[passages.least_of_codes(passages.phrase_codes(t, at))].tolist())]


def test_without_hits_of_the_automata_nothing_is_removed(frame):
    rows = planted(9, 30)
    assert any(r[2] for r in brute(rows, "word"))
    out = passages.remove_repeats(frame(rows), find=lambda machine, symbols: [])
    assert {r.n_removed for r in out.collect()} == {0}


def test_a_hot_row_and_a_long_text(frame):
    """A third of the rows are one text without an id; one text has 400,000 words."""
    rng = random.Random(3)
    hot, long = words_text(rng, 120), words_text(rng, 400_000, 10 ** 6)
    rows = [(None, hot)] * 20 + [(i, words_text(rng, 90, 10 ** 6)) for i in range(30)] + [(50, hot), (60, long), (61, "x " + long)]
    got = {(r.doc_id, r.n_words, r.n_removed) for r in passages.remove_repeats(frame(rows)).collect()}
    assert {(None, 120, 120), (50, 120, 0), (60, 400_000, 0), (61, 400_001, 400_000)} < got and len(got) == 34


@pytest.mark.parametrize("seed", range(40))
def test_merged_transforms(seed):
    rng = random.Random(seed)
    window = rng.choice([2, 3, 5])
    strings = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(max(0, window - 2), 15))) for _ in range(rng.randint(1, 9))]
    shards = [byte_repeats.Shard([s], i) for i, s in enumerate(strings)]
    shard, prefix = byte_repeats.merge(shards, 20)
    suffixes = sorted((tuple(c + 1 for c in s[o:]) + (0,), i, o) for i, s in enumerate(strings) for o in range(len(s) + 1))
    assert shard.tolist() == [i for _, i, _ in suffixes]
    common = [0] + [next((k for k, (x, y) in enumerate(zip(a[0], b[0])) if x != y or x == 0), 99) for a, b in zip(suffixes, suffixes[1:])]
    assert prefix.tolist() == common
    documents = np.array([rng.randrange(9) for _ in strings])
    least = {}
    for s, d in zip(strings, documents):
        for o in range(len(s) - window + 1):
            least[s[o:o + window]] = min(d, least.get(s[o:o + window], d))
    got = byte_repeats.smallest_documents(strings, documents, window, rng.choice([1, 10, 100]))
    assert got.tolist() == [least[s[o:o + window]] for s in strings for o in range(len(s) - window + 1)]


def test_digest_of_kept_words(frame):
    row = passages.remove_repeats(frame([(1, " a\tb  c\n")])).first()
    assert hashlib.sha256(row.kept.encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()


def test_occurrences_of_hot_blocks_are_joined_in_packs():
    """Spans of a hot block's occurrences: as by hand, one row for each text of a task's share."""
    import pyarrow as pa
    rng = random.Random(4)
    rows, want = [], {}
    for _ in range(40):
        n, r = rng.randrange(1, 9), rng.randrange(1, 6)
        o, tk, first = [rng.randrange(12) for _ in range(n)], [rng.randrange(2) for _ in range(n)], [rng.randrange(4000) for _ in range(n)]
        runs = [(i, i + rng.randrange(3), rng.randrange(12)) for i in rng.sample(range(30), r)]
        rows.append(dict(ords=o, tks=tk, firsts=first, **{f"{c}s": [x[j] for x in runs] for j, c in enumerate(("i0", "i1", "wlo"))}))
        for ord_, t, f in zip(o, tk, first):
            for i0, i1, wlo in runs:
                if ord_ > wlo:
                    want.setdefault((ord_, t), set()).update(range(f + i0, f + i1 + 50))
    kinds = {c: pa.list_(pa.int32() if c in ("firsts", "i0s", "i1s") else pa.int64()) for c in rows[0]}
    batch = pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], t) for c, t in kinds.items()})
    out = [r for part in byte_repeats._hot_spans([batch]) for r in part.to_pylist()]
    assert len(out) == len(want)
    for r in out:
        spans = [(s >> 32, s & 0xFFFFFFFF) for s in r["spans"]]
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
        assert {x for b, e in spans for x in range(b, e)} == want[r["ord"], r["tk"]]
