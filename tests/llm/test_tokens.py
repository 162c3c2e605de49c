"""SentencePiece ids and the alignment of two tokenizers, against the libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from medlattice.llm import alignment, pieces
from medlattice.llm.queries import tokenizer_path

A_PATH, B_PATH = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
LETTERS = "abcdeST  \t\n▁é日😀'.,01\x00\x1c\x85\xa0ﬁ½"


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=B_PATH)


def some_texts(n=300, size=60, seed=3):
    rng = random.Random(seed)
    fixed = ["", " ", "  ", "▁", "▁▁a", " a ", "a ", "a\n  b \n", "it's we'll", "<s> </s> <unk> <0x41>", "<|endoftext|> x", "x" * 3000]
    return fixed + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, size))) for _ in range(n)]


# ------------------------------------------------------------------------------ pieces
def test_chunk_table_equals_the_library(model, monkeypatch):
    table, texts = pieces.ChunkTable(B_PATH), some_texts(2000)
    assert table.separable
    expected = [pieces.packed(model.encode(t)) for t in texts]
    assert table.encode(texts) == expected
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 50)             # a table that is emptied all the time
    assert [table.encode([t])[0] for t in texts] == expected
    monkeypatch.setattr(pieces, "segments", lambda t, border, cut=pieces.segments: cut(t, border, 5))
    assert table.encode(texts) == expected                      # cut into segments wherever that is allowed
    table.separable = False
    assert table.encode(texts) == expected


def test_each_distinct_chunk_is_segmented_once():
    table = pieces.ChunkTable(B_PATH)
    asked = Counter()

    class Spy:
        def __getattr__(self, name, model=table.model):
            return getattr(model, name)

        def encode(self, words, model=table.model, **kw):
            asked.update(words)
            return model.encode(words, **kw)
    table.model = Spy()
    table.encode(["one two  one", "two one three", None, ""])
    table.encode(["three two"])
    assert asked == Counter({"one": 1, "two": 1, "▁one": 1, "three": 1})


def test_encode_decode_rows(spark, frame, odd_rows, model):
    rows = odd_rows + list(enumerate(some_texts(100), 100))
    docs = frame(rows).withColumnsRenamed({"h": "ids", "row": "decoded"})      # clashing names
    got = pieces.decode(pieces.encode(docs, B_PATH, out="tokens"), B_PATH, ids="tokens", out="back").collect()
    assert {r["ids"] for r in got} == {"t"} and {r["decoded"] for r in got} == {"v"}
    expected = sorted((i is None, i or 0, t or "", model.encode(t or "") + [2]) for i, t in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.tokens) for r in got) == expected
    assert all(r.back == model.decode(r.tokens) for r in got)
    assert pieces.encode(frame([]), B_PATH).count() == 0
    without = pieces.encode(frame([(1, "a b")]), B_PATH, end=False).first()
    assert without.ids == model.encode("a b")


# --------------------------------------------------------------------------- alignment
def brute_force(rows, model):
    full = Tokenizer.from_file(A_PATH)
    full.encode_special_tokens = True
    letters = alignment.byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in full.get_vocab().items() if not t.startswith("<|")}

    def b_bytes(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a = full.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        raw = (" " + (text or "")).encode()
        if not text or b"".join(map(a_bytes.get, a)) != raw or b"".join(map(b_bytes, b)) != raw:
            a, b = [], []
        ends_a, ends_b = {}, {}
        for ids, size, ends in ((a, lambda i: len(a_bytes[i]), ends_a), (b, lambda i: len(b_bytes(i)), ends_b)):
            at = 0
            for k, i in enumerate(ids):
                at += size(i)
                ends[at] = k
        common, i, j, groups, links = sorted(set(ends_a) & set(ends_b)), 0, 0, [], []
        for end in common:
            groups.append((a[i:ends_a[end] + 1], b[j:ends_b[end] + 1]))
            links.append((a[ends_a[end]], b[ends_b[end]]))
            i, j = ends_a[end] + 1, ends_b[end] + 1
        counts.update(links)
        docs.append((doc_id, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    text = [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for *_, g, _ in docs]
    return sorted(((d is None, d or 0, na, nb, len(g), len(links), sum(counts[x] == best[x[1]] for x in links),
                    sum(counts[x] for x in links), t) for (d, na, nb, g, links), t in zip(docs, text)))


def as_rows(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)
                  for r in df.collect())


def test_alignment_equals_brute_force(spark, frame, odd_rows, model, monkeypatch):
    rows = odd_rows + list(enumerate(some_texts(200), 100)) + [(500 + i, "Repeated words, repeated words!") for i in range(40)]
    expected = brute_force(rows, model)
    assert as_rows(alignment.align(frame(rows), A_PATH, B_PATH)) == expected
    assert alignment.align(frame([]), A_PATH, B_PATH).count() == 0
    assert as_rows(alignment.align(frame([(1, None), (2, "▁")]), A_PATH, B_PATH)) == [(False, i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_alignment_does_not_depend_on_slices(spark, frame, model):
    """Slices of one and of many documents, and a table that is emptied, give the same."""
    rows = list(enumerate(some_texts(60), 1))
    t = alignment.pair(A_PATH, B_PATH)
    one, many = alignment.PartTable(t), alignment.PartTable(t)
    texts = [x for _, x in rows if "▁" not in x and x]
    every = {p for x in texts for p in alignment.parts_of(x)}
    many.learn(every)
    for p in sorted(every):
        one.clear()
        one.learn({p})
        i, j = one.row[p], many.row[p]
        assert one.groups[i] == many.groups[j]
        for name in ("tokens_a", "tokens_b", "n_groups", "exact", "pairs"):
            rows_of = [getattr(x, name).flat[getattr(x, name).start[k]:getattr(x, name).start[k + 1]].tolist() for x, k in ((one, i), (many, j))]
            assert rows_of[0] == rows_of[1]


def test_identity_links_stay_out_of_the_pair_shuffle(spark, frame):
    t = alignment.pair(A_PATH, B_PATH)
    slices = alignment.aligned_slices(frame([(1, "the cat and the dog"), (2, "unpronounceable zyxwvuts")]), A_PATH, B_PATH).collect()
    exact = {a for s in slices if s.slice is None for a in s.exact_a}
    shuffled = {p for s in slices if s.slice is not None for p in s.pair}
    assert exact and all(t.same[a] >= 0 for a in exact)
    assert shuffled and not any(t.same[p // t.n_b] == p % t.n_b for p in shuffled)


def test_digest_before_writing(spark, frame):
    from pyspark.sql import functions as F
    got = alignment.align(frame([(1, "a b"), (2, "")]), A_PATH, B_PATH, keep=lambda g: F.when(g == "", "").otherwise(F.sha2(g, 256)))
    plain = {r.doc_id: r.groups for r in alignment.align(frame([(1, "a b"), (2, "")]), A_PATH, B_PATH).collect()}
    assert {r.doc_id: r.groups for r in got.collect()} == {1: hashlib.sha256(plain[1].encode()).hexdigest(), 2: ""}


def test_slices_are_small_rows(spark, frame):
    """No row holds more than some pairs, and the counts of a slice are never one list of Spark's."""
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(60)) for _ in range(300)]
    slices = alignment.aligned_slices(frame(list(enumerate(texts))), A_PATH, B_PATH).collect()
    pairs = [len(s.pair) for s in slices if s.slice is not None]
    assert max(pairs) == alignment.PAIRS_A_ROW and sum(pairs) > 2 * alignment.PAIRS_A_ROW
    assert sorted(s.doc_id for s in slices if s.doc_id is not None) == list(range(300))
    plan = alignment.align(frame([(1, "a b"), (2, "")]), A_PATH, B_PATH)._jdf.queryExecution().toString()
    assert "collect_list" not in plan
