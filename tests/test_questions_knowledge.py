"""Routing goldens, request validation, response parsing, conversation turns,
text repair and retrieval properties (brute force on small inputs)."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlattice.operators import knowledge as K
from medlattice.operators import questions as Q
from medlattice.streaming import jobs

GOLDEN_ROUTES = [
    ("What is Protected Health Information under HIPAA?", "kb"),
    ("Explain the difference between HIPAA Privacy Rule and Security Rule", "kb"),
    ("What are the normal ranges for a Complete Blood Count?", "kb"),
    ("What is the ICD-10 coding system?", "kb"),
    ("What are HIPAA breach notification requirements?", "direct"),
    ("What are my diagnoses?", "direct"),
    ("What is the mechanism of aspirin?", "direct"),
    ("treatment for asthma", "direct"),
    ("types of insulin", "kb"),
]


def test_golden_routes(spark):
    df = spark.createDataFrame(GOLDEN_ROUTES, "question string, expected string")
    for r in Q.route_question(df).collect():
        assert r["route"] == r["expected"], r["question"]


def test_whole_word_option_changes_substring_quirk(spark):
    df = spark.createDataFrame([("treatment for asthma",)], "question string")
    assert Q.route_question(df, whole_word=True).first()["route"] == "kb"


def test_validate_requests(spark):
    patients = spark.createDataFrame([(10000032,)], "subject_id long")
    reqs = spark.createDataFrame([
        (1, '{"body": {"subject_id": 10000032, "question": "What are my diagnoses?"}}'),
        (2, '{"body": "{\\"subject_id\\": 10000032, \\"question\\": \\"q\\"}"}'),
        (3, '{"subject_id": 10000032, "question": ""}'),
        (4, '{"subject_id": 0, "question": "q"}'),
        (5, '{"subject_id": 42, "question": "q"}'),
        (6, '{"body": "{broken"}'), (7, '{"body": null}'), (8, '{"body": [1]}'),
        (9, '{"body": {"subject_id": "10000032", "question": "false"}}'), (10, '{"subject_id": "0", "question": "[]"}'),
        (11, '{"subject_id": 10000032, "question": []}'), (12, '{"subject_id": false, "question": "q"}'), (13, '[1]'), (14, 'x'),
    ], "request_id int, event string")
    got = {r["request_id"]: (r["status_code"], r["error"]) for r in Q.validate_requests(reqs, patients).collect()}
    assert got[1] == (200, None) and got[2] == (200, None)
    assert got[3] == (400, "Missing required field: question")
    assert got[4] == (400, "Missing required field: subject_id")
    assert got[5] == (404, "Subject ID 42 not found in database")
    assert got[6][0] == 400 and got[14][0] == 400
    assert got[7][0] == got[8][0] == got[13][0] == 500
    assert got[9] == (200, None) and got[10] == (404, "Subject ID 0 not found in database")
    assert got[11] == (400, "Missing required field: question") and got[12] == (400, "Missing required field: subject_id")


def test_parse_model_response_precedence(spark):
    bodies = spark.createDataFrame([
        (1, '{"content": [{"text": "a"}], "completion": "x"}'),
        (2, '{"content": "plain"}'),
        (3, '{"choices": [{"message": {"content": "c"}}]}'),
        (4, '{"completion": "done"}'),
        (5, '{"content": null, "completion": "x"}'), (6, '{"content": "[1,2]"}'),
    ], "id int, body string")
    got = {r["id"]: r["answer"] for r in Q.parse_model_response(bodies).collect()}
    assert got == {1: "a", 2: "plain", 3: "c", 4: "done", 5: None, 6: "[1,2]"}


def test_previous_turn_skips_unanswered_and_stream_equals_batch(spark, tmp_path):
    turns = spark.createDataFrame([
        (1, 0, "system", "be nice"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
        (1, 3, "user", "q2"), (1, 4, "user", "q3"), (1, 5, "assistant", "a3"), (1, 6, "user", "q4"),
        (2, 0, "assistant", "hello"), (2, 1, "user", "only"),
    ], "conv_id long, turn long, role string, text string")
    batch = {(r["conv_id"], r["q_idx"]): (r["prev_question"], r["prev_answer"])
             for r in Q.previous_turn(Q.exchanges(turns)).collect()}
    assert batch[(1, 1)] == (None, None) and batch[(1, 2)] == ("q1", "a1")
    assert batch[(1, 3)] == ("q1", "a1")          # q2 was never answered
    assert batch[(1, 4)] == ("q3", "a3") and batch[(2, 1)] == (None, None)
    src = str(tmp_path / "src")
    turns.write.parquet(src + "/conversations.parquet")
    stream = jobs.file_stream(spark, src + "/conversations.parquet", "*.parquet", turns.schema)
    out = jobs.run_available_now(spark, jobs.stream_previous_turn(stream), str(tmp_path / "out"),
                                 str(tmp_path / "ckpt"))
    streamed = {(r["conv_id"], r["q_idx"]): (r["prev_question"], r["prev_answer"]) for r in out.collect()}
    assert streamed == batch


def test_every_damaged_character_and_pair_is_repaired(spark):
    """All characters whose damage can be told, alone and next to each other; the damage
    is made here, byte by byte."""
    def seen(text):
        return "".join(chr(b) if b < 128 else bytes([b]).decode("cp1252", "replace").replace("\ufffd", chr(b)) for b in text.encode())
    letters = [chr(c) for c in [*range(0xA0, 0x180), *range(0x370, 0x400), 0x800, 0x2013, 0x20AC, 0x4E2D, 0xD7FF, 0xE000, 0xFFFD, 0x1F600, 0x10FFFF]]
    texts = letters + [a + b for a in letters[::3] for b in letters[::2]] + ["plain", "", "x y"]
    df = spark.createDataFrame([(t, seen(t)) for t in texts], "t string, bad string")
    rows = df.select("t", "bad", K.repair_text("bad").alias("fixed"), K.damage_text("t").alias("made")).collect()
    assert all(r.fixed == r.t and r.made == r.bad for r in rows)
    # no character: a surrogate's bytes and an overlong form stay
    odd = ["\u00ed\u00a0\u20ac", "\u00c3", "\u00e2\u201a"]
    assert [r.f for r in spark.createDataFrame([(t,) for t in odd], "t string").select(K.repair_text("t").alias("f")).collect()] == odd


def test_mojibake_repair(spark):
    df = spark.createDataFrame([("Temp 37Â°C, 5 Î¼L, BMI â‰¥ 30",), ("plain",)], "t string")
    got = [r[0] for r in df.select(K.repair_text("t")).collect()]
    assert got == ["Temp 37°C, 5 μL, BMI ≥ 30", "plain"]


def test_passages_and_dedupe(spark):
    docs = spark.createDataFrame([(1, "# Title\nintro words\n\nsame para\n\n" + " ".join(["w"] * 450)),
                                  (2, "Same  para")], "doc_id long, text string")
    p = K.split_passages(docs, max_words=200)
    rows = sorted((r["doc_id"], r["passage_no"], r["word_count"]) for r in p.collect())
    assert rows == [(1, 1, 4), (1, 2, 2), (1, 3, 200), (1, 4, 200), (1, 5, 50), (2, 1, 2)]
    d = {(r["doc_id"], r["passage_no"]): r["copies"] for r in K.dedupe_passages(p).collect()}
    assert d[(1, 2)] == 2 and (2, 1) not in d


def _bm25_brute(questions, docs, k1=1.2, b=0.75):
    import re
    tok = lambda s: [t for t in re.split(r"[^\w]+|[\d_]+", s.lower()) if t]
    dt = {i: tok(t) for i, t in docs}
    n, avg = len(dt), sum(len(v) for v in dt.values()) / len(dt)
    df = Counter(t for v in dt.values() for t in set(v))
    out = {}
    for qid, q in questions:
        sc = {}
        for d, toks in dt.items():
            tf = Counter(toks)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1)
                    / (tf[t] + k1 * (1 - b + b * len(toks) / avg)) for t in set(tok(q)) if tf[t])
            if s:
                sc[d] = round(s, 6)
        out[qid] = sorted(sc.items(), key=lambda kv: (-kv[1], kv[0]))[:2]
    return out


def test_bm25_equals_brute_force(spark):
    docs = [(1, "heart failure and heart rate"), (2, "kidney failure"), (3, "rate of infusion"), (4, "other")]
    qs = [(10, "heart failure"), (11, "infusion rate"), (12, "nothing")]
    got = K.retrieve_lexical(spark.createDataFrame(qs, "question_id long, question string"),
                             spark.createDataFrame(docs, "doc_id long, text string"), k=2)
    res = {}
    for r in got.collect():
        res.setdefault(r["question_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    brute = _bm25_brute(qs, docs)
    for qid, hits in brute.items():
        assert [(d, s) for _, d, s in sorted(res.get(qid, []))] == hits


def _vectors(spark, vecs):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "qid long, vec array<double>")
    return df, df.withColumnRenamed("qid", "vid")


def test_dense_exact_in_blocks(spark):
    vecs = np.random.default_rng(3).normal(size=(120, 16))
    q, c = _vectors(spark, vecs)
    top = {(r["qid"], r["rank"]): r["vid"] for r in K.retrieve_dense(spark, q, c, k=3, block_rows=40).collect()}
    unit = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    sims = unit @ unit.T
    for i in range(120):
        want = sorted(range(120), key=lambda j: (-round(sims[i, j], 6), j))[:3]
        assert [top[(i, r)] for r in (1, 2, 3)] == want
    assert K.retrieve_dense(spark, q.limit(0), c).count() == 0


@pytest.mark.parametrize("kind,most_pairs,least_recall", [("driver", 0.90, 0.90), ("clustered", 0.10, 0.90)])
def test_approximate_index_prunes_and_recalls(spark, kind, most_pairs, least_recall):
    """Share of pairs compared and recall against the exact search."""
    if kind == "driver":
        e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
        q, c = e.selectExpr("vec_id AS qid", "embedding AS vec"), e.selectExpr("vec_id AS vid", "embedding AS vec")
    else:
        rng = np.random.default_rng(5)
        centres = rng.normal(size=(40, 16)) * 3
        q, c = _vectors(spark, centres[rng.integers(40, size=1200)] + 0.3 * rng.normal(size=(1200, 16)))
    n = c.count()
    index = K.CellIndex(c)
    share = index.probes(q, 5).join(index.sizes, "cell").agg({"n": "sum"}).first()[0] / n / n
    exact = {(r["qid"], r["vid"]) for r in K.retrieve_dense(spark, q, c, k=5).collect()}
    approx = [(r["qid"], r["vid"]) for r in K.retrieve_dense_approx(q, c, k=5).collect()]
    assert len(approx) == 5 * n
    recall = len(exact & set(approx)) / len(exact)
    print(kind, "share", share, "recall", recall)
    assert share <= most_pairs and recall >= least_recall


def test_stream_previous_turn_carries_state_across_batches(spark, tmp_path):
    import time

    import pyarrow as pa
    import pyarrow.parquet as pq
    rows = [(1, 0, "system", "be nice"), (1, 1, "user", "q1"), (1, 2, "assistant", "a1"),
            (1, 3, "user", "q2"), (1, 4, "user", "q3"), (1, 5, "assistant", "a3"), (1, 6, "user", "q4"),
            (2, 0, "assistant", "hello"), (2, 1, "user", "only")]
    schema = "conv_id long, turn long, role string, text string"
    turns = spark.createDataFrame(rows, schema)
    batch = {(r["conv_id"], r["q_idx"]): (r["prev_question"], r["prev_answer"])
             for r in Q.previous_turn(Q.exchanges(turns)).collect()}
    src = tmp_path / "src"
    src.mkdir()
    # first file: conversation 1 up to q2 (unanswered); second file: the rest
    for i, part in enumerate([rows[:4], rows[4:]]):
        cols = list(zip(*part))
        pq.write_table(pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()),
                                 "role": pa.array(cols[2]), "text": pa.array(cols[3])}), src / f"part-{i}.parquet")
        time.sleep(1.1)                      # distinct modification times keep the file order
    stream = jobs.file_stream(spark, str(src), "*.parquet", turns.schema, max_files_per_trigger=1)
    ckpt = str(tmp_path / "ckpt")
    out = jobs.run_available_now(spark, jobs.stream_previous_turn(stream), str(tmp_path / "out"), ckpt)
    streamed = {(r["conv_id"], r["q_idx"]): (r["prev_question"], r["prev_answer"]) for r in out.collect()}
    assert streamed == batch
    commits = [p for p in (tmp_path / "ckpt" / "commits").iterdir() if not p.name.startswith(".")]
    assert len(commits) >= 2                 # really two micro-batches


def _jaccard_brute(rows, size=5, bar=0.8):
    sets = {}
    for key, text in rows:
        w = (text or "").lower().split()
        sets[key] = frozenset(" ".join(w[i:i + size]) for i in range(max(len(w) - size + 1, 1))) if w else frozenset()
    first, copies = {}, Counter(sets.values())
    for key in sorted(sets):
        first.setdefault(sets[key], key)
    out = {}
    for key, own in sets.items():
        near = [(len(own & o) / len(own | o), first[o]) for o in first if o != own and own and len(own & o) >= bar * len(own | o) - 1e-9]
        out[key] = (first[own], copies[own], len(near), round(max(near)[0], 6) if near else None,
                    first[own] == key and all(f > key for _, f in near))
    return out


def _near(spark, rows):
    df = spark.createDataFrame([(*key, text) for key, text in rows], "doc_id long, passage_no int, text string").repartition(4)
    return {(r.doc_id, r.passage_no): ((r.first_doc_id, r.first_passage_no), r.copies, r.links, r.best, r.kept)
            for r in K.near_copies(df).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_near_copies_match_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    base = [[f"w{x}" for x in rng.integers(0, 60, size=n)] for n in rng.integers(3, 90, size=12)]
    rows = [((0, 1), None), ((0, 2), ""), ((0, 3), " \n"), ((0, 4), "One two"), ((0, 5), "one  TWO"), ((0, 6), "one two three four five")]
    for i in range(150):
        words = list(base[i % 12])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, len(words)))] = f"x{rng.integers(0, 4)}"
        rows.append(((1 + i // 3, i % 3), " ".join(words + ["tail"] * int(rng.integers(0, 6)))))
    got, want = _near(spark, rows), _jaccard_brute(rows)
    assert got == want
    assert sum(x[2] for x in want.values()) > 100


def test_near_copies_of_a_hot_passage(spark):
    """A third of all rows are one passage, another third share all of its runs but two."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [((i, 1), text) for i in range(60)] + [((i, 2), f"{text} end{i}") for i in range(60)] + [((i, 3), f"other {i} " * 5) for i in range(60)]
    got = _near(spark, rows)
    assert got == _jaccard_brute(rows)
    assert got[(5, 1)] == ((0, 1), 60, 60, round(56 / 57, 6), False) and sum(x[4] for k, x in got.items() if k[1] < 3) == 1


def test_near_copies_of_an_empty_table(spark):
    assert K.near_copies(spark.createDataFrame([], "doc_id long, passage_no int, text string")).count() == 0


@pytest.mark.parametrize("n,m", [(7, 60), (60, 7)])
def test_retrieve_dense_in_many_parts(spark, n, m):
    """Either side may be the larger one; every query block meets every corpus block."""
    rng = np.random.default_rng(n)
    q, c = rng.normal(size=(n * 10, 6)), rng.normal(size=(m * 10, 6))
    make = lambda name, x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{name} long, vec array<double>")
    hits = K.retrieve_dense(spark, make("qid", q), make("vid", c), k=3, block_rows=10).collect()
    cosine = (q / np.linalg.norm(q, axis=1)[:, None]) @ (c / np.linalg.norm(c, axis=1)[:, None]).T
    want = {(i, r + 1): int(v) for i, row in enumerate(cosine) for r, v in enumerate(np.argsort(-row)[:3])}
    assert {(h.qid, h.rank): h.vid for h in hits} == want


def test_lexical_scores_stay_in_their_block(spark, monkeypatch):
    """Any number of blocks gives the same rows, repeated documents included, and neither
    postings nor (question, document) scores are shuffled."""
    docs = spark.createDataFrame([(i, " ".join(["alpha", "beta", "gamma", "delta"][: 1 + i % 4] * (1 + i % 3))) for i in range(40)] + [(7, "alpha beta")],
                                 "doc_id long, text string")
    qs = spark.createDataFrame([(1, "alpha delta"), (2, "gamma gamma beta"), (3, "nothing"), (4, None)], "question_id long, question string")
    whole = K.retrieve_lexical(qs, docs)
    want = sorted(whole.collect())
    assert len(want) == 6
    monkeypatch.setattr(K, "DOCS_A_BLOCK", 3)
    got = K.retrieve_lexical(qs, docs)
    assert sorted(got.collect()) == want
    from __spark_entry__ import queries
    plan = queries()["retrieve_lexical"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and not [line for line in dealt if "doc_id" in line], dealt


def test_cell_index_search_is_exact_in_the_probed_cells(spark):
    """Shards of any size give the best vectors of exactly the probed cells, and a query is
    sent once to a shard, in batches of few vectors."""
    import numpy as np
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 6))
    c = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vid long, vec array<double>")
    q = c.select(F.col("vid").alias("qid"), "vec")
    index = K.CellIndex(c, sample=64)
    cell = {r["vid"]: r["cell"] for r in index.cells.select("vid", "cell").collect()}
    probed = {}
    for r in index.probes(q, 3).select("qid", "cell").collect():
        probed.setdefault(r["qid"], set()).add(r["cell"])
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 6)
    want = {i: sorted(((-sims[i, v], v) for v in range(400) if cell[v] in probed[i]))[:3] for i in range(400)}
    for block_rows in (4096, 60, 7):
        got = {}
        for r in index.search(q, 3, block_rows).collect():
            got.setdefault(r["qid"], []).append((-r["cosine"], r["vid"]))
        assert {i: sorted(rows)[:3] for i, rows in got.items()} == want
    shards = np.arange(len(index.centres)) // 5
    sent = index._sent(q, 3, shards, "shard").groupBy("qid", "shard").count()
    assert sent.where("count > 1").count() == 0 and sent.count() < sum(map(len, probed.values()))


def test_copies_of_vectors_stay_few(spark):
    """Without a block size, shards grow with the corpus: the copies sent of a vector and of a query
    depend on the cores until a task is full, and single precision stays single."""
    for vectors in (50_000, 200_000):
        rows, asked = K._grid(vectors, vectors, 6)
        assert -(-vectors // rows) <= 4 and -(-vectors // asked) <= 4
    assert K._grid(10 ** 7, 10 ** 7, 6) == (K.SHARD_ROWS, K.ASKED_ROWS)
    c = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(200)], "vid long, vec array<float>")
    index, q = K.CellIndex(c, sample=16), c.select(F.col("vid").alias("qid"), "vec")
    assert index.probes(q, 3).schema["vec"].dataType.simpleString() == "array<float>"
    shards = index.search(q, 3).collect()
    assert len(shards) == 200 * 3
