import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from medlattice.llm import language, quality
from medlattice.llm.common import crc_mod
from medlattice.llm.queries import op2_language, op3_quality

SF = "/root/testdata/sf0.01"


def plain_kneser_ney(text, symbols=None):
    """Interpolated Kneser-Ney counted anew with dictionaries: probability(history, symbol)."""
    from collections import Counter, defaultdict
    s = [0, 0, *language.symbols(text).tolist()]
    counts = [Counter(tuple(s[i:i + 4]) for i in range(len(s) - 3))]
    for _ in range(3):
        counts.insert(0, Counter(g[1:] for g in counts[0]))
    levels = []
    for c in counts:
        once, twice = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        total, kinds = defaultdict(int), defaultdict(int)
        for g, v in c.items():
            total[g[:-1]] += v
            kinds[g[:-1]] += 1
        levels.append((c, once / (once + 2 * twice) if once and twice else 0.5, total, kinds))

    def p(history, symbol, order=4):
        if order == 0:
            return 1 / language.ALPHABET
        c, d, total, kinds = levels[order - 1]
        h = tuple(history[len(history) - order + 1:])
        lower = p(history, symbol, order - 1)
        return (max(c[(*h, symbol)] - d, 0) + d * kinds[h] * lower) / total[h] if total[h] else lower
    return p


def as_key(grams):
    return np.array([((a << 16 | b) << 16 | c) << 16 | d for a, b, c, d in grams], np.uint64)


def test_model_equals_kneser_ney_counted_anew():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcd éжя") for _ in range(3000)), "zzz yy xx " * 20]
    built = language.build_model({str(i): language.gram_counts(t) for i, t in enumerate(texts)})
    plain = [plain_kneser_ney(t) for t in texts]
    letters = [0, *map(ord, "abcdéжяzyq日")]
    grams = [tuple(rng.choice(letters) for _ in range(4)) for _ in range(600)]
    seen = language.symbols(texts[0]).tolist()
    grams += [tuple(seen[i:i + 4]) for i in range(0, 2000, 7)]
    got = language._log_p(built, 4, as_key(grams))
    for column, p in enumerate(plain):
        assert np.allclose(got[:, column], [np.log(p(g[:3], g[3])) for g in grams], atol=2e-4)
    model = language.kneser_ney(*language.gram_counts(texts[0]))
    for context in ((0, 0, 0), tuple(seen[50:53]), (1, 2, 3)):
        p = language._interpolated(model, 4, as_key([(*context, 0)]) + np.arange(language.ALPHABET, dtype=np.uint64))
        assert p.sum() == pytest.approx(1.0) and (p > 0).all()


def test_two_languages_of_one_script(frame):
    """Letters keep their identity in any script: two made-up languages over the Cyrillic
    letters, with the same word lengths, are told apart on held-out texts, and so are two
    over Chinese signs."""
    rng = random.Random(4)
    rows, truth = [], {}
    for script in (range(0x430, 0x450), range(0x4E00, 0x4F00)):
        # the two languages use letters that agree modulo 11, in the same order
        for shift in (0, 11):
            letters = [chr(script[0] + k % 11 + shift % (len(script) - 11)) for k in range(11)]
            words = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 6))) for _ in range(30)]
            name = f"{script[0]:x}-{shift}"
            for _ in range(40):
                truth[len(rows)] = name
                rows.append((len(rows), " ".join(rng.choice(words) for _ in range(12)), name))
    docs = None
    for name in set(truth.values()):
        part = frame([(i, t) for i, t, n in rows if n == name], name)
        docs = part if docs is None else docs.unionByName(part)
    found = {r.doc_id: r.lang_pred for r in language.identify(docs, F.col("doc_id") % 4 != 0).collect()}
    held = [i for i in truth if i % 4 == 0]
    assert np.mean([found[i] == truth[i] for i in held]) > 0.95


def test_symbols():
    assert language.symbols("A1b").tolist() == [0, 97, 0, 98, 0]
    assert language.symbols("Жя").tolist() == [0, 0x436, 0x44F, 0]
    assert 0xE000 <= language.symbols("\U00020000")[1] < 0xF900
    assert language.symbols(" 1 2 \n").tolist() == []
    assert len(language.symbols("é")) == 3             # a mark belongs to its letter


def test_long_texts_count_like_one_piece(monkeypatch):
    text = "abc de fgh " * 400
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "_PIECE", 97)
    parts = language.gram_counts(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_identify_odd_rows(frame, odd_rows, spark):
    train = frame([(100 + i, "the cat and the dog are here " * 3) for i in range(5)]).unionByName(
        frame([(200 + i, "der hund und die katze sind hier " * 3) for i in range(5)], "de")).unionByName(
        frame([(300, "no language given")], None))
    docs = train.unionByName(frame(odd_rows + [(400, "the dog"), (401, "die katze"), (402, "12 34")], None))
    found = language.identify(docs, F.col("doc_id") < 399)
    rows = {r.doc_id: r for r in found.collect()}
    assert found.count() == docs.count()
    assert rows[400].lang_pred == "en" and rows[401].lang_pred == "de"
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 402))
    assert all(0 <= r.score <= 1 for r in rows.values())
    nothing = language.identify(frame([(1, "text"), (2, None)], None), F.lit(True))
    assert [r.lang_pred for r in nothing.collect()] == ["und", "und"]
    assert language.identify(frame([]), F.lit(True)).count() == 0


def test_many_languages_make_the_model_coarser(frame):
    """A dirty column of languages: the least count rises, and every row gets its result."""
    docs = None
    for i in range(12):
        part = frame([(10 * i + k, f"word{chr(97 + i)} and {chr(97 + i) * 5} again " * 5) for k in range(3)], f"lang {i}")
        docs = part if docs is None else docs.unionByName(part)
    table = language.language_counts(docs.select("text", "lang"))
    assert language.least_count(table, 1 << 30) == 1
    small = 40 * 8 * (8 + 4 * 12)
    least = language.least_count(table, small)
    assert least > 1 and table.where(F.col("n") >= least).select("key").distinct().count() * 8 * (8 + 4 * 12) <= small
    model = language.fit(docs.select("text", "lang"), small)
    size = sum(k.nbytes + v.nbytes for k, v in [*model["grams"].values(), *model["backoff"].values()])
    assert size <= small and len(language.identify(docs, F.lit(True), max_bytes=small).collect()) == 36


def test_no_gram_is_left_out_unless_asked_for(frame, monkeypatch):
    """Which 4-grams count does not depend on the size of the input."""
    monkeypatch.setattr(language, "least_count", lambda *_: 1024)
    docs = frame([(0, "the cat and the dog"), (1, "a word that stands once")], "en")
    held = language.fit(docs.select("text", "lang"))["grams"][language.ORDER][0]
    assert len(held) == language.language_counts(docs.select("text", "lang")).count() > 0


def test_held_out_language(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_language(spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows) and len(rows) == len(truth)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95


def test_lang_is_no_input_of_a_prediction(frame):
    texts = ["the cat and the dog", "der hund und die katze"]
    base = [(i, texts[i % 2]) for i in range(20)]
    docs = frame(base[::2], "en").unionByName(frame(base[1::2], "de"))
    test = [(100, texts[0]), (101, texts[1])]
    one, two = (sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(docs.unionByName(frame(test, lang)), F.col("doc_id") < 50)
                       .where("doc_id >= 100").collect()) for lang in ("en", "de"))
    assert one == two and [r[1] for r in one] == ["en", "de"]


def test_held_out_quality(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op3_quality(spark, SF).collect()
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_votes_match_direct_cosines(frame, spark):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choice(["stone", "river", "walks", "over", "small"]) for _ in range(40)) + ".") for i in range(40)]
    bad = [(100 + i, "BUY!! " * rng.randint(5, 40)) for i in range(40)]
    docs = frame(good + bad)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad] + [(None, 1), (5, None)], "doc_id long, quality int")
    train = quality.training_labels(labels)
    assert train.where(crc_mod(F.col("doc_id"), 3) == 1).count() == 0
    model = quality.fit(docs, train, per_class=10)
    assert (model["labels"] == 1).sum() == 10 and len(model["labels"]) == 20
    texts = [t.encode() for _, t in good[:5] + bad[:5]] + [b"", None]
    got = quality.vote(model, texts, neighbours=3, block=4)
    for text, score in zip(texts, got):
        places, values = quality.features(text)
        x = quality.weighted(places, values, model["idf"]) @ model["projection"][places]
        cosine = model["vectors"] @ (x / np.linalg.norm(x))
        near = np.argsort(-cosine, kind="stable")[:3]
        weight = np.clip(cosine[near], 1e-6, None) ** quality.SHARPNESS
        assert score == pytest.approx((weight * model["labels"][near]).sum() / weight.sum(), abs=1e-3)
    assert (got[:5] > 0.5).all() and (got[5:10] < 0.5).all()


def test_quality_odd_rows(frame, odd_rows, spark):
    docs = frame(odd_rows)
    labels = spark.createDataFrame([(2, 0), (7, 1), (8, 1), (11, 0), (5, 1), (5, 0)], "doc_id long, quality int")
    scored = quality.score(docs, quality.fit(docs, quality.training_labels(labels)), "mine")
    assert scored.columns == [*docs.columns, "mine"] and scored.count() == len(odd_rows)
    assert scored.where("mine between 0 and 1").count() == len(odd_rows)
    unlabelled = quality.fit(docs, quality.training_labels(labels.limit(0)))
    assert {r.mine for r in quality.score(docs, unlabelled, "mine").collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), quality.training_labels(labels))).count() == 0
