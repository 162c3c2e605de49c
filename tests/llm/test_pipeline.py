import numpy as np

import corpus_pipeline
from medlattice.llm import decontaminate, quality, secrets, simhash
from medlattice.llm.common import materialize
from tests.llm.test_packing_search import check_pieces
from tests.llm.test_scans import brute_hits, brute_spans
from tests.llm.test_simhash import expected

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        after = materialize(stage(spark, docs, SF), "test")
        if name == "packing":
            check_pieces(after.collect(), before, 2048)
            break
        assert after.columns == docs.columns
        kept = {r.doc_id: r.text for r in after.collect()}
        if name == "quality classifier":
            model = quality.fit(docs, quality.training_labels(spark.read.parquet(f"{SF}/labels.parquet")))
            scores = quality.vote(model, [t.encode() for _, t in before])
            assert set(kept) == {i for (i, _), s in zip(before, scores) if s >= 0.5}
            assert 0 < len(kept) < len(before)
        elif name == "simhash near-dedup":
            assert set(kept) == {c for _, _, c in expected(before)}
        elif name == "benchmark decontamination":
            assert set(kept) == {d for d, n, hit, _ in brute_hits(before, items) if not (hit and 20 * hit >= n)}
        else:
            assert set(kept) == {i for i, _ in before}
            assert all((kept[i] == t) == (not brute_spans(t)) for i, t in before)
        docs = after


def test_every_stage_takes_odd_rows(spark, frame, odd_rows):
    docs = frame(odd_rows)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.limit(0), SF)
        assert empty.count() == 0
        after = stage(spark, docs, SF)
        if name != "packing":
            assert after.columns == docs.columns and after.dtypes == docs.dtypes
            untouched = {repr(tuple(r)) for r in docs.collect()}
            assert all(repr(tuple(r)) in untouched for r in after.collect())
        else:
            assert sum(r.start == 0 for r in after.collect()) == len(odd_rows)


def test_columns_named_like_the_stages_own_stay(spark, frame):
    docs = frame([(i, f"A text of some words, number {i}, with a few more words to count.") for i in range(6)] + [(9, None)])
    docs = docs.withColumnsRenamed({"score": "_stage_score", "ord": "_keep_row", "fp": "_KEEP_ROW_"})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.dtypes == docs.dtypes
        untouched = {repr(tuple(r)) for r in docs.collect()}
        assert all(repr(tuple(r)) in untouched for r in after.collect())


def test_general_interfaces_exist():
    assert callable(simhash.keep_one) and callable(decontaminate.drop_contaminated) and callable(secrets.redact)
    assert np.isfinite(quality.features(b"")[1]).all()
