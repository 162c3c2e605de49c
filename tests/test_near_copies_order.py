"""The order of shingles in near_copies: from counters, exact whatever they tell apart."""

import pytest

from medlattice.operators import knowledge as K
from tests.test_questions_knowledge import _jaccard_brute, _near


@pytest.mark.parametrize("counters", [1, 5, 1 << 17])
def test_near_copies_for_any_number_of_counters(spark, monkeypatch, counters):
    monkeypatch.setattr(K, "COUNTERS", counters)
    rows = [((i, 1), " ".join(f"w{(i % 7) * 3 + j}" for j in range(10 + i % 9)) + f" x{i % 5}") for i in range(60)]
    want = _jaccard_brute(rows)
    assert _near(spark, rows) == want and sum(x[2] for x in want.values()) > 20


def test_common_items_come_last(spark):
    """A prefix holds the rare items, in the same order in every set."""
    sets = spark.createDataFrame([(i, [1, 2, 1000 + i]) for i in range(20)], "id long, items array<long>")
    order = K.common_order(sets)
    heads = sets.select("id", K.prefix("items", order, 0.8).alias("head")).collect()
    assert all(r["head"] == [1000 + r["id"]] for r in heads)


def test_only_prefixes_are_shuffled_by_item(spark):
    """Rows that are shuffled by item come from prefixes: no shuffle of every shingle with its set."""
    rows = [(i, 1, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(30)]
    plan = K.near_copies(spark.createDataFrame(rows, "doc_id long, passage_no int, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item#" not in plan and "collect_list" not in plan
