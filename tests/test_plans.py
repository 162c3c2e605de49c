"""Plan-shape checks: no Python UDF outside the two Arrow operators, no
cartesian products, partial top-k before the shuffle for ranked retrievals,
and pushed-down filters / pruned columns at the scans."""

import re

import pytest

from medlattice.plans import QUERIES
from tests.conftest import SMALL_SF

ARROW_OK = {"retrieve_dense", "retrieve_dense_approx", "stream_previous_turn"}
STREAMING = {"stream_query_analytics", "stream_sessions", "stream_first_wins", "stream_previous_turn"}
PLANNED = sorted(n for n in QUERIES if n not in STREAMING)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", PLANNED)
def test_no_cartesian_and_no_row_udf(spark, name):
    plan = _plan(QUERIES[name](spark, SMALL_SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "BatchEvalPython" not in plan
    if name not in ARROW_OK:
        assert "ArrowEvalPython" not in plan and "MapInPandas" not in plan


def _tree(node):
    """(name, text, children) of a physical plan."""
    children = [_tree(node.children().apply(i)) for i in range(node.children().size())]
    return node.nodeName().strip(), node.toString().split("\n", 1)[0], children


def _nodes(tree):
    yield tree
    for child in tree[2]:
        yield from _nodes(child)


def _static_plan(spark, name):
    """The plan without adaptive execution."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return _tree(QUERIES[name](spark, SMALL_SF)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


@pytest.mark.parametrize("name", ["recent_labs", "recent_prescriptions", "recent_vitals", "icu_inputs", "recent_admissions",
                                  "provider_orders", "medication_administrations", "diagnosis_counts", "procedure_history"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    """Some exchange of the ranking has a WindowGroupLimit below it: a hot subject sends
    at most k rows from each input partition."""
    plan = _static_plan(spark, name)
    limited = [n for n in _nodes(plan) if n[0] == "Exchange" and any(m[0] == "WindowGroupLimit" for m in _nodes(n))]
    assert limited
    assert "REPARTITION_BY_NUM" not in " ".join(n[1] for n in _nodes(plan))


@pytest.mark.parametrize("name", ["icu_stays", "readmission_30d"])
def test_bucketed_windows_get_an_exchange_of_their_own(spark, name):
    plan = _static_plan(spark, name)
    assert any(n[0] == "Exchange" and "subject_id" in n[1] and "_bkt" in n[1] for n in _nodes(plan))


def test_one_subject_with_a_third_of_the_rows(spark):
    """Top-k and the full ranking are right for a hot subject."""
    from pyspark.sql import functions as F

    from medlattice.operators import records
    rows = [(7 if i % 3 == 0 else i, i, i, "MICU", "MICU", None, float(i)) for i in range(1, 601)]
    stays = spark.createDataFrame(rows, "subject_id long, stay_id long, hadm_id long, first_careunit string, last_careunit string, "
                                  "intime timestamp_ntz, los double").withColumn(
        "intime", F.expr("timestamp_ntz'2150-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(stay_id as int))")).repartition(5)
    got = records.icu_stays(stays)
    hot = [r for r in got.collect() if r["subject_id"] == 7]
    assert len(hot) == 201 and got.count() == 600


def test_scan_prunes_columns_and_pushes_filters(spark):
    df = QUERIES["recent_prescriptions"](spark, SMALL_SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint" in plan   # not every lineitem column
    icu = QUERIES["icu_stays"](spark, SMALL_SF)
    pushed = re.search(r"PushedFilters: \[([^\]]*)\]", _plan(icu))
    assert pushed and "EqualTo(o_orderpriority,1-URGENT)" in pushed.group(1)
