"""The events of the record queries and of the blood-pressure pairs: dealt by subject or by
order into a number of tasks that grows with the table, and ranked there."""

import datetime as dt

import pytest

from medlattice.operators import records, render
from medlattice.plans import QUERIES, bindings, rendering
from medlattice.plans.bindings import ClinicalTables
from tests.conftest import SMALL_SF
from tests.test_plans import _nodes, _tree

DAY = dt.datetime(2150, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def lines(spark, tmp_path):
    """A folder with 60 orders of 12 customers and a third of one, four lines each."""
    orders = [(i, None if i == 7 else 1 if i % 3 == 0 else i % 12, DAY + dt.timedelta(days=i)) for i in range(60)]
    items = [(i, j, (i * 4 + j) % 9, i % 5, float(i + j), 0.05, 0.01, "ANR"[j % 3], "FO"[i % 2], DAY + dt.timedelta(days=i + j))
             for i in range(60) for j in range(1, 5)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_events_are_ranked_by_subject_without_another_shuffle(spark, lines, monkeypatch):
    monkeypatch.setattr(bindings, "LINES_A_TASK", 16)
    t = ClinicalTables(spark, lines)
    before = _rows(t.events_base.select("subject_id", *bindings._EVENT_COLUMNS))
    assert t.bind_events_once() == 15                       # 240 lines
    assert _rows(t.events_base) == before
    assert "Exchange" not in _plan(records.recent_prescriptions(t.prescriptions, 3))
    assert t.events_base.rdd.getNumPartitions() <= 15
    assert not any(x.name.startswith("medlattice_events") for x in spark.catalog.listTables())


def test_a_hot_subject_keeps_the_limit_before_the_shuffle(spark, lines, monkeypatch):
    dealt = ClinicalTables(spark, lines)
    dealt.bind_events_once()
    monkeypatch.setattr(bindings, "HOT_LINES", 50)          # customer 1 has 80 lines or more
    t = ClinicalTables(spark, lines)
    assert t.bind_events_once() is None
    got = records.recent_prescriptions(t.prescriptions, 3)
    assert "Exchange" in _plan(got) and "WindowGroupLimit" in _plan(got)
    assert _rows(got) == _rows(records.recent_prescriptions(dealt.prescriptions, 3))


def test_only_the_events_asked_for_are_bound(spark, lines):
    t = ClinicalTables(spark, lines)
    want = _rows(t.events_base.where("subject_id IN (1, 5)").select("subject_id", *bindings._EVENT_COLUMNS))
    t.bind_events_once(spark.createDataFrame([(1,), (5,), (99,)], "subject_id long"))
    assert _rows(t.events_base) == want


@pytest.mark.parametrize("gather", [render.record_bundle, render.render_records])
def test_parts_are_gathered_where_they_lie(spark, gather):
    """All parts lie by subject: gathering them moves none again."""
    parts = rendering.parts_for(ClinicalTables(spark, SMALL_SF))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _tree(gather(parts)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert any(n[0] == "Union" for n in _nodes(plan))
    assert not [n for n in _nodes(plan) if "Exchange" in n[0] and any(m[0] == "Union" for m in _nodes(n))]


def test_readings_are_paired_in_tasks_that_grow_with_the_lines(spark, lines, monkeypatch):
    before = _rows(QUERIES["bp_classification"](spark, lines))
    monkeypatch.setattr(bindings, "LINES_A_TASK", 16)
    df = QUERIES["bp_classification"](spark, lines)
    assert "15), REPARTITION_BY_NUM" in _plan(df) and _rows(df) == before


def _counted(events, titles, keys):
    """Rows of a left join, counted."""
    count = {}
    for e in events:
        for title in [t for code, version, t in titles if (code, version) == (e["icd_code"], e["icd_version"])] or [None]:
            key = tuple(title if k == "long_title" else e[k] for k in keys)
            count[key] = count.get(key, 0) + 1
    return count


def _last(v):
    return (v is None, v or 0)


@pytest.mark.parametrize("titles", [[("0", 10, "a"), ("1", 10, "b"), ("1", 10, "c"), ("1", 9, "b")],
                                    [("0", 10, "a"), ("1", 10, "b"), ("2", 10, "d"), ("2", 10, "d"), ("2", 10, "e")]])
def test_titles_meet_the_first_groups_only(spark, titles):
    """Titles that a dictionary holds twice, several titles of a code, codes without any."""
    events = [dict(subject_id=None if i % 7 == 0 else i % 3, hadm_id=i % 4, seq_num=None if i % 5 == 0 else i % 2, icd_code=None if i == 40 else str(i % 4),
                   icd_version=10 if i % 3 else 9, chartdate=None if i % 11 == 0 else DAY + dt.timedelta(days=i % 6)) for i in range(90)]
    df = spark.createDataFrame([tuple(e.values()) for e in events],
                               "subject_id long, hadm_id long, seq_num int, icd_code string, icd_version int, chartdate timestamp_ntz")
    names = spark.createDataFrame(titles, "icd_code string, icd_version int, long_title string")
    admissions = spark.createDataFrame([(h, DAY) for h in (0, 1, 2)], "hadm_id long, admittime timestamp_ntz")
    for k in (1, 3):
        want = set()
        groups = _counted(events, titles, ("subject_id", "icd_code", "long_title", "chartdate"))
        for s in {g[0] for g in groups}:
            mine = [(*g, n) for g, n in groups.items() if g[0] == s]
            mine.sort(key=lambda r: (r[3] is not None, -(r[3] or DAY).timestamp(), *map(_text_last, (r[1], r[2])), r[4]))
            want |= {(s, i + 1, *r[1:]) for i, r in enumerate(mine[:k])}
        got = records.procedure_history(df.drop("hadm_id", "seq_num"), names, k)
        assert {tuple(r) for r in got.collect()} == want
        want = set()
        groups = _counted(events, titles, ("subject_id", "icd_code", "icd_version", "long_title", "seq_num"))
        for s in {g[0] for g in groups}:
            mine = [(*g[1:], n) for g, n in groups.items() if g[0] == s]
            mine.sort(key=lambda r: (-r[4], _last(r[3]), _text_last(r[0]), r[1], _text_last(r[2])))
            want |= {(s, i + 1, *r) for i, r in enumerate(mine[:k])}
        for tasks in (None, 3):
            got = records.diagnosis_counts(df.drop("chartdate"), names, admissions, k, tasks)
            assert {tuple(r)[:-1] for r in got.collect()} == want
    plan = _plan(records.procedure_history(df, names, 3))
    assert "WindowGroupLimit" in plan.split("Join", 1)[1]   # below the join with the titles


def _text_last(v):
    return (v is None, v or "")


VITALS = "subject_id long, itemid long, charttime timestamp_ntz, value string, valuenum double, valueuom string, warning int"


def test_vitals_meet_their_items_by_subject(spark, monkeypatch):
    """Items held twice or under two labels, without a category of vitals, unknown or NULL; equal times; an item read often."""
    events = [(None if i % 13 == 0 else i % 3, None if i % 17 == 0 else 1 if i % 2 else i % 7, None if i % 19 == 0 else DAY + dt.timedelta(days=i % 5),
               None if i % 4 else "high", None if i % 6 == 0 else float(i % 8), "bpm", i % 2) for i in range(160)]
    names = [(1, "pulse", "Vital Signs"), (2, "b", "Labs"), (2, "a", "Respiratory"), (3, "c", "Labs"), (3, "c", "Labs"), (4, "d", "Routine"), (None, "e", "Labs")]
    ce, di = spark.createDataFrame(events, VITALS), spark.createDataFrame(names, "itemid long, label string, category string")
    for k in (1, 4, 200):
        monkeypatch.setattr(records, "ITEMS_AT_HAND", 1 << 16)
        want = _rows(records.recent_vitals(ce, di, k))
        assert _rows(records.recent_vitals(ce, di, k, 3)) == want
        monkeypatch.setattr(records, "ITEMS_AT_HAND", 5)
        assert _rows(records.recent_vitals(ce, di, k, 3)) == want and len(want) > min(k, 100)


def test_vitals_stay_by_subject(spark, lines, monkeypatch):
    monkeypatch.setattr(records, "ITEMS_AT_HAND", 5)
    t = ClinicalTables(spark, lines)
    tasks = t.bind_events_once()
    names = spark.createDataFrame([(i, "x", "Labs") for i in range(9)], "itemid long, label string, category string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _tree(records.recent_vitals(t.chartevents, names, 3, tasks)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    dealt = [n for n in _nodes(plan) if n[0] == "Exchange"]
    assert dealt and all(not [m for m in _nodes(n) if "Window" in m[0]] for n in dealt)


@pytest.mark.parametrize("admissions", [[0, 1, 2, None, None], [0, 1, 1, 2, 2, 2]])
def test_only_the_first_groups_meet_the_admissions(spark, admissions):
    """Only while no admission is held twice, as one that is counts an event twice."""
    events = [(None if i % 7 == 0 else i % 3, i % 5, None if i % 4 == 0 else i % 2, None if i == 40 else str(i % 6), 10 if i % 3 else 9) for i in range(90)]
    d = spark.createDataFrame(events, "subject_id long, hadm_id long, seq_num int, icd_code string, icd_version int")
    names = spark.createDataFrame([("0", 10, "a"), ("1", 10, "b"), ("1", 10, "c")], "icd_code string, icd_version int, long_title string")
    a = spark.createDataFrame([(h, DAY + dt.timedelta(days=i)) for i, h in enumerate(admissions)], "hadm_id long, admittime timestamp_ntz")
    for k in (1, 3):
        got = records.diagnosis_counts(d, names, a, k, 3)
        assert _rows(got) == _rows(records.diagnosis_counts(d, names, a, k))
        assert ("dense_rank" in _plan(got)) == (len(set(admissions[:3])) == 3)


def test_parts_of_a_prompt_batch_are_ranked_apart(spark):
    """No task ranks the parts of a batch one after another: their lines are dealt after the union, and the
    events, bound for the batch only, are not cut to its subjects again."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _tree(QUERIES["build_prompt"](spark, SMALL_SF)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    unions = [n for n in _nodes(plan) if n[0] == "Union"]
    assert unions and all(any(n[0] == "Exchange" and n is not u and any(m is u for m in _nodes(n)) for n in _nodes(plan)) for u in unions)
    cut = [n for n in _nodes(plan) if "LeftSemi" in n[1] and any("medlattice_events" in m[1] for m in _nodes(n))]
    assert all(any(m[0] == "Window" for m in _nodes(n)) for n in cut)       # of the ranked rows, those with a stay
