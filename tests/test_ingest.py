"""Spec-driven ingest on generated clinical CSVs (FIXTURES.md A)."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from medlattice.sources import ingest as I
from medlattice.sources.specs import COUNTED_TABLES, SPECS


def _write(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture(scope="module")
def clinical_root(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("clinical"))
    base = os.path.join(root, "physionet", "export", "2.2")
    hosp, icu = os.path.join(base, "hosp"), os.path.join(base, "icu")
    _write(f"{hosp}/patients.csv", ["subject_id", "gender", "anchor_age", "anchor_year", "anchor_year_group", "dod"], [
        ["1", "F", "52", "2150", "2011 - 2013", ""],
        ["2", "M", "91", "2180", "2014 - 2016", "2181-03-04"],
        ["2", "F", "30", "2180", "2014 - 2016", ""],          # repeated key: first wins
        ["3", "X", "40", "2200", "2017 - 2019", "NA"],         # gender outside M/F -> quarantine
        ["4", "M", "abc", "2150", "None", ""],                 # bad int -> NULL, NA word -> NULL
        ["5", "F", "12.0", "2150", "2008 - 2010", ""],         # '12.0' -> 12; subject with no children
    ])
    _write(f"{hosp}/admissions.csv", ["hadm_id", "subject_id", "admittime", "dischtime", "admission_type",
                                      "insurance", "ethnicity", "hospital_expire_flag"], [
        ["10", "1", "2150-01-01 10:00:00", "2150-01-03 22:00:00", "URGENT", "Medicare", "WHITE", "0"],
        ["11", "1", "2151-05-05 08:00:00", "", "ELECTIVE", "Other", "ASIAN", "0"],       # null LOS (ongoing)
        ["12", "2", "2180-02-02 00:00:00", "2180-02-01 00:00:00", "EW EMER.", "", "", "1"],  # disch < admit
        ["13", "2", "2180-06-01 00:00:00", "2180-06-01 00:00:00", "EW EMER.", "", "", "x"],  # zero LOS, bad flag
        ["14", "99", "not a time", "", "URGENT", "", "", "0"],  # unparseable ts in NOT NULL admittime
    ])
    _write(f"{hosp}/diagnoses_icd.csv", ["subject_id", "hadm_id", "seq_num", "icd_code", "icd_version"], [
        ["1", "10", "1", "0389", "9"],          # leading zero survives (string code)
        ["1", "10", "1", "4019", "9"],          # repeated (hadm, seq): first wins by icd_code
        ["1", "10", "", "E119", "10"],          # null seq: never conflicts
        ["1", "10", "", "E119", "10"],          # ... both kept
        ["1", "77", "2", "I10", "10"],          # orphan hadm_id
    ])
    _write(f"{hosp}/d_icd_diagnoses.csv", ["icd_code", "long_title"], [   # no icd_version column -> 10
        ["E119", "Type 2 diabetes mellitus without complications and with a deliberately long tail"],
    ])
    _write(f"{hosp}/d_labitems.csv", ["itemid", "label", "fluid", "category"], [
        ["50912", "Creatinine", "Blood", "Chemistry"], ["50000", "", "Blood", "Chemistry"],
        ["50001", "NA", "Urine", "Chemistry"]])
    _write(f"{hosp}/drgcodes.csv", ["subject_id", "hadm_id", "drg_type", "drg_code", "description",
                                    "drg_severity", "drg_mortality"], [
        ["1", "10", "APR", "123", "A", "2", "1"], ["1", "10", "HCFA", "456", "B", "", ""]])
    _write(f"{icu}/icustays.csv", ["stay_id", "subject_id", "hadm_id", "first_careunit", "last_careunit",
                                   "intime", "outtime", "los"], [
        ["100", "1", "10", "MICU", "MICU", "2150-01-01 12:00:00", "2150-01-02 12:00:00", "1.0"],
        ["101", "1", "11", "SICU", "MICU", "2151-05-05 09:00:00", "", "0"]])
    return root


def test_discovery_finds_modules_at_depth(spark, clinical_root):
    listing = {(r["table"], r["module"]) for r in I.discover_sources(spark, clinical_root).collect()}
    assert ("patients", "hosp") in listing and ("icustays", "icu") in listing


def _ingest(spark, root, name, **kw):
    paths = I.source_paths(spark, root)
    return I.ingest_table(spark, SPECS[name], I.read_source(spark, SPECS[name], paths.get(name)), **kw)


def test_patients_first_wins_quarantine_and_casts(spark, clinical_root):
    res = _ingest(spark, clinical_root, "patients")
    good = {r["subject_id"]: r for r in res.good.collect()}
    bad = {(r["subject_id"], r["reasons"]) for r in res.quarantine.collect()}
    assert set(good) == {1, 2, 4, 5}
    assert good[2]["gender"] == "F" or good[2]["gender"] == "M"
    assert good[2]["anchor_age"] in (91, 30)
    assert good[4]["anchor_age"] is None and good[4]["anchor_year_group"] is None
    assert good[5]["anchor_age"] == 12
    assert (3, "gender_m_f") in bad
    assert any(r[1] == "duplicate_key" and r[0] == 2 for r in bad)
    # nothing is lost: good + quarantine == input rows
    assert res.good.count() + res.quarantine.count() == 6


def test_first_wins_is_the_smallest_row_and_deterministic(spark, clinical_root):
    a = _ingest(spark, clinical_root, "patients").good.filter("subject_id = 2").collect()
    b = _ingest(spark, clinical_root, "patients").good.filter("subject_id = 2").collect()
    assert a == b and a[0]["anchor_age"] == 30   # the 'F' row sorts first (gender, then the other columns)


def test_admissions_checks_fallback_and_not_null(spark, clinical_root):
    res = _ingest(spark, clinical_root, "admissions")
    good = {r["hadm_id"]: r for r in res.good.collect()}
    reasons = {r["hadm_id"]: r["reasons"] for r in res.quarantine.collect()}
    assert set(good) == {10, 11, 13}
    assert good[10]["race"] == "WHITE"                      # S6: race <- ethnicity
    assert good[13]["hospital_expire_flag"] is None         # 'x' -> NULL passes the CHECK (N7)
    assert reasons[12] == "dischtime_after_admittime"
    assert "admittime_not_null" in reasons[14]


def test_unique_with_null_key_parts_and_leading_zero(spark, clinical_root):
    res = _ingest(spark, clinical_root, "diagnoses_icd")
    rows = [(r["hadm_id"], r["seq_num"], r["icd_code"]) for r in res.good.collect()]
    assert (10, 1, "0389") in rows and (10, 1, "4019") not in rows
    assert rows.count((10, None, "E119")) == 2              # N8: NULL key parts never conflict


def test_default_version_and_label(spark, clinical_root):
    d = _ingest(spark, clinical_root, "d_icd_diagnoses").good.collect()
    assert d[0]["icd_version"] == 10
    labels = {r["itemid"]: r["label"] for r in _ingest(spark, clinical_root, "d_labitems").good.collect()}
    assert labels == {50912: "Creatinine", 50000: "Lab Item 50000", 50001: "Lab Item 50001"}


def test_rerun_is_idempotent_against_existing(spark, clinical_root):
    first = _ingest(spark, clinical_root, "patients").good
    again = _ingest(spark, clinical_root, "patients", existing=first)
    assert again.good.count() == 0                           # every key already present: nothing new


def test_optional_and_mandatory_sources(spark, clinical_root):
    assert I.read_source(spark, SPECS["labevents"], None) is None
    with pytest.raises(FileNotFoundError):
        I.read_source(spark, SPECS["patients"], None)


def test_referential_check_finds_orphans(spark, clinical_root):
    dx = _ingest(spark, clinical_root, "diagnoses_icd").good
    adm = _ingest(spark, clinical_root, "admissions").good
    orphans = [r["hadm_id"] for r in I.referential_check(dx, "hadm_id", adm, "hadm_id").collect()]
    assert orphans == [77]


def test_foreign_keys_split_orphans_by_name(spark, clinical_root):
    """Parents first; an orphan keeps its row and the names of its keys; a NULL key passes."""
    written = {"patients": _ingest(spark, clinical_root, "patients").good, "admissions": _ingest(spark, clinical_root, "admissions").good}
    dx = _ingest(spark, clinical_root, "diagnoses_icd").good
    good, orphans = I.referential_split(dx, SPECS["diagnoses_icd"], written)
    assert {(r["hadm_id"], r["reasons"]) for r in orphans.collect()} == {(77, "hadm_id_not_in_admissions")}
    assert good.count() + orphans.count() == dx.count() and good.columns == dx.columns
    stays = _ingest(spark, clinical_root, "icustays").good.withColumn("hadm_id", F.lit(None).cast("int"))
    assert I.referential_split(stays, SPECS["icustays"], written)[1].count() == 0
    assert I.referential_split(dx, SPECS["diagnoses_icd"], {"patients": None, "admissions": None})[0].count() == 0


def test_load_all_quarantines_orphans(spark, clinical_root, tmp_path):
    I.load_all(spark, clinical_root, str(tmp_path / "out"))
    base = I.published(spark, str(tmp_path / "out"))
    bad = spark.read.parquet(f"{base}/_quarantine/diagnoses_icd")
    assert "hadm_id_not_in_admissions" in {r["reasons"] for r in bad.collect()}
    kept = spark.read.parquet(f"{base}/diagnoses_icd")
    assert kept.count() + bad.count() == 5 and kept.where("hadm_id = 77").count() == 0


def test_load_all_writes_and_counts_every_table(spark, clinical_root, tmp_path):
    counts = {r["table_name"]: r["row_count"] for r in I.load_all(spark, clinical_root, str(tmp_path)).collect()}
    assert list(counts) == COUNTED_TABLES or set(counts) == set(COUNTED_TABLES)
    assert counts["patients"] == 4 and counts["labevents"] is None and counts["emar_detail"] is None
    # a second load replaces the first: counts unchanged
    first = I.published(spark, str(tmp_path))
    again = {r["table_name"]: r["row_count"] for r in I.load_all(spark, clinical_root, str(tmp_path)).collect()}
    assert again == counts and I.published(spark, str(tmp_path)) != first
    report = {(r.table_name, r.reasons): r.row_count for r in I.load_report(spark, str(tmp_path)).collect()}
    assert report["patients", ""] == 4 and report["patients", "duplicate_key"] == 1 and report["patients", "gender_m_f"] == 1


def test_a_failed_load_leaves_the_last_one(spark, clinical_root, tmp_path, monkeypatch):
    I.load_all(spark, clinical_root, str(tmp_path))
    before, report = I.published(spark, str(tmp_path)), sorted(map(tuple, I.load_report(spark, str(tmp_path)).collect()))
    real = I.referential_split

    def broken(df, spec, parents):
        if spec.name == "icustays":
            raise RuntimeError("lost")
        return real(df, spec, parents)
    monkeypatch.setattr(I, "referential_split", broken)
    with pytest.raises(RuntimeError):
        I.load_all(spark, clinical_root, str(tmp_path))
    assert I.published(spark, str(tmp_path)) == before
    assert sorted(map(tuple, I.load_report(spark, str(tmp_path)).collect())) == report
    assert I.published(spark, str(tmp_path / "none")) is None


def test_key_orphans_in_one_pass(spark):
    """Several keys of several tables, with a hot value, NULLs and a parent that is missing."""
    child = spark.createDataFrame([(1, 5, None)] * 300 + [(2, 6, 7), (None, 9, 7), (3, 6, 8)], "a int, b int, c int")
    parent = spark.createDataFrame([(1, 5), (1, 6), (3, None)], "id int, other int")
    keys = [("child", "a", "parent", "id"), ("child", "b", "parent", "other"), ("child", "c", "absent", "id"), ("parent", "other", "child", "b")]
    got = I.key_orphans({"child": child, "parent": parent, "absent": None}, keys)
    assert sorted(map(tuple, got.collect())) == [(0, "2", 1), (1, "9", 1), (2, "7", 2), (2, "8", 1)]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_few_orphans_leave_the_rows_in_place(spark):
    """The orphaned keys are found once; when they are few, the table's rows are not shuffled to meet them."""
    from types import SimpleNamespace

    from pyspark.sql import functions as F
    from medlattice.sources import ingest as I

    child = spark.range(200000).select("id", (F.col("id") % 1000).alias("parent_id"))
    spec = SimpleNamespace(name="child", fks=[("parent_id", "parent", "key")])
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 20))
    try:
        good, lost = I.referential_split(child, spec, {"parent": spark.range(998).select(F.col("id").alias("key"))})
        for part, rows in ((good, 199600), (lost, 400)):
            assert "Exchange hashpartitioning" not in part._jdf.queryExecution().executedPlan().toString()
            assert part.count() == rows
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_load_all_reads_a_source_once(spark, clinical_root, tmp_path, monkeypatch):
    """Good and quarantined rows come from what was read and checked, not from the source again."""
    real, files = I.ingest_table, []

    def spied(*args, **kwargs):
        res = real(*args, **kwargs)
        if res.loaded:
            files.extend(f for df in (res.good, res.quarantine) for f in df.inputFiles())
        return res
    monkeypatch.setattr(I, "ingest_table", spied)
    I.load_all(spark, clinical_root, str(tmp_path))
    assert files and not [f for f in files if ".csv" in f]


def test_first_wins_on_held_keys(spark, tmp_path):
    """Keys that are counted first give the same winners and duplicates: repeated, null and
    lone keys, equal rows, a hot key."""
    rows = [(1, "b", 2), (1, "a", None), (1, "a", None), (2, "c", 1), (None, "d", 1), (None, "d", 1), (3, None, 4), (3, "x", 4)] + [(9, "h", i % 7) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, name string, n int")
    held = []

    def hold(frame):
        held.append(str(tmp_path / f"held-{len(held)}"))
        frame.write.parquet(held[-1])
        return spark.read.schema(frame.schema).parquet(held[-1])
    for key in (["k"], ["k", "n"]):
        for plain, own in zip(I.first_wins(df, key, ["name"]), I.first_wins(df, key, ["name"], hold=hold)):
            assert sorted(map(repr, own.collect())) == sorted(map(repr, plain.collect())) and own.columns == plain.columns
