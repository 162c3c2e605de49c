"""Quality metrics (§2.13): the two-level scans equal their one-window forms
for any bucket width, and the readmission rules on a hand-made fixture."""

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from medlattice.operators import metrics
from medlattice.operators.scan import next_in_key, percent_rank_all
from medlattice.plans.bindings import ClinicalTables
from tests.conftest import SMALL_SF


def _rows(df, cols):
    return sorted(tuple(str(r[c]) for c in cols) for r in df.collect())


def test_next_in_key_equals_lead_for_any_width(spark):
    a = ClinicalTables(spark, SMALL_SF).admissions.select("subject_id", "hadm_id", "admittime")
    # same-day admissions and a NULL time exercise the tie and the NULL bucket
    a = a.withColumn("admittime", F.when(F.col("hadm_id") % 97 == 0, F.lit(None)).otherwise(F.col("admittime")))
    w = Window.partitionBy("subject_id").orderBy(F.col("admittime").asc_nulls_last(), "hadm_id")
    brute = a.select("subject_id", "hadm_id", F.lead("hadm_id").over(w).alias("next_hadm_id"))
    cols = ["subject_id", "hadm_id", "next_hadm_id"]
    want = _rows(brute, cols)
    assert sum(1 for r in want if r[2] != "None") > 100
    for width in (1, 30, 10 ** 6):
        got = next_in_key(a, "subject_id", "admittime", "hadm_id", ["hadm_id"], width_days=width)
        assert _rows(got, cols) == want


def test_percent_rank_all_equals_percent_rank(spark):
    c = spark.read.parquet(f"{SMALL_SF}/customer.parquet").select(
        "c_custkey", F.round(F.col("c_acctbal") / 1000, 1).alias("v"))   # many ties
    brute = c.filter(F.col("v").isNotNull()).select(
        "c_custkey", F.round(F.percent_rank().over(Window.orderBy("v")), 9).alias("pr"))
    want = _rows(brute, ["c_custkey", "pr"])
    for width in (0.05, 1.0, 10 ** 6):
        got = percent_rank_all(c, "v", "pr", width=width).select("c_custkey", F.round("pr", 9).alias("pr"))
        assert _rows(got, ["c_custkey", "pr"]) == want


def test_readmission_rules(spark):
    d = dt.datetime
    rows = [
        (1, 10, "E", d(2150, 1, 1), d(2150, 1, 5)),
        (1, 11, "E", d(2150, 1, 20), d(2150, 1, 22)),    # 15 days after discharge: readmission of 10
        (1, 12, "E", d(2150, 1, 21), None),              # overlaps 11: 11 is not readmitted; 12 is open
        (2, 20, "U", d(2150, 3, 1), d(2150, 3, 2)),
        (2, 21, "U", d(2150, 4, 15), d(2150, 4, 16)),    # 44 days: not within 30
        (3, 30, "U", d(2150, 5, 1), d(2150, 5, 31)),
        (3, 31, "U", d(2150, 6, 30), d(2150, 7, 1)),     # exactly 30 days: counts
    ]
    a = spark.createDataFrame(rows, "subject_id long, hadm_id long, admission_type string, "
                                    "admittime timestamp_ntz, dischtime timestamp_ntz")
    r = {x["hadm_id"]: (x["next_hadm_id"], x["days_to_next"], x["readmitted_30d"])
         for x in metrics.readmission_30d(a).collect()}
    assert r[10] == (11, 15.0, True)
    assert r[11] == (12, -1.0, False)
    assert r[12] == (None, None, False)
    assert r[20] == (21, 44.0, False)
    assert r[30] == (31, 30.0, True)
    rate = {x["admission_type"]: (x["index_admissions"], x["readmissions"])
            for x in metrics.readmission_rate(metrics.readmission_30d(a)).collect()}
    assert rate == {"E": (2, 1), "U": (4, 1)}


def test_icd10_chapter_boundaries(spark):
    codes = ["A00", "b99.1", "C50", "D49", "D50", "O9A", "O99", "P97", "U07", "V01", "X59", "Z99", "123", None]
    df = spark.createDataFrame([(c,) for c in codes], "code string")
    got = dict((r["code"], r["ch"]) for r in df.select("code", metrics.icd10_chapter("code").alias("ch")).collect())
    assert got["A00"] == got["b99.1"] == "Certain infectious and parasitic diseases"
    assert got["C50"] == got["D49"] == "Neoplasms"
    assert got["D50"] == got["P97"] == got["U07"] == got["123"] == "Unlisted"
    assert got["O9A"] == got["O99"] == "Pregnancy, childbirth and the puerperium"
    assert got["V01"] == got["X59"] == "External causes of morbidity"
    assert got[None] is None


def test_lab_range_flags_precedence_and_sex(spark):
    d = dt.datetime(2150, 1, 1)
    labs = spark.createDataFrame([
        (1, 10, 1, d, 16.0, None, None),     # male hemoglobin 16: generic 13.5-17.5 -> normal
        (2, 20, 1, d, 16.0, None, None),     # female hemoglobin 16: generic 12.0-15.5 -> high
        (2, 20, 1, d, 16.0, 10.0, 20.0),     # the dataset's own range wins -> normal
        (2, 20, 1, d, 5.0, 10.0, None),      # own lower bound only -> low
        (1, 10, 2, d, 1.0, None, None),      # item without an analyte -> no flag
        (1, 10, 1, d, None, None, None),     # no value -> no flag
    ], "subject_id long, hadm_id long, itemid long, charttime timestamp_ntz, valuenum double, "
       "ref_range_lower double, ref_range_upper double")
    analytes = spark.createDataFrame([(1, "Hemoglobin")], "itemid long, analyte string")
    patients = spark.createDataFrame([(1, "M"), (2, "F")], "subject_id long, gender string")
    got = [(r["subject_id"], r["valuenum"], r["range_low"], r["range_source"], r["range_flag"])
           for r in metrics.lab_range_flags(labs, analytes, patients).collect()]
    assert sorted(got, key=str) == sorted([
        (1, 16.0, 13.5, "generic", "normal"), (2, 16.0, 12.0, "generic", "high"),
        (2, 16.0, 10.0, "dataset", "normal"), (2, 5.0, 10.0, "dataset", "low"),
        (1, 1.0, None, None, None), (1, None, 13.5, "generic", None)], key=str)


def test_anion_gap_takes_latest_results(spark):
    d = dt.datetime
    labs = spark.createDataFrame([
        (1, 10, 1, d(2150, 1, 1), 130.0), (1, 10, 1, d(2150, 1, 2), 140.0),   # latest sodium 140
        (1, 10, 2, d(2150, 1, 2), 100.0), (1, 10, 2, d(2150, 1, 2), 104.0),   # tie on time: larger value
        (1, 10, 3, d(2150, 1, 1), 24.0),
        (1, 11, 1, d(2150, 2, 1), 139.0),                                     # no chloride: no gap
    ], "subject_id long, hadm_id long, itemid long, charttime timestamp_ntz, valuenum double")
    analytes = spark.createDataFrame([(1, "Sodium"), (2, "Chloride"), (3, "Bicarbonate")],
                                     "itemid long, analyte string")
    got = {r["hadm_id"]: (r["sodium"], r["chloride"], r["bicarbonate"], r["anion_gap"])
           for r in metrics.anion_gap(labs, analytes).collect()}
    assert got == {10: (140.0, 104.0, 24.0, 12.0), 11: (139.0, None, None, None)}


def test_bp_classes_and_pairing(spark):
    d = dt.datetime(2150, 1, 1, 8)
    rows = []
    pairs = [(119, 79, "Normal"), (125, 79, "Elevated"), (125, 80, "Stage 1 hypertension"),
             (135, 70, "Stage 1 hypertension"), (140, 70, "Stage 2 hypertension"), (120, 95, "Stage 2 hypertension"),
             (180, 70, "Hypertensive crisis"), (150, 120, "Hypertensive crisis")]
    for i, (s, dia, _) in enumerate(pairs):
        t = d + dt.timedelta(hours=i)
        rows += [(1, 7, t, "systolic", float(s)), (1, 7, t, "diastolic", float(dia))]
    rows += [(2, 7, d, "systolic", 110.0), (2, 7, d, "systolic", 131.0), (2, 7, d, "diastolic", 70.0),
             (3, 7, d, "systolic", 200.0)]                      # stay 3 has no diastolic: no pair
    df = spark.createDataFrame(rows, "stay_id long, subject_id long, charttime timestamp_ntz, "
                                     "measure string, value double")
    got = sorted((r["stay_id"], r["systolic"], r["diastolic"], r["bp_class"])
                 for r in metrics.bp_classification(df).collect())
    want = sorted([(1, float(s), float(dia), c) for s, dia, c in pairs] + [(2, 131.0, 70.0, "Stage 1 hypertension")])
    assert got == want


def test_net_promoter_score(spark):
    scores = [10, 9, 9, 8, 7, 6, 0, 3, 11, -1]           # 3 promoters, 2 passives, 3 detractors, 2 ignored
    df = spark.createDataFrame([(1, s) for s in scores], "p int, score int")
    r = metrics.net_promoter_score(df, F.col("p")).collect()[0]
    assert (r["respondents"], r["promoters"], r["passives"], r["detractors"], r["nps"]) == (8, 3, 2, 3, 0.0)


def test_diagnosis_frequency_aggregates_before_the_dictionary_join(spark):
    from medlattice.operators import views
    dx = spark.createDataFrame([(1, 10, "A1", 10), (1, 11, "A1", 10), (2, 20, "A1", 10), (2, 20, "B2", 9),
                                (3, 30, "C3", 10), (3, 30, None, 10)],
                               "subject_id long, hadm_id long, icd_code string, icd_version int")
    # A1 has two titles, B2 one title listed twice, C3 none
    dd = spark.createDataFrame([("A1", 10, "alpha"), ("A1", 10, "alpha two"), ("B2", 9, "beta"), ("B2", 9, "beta")],
                               "icd_code string, icd_version int, long_title string")
    naive = (dx.join(dd, ["icd_code", "icd_version"], "left").groupBy("icd_code", "icd_version", "long_title")
             .agg(F.count(F.lit(1)).alias("occurrence_count"), F.countDistinct("subject_id").alias("patient_count"),
                  F.countDistinct("hadm_id").alias("admission_count")))
    cols = ["icd_code", "icd_version", "long_title", "occurrence_count", "patient_count", "admission_count"]
    assert _rows(views.diagnosis_frequency(dx, dd), cols) == _rows(naive, cols)
