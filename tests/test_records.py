"""Retrievals, rendering and their properties on a hand-built clinical subject."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from medlattice.operators import records, render, views
from medlattice.operators.topk import desc, top_k_per_key

TS = dt.datetime


@pytest.fixture(scope="module")
def t(spark):
    mk = spark.createDataFrame
    return dict(
        patients=mk([(1, "F", 52, "2011 - 2013", None), (2, "M", 91, "2014 - 2016", dt.date(2181, 1, 1))],
                    "subject_id long, gender string, anchor_age int, anchor_year_group string, dod date"),
        admissions=mk([(10, 1, TS(2150, 1, 1, 10), TS(2150, 1, 3, 22), "URGENT", "ER", "HOME", "Medicare", "W"),
                       (11, 1, TS(2151, 5, 5, 8), None, "ELECTIVE", "CLINIC", None, "Other", "A")],
                      "hadm_id long, subject_id long, admittime timestamp_ntz, dischtime timestamp_ntz, "
                      "admission_type string, admission_location string, discharge_location string, "
                      "insurance string, race string"),
        drgcodes=mk([(10, "123", "Heart failure", 2, 1), (10, "456", "Other", 0, None)],
                    "hadm_id long, drg_code string, description string, drg_severity int, drg_mortality int"),
        diagnoses=mk([(1, 10, 1, "4019", 9), (1, 11, 1, "4019", 9), (1, 10, None, "E119", 10)],
                     "subject_id long, hadm_id long, seq_num int, icd_code string, icd_version int"),
        d_icd_diagnoses=mk([("4019", 9, "Unspecified essential hypertension"),
                            ("E119", 10, "Type 2 diabetes mellitus without complications, a title that runs longer")],
                           "icd_code string, icd_version int, long_title string"),
        procedures=mk([(1, 10, TS(2150, 1, 2), "0040", 10)],
                      "subject_id long, hadm_id long, chartdate timestamp_ntz, icd_code string, icd_version int"),
        d_icd_procedures=mk([("9999", 10, "Nothing")], "icd_code string, icd_version int, long_title string"),
        labevents=mk([(1, 50912, TS(2150, 1, 2, 6, 30), None, 0.0, "mg/dL", "abnormal", None, 1.2),
                      (1, 50000, TS(2150, 1, 2, 7), "POS", 5.0, None, None, None, None)],
                     "subject_id long, itemid long, charttime timestamp_ntz, value string, valuenum double, "
                     "valueuom string, flag string, ref_range_lower double, ref_range_upper double"),
        d_labitems=mk([(50912, "Creatinine", "Blood", "Chemistry")],
                      "itemid long, label string, fluid string, category string"),
        prescriptions=mk([(1, "Aspirin", "MAIN", "PO", None, "81", "mg"), (1, "Heparin", None, None,
                                                                          TS(2150, 1, 1, 12), "", "unit")],
                         "subject_id long, drug string, drug_type string, route string, starttime timestamp_ntz, "
                         "dose_val_rx string, dose_unit_rx string").withColumn("stoptime", F.lit(None)
                         .cast("timestamp_ntz")).withColumn("form_rx", F.lit(None).cast("string"))
        .withColumn("gsn", F.lit(None).cast("string")).withColumn("ndc", F.lit(None).cast("string")),
        emar=mk([(1, TS(2150, 1, 1, 13), "Heparin", None, None)],
                "subject_id long, charttime timestamp_ntz, medication string, event_txt string, "
                "scheduletime timestamp_ntz"),
        poe=mk([(1, "1-1", TS(2150, 1, 1, 11), "Medications", "IV", "New", "P77", None)],
               "subject_id long, poe_id string, ordertime timestamp_ntz, order_type string, order_subtype string, "
               "transaction_type string, order_provider_id string, order_status string"),
        icustays=mk([(100, 1, 10, "MICU", "SICU", TS(2150, 1, 1, 12), 1.25)],
                    "stay_id long, subject_id long, hadm_id long, first_careunit string, last_careunit string, "
                    "intime timestamp_ntz, los double"),
        chartevents=mk([(1, 220045, TS(2150, 1, 1, 14), None, 88.0, "bpm", 1)],
                       "subject_id long, itemid long, charttime timestamp_ntz, value string, valuenum double, "
                       "valueuom string, warning int"),
        d_items=mk([(220045, "Heart Rate", "Vital Signs"), (225158, "NaCl 0.9%", "Fluids")],
                   "itemid long, label string, category string"),
        inputevents=mk([(1, TS(2150, 1, 1, 15), TS(2150, 1, 1, 16), 225158, 500.0, "mL", None, None, None, "Done")],
                       "subject_id long, starttime timestamp_ntz, endtime timestamp_ntz, itemid long, amount double, "
                       "amountuom string, rate double, rateuom string, ordercategoryname string, "
                       "statusdescription string"),
    )


def _parts(t):
    return render.record_parts(t["patients"], t["admissions"], t["drgcodes"], t["diagnoses"], t["d_icd_diagnoses"],
                               t["procedures"], t["d_icd_procedures"], t["labevents"], t["d_labitems"],
                               t["prescriptions"], t["emar"], t["poe"], t["icustays"], t["chartevents"],
                               t["d_items"], t["inputevents"])


RULE = "═" * 79

EXPECTED_1 = (
    "\n" + RULE + "\nPATIENT CLINICAL RECORD (Subject ID: 1)\n" + RULE + "\n\n"
    "DEMOGRAPHICS & SUMMARY:\n├─ Gender: F\n├─ Age: 52 years\n├─ Year Group: 2011 - 2013\n├─ Status: Living\n"
    "├─ Total Hospital Admissions: 2\n├─ ICU Stays: 1\n├─ Unique Diagnoses: 2\n└─ Unique Medications: 2\n\n"
    "RECENT HOSPITAL ADMISSIONS:\n"
    "1. ELECTIVE admission on 2151-05-05\n   Location: CLINIC → None\n   LOS: Ongoing, Insurance: Other\n"
    "2. URGENT admission on 2150-01-01\n   Location: ER → HOME\n   LOS: 2.5 days, Insurance: Medicare\n"
    "   DRG: 123 - Heart failure (Severity: 2, Mortality Risk: 1)\n"
    "3. URGENT admission on 2150-01-01\n   Location: ER → HOME\n   LOS: 2.5 days, Insurance: Medicare\n"
    "   DRG: 456 - Other\n\n"
    "DIAGNOSES (ICD-10 Codes with Descriptions):\n"
    "1. 4019 [Seq 1] - Unspecified essential hypertension (2x)\n"
    "2. E119  - Type 2 diabetes mellitus without complications, a title that runs long... (1x)\n\n"
    "PROCEDURES PERFORMED:\n1. 0040 - N/A (Date: 2150-01-02)\n\n"
    "RECENT LABORATORY RESULTS:\n"
    "1. Lab Test : POS  (2150-01-02 07:00)\n"
    "2. Creatinine [Chemistry]: N/A mg/dL  ABNORMAL (Ref: ?-1.2) (2150-01-02 06:30)\n\n"
    "PRESCRIBED MEDICATIONS:\n"
    "1. Aspirin 81 mg via PO [MAIN] (Started: Unknown)\n"
    "2. Heparin    (Started: 2150-01-01)\n\n"
    "MEDICATION ADMINISTRATION RECORDS (eMAR):\n1. Heparin - Administered (2150-01-01 13:00)\n\n"
    "PROVIDER ORDERS (POE):\n1. Medications - IV [Unknown] by P77 (2150-01-01 11:00)\n\n"
    "INTENSIVE CARE UNIT STAYS:\n1. ICU Stay ID 100: MICU → SICU\n   Admitted: 2150-01-01 12:00, LOS: 1.2 days\n\n"
    "   Recent ICU Vital Signs:\n   • Heart Rate: 88.0 bpm [Warning] (2150-01-01 14:00)\n\n"
    "   ICU Fluid/Medication Inputs:\n   • NaCl 0.9% (Unknown): 500.0 mL  (Started: 2150-01-01 15:00)\n\n"
    + RULE + "\n")

EXPECTED_2 = (
    "\n" + RULE + "\nPATIENT CLINICAL RECORD (Subject ID: 2)\n" + RULE + "\n\n"
    "DEMOGRAPHICS & SUMMARY:\n├─ Gender: M\n├─ Age: 91 years\n├─ Year Group: 2014 - 2016\n├─ Status: Deceased\n"
    "├─ Total Hospital Admissions: 0\n├─ ICU Stays: 0\n├─ Unique Diagnoses: 0\n└─ Unique Medications: 0\n\n"
    + RULE + "\n")


def test_render_matches_reference_format(t):
    out = {r["subject_id"]: r["record"] for r in render.render_records(_parts(t)).collect()}
    assert out[1] == EXPECTED_1
    assert out[2] == EXPECTED_2


def test_profile_equals_naive_fan_out(t):
    fast = records.subject_profile(t["patients"], t["admissions"], t["diagnoses"], t["icustays"],
                                   t["prescriptions"]).orderBy("subject_id").collect()
    p = t["patients"].alias("p")
    naive = (p.join(t["admissions"].alias("a"), "subject_id", "left")
             .join(t["diagnoses"].alias("d"), "subject_id", "left")
             .join(t["icustays"].alias("i"), "subject_id", "left")
             .join(t["prescriptions"].alias("r"), "subject_id", "left")
             .groupBy("subject_id").agg(F.countDistinct("a.hadm_id").alias("total_admissions"),
                                        F.countDistinct("d.icd_code").alias("unique_diagnoses"),
                                        F.countDistinct("i.stay_id").alias("icu_stays"),
                                        F.countDistinct("r.drug").alias("unique_medications"),
                                        F.max("a.admittime").alias("most_recent_admission"))
             .orderBy("subject_id").collect())
    for a, b in zip(fast, naive):
        for c in ["total_admissions", "unique_diagnoses", "icu_stays", "unique_medications",
                  "most_recent_admission"]:
            assert a[c] == b[c]


def test_unbounded_top_k_is_a_full_ranking(t):
    full = top_k_per_key(t["labevents"], ["subject_id"], [desc("charttime")], None).count()
    assert full == t["labevents"].count()


def test_desc_puts_nulls_first(t):
    rx = records.recent_prescriptions(t["prescriptions"], k=1).collect()
    assert rx[0]["drug"] == "Aspirin"          # NULL starttime sorts first under DESC (N1)


def test_patient_summary_counts_labs(t):
    v = {r["subject_id"]: r for r in views.patient_summary(t["patients"], t["admissions"], t["icustays"],
                                                            t["diagnoses"], t["labevents"]).collect()}
    assert v[1]["unique_lab_tests"] == 2 and v[2]["total_admissions"] == 0 and v[2]["status"] == "Deceased"
