"""Analytic views V1–V3."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def patient_summary(patients: DataFrame, admissions: DataFrame, icustays: DataFrame,
                    diagnoses: DataFrame, labevents: DataFrame) -> DataFrame:
    """V1: per patient status and distinct counts; children pre-aggregated (§4.2)."""
    adm = admissions.groupBy("subject_id").agg(
        F.countDistinct("hadm_id").alias("total_admissions"),
        F.max("admittime").alias("most_recent_admission"))
    icu = icustays.groupBy("subject_id").agg(F.countDistinct("stay_id").alias("total_icu_stays"))
    dx = diagnoses.groupBy("subject_id").agg(F.countDistinct("icd_code").alias("unique_diagnoses"))
    lab = labevents.groupBy("subject_id").agg(F.countDistinct("itemid").alias("unique_lab_tests"))
    p = patients.select("subject_id", "gender", "anchor_age", "anchor_year_group", "dod")
    out = (p.join(adm, "subject_id", "left").join(icu, "subject_id", "left")
           .join(dx, "subject_id", "left").join(lab, "subject_id", "left"))
    return out.select(
        "subject_id", "gender", "anchor_age", "anchor_year_group",
        S.vital_status("dod").alias("status"),
        F.coalesce("total_admissions", F.lit(0)).alias("total_admissions"),
        F.coalesce("total_icu_stays", F.lit(0)).alias("total_icu_stays"),
        F.coalesce("unique_diagnoses", F.lit(0)).alias("unique_diagnoses"),
        F.coalesce("unique_lab_tests", F.lit(0)).alias("unique_lab_tests"),
        "most_recent_admission",
    )


def diagnosis_frequency(diagnoses: DataFrame, d_icd_diagnoses: DataFrame) -> DataFrame:
    """V2: occurrences, distinct patients and admissions per (code, version, title).

    Aggregated on (code, version) before the dictionary join, so the title is
    not carried through the distinct-count expansion and shuffles. Exact for
    any dictionary: each title row of a key joins the key's counts once, and a
    title repeated m times multiplies the occurrences by m, as the join would.
    """
    d = diagnoses.select("subject_id", "hadm_id", "icd_code", "icd_version")
    g = d.groupBy("icd_code", "icd_version").agg(
        F.count(F.lit(1)).alias("_n"),
        F.countDistinct("subject_id").alias("patient_count"),
        F.countDistinct("hadm_id").alias("admission_count"))
    di = (d_icd_diagnoses.groupBy("icd_code", "icd_version", "long_title")
          .agg(F.count(F.lit(1)).alias("_m")))
    out = g.join(di, ["icd_code", "icd_version"], "left").select(
        "icd_code", "icd_version", "long_title",
        (F.col("_n") * F.coalesce(F.col("_m"), F.lit(1))).alias("occurrence_count"),
        "patient_count", "admission_count")
    return out.orderBy(F.col("occurrence_count").desc(), "icd_code", "icd_version")


def query_analytics(kb_queries: DataFrame, avg_digits: int | None = 6) -> DataFrame:
    """V3: per day volume, latency, citations, outcomes, distinct patients.

    ``CASE WHEN success`` counts NULL success in neither column, as in SQL.
    Averages are rounded to ``avg_digits`` so results compare stably.
    """
    def _avg(c: str):
        a = F.avg(c)
        return F.round(a, avg_digits) if avg_digits is not None else a

    g = kb_queries.groupBy(S.day_start("created_at").alias("query_date")).agg(
        F.count(F.lit(1)).alias("total_queries"),
        _avg("response_time_ms").alias("avg_response_time"),
        _avg("citation_count").alias("avg_citations"),
        F.sum(F.when(F.col("success"), 1).otherwise(0)).alias("successful_queries"),
        F.sum(F.when(~F.col("success"), 1).otherwise(0)).alias("failed_queries"),
        F.countDistinct("subject_id").alias("unique_patients_queried"),
    )
    return g.orderBy(F.col("query_date").desc())
