"""Named queries over the driver's tables, each with its DuckDB oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and ``ORACLES[name] -> SQL``.
Every query reads the whole tables (no id subsets, no row caps); limits only
appear where they are the feature (top-k per subject).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import querylog, records, views
from ..functions.scalar import day_start
from .bindings import ClinicalTables, with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def _ties(cols: list[str]) -> str:
    return ", ".join(f"{c} ASC NULLS LAST" for c in cols)


def _topk_sql(source: str, order: str, ties: list[str], select: str, k: int | None) -> str:
    limit = f"WHERE rn <= {k}" if k is not None else ""
    return (f"SELECT {select} FROM (SELECT *, row_number() OVER (PARTITION BY subject_id "
            f"ORDER BY {order}, {_ties(ties)}) AS rn FROM ({source}) s) r {limit}")


# ---------------------------------------------------------------------------
# Q1 subject_exists: requests derived from the query log (ids spread so that
# some are unknown) against patients.
# ---------------------------------------------------------------------------

def _requests(t: ClinicalTables) -> DataFrame:
    e = t.raw("events")
    return e.select(F.col("event_id").alias("request_id"), (F.col("user_id") * 11).alias("subject_id"))


@register("subject_exists", with_ctes("""
SELECT event_id AS request_id, user_id * 11 AS subject_id,
       EXISTS (SELECT 1 FROM patients p WHERE p.subject_id = user_id * 11) AS subject_exists
FROM events""", "patients"))
def q_subject_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.subject_exists(_requests(t), t.patients).select("request_id", "subject_id", "subject_exists")


# ---------------------------------------------------------------------------
# Q2 subject_profile — oracle: per-child COUNT DISTINCT (the naive 4-way join
# is quadratic per subject; the two are equal, see tests).
# ---------------------------------------------------------------------------

@register("subject_profile", with_ctes("""
SELECT p.subject_id, p.gender, p.anchor_age, p.anchor_year_group,
  coalesce(a.n, 0) AS total_admissions, coalesce(d.n, 0) AS unique_diagnoses,
  coalesce(i.n, 0) AS icu_stays, coalesce(r.n, 0) AS unique_medications,
  a.latest AS most_recent_admission,
  CASE WHEN p.dod IS NOT NULL THEN 'Deceased' ELSE 'Living' END AS status
FROM patients p
LEFT JOIN (SELECT subject_id, count(DISTINCT hadm_id) AS n, max(admittime) AS latest FROM admissions GROUP BY 1) a
  ON p.subject_id = a.subject_id
LEFT JOIN (SELECT subject_id, count(DISTINCT icd_code) AS n FROM diagnoses_icd GROUP BY 1) d ON p.subject_id = d.subject_id
LEFT JOIN (SELECT subject_id, count(DISTINCT stay_id) AS n FROM icustays GROUP BY 1) i ON p.subject_id = i.subject_id
LEFT JOIN (SELECT subject_id, count(DISTINCT drug) AS n FROM prescriptions GROUP BY 1) r ON p.subject_id = r.subject_id
""", "patients", "admissions", "diagnoses_icd", "icustays", "prescriptions"))
def q_subject_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.subject_profile(t.patients, t.admissions, t.diagnoses_icd, t.icustays, t.prescriptions)


# ---------------------------------------------------------------------------
# Q3 recent_admissions (+ los_days F3)
# ---------------------------------------------------------------------------

_ADM = records.ADMISSION_COLS
_ADM_TIES = _ADM[:1] + _ADM[2:] + records.DRG_COLS

@register("recent_admissions", with_ctes(_topk_sql(
    """SELECT a.subject_id, a.hadm_id, a.admittime, a.dischtime, a.admission_type, a.admission_location,
       a.discharge_location, a.insurance, a.race,
       epoch(a.dischtime - a.admittime) / 86400 AS los_days,
       d.drg_code, d.description AS drg_description, d.drg_severity, d.drg_mortality
       FROM admissions a LEFT JOIN drgcodes d ON a.hadm_id = d.hadm_id""",
    "admittime DESC NULLS FIRST", _ADM_TIES,
    "subject_id, rn, " + ", ".join(_ADM) + ", los_days, " + ", ".join(records.DRG_COLS), 3),
    "admissions", "drgcodes"))
def q_recent_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.recent_admissions(t.admissions, t.drgcodes, k=3)


@register("los_days", with_ctes("""
SELECT hadm_id, subject_id, epoch(dischtime - admittime) / 86400 AS los_days FROM admissions""", "admissions"))
def q_los_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.scalar import los_days
    t = ClinicalTables(spark, sf_dir)
    return t.admissions.select("hadm_id", "subject_id", los_days("admittime", "dischtime").alias("los_days"))


# ---------------------------------------------------------------------------
# Q4–Q12
# ---------------------------------------------------------------------------

@register("diagnosis_counts", with_ctes(_topk_sql(
    """SELECT d.subject_id, d.icd_code, d.icd_version, dd.long_title, d.seq_num,
       count(*) AS occurrence_count, max(a.admittime) AS most_recent
       FROM diagnoses_icd d
       LEFT JOIN d_icd_diagnoses dd ON d.icd_code = dd.icd_code AND d.icd_version = dd.icd_version
       LEFT JOIN admissions a ON d.hadm_id = a.hadm_id
       GROUP BY d.subject_id, d.icd_code, d.icd_version, dd.long_title, d.seq_num""",
    "occurrence_count DESC NULLS FIRST, seq_num ASC NULLS LAST",
    ["icd_code", "icd_version", "long_title", "most_recent"],
    "subject_id, rn, icd_code, icd_version, long_title, seq_num, occurrence_count, most_recent", 10),
    "diagnoses_icd", "d_icd_diagnoses", "admissions"))
def q_diagnosis_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.diagnosis_counts(t.diagnoses_icd, t.d_icd_diagnoses, t.admissions, k=10)


@register("procedure_history", with_ctes(_topk_sql(
    """SELECT p.subject_id, p.icd_code, dp.long_title, p.chartdate, count(*) AS occurrence_count
       FROM procedures_icd p
       LEFT JOIN d_icd_procedures dp ON p.icd_code = dp.icd_code AND p.icd_version = dp.icd_version
       GROUP BY p.subject_id, p.icd_code, dp.long_title, p.chartdate""",
    "chartdate DESC NULLS FIRST", ["icd_code", "long_title", "occurrence_count"],
    "subject_id, rn, icd_code, long_title, chartdate, occurrence_count", 10),
    "procedures_icd", "d_icd_procedures"))
def q_procedure_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.procedure_history(t.procedures_icd, t.d_icd_procedures, k=10)


@register("recent_labs", with_ctes(
    "SELECT r.subject_id, r.rn, r.charttime, li.label, li.fluid, li.category, r.value, r.valuenum, r.valueuom, "
    "r.flag, r.ref_range_lower, r.ref_range_upper FROM (" + _topk_sql(
        "SELECT * FROM labevents WHERE charttime IS NOT NULL",
        "charttime DESC NULLS FIRST", records.LAB_EVENT_COLS, "*", 15)
    + ") r LEFT JOIN d_labitems li ON r.itemid = li.itemid", "labevents", "d_labitems"))
def q_recent_labs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.recent_labs(t.labevents, t.d_labitems, k=15)


@register("recent_prescriptions", with_ctes(_topk_sql(
    "SELECT * FROM prescriptions WHERE drug IS NOT NULL", "starttime DESC NULLS FIRST",
    [c for c in records.RX_COLS if c != "starttime"], "subject_id, rn, " + ", ".join(records.RX_COLS), 15),
    "prescriptions"))
def q_recent_prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.recent_prescriptions(t.prescriptions, k=15)


@register("medication_administrations", with_ctes(_topk_sql(
    "SELECT * FROM emar WHERE medication IS NOT NULL", "charttime DESC NULLS FIRST",
    records.EMAR_COLS[1:], "subject_id, rn, " + ", ".join(records.EMAR_COLS), 10), "emar"))
def q_medication_administrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.medication_administrations(t.emar, k=10)


@register("provider_orders", with_ctes(_topk_sql(
    "SELECT * FROM poe", "ordertime DESC NULLS FIRST", [c for c in records.POE_COLS if c != "ordertime"],
    "subject_id, rn, " + ", ".join(records.POE_COLS), 10), "poe"))
def q_provider_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.provider_orders(t.poe, k=10)


@register("icu_stays", with_ctes(_topk_sql(
    "SELECT subject_id, stay_id, hadm_id, first_careunit, last_careunit, intime, "
    "CAST(NULL AS TIMESTAMP) AS outtime, los AS los_days FROM icustays",
    "intime DESC NULLS FIRST", [c for c in records.ICU_COLS if c != "intime"],
    "subject_id, rn, " + ", ".join(records.ICU_COLS), None), "icustays"))
def q_icu_stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.icu_stays(t.icustays)


@register("recent_vitals", with_ctes(_topk_sql(
    """SELECT ce.subject_id, ce.itemid, ce.charttime, di.label, di.category, ce.value, ce.valuenum, ce.valueuom,
       CASE WHEN ce.warning = 1 THEN 'Warning' ELSE 'Normal' END AS status
       FROM chartevents ce LEFT JOIN d_items di ON ce.itemid = di.itemid
       WHERE di.category IN ('Vital Signs', 'Labs', 'Respiratory')""",
    "charttime DESC NULLS FIRST", ["itemid", "label", "category", "value", "valuenum", "valueuom", "status"],
    "subject_id, rn, charttime, label, category, value, valuenum, valueuom, status", 20),
    "chartevents", "d_items"))
def q_recent_vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.recent_vitals(t.chartevents, t.d_items, k=20)


@register("icu_inputs", with_ctes(
    "SELECT r.subject_id, r.rn, r.starttime, r.endtime, di.label, r.amount, r.amountuom, r.rate, r.rateuom, "
    "r.ordercategoryname, r.statusdescription FROM (" + _topk_sql(
        "SELECT * FROM inputevents", "starttime DESC NULLS FIRST",
        [c for c in records.INPUT_COLS if c != "starttime"], "*", 10)
    + ") r LEFT JOIN d_items di ON r.itemid = di.itemid", "inputevents", "d_items"))
def q_icu_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return records.icu_inputs(t.inputevents, t.d_items, k=10)


# ---------------------------------------------------------------------------
# Views V1–V3
# ---------------------------------------------------------------------------

@register("patient_summary", with_ctes("""
SELECT p.subject_id, p.gender, p.anchor_age, p.anchor_year_group,
  CASE WHEN p.dod IS NOT NULL THEN 'Deceased' ELSE 'Living' END AS status,
  coalesce(a.n, 0) AS total_admissions, coalesce(i.n, 0) AS total_icu_stays,
  coalesce(d.n, 0) AS unique_diagnoses, coalesce(l.n, 0) AS unique_lab_tests,
  a.latest AS most_recent_admission
FROM patients p
LEFT JOIN (SELECT subject_id, count(DISTINCT hadm_id) AS n, max(admittime) AS latest FROM admissions GROUP BY 1) a
  ON p.subject_id = a.subject_id
LEFT JOIN (SELECT subject_id, count(DISTINCT stay_id) AS n FROM icustays GROUP BY 1) i ON p.subject_id = i.subject_id
LEFT JOIN (SELECT subject_id, count(DISTINCT icd_code) AS n FROM diagnoses_icd GROUP BY 1) d ON p.subject_id = d.subject_id
LEFT JOIN (SELECT subject_id, count(DISTINCT itemid) AS n FROM labevents GROUP BY 1) l ON p.subject_id = l.subject_id
""", "patients", "admissions", "icustays", "diagnoses_icd", "labevents"))
def q_patient_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return views.patient_summary(t.patients, t.admissions, t.icustays, t.diagnoses_icd, t.labevents)


@register("diagnosis_frequency", with_ctes("""
SELECT occ.icd_code, occ.icd_version, titles.long_title, occ.n * coalesce(titles.m, 1) AS occurrence_count,
  who.n AS patient_count, stays.n AS admission_count
FROM (SELECT icd_code, icd_version, count(*) AS n FROM diagnoses_icd GROUP BY ALL) occ
JOIN (SELECT icd_code, icd_version, count(*) AS n
      FROM (SELECT DISTINCT icd_code, icd_version, subject_id FROM diagnoses_icd) GROUP BY ALL) who
  USING (icd_code, icd_version)
JOIN (SELECT icd_code, icd_version, count(*) AS n
      FROM (SELECT DISTINCT icd_code, icd_version, hadm_id FROM diagnoses_icd) GROUP BY ALL) stays
  USING (icd_code, icd_version)
LEFT JOIN (SELECT icd_code, icd_version, long_title, count(*) AS m FROM d_icd_diagnoses GROUP BY ALL) titles
  USING (icd_code, icd_version)""", "diagnoses_icd", "d_icd_diagnoses"))
def q_diagnosis_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return views.diagnosis_frequency(t.diagnoses_icd, t.d_icd_diagnoses)


@register("query_analytics", with_ctes("""
SELECT day AS query_date, v.n AS total_queries, ms AS avg_response_time, cites AS avg_citations,
  coalesce(ok.n, 0) AS successful_queries, coalesce(bad.n, 0) AS failed_queries, coalesce(who.n, 0) AS unique_patients_queried
FROM (SELECT day, count(*) AS n, round(sum(response_time_ms) / count(response_time_ms), 6) AS ms,
        round(sum(citation_count) / count(citation_count), 6) AS cites FROM q GROUP BY day) v
LEFT JOIN (SELECT day, count(*) AS n FROM q WHERE success GROUP BY day) ok USING (day)
LEFT JOIN (SELECT day, count(*) AS n FROM q WHERE NOT success GROUP BY day) bad USING (day)
LEFT JOIN (SELECT day, count(*) AS n FROM (SELECT DISTINCT day, subject_id FROM q WHERE subject_id IS NOT NULL)
           GROUP BY day) who USING (day)""", "kb_queries",
    extra=(("q", "SELECT *, date_trunc('day', created_at) AS day FROM kb_queries"),)))
def q_query_analytics(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return views.query_analytics(t.kb_queries)


# ---------------------------------------------------------------------------
# Query-log rollups A7, A8, K9 (sessions = 30-minute inactivity gap per subject)
# ---------------------------------------------------------------------------

_SESSIONIZED_SQL = """
SELECT *, CAST(subject_id AS VARCHAR) || '@' || strftime(session_start, '%Y%m%dT%H%M%S.%f') AS session_id
FROM (SELECT *, max(_start) OVER (PARTITION BY subject_id ORDER BY created_at
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_start
      FROM (SELECT *, CASE WHEN lag(created_at) OVER w IS NULL
                            OR epoch_us(created_at) - epoch_us(lag(created_at) OVER w) > 1800000000
                           THEN created_at END AS _start
            FROM kb_queries WINDOW w AS (PARTITION BY subject_id ORDER BY created_at)) x) y"""


@register("run_summary", with_ctes("""
SELECT date_trunc('day', created_at) AS run_day, count(*) AS total_queries,
  count(*) FILTER (WHERE success) AS successful,
  count(*) - count(*) FILTER (WHERE success) AS failed,
  round(coalesce(sum(response_time_ms) FILTER (WHERE success), 0) / greatest(count(*) FILTER (WHERE success), 1), 6)
    AS avg_time_ms,
  CAST(coalesce(sum(citation_count) FILTER (WHERE success), 0) AS BIGINT) AS total_citations
FROM kb_queries GROUP BY 1""", "kb_queries"))
def q_run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return querylog.run_summary(t.kb_queries, [day_start("created_at").alias("run_day")])


@register("session_rollup", with_ctes(f"""
SELECT session_id, min(subject_id) AS user_identifier, min(created_at) AS start_time,
  max(created_at) AS last_activity, count(*) AS query_count, sum(response_time_ms) AS total_response_time_ms
FROM ({_SESSIONIZED_SQL}) s GROUP BY session_id""", "kb_queries"))
def q_session_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return querylog.session_rollup(t.kb_queries)


@register("session_summary", with_ctes("""
SELECT a.session_id, questions, total_ms,
  CAST(CASE WHEN questions > 0 THEN trunc(total_ms / questions) ELSE 0 END AS BIGINT) AS avg_ms,
  CAST(trunc((epoch_us(l) - epoch_us(f)) / 1000000) AS BIGINT) AS duration_s, recent_questions
FROM a LEFT JOIN lines ON a.session_id = lines.session_id""", "kb_queries", extra=(
    ("s", _SESSIONIZED_SQL),
    ("t", "SELECT *, CASE WHEN success THEN 200 ELSE 500 END AS status_code FROM s"),
    ("a", """SELECT session_id, count(*) AS questions, CAST(coalesce(sum(response_time_ms), 0) AS BIGINT) AS total_ms,
        min(created_at) AS f, max(created_at) AS l FROM t GROUP BY session_id"""),
    ("r", """SELECT session_id, created_at, query_text, response_time_ms, status_code,
        row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, query_text ASC) AS rn FROM t"""),
    ("lines", """SELECT session_id,
        string_agg('[' || CAST(n AS VARCHAR) || '] ' || line, chr(10) ORDER BY n) AS recent_questions
      FROM (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY rn DESC) AS n,
              strftime(created_at, '%Y-%m-%d %H:%M:%S') || ' | ' || coalesce(substring(query_text, 1, 120), 'None')
              || ' ... | ' || coalesce(CAST(response_time_ms AS VARCHAR), 'None') || ' ms | HTTP '
              || CAST(status_code AS VARCHAR) AS line
            FROM r WHERE rn <= 10) z GROUP BY session_id"""))))
def q_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    turns = querylog.sessionize(t.kb_queries).withColumn(
        "status_code", F.when(F.col("success"), 200).otherwise(500))
    return querylog.session_summary(turns)
