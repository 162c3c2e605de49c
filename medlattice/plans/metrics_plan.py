"""Bindings and oracles for the corpus-defined quality metrics.

The in-hospital outcome flag is derived from admission columns (a discharged
admission whose id is a multiple of 37 ended in death), so the shared
admissions binding stays as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import metrics as M
from .bindings import ClinicalTables, with_ctes
from .catalog import register


def _with_outcome(t: ClinicalTables) -> DataFrame:
    a = t.admissions
    return a.withColumn("hospital_expire_flag", F.when(
        (F.col("admission_location") == "F") & (F.col("hadm_id") % 37 == 0), 1).otherwise(0))


_OUTCOME_SQL = ("outcomes", """SELECT *, CASE WHEN admission_location = 'F' AND hadm_id % 37 = 0 THEN 1 ELSE 0 END
    AS hospital_expire_flag FROM admissions""")

_READMIT_SQL = """
SELECT subject_id, hadm_id, admission_type, admittime, dischtime, next_hadm_id, next_admittime,
       round(epoch(next_admittime - dischtime) / 86400, 6) AS days_to_next,
       coalesce(epoch(next_admittime - dischtime) / 86400 BETWEEN 0 AND 30, false) AS readmitted_30d
FROM (SELECT *, lead(hadm_id) OVER w AS next_hadm_id, lead(admittime) OVER w AS next_admittime
      FROM admissions
      WINDOW w AS (PARTITION BY subject_id ORDER BY admittime ASC NULLS LAST, hadm_id ASC NULLS LAST)) x"""


@register("readmission_30d", with_ctes(_READMIT_SQL, "admissions"))
def q_readmission_30d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.readmission_30d(ClinicalTables(spark, sf_dir).admissions)


@register("readmission_rate", with_ctes(f"""
SELECT admission_type, count(*) AS index_admissions, count_if(readmitted_30d) AS readmissions,
       round(count_if(readmitted_30d) / count(*), 6) AS readmission_rate
FROM ({_READMIT_SQL}) r WHERE dischtime IS NOT NULL GROUP BY admission_type""", "admissions"))
def q_readmission_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.readmission_rate(M.readmission_30d(ClinicalTables(spark, sf_dir).admissions))


@register("inhospital_mortality", with_ctes("""
SELECT admission_type, count(*) AS admissions, CAST(sum(hospital_expire_flag) AS BIGINT) AS deaths,
       round(sum(hospital_expire_flag) / count(*), 6) AS mortality_rate
FROM outcomes GROUP BY admission_type""", "admissions", extra=(_OUTCOME_SQL,)))
def q_inhospital_mortality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.inhospital_mortality(_with_outcome(ClinicalTables(spark, sf_dir)))


@register("los_statistics", with_ctes("""
SELECT admission_type, count(*) AS discharged, round(avg(los), 6) AS mean_los_days,
       round(quantile_cont(los, 0.5), 6) AS median_los_days
FROM (SELECT admission_type, epoch(dischtime - admittime) / 86400 AS los FROM admissions
      WHERE dischtime IS NOT NULL) a
GROUP BY admission_type""", "admissions"))
def q_los_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.los_statistics(ClinicalTables(spark, sf_dir).admissions)


@register("los_percentile_rank", with_ctes("""
SELECT subject_id, mean_los_days, round(percent_rank() OVER (ORDER BY mean_los_days), 6) AS percentile_rank
FROM (SELECT subject_id, round(avg(epoch(dischtime - admittime) / 86400), 6) AS mean_los_days
      FROM admissions WHERE dischtime IS NOT NULL GROUP BY subject_id) s""", "admissions"))
def q_los_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.los_percentile_rank(ClinicalTables(spark, sf_dir).admissions)


@register("event_rate_per_1000_days", with_ctes("""
SELECT a.admission_type, round(sum(a.los), 6) AS patient_days, CAST(sum(coalesce(e.n, 0)) AS BIGINT) AS events,
       CASE WHEN sum(a.los) > 0 THEN round(sum(coalesce(e.n, 0)) * 1000 / sum(a.los), 6) END AS rate_per_1000_days
FROM (SELECT hadm_id, admission_type, epoch(dischtime - admittime) / 86400 AS los FROM admissions
      WHERE dischtime IS NOT NULL) a
LEFT JOIN (SELECT hadm_id, count(*) AS n FROM labevents WHERE lower(flag) = 'abnormal' GROUP BY hadm_id) e
  ON a.hadm_id = e.hadm_id
GROUP BY a.admission_type""", "admissions", "labevents"))
def q_event_rate_per_1000_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return M.event_rate_per_1000_days(t.admissions, t.labevents)


# --- ICD-10 chapters: version-10 diagnosis codes get an ICD-10 shape (a letter
#     from A-Z without U, then two digits) derived from the numeric code -------------

_ICD_LETTERS = "ABCDEFGHIJKLMNOPQRSTVWXYZ"


def _icd10_diagnoses(t: ClinicalTables) -> DataFrame:
    k = F.col("icd_code").cast("bigint")
    letter = F.element_at(F.array(*[F.lit(c) for c in _ICD_LETTERS]), (k % 25 + 1).cast("int"))
    code = F.concat(letter, F.lpad(((k / 25).cast("bigint") % 100).cast("string"), 2, "0"))
    return t.diagnoses_icd.withColumn("icd_code", code)


def _chapter_sql(code: str) -> str:
    c = f"upper(substr({code}, 1, 3))"
    whens = " ".join(f"WHEN {c} >= '{lo}' AND {c} <= '{hi}' THEN '{name}'" for lo, hi, name in M.ICD10_CHAPTERS)
    return f"CASE WHEN {c} IS NULL THEN NULL {whens} ELSE 'Unlisted' END"


_ICD10_SQL = ("icd10", f"""SELECT subject_id, hadm_id, icd_version,
    substr('{_ICD_LETTERS}', CAST(CAST(icd_code AS BIGINT) % 25 + 1 AS INTEGER), 1)
    || lpad(CAST(CAST(CAST(icd_code AS BIGINT) // 25 AS BIGINT) % 100 AS VARCHAR), 2, '0') AS icd_code
    FROM diagnoses_icd""")


@register("icd_chapter_counts", with_ctes(f"""
SELECT {_chapter_sql('icd_code')} AS chapter, count(*) AS diagnoses, count(DISTINCT subject_id) AS patients,
       count(DISTINCT hadm_id) AS admissions
FROM icd10 WHERE icd_version = 10 GROUP BY 1""", "diagnoses_icd", extra=(_ICD10_SQL,)))
def q_icd_chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.icd_chapter_counts(_icd10_diagnoses(ClinicalTables(spark, sf_dir)))


# --- lab analytes: each lab item is bound to one of the corpus's analytes ----------

_ANALYTES = [a for a, *_ in M.GENERIC_LAB_RANGES]


def _analytes(t: ClinicalTables) -> DataFrame:
    names = F.array(*[F.lit(a) for a in _ANALYTES])
    return t.d_labitems.select(
        "itemid", F.element_at(names, (F.col("itemid") % len(_ANALYTES) + 1).cast("int")).alias("analyte"))


_ANALYTES_SQL = ("analytes", "SELECT itemid, list_extract([" + ", ".join(f"'{a}'" for a in _ANALYTES)
                 + f"], CAST(itemid % {len(_ANALYTES)} + 1 AS INTEGER)) AS analyte FROM d_labitems")
_RANGES_SQL = ("ranges", "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{g}', {lo}, {hi})" for a, ml, mh, fl, fh in M.GENERIC_LAB_RANGES
    for g, lo, hi in (("M", ml, mh), ("F", fl, fh))) + ") v(analyte, gender, generic_low, generic_high)")


@register("lab_range_flags", with_ctes("""
SELECT subject_id, hadm_id, itemid, charttime, valuenum, analyte, range_low, range_high, range_source,
       CASE WHEN valuenum IS NULL OR range_source IS NULL THEN NULL
            WHEN range_low IS NOT NULL AND valuenum < range_low THEN 'low'
            WHEN range_high IS NOT NULL AND valuenum > range_high THEN 'high'
            ELSE 'normal' END AS range_flag
FROM (SELECT l.subject_id, l.hadm_id, l.itemid, l.charttime, l.valuenum, a.analyte,
        CASE WHEN l.ref_range_lower IS NOT NULL OR l.ref_range_upper IS NOT NULL THEN l.ref_range_lower
             ELSE r.generic_low END AS range_low,
        CASE WHEN l.ref_range_lower IS NOT NULL OR l.ref_range_upper IS NOT NULL THEN l.ref_range_upper
             ELSE r.generic_high END AS range_high,
        CASE WHEN l.ref_range_lower IS NOT NULL OR l.ref_range_upper IS NOT NULL THEN 'dataset'
             WHEN r.generic_low IS NOT NULL THEN 'generic' END AS range_source
      FROM labevents l
      LEFT JOIN analytes a ON l.itemid = a.itemid
      LEFT JOIN patients p ON l.subject_id = p.subject_id
      LEFT JOIN ranges r ON r.analyte = a.analyte AND r.gender = p.gender) x""",
    "labevents", "d_labitems", "patients", extra=(_ANALYTES_SQL, _RANGES_SQL)))
def q_lab_range_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return M.lab_range_flags(t.labevents, _analytes(t), t.patients)


@register("anion_gap", with_ctes("""
SELECT hadm_id, subject_id, sodium, chloride, bicarbonate, round(sodium - (chloride + bicarbonate), 6) AS anion_gap
FROM (SELECT hadm_id, subject_id,
        max(CASE WHEN analyte = 'Sodium' THEN valuenum END) AS sodium,
        max(CASE WHEN analyte = 'Chloride' THEN valuenum END) AS chloride,
        max(CASE WHEN analyte = 'Bicarbonate' THEN valuenum END) AS bicarbonate
      FROM (SELECT l.hadm_id, l.subject_id, a.analyte, l.valuenum,
              row_number() OVER (PARTITION BY l.hadm_id, l.subject_id, a.analyte
                                 ORDER BY l.charttime DESC, l.valuenum DESC) AS rn
            FROM labevents l JOIN analytes a ON l.itemid = a.itemid
            WHERE a.analyte IN ('Sodium', 'Chloride', 'Bicarbonate')
              AND l.valuenum IS NOT NULL AND l.charttime IS NOT NULL) s
      WHERE rn = 1 GROUP BY hadm_id, subject_id) g""",
    "labevents", "d_labitems", extra=(_ANALYTES_SQL,)))
def q_anion_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    return M.anion_gap(t.labevents, _analytes(t))


# --- blood pressure: chart items with an even id are bound as systolic, odd ids as
#     diastolic; the charted quantity is scaled into mmHg ------------------------------

def _bp_readings(t: ClinicalTables) -> DataFrame:
    ce = t.chartevents
    even = F.col("itemid") % 2 == 0
    m = F.when(even, "systolic").otherwise("diastolic")
    v = F.when(even, F.col("valuenum") * 3 + 80).otherwise(F.col("valuenum") * 2 + 40)
    return ce.select("stay_id", "subject_id", "charttime", m.alias("measure"), v.alias("value"))


@register("bp_classification", with_ctes("""
SELECT stay_id, subject_id, charttime, systolic, diastolic,
       CASE WHEN systolic >= 180 OR diastolic >= 120 THEN 'Hypertensive crisis'
            WHEN systolic >= 140 OR diastolic >= 90 THEN 'Stage 2 hypertension'
            WHEN systolic >= 130 OR diastolic >= 80 THEN 'Stage 1 hypertension'
            WHEN systolic >= 120 THEN 'Elevated' ELSE 'Normal' END AS bp_class
FROM (SELECT stay_id, subject_id, charttime,
        max(CASE WHEN itemid % 2 = 0 THEN valuenum * 3 + 80 END) AS systolic,
        max(CASE WHEN itemid % 2 = 1 THEN valuenum * 2 + 40 END) AS diastolic
      FROM chartevents GROUP BY stay_id, subject_id, charttime) g
WHERE systolic IS NOT NULL AND diastolic IS NOT NULL""", "chartevents"))
def q_bp_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ClinicalTables(spark, sf_dir)
    t.events_base = t.events_dealt()
    return M.bp_classification(_bp_readings(t))


# --- NPS per day: a 'purchase' event is a completed visit whose survey score is
#     floor(value) mod 11 -------------------------------------------------------------

def _survey(t: ClinicalTables) -> DataFrame:
    e = t.raw("events").filter(F.col("event_type") == "purchase")
    return e.select("ts", (F.floor(F.col("value")).cast("bigint") % 11).cast("int").alias("score"))


@register("net_promoter_score", with_ctes("""
SELECT period, count(*) AS respondents, count_if(score >= 9) AS promoters,
       count_if(score BETWEEN 7 AND 8) AS passives, count_if(score <= 6) AS detractors,
       round((count_if(score >= 9) - count_if(score <= 6)) * 100.0 / count(*), 6) AS nps
FROM (SELECT date_trunc('day', ts) AS period, CAST(CAST(floor(value) AS BIGINT) % 11 AS INTEGER) AS score
      FROM events WHERE event_type = 'purchase') s
WHERE score BETWEEN 0 AND 10 GROUP BY period"""))
def q_net_promoter_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.net_promoter_score(_survey(ClinicalTables(spark, sf_dir)), S.day_start("ts"))
